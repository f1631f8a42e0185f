"""Embedded thumbnails: the second TIFF directory's JPEG or strips, and signs of the encoder."""

from __future__ import annotations

import hashlib
import re
from pathlib import PurePosixPath

from provenix.sources.containers import jpeg_segments
from provenix.sources.tiff import Directories, exif_payload

#: Largest thumbnail, most strips and largest side that is believed.
MOST, MOST_STRIPS, SIDE = 16 << 20, 4096, 65_500
#: Frame headers of a JPEG, and tags of the second directory.
FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
WIDTH, HEIGHT, COMPRESSION, STRIPS, JPEG_START, STRIP_SIZES, JPEG_SIZE = 0x100, 0x101, 0x103, 0x111, 0x201, 0x117, 0x202


def encoder_signals(data: bytes) -> tuple[int, bool]:
    """Number of quantization tables (64 values of one byte, or of two if the high half of their first byte isn't zero), and whether Huffman tables are there."""
    tables, huffman = 0, False
    for marker, payload in jpeg_segments(data) if data[:2] == b"\xff\xd8" else ():
        huffman |= marker == 0xC4
        at = 0
        while marker == 0xDB and at + 65 <= len(payload):
            at += 129 if payload[at] >> 4 else 65
            tables += at <= len(payload)
    return tables, huffman


def frame_size(data: bytes) -> tuple[int | None, int | None]:
    """Width and height from a JPEG's first frame header."""
    frame = next((p for m, p in jpeg_segments(data) if m in FRAMES), b"") if data[:2] == b"\xff\xd8" else b""
    size = (int.from_bytes(frame[3:5], "big"), int.from_bytes(frame[1:3], "big")) if len(frame) >= 7 else (0, 0)
    return size if all(0 < x <= SIDE for x in size) else (None, None)


def _ints(tags: dict[int, object], tag: int) -> list[int]:
    value = tags.get(tag)
    out = value if isinstance(value, list) else [value]
    return out if len(out) <= MOST_STRIPS and all(isinstance(x, int) for x in out) else []


def _parts(tags: dict[int, object], size: int) -> tuple[str, list[tuple[int, int]], str | None]:
    """Kind, places of the thumbnail's bytes, and why it can't be taken."""
    if (starts := _ints(tags, JPEG_START)) and (sizes := _ints(tags, JPEG_SIZE)):
        kind, places = "JPEG blob", [(starts[0], sizes[0])]
    elif (starts := _ints(tags, STRIPS)) and (sizes := _ints(tags, STRIP_SIZES)):
        sizes = sizes * len(starts) if len(sizes) == 1 else sizes
        kind, places = "TIFF strips", list(zip(starts, sizes, strict=False))
        if (_ints(tags, COMPRESSION) or [1])[0] != 1:
            return kind, [], "its strips are compressed"
        if len(starts) != len(sizes):
            return kind, [], "its strips and their sizes differ in number"
    else:
        return "", [], "it has no data"
    if not 0 < sum(n for _, n in places) <= MOST:
        return kind, [], "its size can't be"
    return kind, places, "it lies outside the data" if any(at < 0 or n < 0 or at + n > size for at, n in places) else None


def decode(fmt: str, data: bytes) -> dict | None:
    """Thumbnails of a JPEG or TIFF with their bytes, and the main image's signals; None for other formats."""
    if fmt not in ("JPEG", "TIFF"):
        return None
    out: dict = {"main_dqt": None, "main_dht": None, "claimed": False, "found": [], "warnings": []}
    if fmt == "JPEG":
        out["main_dqt"], out["main_dht"] = encoder_signals(data)
    payload = exif_payload(fmt, data)
    second = Directories(payload).second() if payload is not None else None
    if second is None:
        return out
    out["claimed"] = True
    kind, places, wrong = _parts(second, len(payload))
    if wrong:
        out["warnings"].append(f"thumbnail not taken: {wrong}")
        return out
    blob = b"".join(payload[at : at + n] for at, n in places)
    shape = "JPEG" if blob[:3] == b"\xff\xd8\xff" else "TIFF" if blob[:4] in (b"II*\0", b"MM\0*") else "UNKNOWN"
    claimed = [next(iter(_ints(second, t)), None) for t in (WIDTH, HEIGHT)] if kind == "TIFF strips" else [None, None]
    width, height = (c if c is not None else f for c, f in zip(claimed, frame_size(blob), strict=True))
    dqt, dht = encoder_signals(blob) if shape == "JPEG" else (None, None)
    out["found"].append({"index": 0, "source": f"{'EXIF' if fmt == 'JPEG' else 'TIFF'} IFD1 ({kind})", "byte_size": len(blob), "sha256": hashlib.sha256(blob).hexdigest(), "width": width, "height": height, "format": shape, "dqt": dqt, "dht": dht, "blob": blob})
    return out


def file_name(path: str, index: int, fmt: str) -> str:
    """``<stem>_thumb<index>`` with the ending of the thumbnail's format; other than letters, digits, ``.``, ``_`` and ``-`` become ``_``."""
    stem = re.sub(r"[^A-Za-z0-9._-]", "_", PurePosixPath(path).stem) or "image"
    return f"{stem}_thumb{index}.{ {'JPEG': 'jpg', 'TIFF': 'tif'}.get(fmt, 'bin')}"
