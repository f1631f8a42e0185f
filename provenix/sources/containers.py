"""Walking image containers: JPEG segments, PNG chunks and WebP chunks, bounded and without raising on damage."""

from __future__ import annotations

from collections.abc import Iterator

#: Elements of a file that are looked at; largest side of an image that is believed.
MOST, SIDE = 4096, 1_000_000
#: Most tags of a TIFF's first directory whose dimensions are believed.
TIFF_TAGS = 256
#: Markers without a payload, and the frame headers of baseline to lossless coding that give dimensions.
ALONE = {0x01, *range(0xD0, 0xD9)}
FRAMES = {0xC0, 0xC1, 0xC2, 0xC3}


def jpeg_segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, payload) up to the scan, the end, a cut or MOST segments; fill bytes are skipped."""
    at = 2
    for _ in range(MOST):
        if at + 2 > len(data) or data[at] != 0xFF:
            return
        marker = data[at + 1]
        at += 1 if marker == 0xFF else 2
        if marker == 0xFF or marker in ALONE:
            continue
        if marker in (0xDA, 0xD9) or at + 2 > len(data):
            return
        size = int.from_bytes(data[at : at + 2], "big")
        if size < 2 or at + size > len(data):
            return
        yield marker, data[at + 2 : at + size]
        at += size


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(type, payload) up to IEND; checksums are not tested."""
    at = 8
    for _ in range(MOST):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 8 > len(data) or at + 12 + size > len(data):
            return
        kind = data[at + 4 : at + 8]
        yield kind, data[at + 8 : at + 8 + size]
        if kind == b"IEND":
            return
        at += 12 + size


def webp_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(type, payload); chunks are padded to even lengths."""
    at = 12
    for _ in range(MOST):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 > len(data) or at + 8 + size > len(data):
            return
        yield data[at : at + 4], data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def _tiff_size(data: bytes) -> tuple[int, int] | None:
    """Width and height of the first directory: its last single short or long of each tag."""
    order = "little" if data[:2] == b"II" else "big"
    number = lambda a, n: int.from_bytes(data[a : a + n], order)
    at = number(4, 4)
    if len(data) < 8 or number(2, 2) != 42 or at > SIDE or at + 2 > len(data) or number(at, 2) > TIFF_TAGS:
        return None
    found = {}
    for e in range(at + 2, min(at + 2 + 12 * number(at, 2), len(data) - 11), 12):
        if number(e + 2, 2) in (3, 4) and number(e + 4, 4) == 1:
            found[number(e, 2)] = number(e + 8, 2 * number(e + 2, 2) - 4)
    return (found[256], found[257]) if 256 in found and 257 in found else None


def dimensions(fmt: str, data: bytes) -> tuple[int | None, int | None]:
    """Width and height from the header; (None, None) if it doesn't say or says what can't be."""
    size: tuple[int, int] | None = None
    little = lambda a, n: int.from_bytes(data[a : a + n], "little")
    if fmt == "PNG" and data[12:16] == b"IHDR":
        size = int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    elif fmt == "GIF" and len(data) >= 10:
        size = little(6, 2), little(8, 2)
    elif fmt == "BMP" and len(data) >= 26:
        size = int.from_bytes(data[18:22], "little", signed=True), abs(int.from_bytes(data[22:26], "little", signed=True))
    elif fmt == "JPEG":
        frame = next((p for m, p in jpeg_segments(data) if m in FRAMES and len(p) >= 5), None)
        size = (int.from_bytes(frame[3:5], "big"), int.from_bytes(frame[1:3], "big")) if frame else None
    elif fmt == "TIFF":
        size = _tiff_size(data)
    elif fmt == "WEBP":
        kind, body = next(webp_chunks(data), (b"", b""))
        if kind == b"VP8X" and len(body) >= 10:
            size = int.from_bytes(body[4:7], "little") + 1, int.from_bytes(body[7:10], "little") + 1
        elif kind == b"VP8L" and len(body) >= 5 and body[0] == 0x2F:
            bits = int.from_bytes(body[1:5], "little")
            size = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        elif kind == b"VP8 " and body[3:6] == b"\x9d\x01\x2a":
            size = int.from_bytes(body[6:8], "little") & 0x3FFF, int.from_bytes(body[8:10], "little") & 0x3FFF
    return size if size and all(0 < x <= SIDE for x in size) else (None, None)


def encoding(fmt: str, data: bytes) -> str:
    """The coding that the header states; without believable dimensions, that."""
    if dimensions(fmt, data) == (None, None):
        return f"{fmt.replace('WEBP', 'WebP')} (no dimensions)"
    if fmt == "PNG":
        return f"PNG (color type {data[25]}, bit depth {data[24]})" if len(data) >= 26 else "PNG (no dimensions)"
    if fmt == "JPEG":
        return "JPEG (progressive DCT)" if next(m for m, _ in jpeg_segments(data) if m in FRAMES) == 0xC2 else "JPEG (baseline DCT)"
    return {"GIF": f"GIF ({data[3:6].decode('ascii', 'replace')})", "BMP": "BMP (DIB)", "TIFF": "TIFF"}.get(fmt) or {b"VP8X": "WebP (VP8X, extended)", b"VP8L": "WebP (VP8L, lossless)"}.get(data[12:16], "WebP (VP8, lossy)")
