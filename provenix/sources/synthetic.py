"""Small image files built in memory, for queries and tests."""

from __future__ import annotations

import struct
import zlib
from xml.sax.saxutils import quoteattr

from provenix.sources.tiff import EXIF_POINTER, GPS_POINTER, TYPES
from provenix.sources.xmp import BASIC, CAMERA, DC, PHOTOSHOP, RDF


def tiff(first: list[tuple], exif: list[tuple] = (), gps: list[tuple] = (), order: str = "<") -> bytes:
    """A TIFF structure of (tag, type, value) entries; rationals are lists of pairs."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8))

    def directory(entries: list[tuple]) -> None:
        start = len(out)
        out.extend(bytes(2 + 12 * len(entries) + 4))
        struct.pack_into(order + "H", out, start, len(entries))
        for i, (tag, kind, value) in enumerate(entries):
            if kind == 2:
                n, raw = len(value.encode()) + 1, value.encode() + b"\0"
            else:
                flat = [y for x in (value if isinstance(value, list) else [value]) for y in (x if isinstance(x, tuple) else (x,))]
                code = TYPES[kind][1]
                n = len(flat) // len(code)
                raw = struct.pack(order + code * n, *flat)
            at = start + 2 + 12 * i
            struct.pack_into(order + "HHI", out, at, tag, kind, n)
            if len(raw) > 4:
                struct.pack_into(order + "I", out, at + 8, len(out))
                out.extend(raw)
            else:
                out[at + 8 : at + 8 + len(raw)] = raw

    pointers = [(p, 4, 0) for p, e in ((EXIF_POINTER, exif), (GPS_POINTER, gps)) if e]
    directory([*first, *pointers])
    for i, entries in enumerate(e for e in (exif, gps) if e):
        struct.pack_into(order + "I", out, 8 + 2 + 12 * (len(first) + i) + 8, len(out))
        directory(list(entries))
    return bytes(out)


def with_thumbnail(structure: bytes, blob: bytes) -> bytes:
    """A TIFF structure (little-endian, one directory at 8) with a second directory that holds a JPEG thumbnail."""
    out = bytearray(structure)
    at = len(out)
    struct.pack_into("<I", out, 10 + 12 * struct.unpack_from("<H", out, 8)[0], at)
    out += struct.pack("<H", 2) + struct.pack("<HHII", 0x201, 4, 1, at + 30) + struct.pack("<HHII", 0x202, 4, 1, len(blob)) + bytes(4) + blob
    return bytes(out)


def segment(marker: int, payload: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(payload) + 2) + payload


def jpeg(payload: bytes | None, width: int = 64, height: int = 48, segments: list[tuple[int, bytes]] = ()) -> bytes:
    exif = segment(0xE1, b"Exif\0\0" + payload) if payload is not None else b""
    return b"\xff\xd8" + exif + b"".join(segment(m, p) for m, p in segments) + segment(0xC0, struct.pack(">BHHB", 8, height, width, 0) + bytes(9)) + b"\xff\xd9"


def png(chunks: list[tuple[bytes, bytes]], width: int = 8, height: int = 6) -> bytes:
    each = [(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)), *chunks, (b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(p)) + k + p + bytes(4) for k, p in each)


def webp(packet: bytes, width: int = 64, height: int = 48) -> bytes:
    """An extended WebP with an XMP chunk."""
    side = lambda n: (n - 1).to_bytes(3, "little")
    body = b"VP8X" + struct.pack("<I", 10) + bytes(4) + side(width) + side(height) + b"XMP " + struct.pack("<I", len(packet)) + packet + bytes(len(packet) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def itxt(text: bytes, packed: bool = False) -> bytes:
    return b"XML:com.adobe.xmp\0" + bytes([packed, 0]) + b"\0\0" + (zlib.compress(text) if packed else text)


def xmp(attributes: dict[str, str], elements: str = "") -> bytes:
    """A packet with one description; the usual prefixes are declared."""
    spaces = {"rdf": RDF, "dc": DC, "xmp": BASIC, "photoshop": PHOTOSHOP, **dict(zip(("tiff", "exif", "aux"), CAMERA, strict=True))}
    return f"""<x:xmpmeta xmlns:x="adobe:ns:meta/" {" ".join(f'xmlns:{k}="{v}"' for k, v in spaces.items())}><rdf:RDF><rdf:Description rdf:about="" {" ".join(f"{k}={quoteattr(v)}" for k, v in attributes.items())}>{elements}</rdf:Description></rdf:RDF></x:xmpmeta>""".encode()


def iptc(values: list[tuple[int, bytes]]) -> bytes:
    """The payload of a JPEG segment with datasets of record 2."""
    record = b"".join(struct.pack(">BBBH", 0x1C, 2, d, len(v)) + v for d, v in values)
    return b"Photoshop 3.0\0" + b"8BIM" + struct.pack(">H", 0x0404) + b"\0\0" + struct.pack(">I", len(record)) + record + bytes(len(record) % 2)


def icc(year: int = 2026, size: int = 0) -> bytes:
    """A display profile with one tag, filled up to a size."""
    out = bytearray(max(size, 156))
    struct.pack_into(">I4sBB", out, 0, len(out), b"test", 2, 0x10)
    struct.pack_into(">4s4s4s6H4s", out, 12, b"mntr", b"RGB ", b"XYZ ", year, 9, 14, 18, 42, 7, b"acsp")
    struct.pack_into(">I4sII", out, 128, 1, b"desc", 144, 12)
    return bytes(out)


def icc_segments(profile: bytes, chunk: int) -> list[tuple[int, bytes]]:
    """Segments of a profile's chunks, last one first."""
    parts = [profile[i : i + chunk] for i in range(0, len(profile), chunk)]
    return [(0xE2, b"ICC_PROFILE\0" + bytes([i + 1, len(parts)]) + p) for i, p in enumerate(parts)][::-1]
