"""TIFF directories, as EXIF uses them: tags to values, bounded, with warnings instead of errors."""

from __future__ import annotations

import struct

from provenix.sources.containers import jpeg_segments

#: Byte size and struct code of the field types that are read.
TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 7: (1, "B"), 9: (4, "i"), 10: (8, "ii")}
#: Pointers to the EXIF and GPS directories.
EXIF_POINTER, GPS_POINTER = 0x8769, 0x8825
MAX_TAGS, MAX_VALUE = 512, 1 << 20


def exif_payload(fmt: str, data: bytes) -> bytes | None:
    """The TIFF structure of a file: all of a TIFF, or the first EXIF segment of a JPEG."""
    if fmt == "TIFF":
        return data
    if fmt == "JPEG":
        return next((p[6:] for m, p in jpeg_segments(data) if m == 0xE1 and p[:6] == b"Exif\0\0"), None)
    return None


class Directories:
    """First directory, EXIF directory (the first one's tags win) and GPS directory of a TIFF structure."""

    def __init__(self, data: bytes, max_tags: int = MAX_TAGS, max_value: int = MAX_VALUE):
        self.data, self.warnings, self.max_tags, self.max_value = data, [], max_tags, max_value
        self.order = {b"II": "<", b"MM": ">"}.get(data[:2], "")
        self.tags: dict[int, object] = {}
        self.gps: dict[int, object] = {}
        if not self.order or len(data) < 8 or struct.unpack(self.order + "H", data[2:4])[0] != 42:
            self.warnings.append("not a TIFF structure")
            self.order = ""
            return
        self.tags = self.read(struct.unpack(self.order + "I", data[4:8])[0], "IFD0")
        for pointer, name in ((EXIF_POINTER, "EXIF"), (GPS_POINTER, "GPS")):
            if isinstance(at := self.tags.get(pointer), int):
                found = self.read(at, name)
                if name == "GPS":
                    self.gps = found
                else:
                    self.tags = found | self.tags

    def blob(self, tag: int) -> bytes | None:
        """A tag of bytes."""
        value = self.tags.get(tag)
        if isinstance(value, list) and all(isinstance(x, int) and 0 <= x < 256 for x in value):
            return bytes(value)
        return value if isinstance(value, bytes) else None

    def second(self) -> dict[int, object] | None:
        """Tags of the directory after the first; None without one."""
        if not self.order:
            return None
        first = struct.unpack(self.order + "I", self.data[4:8])[0]
        if first + 2 > len(self.data):
            return None
        link = first + 2 + 12 * min(struct.unpack(self.order + "H", self.data[first : first + 2])[0], self.max_tags)
        at = struct.unpack(self.order + "I", self.data[link : link + 4])[0] if link + 4 <= len(self.data) else 0
        return self.read(at, "IFD1") if at else None

    def read(self, at: int, name: str) -> dict[int, object]:
        """Tags of the directory at an offset; of a repeated tag the first counts."""
        if at + 2 > len(self.data):
            self.warnings.append(f"{name} lies outside the data")
            return {}
        out: dict[int, object] = {}
        count = struct.unpack(self.order + "H", self.data[at : at + 2])[0]
        if count > self.max_tags:
            self.warnings.append(f"{name} has {count} tags; the first {self.max_tags} are read")
        for i in range(min(count, self.max_tags)):
            entry = self.data[at + 2 + 12 * i : at + 14 + 12 * i]
            if len(entry) < 12:
                self.warnings.append(f"{name} is cut")
                break
            tag, kind, n = struct.unpack(self.order + "HHI", entry[:8])
            value = self.value(name, tag, kind, n, entry[8:])
            if value is not None:
                out.setdefault(tag, value)
        return out

    def value(self, name: str, tag: int, kind: int, n: int, field: bytes) -> object:
        if kind not in TYPES:
            self.warnings.append(f"{name} tag {tag:#06x}: type {kind} is not read")
            return None
        size, code = TYPES[kind][0] * n, TYPES[kind][1]
        if size > self.max_value or n > self.max_tags * 64:
            self.warnings.append(f"{name} tag {tag:#06x}: value too large")
            return None
        if size > 4:
            start = struct.unpack(self.order + "I", field)[0]
            field = self.data[start : start + size]
            if len(field) < size:
                self.warnings.append(f"{name} tag {tag:#06x}: value lies outside the data")
                return None
        raw = field[:size]
        if kind == 2:
            return raw.split(b"\0")[0].decode("utf-8", "replace")
        if kind == 7:
            return raw
        numbers = struct.unpack(self.order + code * n, raw)
        values = list(zip(numbers[::2], numbers[1::2], strict=True)) if len(code) == 2 else list(numbers)
        return values[0] if n == 1 else values
