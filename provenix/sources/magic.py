"""Format detection and header fields as expressions over binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Magic bytes in the order they are tested.
MAGIC = (("JPEG", "FFD8FF"), ("PNG", "89504E470D0A1A0A"), ("GIF", "474946383761"), ("GIF", "474946383961"), ("BMP", "424D"), ("WEBP", "52494646"), ("TIFF", "49492A00"), ("TIFF", "4D4D002A"))
SUPPORTED = ("JPEG", "PNG", "GIF", "BMP", "WEBP", "TIFF")


def detect_format(content: Column) -> Column:
    out = None
    for name, magic in MAGIC:
        test = F.startswith(content, F.unhex(F.lit(magic)))
        if name == "WEBP":
            test = test & (F.substring(content, 9, 4) == F.lit(b"WEBP"))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("UNKNOWN")


def mime(fmt: Column) -> Column:
    return F.when(fmt == "UNKNOWN", "").otherwise(F.concat(F.lit("image/"), F.lower(fmt)))


def unsigned(content: Column, at: int, size: int, little: bool = False) -> Column:
    """Unsigned integer of ``size`` bytes at a place from 0."""
    part = F.substring(content, at + 1, size)
    return F.conv(F.hex(F.reverse(part) if little else part), 16, 10).cast("long")


def png_dimensions(content: Column) -> tuple[Column, Column]:
    """Width and height of a PNG whose first chunk is IHDR; null when zero or above a million."""
    w, h = unsigned(content, 16, 4), unsigned(content, 20, 4)
    good = (F.substring(content, 13, 4) == F.lit(b"IHDR")) & w.between(1, 1_000_000) & h.between(1, 1_000_000)
    return F.when(good, w), F.when(good, h)
