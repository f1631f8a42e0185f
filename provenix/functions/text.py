"""String expressions: trimming, collapsing, comparison keys, product names, quoting, literal search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, a trailing version, and one trailing corporate suffix.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WHITE_RANGES = "\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
VERSION_TAIL = r"[\s\-_]*v?\d+(\.\d+)*(\s+[A-Za-z]+)?\s*$"
CORPORATE = r"(?i)\s+(inc\.?|incorporated|corp\.?|corporation|co\.?,?\s*ltd\.?|ltd\.?|gmbh|s\.?a\.?|pty\.?|limited)$"


def inline(value: Column, step: int) -> Column:
    """The ``keep`` that keeps nothing. One that does gives a column that holds the value, made once; values of a step may refer to those of steps before it."""
    return value


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def given(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def collapse(c: Column) -> Column:
    """Stripped, without NULs, inner white space as one space; empty becomes null."""
    return F.nullif(F.regexp_replace(strip(F.replace(c, F.lit("\x00"), F.lit(""))), f"[{WHITE_RANGES}]+", " "), F.lit(""))


def comparison_key(c: Column) -> Column:
    """Lower-case letters and digits only; empty becomes null."""
    return F.nullif(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), F.lit(""))


def product_name(c: Column) -> Column:
    """An editor's name without its version, unless nothing else is left."""
    return F.coalesce(F.nullif(strip(F.regexp_replace(strip(c), VERSION_TAIL, "")), F.lit("")), strip(c))


def contains_literal(c: Column, needle: str) -> Column:
    return F.contains(F.lower(c), F.lit(needle.lower()))


def quoted(c: Column) -> Column:
    """The text in quotes, as a program would write it: single ones unless only those occur inside; backslashes, the quote and control characters are escaped."""
    safe = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for char, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        safe = F.replace(safe, F.lit(char), F.lit(name))
    odd = safe
    for i in (*range(9), 11, 12, *range(14, 32), 127):
        odd = F.replace(odd, F.lit(chr(i)), F.lit(f"\\x{i:02x}"))
    safe = F.when(c.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), odd).otherwise(safe)
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), safe, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(safe, F.lit("'"), F.lit("\\'")), F.lit("'")))


def decode_lenient(binary: Column) -> Column:
    """UTF-8 where it is valid, else Latin-1."""
    return F.when(F.is_valid_utf8(binary.cast("string")), binary.cast("string")).otherwise(F.decode(binary, "ISO-8859-1"))
