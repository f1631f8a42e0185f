"""Timestamp claims: observed strings kept next to a normalized instant or wall time.

A claim is a struct (label, source, raw, value_utc, wall, precision, timezone_status, parseable). Dates
are range-checked only, so an impossible one like 31 February stays a naive wall time; where an offset
asks for an instant that doesn't exist, value_utc is null though the status is explicit, and
``impossible`` says so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from provenix.functions.text import given, inline, quoted, strip

#: The formats that sources write, with the ranges that their fields may have.
YEAR, MONTH, DAY = r"(?!0000)\d{4}", r"(0[1-9]|1[0-2])", r"(0[1-9]|[12]\d|3[01])"
HOUR, MINUTE, SECOND = r"([01]\d|2[0-3])", r"[0-5]\d", r"([0-5]\d|6[01])"
EXIF = rf"^{YEAR}:{MONTH}:{DAY} {HOUR}:{MINUTE}:{SECOND}$"
XMP = rf"^{YEAR}-{MONTH}-{DAY}([T ]{HOUR}:{MINUTE}(:{SECOND}(\.\d{{1,9}})?)?(Z|[+-]\d{{2}}:?\d{{2}})?)?$"
IPTC_DATE = rf"^{YEAR}{MONTH}{DAY}$"
IPTC_TIME = rf"^{HOUR}{MINUTE}\d{{2}}([+-]\d{{4}})?$"
OFFSET = rf"^[+-]{HOUR}:?{MINUTE}$"
ZONE = r"(Z|[+-]\d{2}:?\d{2})$"
GPS_DATE = rf"^\d{{4}}:{MONTH}:{DAY}$"
CAPTURE_SOURCES = ("EXIF DateTimeOriginal", "XMP xmp:CreateDate", "IPTC DateCreated/TimeCreated")


def _number(c: Column, at: int, n: int = 2) -> Column:
    return F.substring(c, at, n).try_cast("int")


def parse_offset(c: Column) -> Column:
    """Minutes east of UTC of ``Z`` or ``+HH:MM``; null for anything else."""
    c = strip(c)
    size = _number(c, 2) * 60 + F.right(c, F.lit(2)).try_cast("int")
    return F.when(c == "Z", F.lit(0)).when(c.rlike(OFFSET), F.when(F.startswith(c, F.lit("-")), -size).otherwise(size))


def instant(wall: Column) -> Column:
    """Seconds of an ISO wall time, or of the midnight of an ISO day; null where it doesn't exist (also for seconds from 60 on)."""
    second = F.substring(wall, 18, 2)
    time = [F.coalesce(_number(wall, at), F.lit(0)) for at in (12, 15, 18)]
    return F.when(second < "60", F.unix_seconds(F.try_make_timestamp(_number(wall, 1, 4), _number(wall, 6), _number(wall, 9), *time[:2], time[2].cast("decimal(16,6)"))))


def iso_utc(wall: Column, offset: Column) -> Column:
    """The instant of a wall time as text; null where it doesn't exist."""
    return F.date_format(F.timestamp_seconds(instant(wall) - offset * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def claim(label: str, source: str, raw: Column, utc: Column | None = None, wall: Column | None = None, precision: Column | str = "unknown", status: Column | str = "naive", parseable: bool | Column = True) -> Column:
    null = F.lit(None).cast("string")
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(label).alias("label"), F.lit(source).alias("source"), raw.alias("raw"), (null if utc is None else utc).alias("value_utc"), (null if wall is None else wall).alias("wall"),
        as_column(precision).alias("precision"), as_column(status).alias("timezone_status"), as_column(parseable).alias("parseable"),
    )


def _joined(text: Column, *parts: tuple[int, int] | str) -> Column:
    """Pieces of a text (place from 1, length) and constants, put together."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.substring(text, *p) for p in parts))


def exif_wall(text: Column) -> Column:
    return _joined(text, (1, 4), "-", (6, 2), "-", (9, 2), "T", (12, 8))


def normalize_exif(raw: Column, offset_raw: Column, label: str, source: str, keep: Callable = inline) -> Column:
    text = keep(strip(raw), 0)
    wall, offset = keep(exif_wall(text), 1), keep(parse_offset(offset_raw), 1)
    known = given(offset_raw) & offset.isNotNull()
    shown = F.when(given(offset_raw) & ~known, F.concat(text, F.lit(" (offset tag "), quoted(offset_raw), F.lit(" unparseable)"))).otherwise(text)
    read = claim(label, source, shown, F.when(known, iso_utc(wall, offset)), wall, "second", F.when(known, "explicit").otherwise("naive"))
    return F.when(given(raw), F.when(text.rlike(EXIF), read).otherwise(claim(label, source, text, parseable=False)))


def normalize_xmp(raw: Column, label: str, source: str, keep: Callable = inline) -> Column:
    text = keep(strip(raw), 0)
    by_day, with_seconds = F.length(text) == 10, F.substring(text, 17, 1) == ":"
    zone = keep(F.when(by_day, "").otherwise(F.regexp_extract(text, ZONE, 1)), 1)
    offset = keep(parse_offset(zone), 2)
    minute = _joined(text, (1, 10), "T", (12, 5))
    wall = keep(F.when(by_day, text).when(with_seconds, F.concat(minute, F.substring(text, 17, 3))).otherwise(F.concat(minute, F.lit(":00"))), 1)
    precision = F.when(by_day, "day").when(with_seconds, "second").otherwise("minute")
    good = text.rlike(XMP) & ((zone == "") | offset.isNotNull())
    read = claim(label, source, text, F.when(zone != "", iso_utc(wall, offset)), wall, precision, F.when(zone == "", "naive").otherwise("explicit"))
    return F.when(given(raw), F.when(good, read).otherwise(claim(label, source, text, parseable=False)))


def normalize_iptc(date_raw: Column, time_raw: Column, source: str, keep: Callable = inline) -> Column:
    both = F.concat_ws(" ", F.nullif(date_raw, F.lit("")), F.nullif(time_raw, F.lit("")))
    date, time = keep(strip(date_raw), 0), keep(strip(time_raw), 0)
    day = _joined(date, (1, 4), "-", (5, 2), "-", (7, 2))
    zone = keep(F.substring(time, 7, 5), 1)
    offset = keep(parse_offset(zone), 2)
    wall = keep(F.concat(day, F.lit("T"), _joined(time, (1, 2), ":", (3, 2), ":", (5, 2))), 1)
    good = F.coalesce(date.rlike(IPTC_DATE), F.lit(False)) & (~given(time_raw) | F.coalesce(time.rlike(IPTC_TIME) & ((zone == "") | offset.isNotNull()), F.lit(False)))
    by_time = claim("capture", source, both, F.when(zone != "", iso_utc(wall, offset)), wall, "second", F.when(zone == "", "naive").otherwise("explicit"))
    read = F.when(~given(time_raw), claim("capture", source, both, None, day, "day", "naive")).otherwise(by_time)
    return F.when(given(date_raw) | given(time_raw), F.when(good, read).otherwise(claim("capture", source, both, parseable=False)))


def normalize_utc(iso: Column, raw: Column, label: str, source: str) -> Column:
    """A claim that is UTC by definition (GPS, ICC, file system)."""
    return F.when(iso.isNotNull(), claim(label, source, raw, iso, F.rtrim(iso, F.lit("Z")), "second", "utc"))


def normalize_gps(date_raw: Column, hour: Column, minute: Column, second: Column) -> Column:
    return normalize_utc(gps_datetime(date_raw, hour, minute, second), F.concat_ws(" ", date_raw, F.format_string("%02d:%02d:%02d", *(x.cast("int") for x in (hour, minute, second)))), "gps", "GPS GPSDateStamp/GPSTimeStamp")


def normalize_icc(created: Column) -> Column:
    """A profile's time of creation, which is UTC."""
    return normalize_utc(F.concat(created, F.lit("Z")), created, "icc-created", "ICC profile creation")


def normalize_mtime(seconds: Column) -> Column:
    """A file's time of modification in seconds (a double); what was observed is that number."""
    iso = F.date_format(F.timestamp_seconds(F.floor(seconds)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return normalize_utc(iso, decimal(seconds), "filesystem", "filesystem mtime (not image metadata)")


def decimal(seconds: Column) -> Column:
    """A number of seconds in the fewest digits that give the same double, with one decimal at least."""
    return F.regexp_replace(seconds.cast("decimal(27,9)").cast("string"), r"(\.\d+?)0+$", "$1")


def exif_datetime(raw: Column) -> Column:
    """``YYYY:MM:DD HH:MM:SS`` as ISO text, range-checked; else null."""
    text = strip(raw)
    return F.when(text.rlike(EXIF), exif_wall(text))


def gps_datetime(date_raw: Column, hour: Column, minute: Column, second: Column) -> Column:
    """A GPS date and its three time values (doubles) as UTC text; partial or out of range gives null. Seconds are cut."""
    date = strip(date_raw)
    good = date.rlike(GPS_DATE) & hour.between(0, 23) & minute.between(0, 59) & second.between(0, 61)
    clock = F.format_string("T%02d:%02d:%02dZ", *(x.cast("int") for x in (hour, minute, second)))
    return F.when(good, F.concat(_joined(date, (1, 4), "-", (6, 2), "-", (9, 2)), clock))


def impossible(*claims: Column) -> Column:
    """An offset of one of the claims asks for an instant that doesn't exist: the file counts as failed."""
    out = F.lit(False)
    for t in claims:
        out = out | F.coalesce((t["timezone_status"] == "explicit") & t["parseable"] & t["value_utc"].isNull(), F.lit(False))
    return out


def rank_and_key(t: Column) -> tuple[Column, Column]:
    """Order of claims: instants first, then wall times, then what was observed."""
    rank = F.when(t["value_utc"].isNotNull(), 0).when(t["wall"].isNotNull(), 1).otherwise(2)
    return rank, F.coalesce(t["value_utc"], t["wall"], t["raw"], F.lit(""))


def sorted_claims(claims: Column) -> Column:
    """A file's claims in order of time; equal ones stay in the order of their sources."""
    keyed = F.transform(claims, lambda t, i: F.struct(rank_and_key(t)[0].alias("rank"), rank_and_key(t)[1].alias("key"), i.alias("i"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda x: x["t"])


UNKNOWN_DATE = "unknown date"


def capture_day(*claims: Column) -> tuple[Column, Column]:
    """(key, display) of the first parseable capture claim's day."""
    usable = [F.coalesce(t["parseable"], F.lit(False)) & F.coalesce(t["value_utc"], t["wall"]).isNotNull() for t in claims]
    day = F.coalesce(*(F.when(u, F.substring(F.coalesce(t["value_utc"], t["wall"]), 1, 10)) for u, t in zip(usable, claims, strict=True)))
    shown = F.coalesce(*(F.when(u, F.when(t["value_utc"].isNotNull(), F.substring(t["value_utc"], 1, 10)).otherwise(F.concat(F.substring(t["wall"], 1, 10), F.lit(" (timezone unknown)")))) for u, t in zip(usable, claims, strict=True)))
    return F.coalesce(day, F.lit("unknown")), F.coalesce(shown, F.lit(UNKNOWN_DATE))


def fmt_duration(seconds: Column) -> Column:
    s = F.bround(seconds, 0).cast("long")
    minutes = F.floor(s / 60)
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)
    text = lambda big, unit, small, sub: F.concat(big.cast("string"), F.lit(unit), F.when(small != 0, F.concat(small.cast("string"), F.lit(sub))).otherwise(""))
    return F.when(s < 120, F.concat(s.cast("string"), F.lit("s"))).when(minutes < 120, F.concat(minutes.cast("string"), F.lit("m"))).when(hours < 48, text(hours, "h", minutes % 60, "m")).otherwise(text(days, "d", hours % 24, "h"))


def fmt_offset(hours: Column) -> Column:
    size = F.abs(hours)
    whole = F.floor(size).cast("int")
    return F.when(hours.isNotNull(), F.concat(F.lit("UTC"), F.when(hours >= 0, "+").otherwise("-"), F.format_string("%02d:%02d", whole, F.bround((size - whole) * 60, 0).cast("int"))))
