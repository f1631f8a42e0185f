"""Consistency rules: each gives an array of flags of a row.

The rows have the columns of ``plans.evidence.analyzed``: the claims of capture time (t_x of EXIF, t_m of
XMP, t_i of IPTC) and of the device (c_x, c_m), and the statuses of the compared facts.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provenix.functions import geo
from provenix.functions.compare import differs, is_claim
from provenix.functions.text import product_name, quoted, strip
from provenix.functions.time import fmt_duration, fmt_offset, given, instant

TOLERANCE_S = 60.0
ASPECT_TOLERANCE = 0.05
STAMPS = ("t_x", "t_m", "t_i")
FLAG = "array<struct<rule_id:string,severity:string,confidence:int,title:string,explanation:string,values:map<string,string>,sources:array<string>,does_not_prove:string>>"

#: What a flag of each rule doesn't prove, and the line that says so.
MARK = "What this does NOT prove:"
NOT_PROVED = {
    "timestamp-conflict": "a timestamp conflict does not prove manipulation — camera clocks drift, timezone settings are often wrong, and editors routinely rewrite metadata timestamps.",
    "gps-timezone-implausible": "an implausible offset does not prove the location is wrong — the camera's clock or timezone setting may be wrong, or the photo may have been taken while traveling.",
    "device-identity-mismatch": "a device mismatch does not prove forgery — metadata is often rewritten when images pass through editors, converters, or stock-photo pipelines.",
    "serial-number-conflict": "a serial-number conflict does not prove the image is fake — serials are sometimes stripped, replaced, or miswritten by editing software; treat it as a lead, not a verdict.",
    "software-chain-resave": "different software tags do not prove forgery — many legitimate workflows pass images through multiple editors.",
    "no-thumbnail": "a missing thumbnail does not prove manipulation — many editors and converters drop embedded previews when re-saving.",
    "large-thumbnail": "an oversized thumbnail does not prove manipulation — it can result from container reuse or sloppy metadata handling.",
    "aspect": "an aspect mismatch does not prove manipulation — cameras and editors often generate thumbnails with different cropping than the main image.",
    "encoder": "differing encoder signals do not prove the thumbnail came from another image — encoders vary DQT/DHT layout freely; this is a weak signal, not a verdict.",
}
#: Longer texts of explanations and notes.
NAIVE = " At least one compared claim is timezone-naive, so the comparison used wall-clock readings as written; part or all of the disagreement may be a timezone offset rather than a real time difference."
NO_ZONE = "GPS coordinates are present but no capture timestamp carries timezone information, so UTC-offset plausibility cannot be assessed."


def _text(*parts: Column | str) -> Column:
    """Columns and constants in a row; a null is an empty text."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def flag(rule: str, severity: Column | str, confidence: Column | int, title: Column | str, body: Column, values: Column, sources: Column, proof: str = "") -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    proof = NOT_PROVED[proof or rule]
    return F.struct(
        F.lit(rule).alias("rule_id"), as_column(severity).alias("severity"), as_column(confidence).cast("int").alias("confidence"), as_column(title).alias("title"),
        F.concat(body, F.lit(f"\n\n{MARK} {proof}")).alias("explanation"), values.alias("values"), sources.alias("sources"), F.lit(proof).alias("does_not_prove"),
    )


def _when(condition: Column, made: Column) -> Column:
    """An array with the flag where the condition holds, else an empty one."""
    return F.when(condition, F.array(made).cast(FLAG)).otherwise(F.array().cast(FLAG))


def _entries(*each: tuple[Column | str, Column, Column | None]) -> Column:
    """map<string,string> of (key, value) entries; one with a condition is left out where that doesn't hold."""
    pairs = F.array(*(F.when(F.coalesce(ok, F.lit(False)) if ok is not None else F.lit(True), F.struct(_text(k).alias("key"), v.cast("string").alias("value"))) for k, v, ok in each))
    return F.map_from_entries(F.array_compact(pairs))


def raised(conditions: dict[str, Column]) -> Column:
    """The rule id of each flag, in order: by rule whether it raises one, or how many. No text is made for it."""
    n = lambda x, rule: x if rule == "thumbnail-mismatch" else x.cast("int")
    return F.concat(*(F.array_repeat(F.lit(rule), n(x, rule)) for rule, x in conditions.items()))


def instants() -> dict[str, Column]:
    """Columns that pairs of claims are compared by: seconds of each claim's wall time and instant, and its place among the claims that can be compared."""
    out = {}
    for k, name in enumerate(STAMPS):
        t = F.col(name)
        out[f"w{k}"], out[f"u{k}"] = F.when(is_claim(t), instant(t["wall"])), F.when(is_claim(t), instant(t["value_utc"]))
        out[f"at{k}"] = sum((is_claim(F.col(s)).cast("int") for s in STAMPS[:k]), F.lit(0))
    return out


def pair(i: int, j: int) -> Column:
    """struct<diff, i, j, naive> of two claims, over the columns of ``instants``; null where they can't be compared."""
    a, b = F.col(STAMPS[i]), F.col(STAMPS[j])
    c = F.col
    naive = (a["timezone_status"] == "naive") | (b["timezone_status"] == "naive")
    days = F.abs(F.floor(c(f"w{i}") / 86400) - F.floor(c(f"w{j}") / 86400)) * 86400
    utc = F.abs(c(f"u{i}") - c(f"u{j}"))
    diff = F.when((a["precision"] == "day") | (b["precision"] == "day"), days).when(~naive & utc.isNotNull(), utc).otherwise(F.abs(c(f"w{i}") - c(f"w{j}")))
    return F.when(is_claim(a) & is_claim(b) & diff.isNotNull(), F.struct(diff.cast("double").alias("diff"), c(f"at{i}").alias("i"), c(f"at{j}").alias("j"), naive.alias("naive")))


def pairs() -> dict[str, Column]:
    return {f"pair{i}{j}": pair(i, j) for i, j in combinations(range(len(STAMPS)), 2)}


def widest_pair() -> Column:
    """The largest difference among the columns of ``pairs``; of equal ones the first pair."""
    each = [F.col(name) for name in pairs()]
    most = F.greatest(*(p["diff"] for p in each))
    return F.coalesce(*(F.when(p["diff"] == most, p) for p in each))


def apart(widest: Column, tolerance_s: float = TOLERANCE_S) -> Column:
    return F.coalesce(widest["diff"] > tolerance_s, F.lit(False))


def timestamp_conflict(widest: Column, tolerance_s: float = TOLERANCE_S) -> Column:
    diff = widest["diff"]
    severity = F.when(diff > 86400, "high").when(diff > 3600, "medium").otherwise("low")
    sure = F.when(diff > 86400, 85).when(diff > 3600, 70).otherwise(50)
    sure = F.when(widest["naive"], F.least(sure, F.lit(60))).otherwise(sure)
    claims = [F.col(s) for s in STAMPS]
    said = F.concat_ws("; ", *(F.when(is_claim(t), _text(t["source"], " claims ", quoted(t["raw"]), F.when(t["timezone_status"] == "naive", " (timezone unknown)"))) for t in claims))
    body = _text("Capture-time claims disagree: ", said, " — ", fmt_duration(diff), f" apart at most, beyond the {tolerance_s:g}s tolerance.", F.when(widest["naive"], F.lit(NAIVE)))
    values = _entries(*((t["source"], t["raw"], is_claim(t)) for t in claims))
    sources = F.array_compact(F.array(*(F.when(is_claim(t), t["source"]) for t in claims)))
    return _when(apart(widest, tolerance_s), flag("timestamp-conflict", severity, sure, F.concat(F.lit("capture timestamps disagree by "), fmt_duration(diff)), body, values, sources))


def zone_claim() -> Column:
    """The first capture claim with an explicit offset, by source."""
    return F.coalesce(*(F.when(t["parseable"] & (t["timezone_status"] == "explicit") & t["value_utc"].isNotNull() & t["wall"].isNotNull(), t) for t in map(F.col, STAMPS)))


def zone_hours(claim: Column) -> Column:
    """Hours that a claim's offset is east of UTC."""
    return (instant(claim["wall"]) - instant(claim["value_utc"])) / 3600.0


def off_zone(hours: Column, located: Column, lon: Column) -> Column:
    return F.coalesce(located & (F.abs(hours - lon / 15.0) > 2), F.lit(False))


def gps_timezone(claim: Column, hours: Column, located: Column, lon: Column) -> Column:
    """``hours``: zone_hours of the claim; ``located``: coordinates are there and valid."""
    gap = F.abs(hours - lon / 15.0)
    body = _text("GPS claims longitude ", geo.fixed(lon, 2), "° (implied zone ≈ ", fmt_offset(lon / 15.0), ") but ", claim["source"], " carries offset ", fmt_offset(hours), " (", claim["raw"], "); ", geo.fixed(gap, 1),
                 "h from the longitude-implied zone, beyond the ±2h tolerance for borders and daylight saving.")
    values = _entries(("GPS longitude", geo.fixed(lon, 6), None), ("implied zone", fmt_offset(lon / 15.0), None), (claim["source"], claim["raw"], None), ("claimed offset", fmt_offset(hours), None))
    return _when(off_zone(hours, located, lon), flag("gps-timezone-implausible", "medium", 55, "capture timezone implausible for GPS longitude", body, values, F.array(F.lit("EXIF GPS"), claim["source"])))


def gps_timezone_note(claim: Column, located: Column) -> Column:
    """The note where valid coordinates and a capture time are there, but no claim carries an offset; else null."""
    some = F.lit(False)
    for s in STAMPS:
        some = some | F.coalesce(F.col(s)["parseable"], F.lit(False))
    return F.when(F.coalesce(located, F.lit(False)) & claim.isNull() & some, F.lit(NO_ZONE))


def devices_differ() -> Column:
    return F.coalesce(differs("device_make", "device_model"), F.lit(False))


def device_mismatch() -> Column:
    facts = {"device_make": ("s_make", "make"), "device_model": ("s_model", "model")}
    claims = [F.col("c_x"), F.col("c_m")]
    said, entries = [], []
    for fact, (column, field) in facts.items():
        here = F.col(column) == "differ"
        has = [c[f"{field}_norm"].isNotNull() & c[f"{field}_key"].isNotNull() for c in claims]
        said.append(F.when(here, _text(f"{fact}: ", F.concat_ws("; ", *(F.when(h, _text(c["source"], " claims ", quoted(c[f"{field}_raw"]))) for h, c in zip(has, claims, strict=True))))))
        entries += [(_text(c["source"], f" [{fact}]"), c[f"{field}_raw"], here & h) for h, c in zip(has, claims, strict=True)]
    body = _text("Device identity differs across sources (compared after case/whitespace-insensitive normalization): ", F.concat_ws("; ", *said), ".")
    made = flag("device-identity-mismatch", "medium", 65, "device make/model differs across metadata sources", body, _entries(*entries), F.array(*(c["source"] for c in claims)))
    return _when(devices_differ(), made)


def _serials(*observed: Column) -> list[Column]:
    return [F.nullif(strip(x), F.lit("")) for x in observed]


def serials_differ(body_serial: Column, aux: Column) -> Column:
    a, b = _serials(body_serial, aux)
    return F.coalesce(a != b, F.lit(False))


def serial_conflict(body_serial: Column, aux: Column) -> Column:
    a, b = _serials(body_serial, aux)
    body = _text("EXIF BodySerialNumber is ", quoted(a), " but XMP aux:SerialNumber is ", quoted(b), " — two sources name different cameras.")
    values = _entries(("EXIF BodySerialNumber", a, None), ("XMP aux:SerialNumber", b, None))
    made = flag("serial-number-conflict", "high", 80, "camera serial number differs across metadata sources", body, values, F.array(F.lit("EXIF"), F.lit("XMP aux:SerialNumber")))
    return _when(serials_differ(body_serial, aux), made)


def editors_differ(exif: Column, xmp: Column) -> Column:
    return given(exif) & given(xmp) & F.coalesce(F.lower(product_name(exif)) != F.lower(product_name(xmp)), F.lit(False))


def software_chain(exif: Column, xmp: Column) -> Column:
    a, b = product_name(exif), product_name(xmp)
    title = F.concat(F.lit("different editors in metadata chain ("), a, F.lit(" vs "), b, F.lit(")"))
    body = _text("EXIF Software claims ", quoted(exif), " but XMP xmp:CreatorTool claims ", quoted(xmp), " — the file passed through different editors (a re-save in the chain, not necessarily an edit of image content).")
    made = flag("software-chain-resave", "low", 60, title, body, _entries(("EXIF Software", exif, None), ("XMP xmp:CreatorTool", xmp, None)), F.array(F.lit("EXIF"), F.lit("XMP xmp:CreatorTool")))
    return _when(editors_differ(exif, xmp), made)


def compare_thumbnail(width: Column, height: Column, main_width: Column, main_height: Column, dqt: Column, dht: Column, main_dqt: Column, main_dht: Column) -> Column:
    """Struct (larger, aspect, off, scale, encoder) of a thumbnail against its image; ``off`` is the relative difference of aspects."""
    known = (width > 0) & (height > 0) & (main_width > 0) & (main_height > 0)
    main = main_width / main_height
    off = F.abs(main - width / height) / main
    apart, same = (dqt != main_dqt) & (dht != main_dht), (dqt == main_dqt) & (dht == main_dht)
    return F.struct(
        F.coalesce(known & ((width > main_width) | (height > main_height)), F.lit(False)).alias("larger"), F.when(known, F.when(off <= ASPECT_TOLERANCE, "same").otherwise("different")).otherwise("unknown").alias("aspect"),
        F.when(known, off).alias("off"), F.when(known, geo.rounded(width / main_width, 4)).alias("scale"), F.when(apart, "different").when(same, "same").otherwise("unknown").alias("encoder"),
    )


def _cases(main_width: Column, main_height: Column, claimed: Column, thumbs: Column) -> tuple[Column, Column]:
    """Whether a claimed thumbnail is absent, and whether there are some to compare."""
    sized = F.coalesce((main_width > 0) & (main_height > 0), F.lit(False))
    return sized & F.coalesce(claimed, F.lit(False)) & (F.size(thumbs) == 0), sized & (F.size(thumbs) > 0)


def thumbnail_flags(main_width: Column, main_height: Column, claimed: Column, thumbs: Column) -> Column:
    """How many flags ``thumbnail_mismatch`` gives."""
    absent, some = _cases(main_width, main_height, claimed, thumbs)
    sizes, encoders = F.filter(thumbs, lambda t: t["larger"] | (t["aspect"] == "different")), F.filter(thumbs, lambda t: t["encoder"] == "different")
    return F.when(absent, 1).when(some, F.size(sizes) + F.size(encoders)).otherwise(0)


def thumbnail_mismatch(main_width: Column, main_height: Column, claimed: Column, thumbs: Column, main_dqt: Column, main_dht: Column, warnings: Column | None = None) -> Column:
    """``thumbs``: array of structs of a thumbnail (index, source, width, height, sha256, dqt, dht) and its comparison; ``claimed``: a second IFD exists."""
    rule, main = "thumbnail-mismatch", _text(main_width, "x", main_height)
    known = lambda t: (t["width"] > 0) & (t["height"] > 0)
    has = lambda x: F.when(x, "present").otherwise("absent")
    shown = lambda x: F.when(x, "True").when(~x, "False").otherwise("None")

    def of(t: Column) -> Column:
        name = _text("thumbnail #", t["index"], " (", t["source"], ")")
        dims = F.when(F.coalesce(known(t), F.lit(False)), _text(t["width"], "x", t["height"])).otherwise("dimensions unknown")
        sources = F.array(F.lit("image header"), t["source"])
        sizes = (("main dimensions", main, None), (_text("thumbnail #", t["index"], " dimensions"), dims, None))
        large = flag(rule, "medium", 60, "embedded thumbnail larger than the main image", _text(name, " is ", dims, " but the main image is ", main, " — a preview larger than its image is unusual."),
                     _entries(*sizes, ("thumbnail sha256", F.substring(t["sha256"], 1, 16), None)), sources, "large-thumbnail")
        aspect = flag(rule, "low", 45, "embedded thumbnail aspect differs from main image", _text(name, ": main ", main, " (aspect ", geo.fixed(main_width / main_height, 3), ") vs thumbnail ", dims, " (aspect ", geo.fixed(t["width"] / t["height"], 3), "): ", geo.fixed(t["off"] * 100, 1), "% relative difference."),
                      _entries(*sizes), sources, "aspect")
        encoder = flag(rule, "low", 50, "thumbnail encoder signals differ from main image",
                       _text(name, ": main image: ", main_dqt, " DQT table(s), DHT ", has(main_dht), "; thumbnail: ", t["dqt"], " DQT table(s), DHT ", has(t["dht"]), " — encoder signatures differ (weak signal: encoders vary these)."),
                       _entries(("main DQT tables", main_dqt, None), ("main DHT present", shown(main_dht), None), (_text("thumbnail #", t["index"], " DQT tables"), t["dqt"], None), (_text("thumbnail #", t["index"], " DHT present"), shown(t["dht"]), None)), sources, "encoder")
        return F.array_compact(F.array(F.when(t["larger"], large).when(t["aspect"] == "different", aspect), F.when(t["encoder"] == "different", encoder)))

    detail = F.coalesce(F.nullif(F.array_join(warnings, "; "), F.lit("")), F.lit("no details")) if warnings is not None else F.lit("no details")
    none = flag(rule, "medium", 60, "IFD1 claims a thumbnail but none was extractable", _text("EXIF IFD1 exists, yet no thumbnail bytes could be extracted (", detail, ") — the thumbnail may have been stripped, or its offsets/lengths are corrupt."),
                _entries(("has_thumbnail_ifd", F.lit("True"), None), ("thumbnails_extracted", F.lit("0"), None)), F.array(F.lit("EXIF IFD1")), "no-thumbnail")
    absent, some = _cases(main_width, main_height, claimed, thumbs)
    return F.when(absent, F.array(none).cast(FLAG)).when(some, F.flatten(F.transform(thumbs, of)).cast(FLAG)).otherwise(F.array().cast(FLAG))
