"""Queries over the evidence view: normalization, comparison, rules, batch reports and search."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenix.functions import device, geo, text, time
from provenix.operators import batch, rules, search
from provenix.plans.evidence import EV_SQL, analyzed, computed, evidence, flagged, rule_ids
from provenix.plans.registry import query
from provenix.sources import index
from provenix.sources.shared import shared_dir

SQL = f"WITH RECURSIVE {EV_SQL} "
c = F.col


def ev(name: str, sql: str | None, step=None):
    """Registers a function of the evidence view (after ``step``); ``sql`` follows the view's own."""

    def add(f):
        return query(name, SQL + sql if sql else None)(lambda spark, sf_dir: f(step(evidence(spark, sf_dir)) if step else evidence(spark, sf_dir)))

    return add


def ok_analyzed(df: DataFrame) -> DataFrame:
    return analyzed(batch.ok(df))


def ok_flagged(df: DataFrame) -> DataFrame:
    return flagged(ok_analyzed(df))


def unparseable(df: DataFrame) -> DataFrame:
    """Claims of XMP and IPTC that can't be read; the decoders report those of other sources themselves."""
    bad = F.filter("timestamps", lambda t: ~t["parseable"] & t["raw"].isNotNull() & (F.startswith(t["source"], F.lit("XMP")) | F.startswith(t["source"], F.lit("IPTC"))))
    return analyzed(df).select("path", F.explode(bad).alias("t")).select("path", "t.raw", "t.source")


# normalization -------------------------------------------------------------------------------------------------------


def _claim_columns(t) -> list:
    return [t[x].alias(x) for x in ("raw", "value_utc", "wall", "precision", "timezone_status", "parseable")]


ev("normalize_exif_ts", """SELECT path, CASE WHEN offset_raw = 'bogus' AND x_wall IS NOT NULL THEN exif_raw || ' (offset tag ''bogus'' unparseable)' ELSE exif_raw END AS raw, x_utc AS value_utc, x_wall AS wall,
  CASE WHEN x_wall IS NULL THEN 'unknown' ELSE 'second' END AS precision, CASE WHEN x_utc IS NULL THEN 'naive' ELSE 'explicit' END AS timezone_status, x_wall IS NOT NULL AS parseable FROM n""")(
    lambda df: df.select("path", *_claim_columns(time.normalize_exif(c("exif_raw"), c("offset_raw"), "capture", "EXIF DateTimeOriginal"))))
ev("normalize_xmp_ts", "SELECT path, xmp_raw AS raw, m_utc AS value_utc, m_wall AS wall, 'second' AS precision, 'explicit' AS timezone_status, true AS parseable FROM n")(
    lambda df: df.select("path", *_claim_columns(time.normalize_xmp(c("xmp_raw"), "capture", "XMP xmp:CreateDate"))))
ev("normalize_iptc_ts", """SELECT path, iptc_date || coalesce(' ' || iptc_time, '') AS raw, i_utc AS value_utc, i_wall AS wall, CASE WHEN iptc_time IS NULL THEN 'day' ELSE 'second' END AS precision,
  CASE WHEN iptc_time IS NULL THEN 'naive' ELSE 'explicit' END AS timezone_status, true AS parseable FROM n""")(
    lambda df: df.select("path", *_claim_columns(time.normalize_iptc(c("iptc_date"), c("iptc_time"), "IPTC DateCreated/TimeCreated"))))
_UTC = "SELECT path, {0} AS raw, {1} || 'Z' AS value_utc, {1} AS wall, 'utc' AS timezone_status FROM n WHERE {2}"
_GPS_WALL = "replace(substr(exif_raw, 1, 10), ':', '-') || 'T' || lpad((k % 24)::VARCHAR, 2, '0') || ':05:07'"
ev("normalize_gps_ts", _UTC.format("substr(exif_raw, 1, 10) || ' ' || lpad((k % 24)::VARCHAR, 2, '0') || ':05:07'", _GPS_WALL, "k <> 99"))(
    lambda df: df.select("path", time.normalize_gps(F.substring("exif_raw", 1, 10), (c("k") % 24).cast("double"), F.lit(5.0), F.lit(7.9)).alias("t")).where("t is not null").select("path", "t.raw", "t.value_utc", "t.wall", "t.timezone_status"))
ev("normalize_icc_ts", _UTC.format("replace(m_wall, '2024', '1999')", "replace(m_wall, '2024', '1999')", "k % 2 = 0"))(
    lambda df: df.select("path", time.normalize_icc(F.when(c("k") % 2 == 0, F.replace(F.rtrim("xmp_raw", F.lit("Z")), F.lit("2024"), F.lit("1999")))).alias("t")).where("t is not null").select("path", "t.raw", "t.value_utc", "t.wall", "t.timezone_status"))
ev("normalize_fs_ts", "SELECT path, (epoch(date_trunc('second', ts)) + k % 8 / 8.0)::DOUBLE::VARCHAR AS raw, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS value_utc, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS wall, 'utc' AS timezone_status FROM n")(
    lambda df: df.select("path", time.normalize_mtime(F.unix_seconds(c("ts").cast("timestamp")) + (c("k") % 8) / 8.0).alias("t")).select("path", "t.raw", "t.value_utc", "t.wall", "t.timezone_status"))
ev("exif_datetime", "SELECT path, x_wall AS iso FROM n")(lambda df: df.select("path", time.exif_datetime(c("exif_raw")).alias("iso")))
ev("plausible_datetime", "SELECT path, x_wall IS NOT NULL AS plausible FROM n")(lambda df: df.select("path", time.exif_datetime(c("exif_raw")).isNotNull().alias("plausible")))
ev("parse_offset", "SELECT path, offset_raw, x_off AS minutes FROM n")(lambda df: df.select("path", "offset_raw", time.parse_offset(c("offset_raw")).alias("minutes")))
ev("iptc_datetime", "SELECT path, i_wall AS iso FROM n")(lambda df: df.select("path", time.normalize_iptc(c("iptc_date"), c("iptc_time"), "IPTC")["wall"].alias("iso")))
ev("gps_datetime", "SELECT path, replace(substr(exif_raw, 1, 10), ':', '-') || 'T' || lpad((k % 30)::VARCHAR, 2, '0') || ':05:07Z' AS iso FROM n WHERE k < 99 AND k % 30 < 24")(
    lambda df: df.select("path", time.gps_datetime(F.substring("exif_raw", 1, 10), (c("k") % 30).cast("double"), F.lit(5.0), F.lit(7.9)).alias("iso")).where("iso is not null"))
ev("collect_timestamps", """SELECT path, 'EXIF DateTimeOriginal' AS source, coalesce(x_utc, x_wall, exif_raw) AS shown FROM n UNION ALL SELECT path, 'XMP xmp:CreateDate', m_utc FROM n
  UNION ALL SELECT path, 'IPTC DateCreated/TimeCreated', coalesce(i_utc, i_wall) FROM n""")(
    lambda df: analyzed(df).select("path", F.explode("timestamps").alias("t")).select("path", "t.source", F.coalesce("t.value_utc", "t.wall", "t.raw").alias("shown")))
ev("unparseable_findings", """SELECT path, raw, source FROM (SELECT path, 'XMP xmp:CreateDate' AS source, CASE k % 11 WHEN 5 THEN 'on ' || xmp_raw WHEN 6 THEN substr(xmp_raw, 1, 7) END AS raw FROM ev
  UNION ALL SELECT path, 'IPTC DateCreated/TimeCreated', CASE WHEN k % 13 = 4 THEN '20241399' || coalesce(' ' || iptc_time, '') WHEN k % 13 = 5 THEN iptc_time WHEN k % 13 = 6 THEN iptc_date || ' 256000' END FROM ev) WHERE raw IS NOT NULL""")(
    lambda df: unparseable(df.withColumns({"xmp_raw": F.when(c("k") % 11 == 5, F.concat(F.lit("on "), "xmp_raw")).when(c("k") % 11 == 6, F.substring("xmp_raw", 1, 7)).otherwise(c("xmp_raw")),
                                           "iptc_date": F.when(c("k") % 13 == 4, "20241399").when(c("k") % 13 != 5, c("iptc_date")), "iptc_time": F.when(c("k") % 13 == 6, "256000").otherwise(c("iptc_time"))})))
ev("capture_day", "SELECT path, capture_day, capture_day_display FROM d")(lambda df: analyzed(df).select("path", "capture_day", "capture_day_display"))

ev("normalize_make", "SELECT path, x_make AS make, x_make_key AS make_key FROM n")(lambda df: df.select("path", *(x.alias(n) for x, n in zip(device.normalize_make(c("make_raw")), ("make", "make_key"), strict=True))))


@ev("make_lookup_join", f"SELECT path, x_make AS make FROM n WHERE replace(replace(upper(x_base), ' ', ''), '-', '') IN ({', '.join(map(repr, device.MAKES))})")
def make_lookup_join(df: DataFrame) -> DataFrame:
    known = F.broadcast(df.sparkSession.createDataFrame(list(device.MAKES.items()), "known string, make string"))  # a fixed table
    return df.withColumn("known", F.regexp_replace(F.upper(device.make_base(c("make_raw"))), "[ -]", "")).join(known, "known").select("path", "make")


ev("normalize_model", "SELECT path, x_model AS model, x_model_key AS model_key FROM n")(
    lambda df: df.withColumns(dict(zip(("mk", "kk"), device.normalize_make(c("make_raw")), strict=True))).select("path", *(x.alias(n) for x, n in zip(device.normalize_model(c("model_raw"), c("mk"), c("kk")), ("model", "model_key"), strict=True))))
ev("normalize_software", "SELECT path, x_software AS software, x_software_key AS software_key FROM n")(
    lambda df: df.select("path", *(x.alias(n) for x, n in zip(device.normalize_software(c("software_raw")), ("software", "software_key"), strict=True))))
ev("device_claims", "SELECT path, 'EXIF' AS source, x_make_key AS make_key, x_model_key AS model_key FROM d WHERE x_claim UNION ALL SELECT path, 'XMP tiff:Make/tiff:Model', m_make_key, m_model_key FROM d WHERE m_claim")(
    lambda df: analyzed(df).select("path", F.explode("claims").alias("x")).select("path", "x.source", "x.make_key", "x.model_key"))
ev("preferred_claim", "SELECT path, CASE WHEN x_claim THEN 'EXIF' WHEN m_claim THEN 'XMP tiff:Make/tiff:Model' END AS source FROM d")(lambda df: analyzed(df).select("path", F.coalesce("c_x", "c_m")["source"].alias("source")))
ev("device_key_display", "SELECT path, device_key, device_display FROM g")(lambda df: analyzed(df).select("path", "device_key", "device_display"))
ev("product_name", "SELECT path, CASE WHEN starts_with(software_raw, 'Editor') THEN 'Editor' WHEN starts_with(software_raw, 'Shop') THEN 'Shop Pro' ELSE software_raw END AS product FROM n")(
    lambda df: df.select("path", text.product_name(c("software_raw")).alias("product")))

# comparison and rules ------------------------------------------------------------------------------------------------


ev("compare_capture_time", "SELECT path, s_time AS status FROM g")(lambda df: analyzed(df).select("path", c("s_time").alias("status")))
ev("compare_device_fields", "SELECT path, s_make, s_model, s_software FROM g")(lambda df: analyzed(df).select("path", "s_make", "s_model", "s_software"))
ev("comparison_status", "SELECT s AS status, count(*) AS n FROM (SELECT unnest([s_time, s_make, s_model, s_software]) AS s FROM g) GROUP BY s")(
    lambda df: analyzed(df).select(F.explode("comparison").alias("f")).groupBy(c("f.status").alias("status")).agg(F.count("*").alias("n")))
ev("has_conflicts", "SELECT path, 'differ' IN (s_time, s_make, s_model, s_software) AS has_conflicts FROM g")(lambda df: analyzed(df).select("path", "has_conflicts"))

_PAIRS = """, t AS (SELECT path, 0 AS i, x_utc AS u, x_wall AS w, 'second' AS p FROM g WHERE x_wall IS NOT NULL UNION ALL SELECT path, 1, m_utc, m_wall, 'second' FROM g
  UNION ALL SELECT path, 2, i_utc, i_wall, CASE WHEN iptc_time IS NULL THEN 'day' ELSE 'second' END FROM g),
ti AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS i, u, p, w, epoch(try_strptime(CASE WHEN length(w) = 10 THEN w || 'T00:00:00' ELSE w END, '%Y-%m-%dT%H:%M:%S')) AS ws, epoch(strptime(u, '%Y-%m-%dT%H:%M:%SZ')) AS us FROM t),
q AS (SELECT a.path, a.i, b.i AS j, a.u IS NULL OR b.u IS NULL AS naive, CASE WHEN 'day' IN (a.p, b.p) THEN abs(floor(a.ws / 86400) - floor(b.ws / 86400)) * 86400 WHEN a.us IS NOT NULL AND b.us IS NOT NULL THEN abs(a.us - b.us) ELSE abs(a.ws - b.ws) END::DOUBLE AS diff
  FROM ti a JOIN ti b ON a.path = b.path AND a.i < b.i),
w AS (SELECT path, diff, naive FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY diff DESC, i, j) AS r FROM q WHERE diff IS NOT NULL) WHERE r = 1)
"""
def compared(df: DataFrame) -> DataFrame:
    """Analyzed rows with the pairs of claims and the widest one."""
    return computed(computed(analyzed(df), rules.instants()).withColumns(rules.pairs()), {"w": rules.widest_pair()})


ev("claim_pairs", _PAIRS + "SELECT path, i::INT AS i, j::INT AS j, diff, naive FROM q WHERE diff IS NOT NULL")(
    lambda df: compared(df).select("path", F.explode(F.array_compact(F.array(*rules.pairs()))).alias("p")).select("path", "p.i", "p.j", "p.diff", "p.naive"))
ev("max_gap_topk", _PAIRS + "SELECT path, diff, naive FROM w")(lambda df: compared(df).where("w is not null").select("path", "w.diff", "w.naive"))

_DUR = "CASE WHEN diff < 120 THEN diff::BIGINT || 's' WHEN diff < 7200 THEN (diff::BIGINT // 60) || 'm' WHEN diff < 172800 THEN (diff::BIGINT // 3600) || 'h' || CASE WHEN diff::BIGINT // 60 % 60 <> 0 THEN (diff::BIGINT // 60 % 60) || 'm' ELSE '' END ELSE (diff::BIGINT // 86400) || 'd' || CASE WHEN diff::BIGINT // 3600 % 24 <> 0 THEN (diff::BIGINT // 3600 % 24) || 'h' ELSE '' END END"
ev("fmt_duration", _PAIRS + f"SELECT path, {_DUR} AS duration FROM w")(lambda df: compared(df).where("w is not null").select("path", time.fmt_duration(c("w.diff")).alias("duration")))
ev("fmt_offset", "SELECT path, 'UTC' || CASE WHEN x_off < 0 THEN '-' ELSE '+' END || lpad((abs(x_off) // 60)::VARCHAR, 2, '0') || ':' || lpad((abs(x_off) % 60)::VARCHAR, 2, '0') AS shown FROM n WHERE x_off IS NOT NULL")(
    lambda df: df.select("path", time.fmt_offset(time.parse_offset(c("offset_raw")) / 60.0).alias("shown")).where("shown is not null"))

def _quoted(x: str) -> str:
    return f"(CASE WHEN contains({x}, chr(39)) AND NOT contains({x}, chr(34)) THEN chr(34) || {x} || chr(34) ELSE chr(39) || {x} || chr(39) END)"


def _offset(hours: str) -> str:
    return f"('UTC' || CASE WHEN {hours} >= 0 THEN '+' ELSE '-' END || lpad(floor(abs({hours}))::INT::VARCHAR, 2, '0') || ':' || lpad(round_even((abs({hours}) - floor(abs({hours}))) * 60, 0)::INT::VARCHAR, 2, '0'))"


def _proof(rule: str) -> str:
    return f"'{rules.NOT_PROVED[rule]}' AS proof".replace("camera's", "camera''s")


_X_RAW = "CASE WHEN offset_raw = 'bogus' AND x_wall IS NOT NULL THEN exif_raw || ' (offset tag ''bogus'' unparseable)' ELSE exif_raw END"
_CLAIMS = (("'EXIF DateTimeOriginal'", "x_raw", "x_wall IS NOT NULL", "x_utc"), ("'XMP xmp:CreateDate'", "xmp_raw", "true", "m_utc"), ("'IPTC DateCreated/TimeCreated'", "i_raw", "true", "i_utc"))
_SAID = "concat_ws('; ', " + ", ".join(f"CASE WHEN {has} THEN {source} || ' claims ' || {_quoted(raw)} || CASE WHEN {utc} IS NULL THEN ' (timezone unknown)' ELSE '' END END" for source, raw, has, utc in _CLAIMS) + ")"
_RAWS = "concat_ws('|', " + ", ".join(f"CASE WHEN {has} THEN {source} || '=' || {raw} END" for source, raw, has, _ in _CLAIMS) + ")"
_SOURCES = "concat_ws('|', " + ", ".join(f"CASE WHEN {has} THEN {source} END" for source, _, has, _ in _CLAIMS) + ")"
_BOTH = "'{0}: EXIF claims ' || {1} || '; XMP tiff:Make/tiff:Model claims ' || {2}"
_THUMB = "'thumbnail #0 (EXIF IFD1 (JPEG blob))'"
_SIZES = "'main dimensions=' || width || 'x' || height || '|thumbnail #0 dimensions=' || thumb_width || 'x' || thumb_height"
_HAS = "CASE WHEN {0} THEN 'present' ELSE 'absent' END"
_IS = "CASE WHEN {0} THEN 'True' ELSE 'False' END"
_ZONE = _PAIRS + f""", z AS (SELECT *, CASE WHEN x_utc IS NOT NULL THEN x_off ELSE 0 END / 60.0 AS off, CASE WHEN x_utc IS NOT NULL THEN 'EXIF DateTimeOriginal' ELSE 'XMP xmp:CreateDate' END AS off_source, CASE WHEN x_utc IS NOT NULL THEN exif_raw ELSE xmp_raw END AS off_raw,
  {_X_RAW} AS x_raw, iptc_date || coalesce(' ' || iptc_time, '') AS i_raw FROM g),
th AS (SELECT *, CASE WHEN k % 3 <> 0 AND (thumb_width > width OR thumb_height > height) THEN 'larger' WHEN k % 3 <> 0 AND abs(thumb_width / thumb_height - width / height) / (width / height) > 0.05 THEN 'aspect' END AS t1,
  k % 3 <> 0 AND thumb_dqt <> main_dqt AND thumb_dht <> main_dht AS t2 FROM z),
pn AS (SELECT *, CASE WHEN starts_with(software_raw, 'Editor') THEN 'Editor' WHEN starts_with(software_raw, 'Shop') THEN 'Shop Pro' ELSE software_raw END AS p1,
  CASE WHEN starts_with(xmp_tool_raw, 'Editor') THEN 'Editor' WHEN starts_with(xmp_tool_raw, 'Shop') THEN 'Shop Pro' ELSE xmp_tool_raw END AS p2 FROM th),
f0 AS (
  SELECT path, 1 AS o, 'timestamp-conflict' AS rule_id, CASE WHEN diff > 86400 THEN 'high' WHEN diff > 3600 THEN 'medium' ELSE 'low' END AS severity, least(CASE WHEN diff > 86400 THEN 85 WHEN diff > 3600 THEN 70 ELSE 50 END, CASE WHEN naive THEN 60 ELSE 100 END) AS confidence,
    'capture timestamps disagree by ' || {_DUR} AS title, 'Capture-time claims disagree: ' || {_SAID} || ' — ' || {_DUR} || ' apart at most, beyond the 60s tolerance.' || CASE WHEN naive THEN '{rules.NAIVE}' ELSE '' END AS body,
    {_RAWS} AS vals, {_SOURCES} AS sources, {_proof("timestamp-conflict")} FROM w JOIN z USING (path) WHERE diff > 60
  UNION ALL SELECT path, 2, 'gps-timezone-implausible', 'medium', 55, 'capture timezone implausible for GPS longitude', 'GPS claims longitude ' || printf('%.2f', lon) || '° (implied zone ≈ ' || {_offset("(lon / 15.0)")} || ') but ' || off_source || ' carries offset ' || {_offset("off")} || ' (' || off_raw || '); '
    || printf('%.1f', abs(off - lon / 15.0)) || 'h from the longitude-implied zone, beyond the ±2h tolerance for borders and daylight saving.', 'GPS longitude=' || printf('%.6f', lon) || '|implied zone=' || {_offset("(lon / 15.0)")} || '|' || off_source || '=' || off_raw || '|claimed offset=' || {_offset("off")},
    'EXIF GPS|' || off_source, {_proof("gps-timezone-implausible")} FROM z WHERE gps_valid AND abs(off - lon / 15.0) > 2
  UNION ALL SELECT path, 3, 'device-identity-mismatch', 'medium', 65, 'device make/model differs across metadata sources', 'Device identity differs across sources (compared after case/whitespace-insensitive normalization): ' || concat_ws('; ', CASE WHEN s_make = 'differ' THEN {_BOTH.format("device_make", _quoted("make_raw"), _quoted("xmp_make_raw"))} END,
    CASE WHEN s_model = 'differ' THEN {_BOTH.format("device_model", _quoted("model_raw"), _quoted("xmp_model_raw"))} END) || '.', concat_ws('|', CASE WHEN s_make = 'differ' THEN 'EXIF [device_make]=' || make_raw || '|XMP tiff:Make/tiff:Model [device_make]=' || xmp_make_raw END,
    CASE WHEN s_model = 'differ' THEN 'EXIF [device_model]=' || model_raw || '|XMP tiff:Make/tiff:Model [device_model]=' || xmp_model_raw END), 'EXIF|XMP tiff:Make/tiff:Model', {_proof("device-identity-mismatch")} FROM z WHERE 'differ' IN (s_make, s_model)
  UNION ALL SELECT path, 4, 'serial-number-conflict', 'high', 80, 'camera serial number differs across metadata sources', 'EXIF BodySerialNumber is ' || {_quoted("body_serial")} || ' but XMP aux:SerialNumber is ' || {_quoted("trim(aux_serial)")} || ' — two sources name different cameras.',
    'EXIF BodySerialNumber=' || body_serial || '|XMP aux:SerialNumber=' || trim(aux_serial), 'EXIF|XMP aux:SerialNumber', {_proof("serial-number-conflict")} FROM z WHERE body_serial <> trim(aux_serial)
  UNION ALL SELECT path, 5, 'software-chain-resave', 'low', 60, 'different editors in metadata chain (' || p1 || ' vs ' || p2 || ')', 'EXIF Software claims ' || {_quoted("software_raw")} || ' but XMP xmp:CreatorTool claims ' || {_quoted("xmp_tool_raw")} || ' — the file passed through different editors (a re-save in the chain, not necessarily an edit of image content).',
    'EXIF Software=' || software_raw || '|XMP xmp:CreatorTool=' || xmp_tool_raw, 'EXIF|XMP xmp:CreatorTool', {_proof("software-chain-resave")} FROM pn WHERE p1 <> '' AND p2 <> '' AND lower(p1) <> lower(p2)
  UNION ALL SELECT path, 6, 'thumbnail-mismatch', 'medium', 60, 'IFD1 claims a thumbnail but none was extractable', 'EXIF IFD1 exists, yet no thumbnail bytes could be extracted (no details) — the thumbnail may have been stripped, or its offsets/lengths are corrupt.', 'has_thumbnail_ifd=True|thumbnails_extracted=0', 'EXIF IFD1', {_proof("no-thumbnail")} FROM pn WHERE thumb_claimed AND k % 3 = 0
  UNION ALL SELECT path, 6, 'thumbnail-mismatch', 'medium', 60, 'embedded thumbnail larger than the main image', {_THUMB} || ' is ' || thumb_width || 'x' || thumb_height || ' but the main image is ' || width || 'x' || height || ' — a preview larger than its image is unusual.', {_SIZES} || '|thumbnail sha256=' || substr(sha256, 1, 16),
    'image header|EXIF IFD1 (JPEG blob)', {_proof("large-thumbnail")} FROM pn WHERE t1 = 'larger'
  UNION ALL SELECT path, 6, 'thumbnail-mismatch', 'low', 45, 'embedded thumbnail aspect differs from main image', {_THUMB} || ': main ' || width || 'x' || height || ' (aspect ' || printf('%.3f', width / height) || ') vs thumbnail ' || thumb_width || 'x' || thumb_height || ' (aspect ' || printf('%.3f', thumb_width / thumb_height) || '): '
    || printf('%.1f', abs(width / height - thumb_width / thumb_height) / (width / height) * 100) || '% relative difference.', {_SIZES}, 'image header|EXIF IFD1 (JPEG blob)', {_proof("aspect")} FROM pn WHERE t1 = 'aspect'
  UNION ALL SELECT path, 6, 'thumbnail-mismatch', 'low', 50, 'thumbnail encoder signals differ from main image', {_THUMB} || ': main image: ' || main_dqt || ' DQT table(s), DHT ' || {_HAS.format("main_dht")} || '; thumbnail: ' || thumb_dqt || ' DQT table(s), DHT ' || {_HAS.format("thumb_dht")} || ' — encoder signatures differ (weak signal: encoders vary these).',
    'main DQT tables=' || main_dqt || '|main DHT present=' || {_IS.format("main_dht")} || '|thumbnail #0 DQT tables=' || thumb_dqt || '|thumbnail #0 DHT present=' || {_IS.format("thumb_dht")}, 'image header|EXIF IFD1 (JPEG blob)', {_proof("encoder")} FROM pn WHERE t2),
fl AS (SELECT path, o, rule_id, severity, confidence, title, body || chr(10) || chr(10) || '{rules.MARK} ' || proof AS explanation, vals, sources, proof AS does_not_prove FROM f0)
"""
_FLAG = "path, rule_id, severity, confidence, title, explanation, vals, sources, does_not_prove"


def _flags(column: str):
    """A row a flag, with its values as ``key=value`` and its sources, joined."""

    def rows(df: DataFrame) -> DataFrame:
        values = F.array_join(F.transform(F.map_entries("f.values"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "|").alias("vals")
        each = flagged(analyzed(df)).select("path", F.explode(column).alias("f"))
        return each.select("path", "f.rule_id", "f.severity", "f.confidence", "f.title", "f.explanation", values, F.array_join("f.sources", "|").alias("sources"), "f.does_not_prove")

    return rows


for _name, _column, _rule in (
    ("rule_timestamp_conflict", "f_time", "timestamp-conflict"), ("rule_gps_timezone", "f_zone", "gps-timezone-implausible"), ("rule_device_mismatch", "f_device", "device-identity-mismatch"),
    ("rule_serial_conflict", "f_serial", "serial-number-conflict"), ("rule_software_chain", "f_software", "software-chain-resave"), ("rule_thumbnail_mismatch", "f_thumb", "thumbnail-mismatch"),
):
    ev(_name, _ZONE + f"SELECT {_FLAG} FROM fl WHERE rule_id = '{_rule}'")(_flags(_column))
ev("detect_anomalies", _ZONE + f"SELECT {_FLAG} FROM fl")(_flags("flags"))
ev("gps_timezone_notes", f"""SELECT path, '{rules.NO_ZONE}' AS note FROM n WHERE gps_valid AND NOT (k <> 99 AND x_off IS NOT NULL AND k % 2 = 1) AND user_id % 3 = 0 AND (iptc_time IS NULL OR k % 7 = 1)""")(
    lambda df: flagged(analyzed(df.withColumns({"offset_raw": F.when(c("k") % 2 == 1, c("offset_raw")), "xmp_raw": F.when(c("user_id") % 3 == 0, F.rtrim("xmp_raw", F.lit("Z"))).otherwise(c("xmp_raw")),
                                                "iptc_time": F.when(c("k") % 7 == 1, F.substring("iptc_time", 1, 6)).otherwise(c("iptc_time"))}))).where("zone_note is not null").select("path", c("zone_note").alias("note")))
ev("high_flag_findings", _ZONE + "SELECT path, 'anomaly: ' || title AS title FROM fl WHERE severity = 'high'")(
    lambda df: _flags("flags")(df).where("severity = 'high'").select("path", F.concat(F.lit("anomaly: "), "title").alias("title")))
ev("thumbnail_compare", _ZONE + """SELECT path, coalesce(t1 = 'larger', false) AS larger, printf('%.4f', thumb_width / width)::DOUBLE AS scale, CASE WHEN abs(thumb_width / thumb_height - width / height) / (width / height) <= 0.05 THEN 'same' ELSE 'different' END AS aspect,
  CASE WHEN t2 THEN 'different' WHEN thumb_dqt = main_dqt AND thumb_dht = main_dht THEN 'same' ELSE 'unknown' END AS encoder FROM pn WHERE k % 3 <> 0""")(
    lambda df: flagged(analyzed(df)).select("path", F.explode("thumbs").alias("t")).select("path", "t.larger", "t.scale", "t.aspect", "t.encoder"))

# batch reports -------------------------------------------------------------------------------------------------------

ev("status_counts", "SELECT status, count(*) AS n FROM ev GROUP BY status")(lambda df: df.groupBy("status").agg(F.count("*").alias("n")))
ev("by_format", "SELECT format, count(*) AS n FROM ev WHERE status = 'ok' GROUP BY format")(lambda df: batch.ok(df).groupBy("format").agg(F.count("*").alias("n")))
ev("has_gps", "SELECT path, has_gps FROM ev WHERE status = 'ok'")(lambda df: batch.ok(df).select("path", (c("lat").isNotNull() & c("lon").isNotNull()).alias("has_gps")))
ev("batch_summary", """SELECT count(*) AS scanned, count(*) FILTER (WHERE status = 'ok') AS analyzed, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'error') AS errors,
  count(*) FILTER (WHERE status = 'ok' AND has_gps) AS with_gps, count(*) FILTER (WHERE status = 'ok' AND 'differ' IN (s_time, s_make, s_model, s_software)) AS with_conflicts FROM g""")(
    lambda df: batch.counters(analyzed(df), F.lit(0), F.lit(0)).select("scanned", "analyzed", "skipped", "errors", "with_gps", "with_conflicts"))
ev("batch_totals", _ZONE + """, fc AS (SELECT path, count(*) AS n FROM fl GROUP BY path), du AS (SELECT count(*) AS n FROM ev WHERE status = 'ok' GROUP BY sha256 HAVING count(*) > 1)
  SELECT count(*) FILTER (WHERE n > 0) AS with_anomalies, coalesce(sum(n), 0)::BIGINT AS anomaly_flags, count(*) FILTER (WHERE thumbnail_count > 0) AS with_thumbnails, sum(thumbnail_count)::BIGINT AS thumbnails,
    (SELECT count(*) FROM du) AS duplicate_groups, coalesce((SELECT sum(n)::BIGINT FROM du), 0) AS duplicate_files FROM g LEFT JOIN fc USING (path) WHERE status = 'ok'""")(
    lambda df: batch.totals(flagged(analyzed(df)), F.size("raised")).select("with_anomalies", "anomaly_flags", "with_thumbnails", "thumbnails", "duplicate_groups", "duplicate_files"))
ev("anomaly_totals", _ZONE + "SELECT count(*) AS flags, count(DISTINCT path) AS files FROM fl")(
    lambda df: flagged(analyzed(df)).agg(F.sum(F.size("flags")).alias("flags"), F.count_if(F.size("flags") > 0).alias("files")))
_GROUPS = "SELECT {0} AS key, arg_min({1}, path) AS display, count(*) AS n FROM g WHERE status = 'ok' GROUP BY {0}"
for _name, _key, _display in (("device", "device_key", "device_display"), ("capture_day", "capture_day", "capture_day_display")):
    ev(f"group_by_{_name}", _GROUPS.format(_key, _display), ok_analyzed)(lambda a, _k=_key, _d=_display: batch.buckets(a, _k, _d))
    ev(f"group_by_{_name}_members", f"SELECT {_key} AS key, path FROM g WHERE status = 'ok'", ok_analyzed)(lambda a, _k=_key: batch.members(a, _k))
ev("by_device_display", "SELECT display, arg_max(n, key) AS n FROM (" + _GROUPS.format("device_key", "device_display") + ") GROUP BY display", ok_analyzed)(lambda a: batch.display_counts(batch.buckets(a, "device_key", "device_display")))
_CELL = "printf('%.2f', lat) || ',' || printf('%.2f', lon)"
ev("location_cell", f"SELECT path, {_CELL} AS key, '~' || printf('%.2f', lat) || ', ' || printf('%.2f', lon) || ' (approx. 1 km cell)' AS label, printf('%.2f', lat)::DOUBLE AS cell_lat FROM ev WHERE gps_valid")(
    lambda df: batch.with_location(df).where("location_key is not null").select("path", c("location_key").alias("key"), c("location_label").alias("label"), geo.rounded(c("lat")).alias("cell_lat")))
ev("group_by_location", f"SELECT {_CELL} AS key, '~' || printf('%.2f', any_value(lat)) || ', ' || printf('%.2f', any_value(lon)) || ' (approx. 1 km cell)' AS display, count(*) AS n FROM ev WHERE gps_valid AND status = 'ok' GROUP BY 1")(
    lambda df: batch.buckets(batch.with_location(batch.ok(df)), "location_key", "location_label"))
ev("group_by_location_members", f"SELECT {_CELL} AS key, path FROM ev WHERE gps_valid AND status = 'ok'")(lambda df: batch.members(batch.with_location(batch.ok(df)), "location_key"))


ev("timeline_sort_key", """SELECT path, 0 AS pos, CASE WHEN x_utc IS NOT NULL THEN 0 WHEN x_wall IS NOT NULL THEN 1 ELSE 2 END AS rank, coalesce(x_utc, x_wall, exif_raw) AS key FROM n
  UNION ALL SELECT path, 1, 0, m_utc FROM n UNION ALL SELECT path, 2, CASE WHEN i_utc IS NULL THEN 1 ELSE 0 END, coalesce(i_utc, i_wall) FROM n""", analyzed)(lambda a: batch.timeline(a).select("path", "pos", "rank", "key"))
_LINE = """, tl AS (SELECT path, filename, status, capture_day, 0 AS pos, CASE WHEN x_utc IS NOT NULL THEN 0 WHEN x_wall IS NOT NULL THEN 1 ELSE 2 END AS rank, coalesce(x_utc, x_wall, exif_raw) AS key, coalesce(x_utc, x_wall, '') AS timestamp,
  'EXIF DateTimeOriginal' AS source, CASE WHEN x_utc IS NULL THEN 'naive' ELSE 'explicit' END AS timezone_status, """ + _X_RAW + """ AS raw FROM d
  UNION ALL SELECT path, filename, status, capture_day, 1, 0, m_utc, m_utc, 'XMP xmp:CreateDate', 'explicit', xmp_raw FROM d
  UNION ALL SELECT path, filename, status, capture_day, 2, CASE WHEN i_utc IS NULL THEN 1 ELSE 0 END, coalesce(i_utc, i_wall), coalesce(i_utc, i_wall), 'IPTC DateCreated/TimeCreated', CASE WHEN i_utc IS NULL THEN 'naive' ELSE 'explicit' END, iptc_date || coalesce(' ' || iptc_time, '') FROM d) """
ev("cross_image_timeline", _LINE + "SELECT path, filename, pos, rank, key FROM tl WHERE status = 'ok'", ok_analyzed)(lambda a: batch.ordered(batch.timeline(a)).select("path", "filename", "pos", "rank", "key"))
ev("search_timeline", _LINE + "SELECT path, filename, pos, rank, key FROM tl WHERE status = 'ok' AND capture_day BETWEEN '2024-01-05' AND '2024-01-20'", ok_analyzed)(
    lambda a: batch.ordered(batch.timeline(a.where(search.Filters(date_range=("2024-01-05", "2024-01-20")).predicate()))).select("path", "filename", "pos", "rank", "key"))
ev("timeline_csv", _LINE + "SELECT path, filename, timestamp, source, 'capture' AS label, timezone_status, raw FROM tl WHERE status = 'ok'", ok_analyzed)(lambda a: batch.timeline(a).select(*batch.TIMELINE_CSV))
ev("file_timeline", _LINE + "SELECT path, row_number() OVER (PARTITION BY path ORDER BY rank, key, pos) - 1 AS place, source, timestamp FROM tl", analyzed)(
    lambda a: batch.file_timeline(a).select("path", c("place").cast("long").alias("place"), "source", F.coalesce("value_utc", "wall", F.lit("")).alias("timestamp")))
ev("first_capture_window", "SELECT device_key, min(path) AS path FROM g WHERE status = 'ok' GROUP BY device_key", ok_analyzed)(lambda a: batch.first_by(a.select("device_key", "path"), "device_key", "path"))
_DONE = ", ".join(f"CASE WHEN status = 'ok' THEN nullif(({x})::VARCHAR, '') END AS {n}" for n, x in (
    ("format", "format"), ("width", "width"), ("height", "height"), ("size_bytes", "size_bytes"), ("sha256", "g.sha256"), ("make", "p_make"), ("model", "p_model"), ("software", "p_software"), ("capture_day", "nullif(capture_day, 'unknown')"),
    ("gps_latitude", "lat"), ("gps_longitude", "lon"), ("thumbnails", "nullif(thumbnail_count, 0)"), ("warnings", "warning_count")))
ev("batch_csv", f"""SELECT path, filename, status, {_DONE}, substr(x.sha256, 1, 16) AS duplicate_group, CASE WHEN status <> 'ok' THEN error END AS error
  FROM g LEFT JOIN (SELECT sha256 FROM ev WHERE status = 'ok' GROUP BY sha256 HAVING count(*) > 1) x ON status = 'ok' AND x.sha256 = g.sha256""")(lambda df: batch.csv_rows(analyzed(df)))

# search --------------------------------------------------------------------------------------------------------------

_RECORD = """path, filename, sha256, format, coalesce(p_make, '') AS device_make, coalesce(p_model, '') AS device_model, device_display, capture_day, capture_day_display, lat AS gps_lat, lon AS gps_lon, has_gps, gps_valid, (2 + (x_wall IS NOT NULL OR exif_raw <> '')::INT) AS stamps,
  thumbnail_count, coalesce((SELECT string_agg(rule_id, ',' ORDER BY o) FROM (SELECT DISTINCT f.path, f.rule_id, f.o FROM fl f) y WHERE y.path = g.path), '') AS anomaly_rule_ids, caption, array_to_string(keywords, ',') AS keywords, coalesce(software_raw, '') AS software, coalesce(title, '') AS title"""


def records(df: DataFrame) -> DataFrame:
    """Index records: what search runs on."""
    return index.records(ok_flagged(df).withColumn("anomaly_rule_ids", rule_ids()))


def shown(r: DataFrame) -> DataFrame:
    """Records with their lists as texts, and the number of timestamps in place of these."""
    lists = {"timestamps": F.size("timestamps").alias("stamps"), "anomaly_rule_ids": F.array_join("anomaly_rule_ids", ",").alias("anomaly_rule_ids"), "keywords": F.array_join("keywords", ",").alias("keywords")}
    return r.select(*(lists.get(n, c(n)) for n in index.RECORD))


def roundtrip(r: DataFrame) -> DataFrame:
    """The records written as an index and read back."""
    place = shared_dir(r.sparkSession, "index")
    index.write_index(r, place)
    return index.read_index(r.sparkSession, place)


ev("build_index_record", _ZONE + f"SELECT {_RECORD} FROM g WHERE status = 'ok'", records)(shown)
ev("index_roundtrip", _ZONE + f"SELECT {_RECORD} FROM g WHERE status = 'ok'", records)(lambda r: shown(roundtrip(r)))


def searched(name: str, sql: str, filters: search.Filters) -> None:
    ev(name, _ZONE + f"SELECT path FROM g WHERE status = 'ok' AND {sql}", records)(lambda r: r.where(filters.predicate()).select("path"))


searched("filter_device", "contains(lower(device_display), 'canon')", search.Filters(device="Canon"))
searched("filter_date", "capture_day = '2024-01-10'", search.Filters(date="2024-01-10"))
searched("filter_date_range", "capture_day BETWEEN '2024-01-05' AND '2024-01-20'", search.Filters(date_range=("2024-01-05", "2024-01-20")))
searched("filter_gps", "has_gps", search.Filters(gps_only=True))
searched("filter_anomaly", "path IN (SELECT path FROM fl WHERE rule_id = 'serial-number-conflict')", search.Filters(anomaly="serial-number-conflict"))
_TEXT = "(contains(lower(caption), 'harbour') OR len(list_filter(keywords, lambda v: contains(lower(v), 'harbour'))) > 0 OR contains(lower(coalesce(p_make, '') || '|' || coalesce(p_model, '') || '|' || coalesce(software_raw, '') || '|' || coalesce(title, '') || '|' || device_display), 'harbour'))"
searched("filter_text", _TEXT, search.Filters(text="HARBOUR"))
_SOME = hashlib.sha256(b"7").hexdigest()
searched("filter_hash", f"starts_with(sha256, '{_SOME[:10]}')", search.Filters.parsed(hash=_SOME[:10].upper()))
_HAVERSINE = "2 * 6371.0 * asin(sqrt(least(pow(sin(radians(20.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(20.0)) * pow(sin(radians(10.0 - lon) / 2), 2), 1.0)))"
searched("filter_near", "has_gps AND " + _HAVERSINE.replace("20.0", "-72.0").replace("10.0", "-65.0") + " <= 900", search.Filters.parsed(near="-72,-65,900"))
searched("filters_compose", f"contains(lower(device_display), 'canon') AND has_gps AND {_TEXT} AND capture_day BETWEEN '2024-01-01' AND '2024-06-30'", search.Filters(device="canon", gps_only=True, text="harbour", date_range=("2024-01-01", "2024-06-30")))

ev("grid_cell", "SELECT path, floor(lat / 0.01)::BIGINT AS y, floor(lon / 0.01)::BIGINT AS x FROM ev WHERE has_gps")(lambda df: df.where("has_gps").select("path", geo.cell(c("lat")).alias("y"), geo.cell(c("lon")).alias("x")))
ev("haversine", f"SELECT path, round({_HAVERSINE}, 6) AS km FROM ev WHERE has_gps")(lambda df: df.where("has_gps").select("path", F.round(geo.haversine(c("lat"), c("lon"), F.lit(20.0), F.lit(10.0)), 6).alias("km")))
_CELLS = ", cells AS (SELECT DISTINCT floor(lat / 0.01)::BIGINT AS y, floor(lon / 0.01)::BIGINT AS x FROM ev WHERE has_gps AND status = 'ok') "


@ev("cell_neighbors", _CELLS + "SELECT a.y, a.x, count(*) - 1 AS n FROM cells a JOIN cells b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.y, a.x")
def cell_neighbors(df: DataFrame) -> DataFrame:
    cells = batch.ok(df).where("has_gps").select(geo.cell(c("lat")).alias("y"), geo.cell(c("lon")).alias("x")).distinct()
    step = F.explode(F.expr("flatten(transform(sequence(-1, 1), a -> transform(sequence(-1, 1), b -> struct(a as dy, b as dx))))"))
    reach = cells.withColumn("s", step).select((c("y") + c("s.dy")).alias("y"), (c("x") + c("s.dx")).alias("x"))
    return cells.join(reach.groupBy("y", "x").agg((F.count("*") - 1).alias("n")), ["y", "x"])


_COMPONENTS = _CELLS + """, r AS (SELECT y AS y0, x AS x0, y, x FROM cells UNION SELECT r.y0, r.x0, cells.y, cells.x FROM r JOIN cells ON abs(r.y - cells.y) <= 1 AND abs(r.x - cells.x) <= 1),
l AS (SELECT y, x, min((y0 + 100000) * 1000000 + x0 + 100000) AS label FROM r GROUP BY y, x) """
ev("cluster_components", _COMPONENTS + "SELECT y, x, label FROM l")(
    lambda df: search.cell_components(batch.ok(df).where("has_gps")).select("y", "x", ((c("label.y") + 100000) * 1000000 + c("label.x") + 100000).alias("label")))
_POINTS = _COMPONENTS + ", p AS (SELECT l.label, g.* FROM g JOIN l ON floor(g.lat / 0.01)::BIGINT = l.y AND floor(g.lon / 0.01)::BIGINT = l.x WHERE g.status = 'ok' AND has_gps), ce AS (SELECT label, avg(lat) AS clat, avg(lon) AS clon FROM p GROUP BY label) "
_AWAY = "2 * 6371.0 * asin(sqrt(least(pow(sin(radians(lat - clat) / 2), 2) + cos(radians(clat)) * cos(radians(lat)) * pow(sin(radians(lon - clon) / 2), 2), 1.0)))"


def _label() -> Column:
    return ((c("label.y") + 100000) * 1000000 + c("label.x") + 100000).alias("label")


ev("cluster_locations", _POINTS + f"""SELECT label, round(any_value(clat), 10) AS center_lat, round(any_value(clon), 10) AS center_lon, round(max({_AWAY}), 4) AS radius_km, count(*) AS n, min(capture_day) AS first_day, max(capture_day) AS last_day
  FROM p JOIN ce USING (label) GROUP BY label""", ok_analyzed)(
    lambda a: search.clusters(a.where("has_gps"))[0].select(_label(), F.round("center_lat", 10).alias("center_lat"), F.round("center_lon", 10).alias("center_lon"), F.round("radius_km", 4).alias("radius_km"), "n", "first_day", "last_day"))
ev("cluster_members", _POINTS + "SELECT label, path FROM p", ok_analyzed)(lambda a: search.clusters(a.where("has_gps"))[1].select(_label(), "path"))
