"""The evidence view: image-like records derived from ``events`` by arithmetic, and all that is normalized from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenix.functions import compare, device, time
from provenix.operators import rules

MAKES = ("CANON INC.", "canon", "Nikon Corporation", "SONY", "Acme-Cam", None, "FUJI", "OM SYSTEM")
MODELS = ("EOS R5", "Canon EOS R5", "Z 9", "", "X100V", None)
SOFTWARE = ("Editor 1.0", "Editor 2.1", "Shop Pro v3", None, "")
OFFSETS = (None, "+02:00", "-0800", "Z", "bogus")
SHIFTS = (23, 113, 7200, 259200)
FORMATS = {"click": "JPEG", "view": "PNG", "purchase": "TIFF", "signup": "WEBP"}


def _pick(values: tuple, at: Column) -> Column:
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), at.cast("int"))


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are evaluated once: what refers to them cannot be merged below the generator, so plans stay small.

    They are of a projection under it, which compiles in parts and shares what they have in common; an argument of
    the generator would be interpreted, wherever a stage is too large to be compiled as a whole. Methods of over
    8,000 bytes are never made machine code by the JVM, so a stage that has one is run operator by operator.
    """
    df.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return df.withColumns(columns).select("*", F.explode(F.array(F.lit(True))).alias("_once")).drop("_once")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record an event, as observed."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    cores = spark.sparkContext.defaultParallelism
    if e.rdd.getNumPartitions() < cores:  # a small file: what follows is all computation, so it is dealt out
        e = e.repartition(cores, "event_id")
    k = F.regexp_extract("props", r'"k": *(\d+)', 1).cast("int")
    e = e.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), k.alias("k"))
    u, k, name = F.col("user_id"), F.col("k"), F.concat(F.lpad(F.col("event_id").cast("string"), 8, "0"), F.lit(".img"))
    shifted = F.timestamp_add("SECOND", F.get(F.array(*(F.lit(s) for s in SHIFTS)), k % 4), F.col("ts"))
    return e.select(
        "event_id", "user_id", "k", "ts", F.concat(F.lit("/evidence/"), name).alias("path"), name.alias("filename"), F.sha2((F.col("event_id") % 3000).cast("string"), 256).alias("sha256"),
        F.coalesce(*(F.when(F.col("event_type") == t, f) for t, f in FORMATS.items()), F.lit("UNKNOWN")).alias("format"),
        F.when(F.col("event_type") == "error", "skipped").when(k == 0, "error").otherwise("ok").alias("status"),
        _pick(MAKES, u % 8).alias("make_raw"), _pick(MODELS, u % 6).alias("model_raw"), _pick(SOFTWARE, k % 5).alias("software_raw"),
        _pick(MAKES, (u + k % 3) % 8).alias("xmp_make_raw"), _pick(MODELS, (u + k % 2) % 6).alias("xmp_model_raw"), _pick(SOFTWARE, (u + k) % 5).alias("xmp_tool_raw"),
        F.when(k == 99, "not a date").when(k == 98, "2024:02:31 10:00:00").otherwise(F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).alias("exif_raw"),
        F.when(k != 98, _pick(OFFSETS, k % 5)).alias("offset_raw"), F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("xmp_raw"),
        F.date_format("ts", "yyyyMMdd").alias("iptc_date"), F.when(k % 3 != 0, F.concat(F.date_format("ts", "HHmmss"), F.lit("+0000"))).alias("iptc_time"),
        (k % 4 != 0).alias("has_gps"), ((k % 4 != 0) & (k % 25 != 7)).alias("gps_valid"), F.when(k % 4 != 0, ((u * 7919) % 160000 - 80000 + k % 20) / 1000.0).alias("lat"), F.when(k % 4 != 0, ((u * 104729) % 340000 - 170000 + k % 10) / 1000.0).alias("lon"),
        F.concat(F.lit("Caption "), F.when(k % 2 == 0, "Harbour").otherwise("mountain"), F.lit(" view")).alias("caption"),
        F.array(F.when(k % 7 == 0, "Sea").otherwise("land"), F.concat(F.lit("k"), (k % 10).cast("string"))).alias("keywords"),
        F.concat(F.lit("S"), (u % 4).cast("string")).alias("body_serial"), F.when(k % 6 != 0, F.concat(F.lit(" S"), (k % 4).cast("string"))).alias("aux_serial"),
        (F.lit(640) + k * 10).alias("width"), (F.lit(480) + (u % 50) * 10).alias("height"), F.when(k % 3 != 0, F.lit(160) + (u % 3) * 600).alias("thumb_width"), F.when(k % 3 != 0, F.lit(120) + k % 40).alias("thumb_height"),
        F.lit(2).alias("main_dqt"), (k % 2 == 0).alias("main_dht"), F.when(k % 9 != 0, 1 + k % 2).alias("thumb_dqt"), (u % 2 == 0).alias("thumb_dht"), (k % 5 != 0).alias("thumb_claimed"),
        F.when(k % 5 == 1, F.concat(F.lit("Title "), (k % 3).cast("string"))).alias("title"), (F.lit(1000) + k).alias("size_bytes"), F.when(k % 3 != 0, 1).otherwise(0).alias("thumbnail_count"), (k % 3).alias("warning_count"),
        F.when(F.col("event_type") == "error", "not a recognized image format (magic bytes)").when(k == 0, "cannot be read").alias("error"),
    )


def claims(df: DataFrame, others: dict[str, Column] | None = None) -> DataFrame:
    """Adds the claims (and others) once: those of capture time (t_x of EXIF, t_m of XMP, t_i of IPTC) and of the device (c_x, c_m); null where a source makes none."""
    c = F.col
    steps: list[dict[str, Column]] = [{}, {}, {}]

    def keep(value: Column, step: int) -> Column:
        name = f"_kept{step}_{len(steps[step])}"
        steps[step][name] = value
        return c(name)

    each = (others or {}) | {
        "t_x": time.normalize_exif(c("exif_raw"), c("offset_raw"), "capture", time.CAPTURE_SOURCES[0], keep), "t_m": time.normalize_xmp(c("xmp_raw"), "capture", time.CAPTURE_SOURCES[1], keep),
        "t_i": time.normalize_iptc(c("iptc_date"), c("iptc_time"), time.CAPTURE_SOURCES[2], keep), "c_x": device.device_claim(device.EXIF_SOURCE, c("make_raw"), c("model_raw"), c("software_raw"), keep),
        "c_m": device.device_claim(device.XMP_SOURCE, c("xmp_make_raw"), c("xmp_model_raw"), c("xmp_tool_raw"), keep),
    }
    for columns in (*steps, each):
        df = computed(df, columns)
    return df.drop(*(name for columns in steps for name in columns))


def analyzed(ev: DataFrame, others: dict[str, Column] | None = None) -> DataFrame:
    """Adds claims, all timestamps in the order of their sources, statuses, comparison, device and day; ``failed`` marks impossible instants.

    Claims are computed once; of what follows from them each column only where it is asked for. ``others`` are the claims beside
    those of capture time, by name; names sort as their sources do, with t_x, t_m and t_i among them.
    """
    out = claims(ev, others)
    names = sorted({"t_x": "t_1", "t_m": "t_4", "t_i": "t_6"}.get(n, n) + "|" + n for n in ("t_x", "t_m", "t_i", *(others or {})))
    stamps = [F.col(n.partition("|")[2]) for n in names]
    capture, own = [F.col(n) for n in rules.STAMPS], [F.col("c_x"), F.col("c_m")]
    preferred = F.coalesce(*own)
    key, display = device.key_and_display(preferred)
    day, day_display = time.capture_day(*capture)
    out = out.withColumns(compare.statuses(capture, own))
    return out.withColumns({
        "timestamps": F.array_compact(F.array(*stamps)), "claims": F.array_compact(F.array(*own)), "comparison": compare.facts(), "device_key": key, "device_display": display, "device_make": F.coalesce(preferred["make_norm"], F.lit("")),
        "device_model": F.coalesce(preferred["model_norm"], F.lit("")), "device_software": F.coalesce(preferred["software_norm"], F.lit("")), "capture_day": day, "capture_day_display": day_display,
        "failed": time.impossible(*stamps), "has_conflicts": compare.differs(),
    })


def flagged(a: DataFrame, tolerance_s: float = rules.TOLERANCE_S) -> DataFrame:
    """Adds the flags of every rule, in the rules' order, the rule id of each flag without its texts (``raised``), and the note on time zones. ``thumbs`` are the thumbnails' facts, or the view's one."""
    if not tolerance_s >= 0:
        raise ValueError("tolerance must be >= 0")
    c = F.col
    first = rules.instants() | {"zone": rules.zone_claim()}
    then = {"widest": rules.widest_pair(), "zone_hours": rules.zone_hours(c("zone")), "located": c("has_gps") & c("gps_valid")}
    if "thumbs" not in a.columns:
        compared = rules.compare_thumbnail(*(c(n) for n in ("thumb_width", "thumb_height", "width", "height", "thumb_dqt", "thumb_dht", "main_dqt", "main_dht")))
        facts = {"index": F.lit(0), "source": F.lit("EXIF IFD1 (JPEG blob)"), "width": c("thumb_width"), "height": c("thumb_height"), "sha256": c("sha256"), "dqt": c("thumb_dqt"), "dht": c("thumb_dht")} | {n: compared[n] for n in ("larger", "aspect", "off", "scale", "encoder")}
        first["thumbs"] = F.array_compact(F.array(F.when(c("thumb_width").isNotNull(), F.struct(*(x.alias(n) for n, x in facts.items())))))
    a = computed(computed(a, first).withColumns(rules.pairs()), then).drop(*rules.pairs(), *rules.instants())
    sizes = c("width"), c("height"), c("thumb_claimed"), c("thumbs")
    a = a.withColumns({
        "f_time": rules.timestamp_conflict(c("widest"), tolerance_s), "f_zone": rules.gps_timezone(c("zone"), c("zone_hours"), c("located"), c("lon")), "f_device": rules.device_mismatch(),
        "f_serial": rules.serial_conflict(c("body_serial"), c("aux_serial")), "f_software": rules.software_chain(c("software_raw"), c("xmp_tool_raw")),
        "f_thumb": rules.thumbnail_mismatch(*sizes, c("main_dqt"), c("main_dht"), c("thumbnail_warnings") if "thumbnail_warnings" in a.columns else None),
        "zone_note": rules.gps_timezone_note(c("zone"), c("located")),
        "raised": rules.raised({
            "timestamp-conflict": rules.apart(c("widest"), tolerance_s), "gps-timezone-implausible": rules.off_zone(c("zone_hours"), c("located"), c("lon")), "device-identity-mismatch": rules.devices_differ(),
            "serial-number-conflict": rules.serials_differ(c("body_serial"), c("aux_serial")), "software-chain-resave": rules.editors_differ(c("software_raw"), c("xmp_tool_raw")), "thumbnail-mismatch": rules.thumbnail_flags(*sizes),
        }),
    })
    return a.withColumn("flags", F.concat(*(c(n) for n in RULES)))


#: Columns of each rule's flags, in order.
RULES = ("f_time", "f_zone", "f_device", "f_serial", "f_software", "f_thumb")


def rule_ids() -> Column:
    """The ids of the rules that raised a flag, in order."""
    return F.array_distinct("raised")


def _values(values: tuple, at: str) -> str:
    return f"([{', '.join('NULL' if v is None else repr(v) for v in values)}])[({at}) + 1]"


_KEY = "nullif(regexp_replace(lower({0}), '[^a-z0-9]', '', 'g'), '')"
_CLEAN = "nullif(trim({0}), '')"
_BASE = "trim(regexp_replace(nullif(trim({0}), ''), '\\s+(inc\\.?|incorporated|corp\\.?|corporation|limited|gmbh)$', '', 'i'))"


def _device_sql(p: str, make: str, model: str, software: str) -> str:
    base = _BASE.format(make)
    known = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in device.MAKES.items())
    return f"""{base} AS {p}base, coalesce(CASE replace(replace(upper({base}), ' ', ''), '-', '') {known} END, {base}) AS {p}make, {_KEY.format(base)} AS {p}make_key,
    CASE WHEN {_KEY.format(base)} IS NOT NULL AND {_KEY.format(model)} IS NOT NULL AND NOT starts_with({_KEY.format(model)}, {_KEY.format(base)})
         THEN coalesce(CASE replace(replace(upper({base}), ' ', ''), '-', '') {known} END, {base}) || ' ' || {_CLEAN.format(model)} ELSE {_CLEAN.format(model)} END AS {p}model,
    {_CLEAN.format(software)} AS {p}software, {_KEY.format(software)} AS {p}software_key"""


#: The view in DuckDB SQL: ev as observed, n with normalized columns (x: EXIF, m: XMP, i: IPTC), d with one row of comparisons and rules.
EV_SQL = f"""
e AS (SELECT event_id, user_id, event_type, ts, regexp_extract(props, '"k": *(\\d+)', 1)::INT AS k FROM events),
ev AS (SELECT event_id, user_id, k, ts, '/evidence/' || lpad(event_id::VARCHAR, 8, '0') || '.img' AS path, lpad(event_id::VARCHAR, 8, '0') || '.img' AS filename, sha256((event_id % 3000)::VARCHAR) AS sha256,
  CASE event_type WHEN 'click' THEN 'JPEG' WHEN 'view' THEN 'PNG' WHEN 'purchase' THEN 'TIFF' WHEN 'signup' THEN 'WEBP' ELSE 'UNKNOWN' END AS format,
  CASE WHEN event_type = 'error' THEN 'skipped' WHEN k = 0 THEN 'error' ELSE 'ok' END AS status,
  {_values(MAKES, 'user_id % 8')} AS make_raw, {_values(MODELS, 'user_id % 6')} AS model_raw, {_values(SOFTWARE, 'k % 5')} AS software_raw,
  {_values(MAKES, '(user_id + k % 3) % 8')} AS xmp_make_raw, {_values(MODELS, '(user_id + k % 2) % 6')} AS xmp_model_raw, {_values(SOFTWARE, '(user_id + k) % 5')} AS xmp_tool_raw,
  CASE k WHEN 99 THEN 'not a date' WHEN 98 THEN '2024:02:31 10:00:00' ELSE strftime(ts, '%Y:%m:%d %H:%M:%S') END AS exif_raw,
  CASE WHEN k <> 98 THEN {_values(OFFSETS, 'k % 5')} END AS offset_raw, strftime(ts + to_seconds(([23, 113, 7200, 259200])[k % 4 + 1]), '%Y-%m-%dT%H:%M:%SZ') AS xmp_raw,
  strftime(ts, '%Y%m%d') AS iptc_date, CASE WHEN k % 3 <> 0 THEN strftime(ts, '%H%M%S') || '+0000' END AS iptc_time, k % 4 <> 0 AS has_gps, k % 4 <> 0 AND k % 25 <> 7 AS gps_valid,
  CASE WHEN k % 4 <> 0 THEN ((user_id * 7919) % 160000 - 80000 + k % 20) / 1000.0::DOUBLE END AS lat, CASE WHEN k % 4 <> 0 THEN ((user_id * 104729) % 340000 - 170000 + k % 10) / 1000.0::DOUBLE END AS lon,
  'Caption ' || CASE WHEN k % 2 = 0 THEN 'Harbour' ELSE 'mountain' END || ' view' AS caption, [CASE WHEN k % 7 = 0 THEN 'Sea' ELSE 'land' END, 'k' || (k % 10)] AS keywords,
  'S' || (user_id % 4) AS body_serial, CASE WHEN k % 6 <> 0 THEN ' S' || (k % 4) END AS aux_serial, 640 + k * 10 AS width, 480 + (user_id % 50) * 10 AS height,
  CASE WHEN k % 3 <> 0 THEN 160 + (user_id % 3) * 600 END AS thumb_width, CASE WHEN k % 3 <> 0 THEN 120 + k % 40 END AS thumb_height, 2 AS main_dqt, k % 2 = 0 AS main_dht,
  CASE WHEN k % 9 <> 0 THEN 1 + k % 2 END AS thumb_dqt, user_id % 2 = 0 AS thumb_dht, k % 5 <> 0 AS thumb_claimed,
  CASE WHEN k % 5 = 1 THEN 'Title ' || (k % 3) END AS title, 1000 + k AS size_bytes, CASE WHEN k % 3 <> 0 THEN 1 ELSE 0 END AS thumbnail_count, k % 3 AS warning_count,
  CASE WHEN event_type = 'error' THEN 'not a recognized image format (magic bytes)' WHEN k = 0 THEN 'cannot be read' END AS error FROM e),
n0 AS (SELECT *, CASE WHEN k <> 99 THEN replace(substr(exif_raw, 1, 10), ':', '-') || 'T' || substr(exif_raw, 12) END AS x_wall,
  CASE offset_raw WHEN '+02:00' THEN 120 WHEN '-0800' THEN -480 WHEN 'Z' THEN 0 END AS x_off, xmp_raw AS m_utc, rtrim(xmp_raw, 'Z') AS m_wall,
  substr(iptc_date, 1, 4) || '-' || substr(iptc_date, 5, 2) || '-' || substr(iptc_date, 7) || CASE WHEN iptc_time IS NULL THEN '' ELSE 'T' || substr(iptc_time, 1, 2) || ':' || substr(iptc_time, 3, 2) || ':' || substr(iptc_time, 5, 2) END AS i_wall,
  {_device_sql('x_', 'make_raw', 'model_raw', 'software_raw')}, {_device_sql('m_', 'xmp_make_raw', 'xmp_model_raw', 'xmp_tool_raw')} FROM ev),
n AS (SELECT *, {_KEY.format('x_model')} AS x_model_key, {_KEY.format('m_model')} AS m_model_key,
  CASE WHEN x_wall IS NOT NULL AND x_off IS NOT NULL THEN strftime(strptime(x_wall, '%Y-%m-%dT%H:%M:%S') - to_minutes(x_off), '%Y-%m-%dT%H:%M:%SZ') END AS x_utc,
  CASE WHEN iptc_time IS NOT NULL THEN i_wall || 'Z' END AS i_utc,
  coalesce(nullif(make_raw, ''), nullif(model_raw, ''), nullif(software_raw, '')) IS NOT NULL AS x_claim,
  coalesce(nullif(xmp_make_raw, ''), nullif(xmp_model_raw, ''), nullif(xmp_tool_raw, '')) IS NOT NULL AS m_claim FROM n0),
d AS (SELECT *, CASE WHEN x_claim THEN x_make_key ELSE m_make_key END AS p_make_key, CASE WHEN x_claim THEN x_model_key ELSE m_model_key END AS p_model_key,
  CASE WHEN x_claim THEN coalesce(x_model, x_make || ' (model unknown)') ELSE coalesce(m_model, m_make || ' (model unknown)') END AS p_display,
  CASE WHEN x_claim THEN x_make ELSE m_make END AS p_make, CASE WHEN x_claim THEN x_model ELSE m_model END AS p_model, CASE WHEN x_claim THEN x_software ELSE m_software END AS p_software,
  CASE WHEN x_wall IS NULL THEN substr(m_utc, 1, 10) ELSE substr(coalesce(x_utc, x_wall), 1, 10) END AS capture_day,
  CASE WHEN x_wall IS NULL THEN substr(m_utc, 1, 10) WHEN x_utc IS NOT NULL THEN substr(x_utc, 1, 10) ELSE substr(x_wall, 1, 10) || ' (timezone unknown)' END AS capture_day_display,
  list_filter([CASE WHEN x_utc IS NOT NULL THEN 'utc:' || x_utc ELSE 'naive:' || x_wall END, 'utc:' || m_utc, CASE WHEN i_utc IS NOT NULL THEN 'utc:' || i_utc ELSE 'naive:' || i_wall END], lambda v: v IS NOT NULL) AS time_keys,
  list_filter([x_make_key, m_make_key], lambda v: v IS NOT NULL) AS make_keys, list_filter([x_model_key, m_model_key], lambda v: v IS NOT NULL) AS model_keys,
  list_filter([x_software_key, m_software_key], lambda v: v IS NOT NULL) AS software_keys FROM n),
g AS (SELECT *, CASE WHEN p_make_key IS NULL AND p_model_key IS NULL THEN 'unknown' ELSE coalesce(p_make_key, '?') || '/' || coalesce(p_model_key, '?') END AS device_key,
  CASE WHEN p_make_key IS NULL AND p_model_key IS NULL THEN 'unknown device' ELSE p_display END AS device_display,
  {', '.join(f"CASE len({c}) WHEN 0 THEN 'no-data' WHEN 1 THEN 'only-in-one-source' ELSE CASE WHEN len(list_distinct({c})) = 1 THEN 'agree' ELSE 'differ' END END AS {s}" for c, s in (('time_keys', 's_time'), ('make_keys', 's_make'), ('model_keys', 's_model'), ('software_keys', 's_software')))} FROM d)
"""
