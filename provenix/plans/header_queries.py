"""Queries over the natural tables: hashes, duplicates, headers, coordinates and ordered chunks."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenix.functions import geo, text
from provenix.operators import batch, files
from provenix.plans.registry import query, table
from provenix.sources import images, magic, storage, synthetic, xmp
from provenix.sources.shared import shared_dir

c = F.col


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


query("hash_sha256", "SELECT doc_id, sha256(text) AS sha256 FROM documents")(_documents)
#: The digest of ``abc``, the only one that SQL here can't compute; a test has it.
query("hash_sha512")(lambda spark, d: table(spark, d, "documents").select("doc_id", F.sha2("text", 512).alias("sha512")))
query("evidence_id", "SELECT doc_id, 'MT-' || substr(sha256(text), 1, 16) AS evidence_id FROM documents")(lambda s, d: _documents(s, d).select("doc_id", F.concat(F.lit("MT-"), F.substring("sha256", 1, 16)).alias("evidence_id")))
_SAME = "(SELECT sha256(text) AS h, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"
query("find_duplicates", f"SELECT h AS sha256, n FROM {_SAME}")(lambda s, d: batch.duplicates(_documents(s, d).where("sha256 is not null")))
query("duplicate_members", f"SELECT h AS key, doc_id FROM documents JOIN {_SAME} ON h = sha256(text)")(lambda s, d: batch.members(_documents(s, d), "sha256", "doc_id", batch.duplicates(_documents(s, d))))
query("duplicate_counts", f"SELECT count(*) AS duplicate_groups, coalesce(sum(n), 0)::BIGINT AS duplicate_files FROM {_SAME}")(lambda s, d: batch.duplicate_counts(batch.duplicates(_documents(s, d).where("sha256 is not null"))))
query("dup_left_join", f"SELECT doc_id, substr(h, 1, 16) AS duplicate_group FROM documents LEFT JOIN {_SAME} ON h = sha256(text)")(
    lambda s, d: _documents(s, d).join(batch.duplicates(_documents(s, d)).select("sha256", F.substring("sha256", 1, 16).alias("duplicate_group")), "sha256", "left").select("doc_id", "duplicate_group"))
query("text_decode_fallback")(lambda s, d: table(s, d, "documents").select("doc_id", text.decode_lenient(F.encode("text", "UTF-8")).alias("utf8"), text.decode_lenient(F.unhex(F.lit("ff41"))).alias("latin1")))

#: Header bytes of each event type, as hex: JPEG, PNG, WebP, TIFF, and a RIFF file that is no image.
_HEADERS = {"click": "FFD8FFE0", "view": "89504E470D0A1A0A", "purchase": "49492A00", "signup": "5249464600000000574542505650", "error": "5249464600000000415649"}
_HEX_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _HEADERS.items()) + " END"
_FORMAT_SQL = f"CASE WHEN starts_with({_HEX_SQL}, 'FFD8FF') THEN 'JPEG' WHEN starts_with({_HEX_SQL}, '89504E470D0A1A0A') THEN 'PNG' WHEN starts_with({_HEX_SQL}, '52494646') AND substr({_HEX_SQL}, 17, 8) = '57454250' THEN 'WEBP' WHEN starts_with({_HEX_SQL}, '49492A00') THEN 'TIFF' ELSE 'UNKNOWN' END"


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.coalesce(*(F.when(c("event_type") == k, F.unhex(F.lit(v))) for k, v in _HEADERS.items()))
    return table(spark, sf_dir, "events").select("event_id", magic.detect_format(content).alias("format"))


query("detect_format", f"SELECT event_id, {_FORMAT_SQL} AS format FROM events")(_headers)
query("supported_filter", f"SELECT event_id FROM events WHERE {_FORMAT_SQL} <> 'UNKNOWN'")(lambda s, d: _headers(s, d).where(c("format").isin(*magic.SUPPORTED)).select("event_id"))


def _png(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.concat(F.lpad(F.hex("p_partkey"), 8, "0"), F.lpad(F.hex(c("p_size").cast("long")), 8, "0"))
    return table(spark, sf_dir, "part").select("p_partkey", F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), size, F.lit("0802000000"))).alias("content"))


query("png_dimensions", "SELECT p_partkey, p_partkey AS width, p_size::BIGINT AS height FROM part WHERE p_partkey BETWEEN 1 AND 1000000 AND p_size BETWEEN 1 AND 1000000")(
    lambda s, d: _png(s, d).select("p_partkey", *(x.alias(n) for x, n in zip(magic.png_dimensions(c("content")), ("width", "height"), strict=True))).where("width is not null"))
query("identify", "SELECT p_partkey, 'PNG' AS format, 'image/png' AS mime, 'PNG (color type 2, bit depth 8)' AS encoding FROM part")(
    lambda s, d: _png(s, d).withColumn("format", magic.detect_format(c("content"))).select("p_partkey", "format", magic.mime(c("format")).alias("mime"),
        F.concat(F.lit("PNG (color type "), magic.unsigned(c("content"), 25, 1).cast("string"), F.lit(", bit depth "), magic.unsigned(c("content"), 24, 1).cast("string"), F.lit(")")).alias("encoding")))


def _dms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", (c("p_partkey") % 95).cast("double").alias("deg"), (c("p_size") * 1.5).alias("mi"), (c("p_partkey") % 6100 / 100.0).alias("se"), F.when(c("p_partkey") % 3 == 0, "S").otherwise("n").alias("ref"))


_DMS = "(CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE 1 END * (p_partkey % 95 + p_size * 1.5::DOUBLE / 60.0::DOUBLE + p_partkey % 6100 / 100.0::DOUBLE / 3600.0::DOUBLE))"
query("dms_to_decimal", f"SELECT p_partkey, round({_DMS}, 6) AS lat FROM part")(lambda s, d: _dms(s, d).select("p_partkey", F.round(geo.dms_to_decimal(c("deg"), c("mi"), c("se"), c("ref"), "N", "S"), 6).alias("lat")))
query("gps_validity", f"SELECT p_partkey, {_DMS} BETWEEN -90 AND 90 AND p_size * 1.5 < 60 AND p_partkey % 6100 / 100.0 < 60 AS valid FROM part")(
    lambda s, d: _dms(s, d).select("p_partkey", (geo.in_range(geo.dms_to_decimal(c("deg"), c("mi"), c("se"), c("ref"), "N", "S"), F.lit(0.0)) & (F.size(geo.dms_issues(c("deg"), c("mi"), c("se"))) == 0)).alias("valid")))
query("altitude_sign", "SELECT p_partkey, CASE WHEN (CASE WHEN p_size % 2 = 1 THEN -1 ELSE 1 END) * p_partkey BETWEEN -1000 AND 12000 THEN ((CASE WHEN p_size % 2 = 1 THEN -1 ELSE 1 END) * p_partkey)::DOUBLE END AS altitude FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", geo.altitude(c("p_partkey").cast("double"), c("p_size") % 2).alias("altitude")))
query("bearing_wrap", "SELECT p_partkey, ((p_partkey - 1000) % 360 + 360)::DOUBLE % 360 AS bearing FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", geo.bearing((c("p_partkey") - 1000).cast("double")).alias("bearing")))
query("osm_link", "SELECT p_partkey, printf('https://www.openstreetmap.org/?mlat=%.6f&mlon=%.6f#map=15/%.6f/%.6f', p_size + 0.25, p_partkey % 180 + 0.5, p_size + 0.25, p_partkey % 180 + 0.5) AS link FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", geo.osm_link(c("p_size") + F.lit(0.25).cast("double"), c("p_partkey") % 180 + F.lit(0.5).cast("double")).alias("link")))


@query("format_rational", "SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN '0' WHEN (p_size % 10) // gcd(p_partkey % 7, p_size % 10) = 1 THEN ((p_partkey % 7) // gcd(p_partkey % 7, p_size % 10))::VARCHAR ELSE ((p_partkey % 7) // gcd(p_partkey % 7, p_size % 10)) || '/' || ((p_size % 10) // gcd(p_partkey % 7, p_size % 10)) END AS shown FROM part")
def format_rational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fraction in lowest terms; the greatest common divisor by Euclid's steps, of which 48 suffice for 32-bit terms."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (c("p_partkey") % 7).alias("num"), (c("p_size") % 10).cast("long").alias("den"))
    step = lambda a, _: F.when(a["b"] == 0, a).otherwise(F.struct(a["b"].alias("a"), (a["a"] % F.when(a["b"] == 0, 1).otherwise(a["b"])).alias("b")))
    rows = rows.withColumn("g", F.aggregate(F.sequence(F.lit(1), F.lit(48)), F.struct(F.abs("num").alias("a"), F.abs("den").alias("b")), step, lambda a: a["a"]))
    n, m = (F.floor(c(x) / F.greatest("g", F.lit(1))).cast("long") for x in ("num", "den"))
    return rows.select("p_partkey", F.when(c("den") == 0, None).when(c("num") == 0, "0").when(m == 1, n.cast("string")).otherwise(F.concat(n.cast("string"), F.lit("/"), m.cast("string"))).alias("shown"))


#: EXIF orientations 1 to 8.
ORIENTATION = ("normal", "mirrored horizontally", "rotated 180°", "mirrored vertically", "mirrored horizontally and rotated 270° CW", "rotated 90° CW", "mirrored horizontally and rotated 90° CW", "rotated 270° CW")
_ORIENT = "([" + ", ".join(f"'{x}'" for x in ORIENTATION) + "])"
query("orientation_flash", f"SELECT p_partkey, {_ORIENT}[p_size % 9] AS orientation, p_partkey % 2 = 1 AS flash_fired FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", F.get(F.array(*map(F.lit, ORIENTATION)), c("p_size") % 9 - 1).alias("orientation"), (c("p_partkey").bitwiseAND(1) == 1).alias("flash_fired")))

query("chunk_reassembly", "SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn)) AS sha256, count(*) AS chunks FROM conversations GROUP BY conv_id")(
    lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("x")).select("conv_id", F.sha2(F.array_join(c("x.text"), ""), 256).alias("sha256"), F.size("x").cast("long").alias("chunks")))
query("missing_chunks", "SELECT c.conv_id, string_agg(i::VARCHAR, ',' ORDER BY i) AS missing FROM (SELECT conv_id, m, unnest(generate_series(0, m + 2)) AS i FROM (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY conv_id)) c WHERE NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn = i) GROUP BY c.conv_id")(
    lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.collect_set("turn").alias("seen"), F.max("turn").alias("m")).where("m >= -2").select("conv_id", F.array_join(F.transform(F.array_except(F.sequence(F.lit(0).cast("long"), c("m") + 2), "seen"), lambda x: x.cast("string")), ",").alias("missing")))


@query("near_join", "SELECT c_custkey, count(*) AS n FROM customer JOIN supplier ON 2 * 6371.0 * asin(sqrt(least(pow(sin(radians(s_suppkey % 170 - 85 - (c_custkey % 170 - 85)) / 2), 2) + cos(radians(c_custkey % 170 - 85)) * cos(radians(s_suppkey % 170 - 85)) * pow(sin(radians(s_suppkey % 350 - 175 - (c_custkey % 350 - 175)) / 2), 2), 1.0))) <= 500 GROUP BY c_custkey")
def near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points within 500 km: an equi-join on bands of latitude as high as the radius, each point in its band and the next ones, then the exact distance."""
    place = lambda key: ((c(key) % 170 - 85).cast("double"), (c(key) % 350 - 175).cast("double"))
    band = 500.0 / 111.0
    left = table(spark, sf_dir, "customer").select("c_custkey", *(x.alias(n) for x, n in zip(place("c_custkey"), ("lat", "lon"), strict=True))).withColumn("band", F.floor(c("lat") / band))
    right = table(spark, sf_dir, "supplier").select(*(x.alias(n) for x, n in zip(place("s_suppkey"), ("s_lat", "s_lon"), strict=True)))
    right = right.withColumn("band", F.explode(F.sequence(F.floor(c("s_lat") / band) - 1, F.floor(c("s_lat") / band) + 1)))
    return left.join(right, "band").where(geo.haversine(c("lat"), c("lon"), c("s_lat"), c("s_lon")) <= 500).groupBy("c_custkey").agg(F.count("*").alias("n"))


def _built(rows: DataFrame, build: Callable[[dict], list[tuple[str, bytes]]]) -> DataFrame:
    """(path, content) of the files built from each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [f for r in batch.to_pylist() for f in build(r)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.string()), pa.array([x for _, x in made], pa.binary())], names=["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


def _exif(r: dict) -> bytes:
    return synthetic.tiff(
        [(0x010F, 2, r["p_brand"]), (0x0110, 2, r["p_name"]), (0x0112, 3, r["p_size"] % 8 + 1)], [(0x9003, 2, "2026:09:14 18:42:07"), (0x8827, 3, r["p_size"] * 10), (0x829A, 5, [(10, r["p_size"] * 10)])],
        [(1, 2, "NS"[r["p_partkey"] % 2]), (2, 5, [(r["p_partkey"] % 90, 1), (30, 1), (0, 1)]), (3, 2, "E"), (4, 5, [(r["p_size"], 1), (15, 1), (0, 1)])], "<>"[r["p_partkey"] % 2])


def _parts(spark: SparkSession, sf_dir: str, build: Callable[[dict], bytes]) -> DataFrame:
    """A decoded file for each part, its metadata taken from the part."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    return images.extract(_built(rows, lambda r: [(str(r["p_partkey"]), build(r))]))


query("exif_extract", """SELECT p_partkey::VARCHAR AS path, 'ok' AS status, 'JPEG' AS format, 'JPEG (baseline DCT)' AS encoding, (p_size + 100)::BIGINT AS width, 48::BIGINT AS height, p_brand AS make, p_name AS model, (p_size % 8 + 1)::BIGINT AS orientation, (p_size * 10)::BIGINT AS iso,
  CASE p_size WHEN 1 THEN '1' ELSE '1/' || p_size END AS exposure_time, '2026:09:14 18:42:07' AS datetime_original, CASE WHEN p_partkey % 2 = 1 THEN -1 ELSE 1 END * (p_partkey % 90 + 0.5::DOUBLE) AS lat, p_size + 0.25::DOUBLE AS lon FROM part""")(
    lambda s, d: _parts(s, d, lambda r: synthetic.jpeg(_exif(r), r["p_size"] + 100)).select("path", "status", "format", "encoding", "width", "height", "make", "model", "orientation", "iso", "exposure_time", "datetime_original", "lat", "lon"))


def _packet(r: dict) -> bytes:
    """A packet in a JPEG, PNG (plain or packed) or WebP, by the part's key."""
    words = "".join(f"<rdf:li>{w}</rdf:li>" for w in ("sea", r["p_brand"]))
    body = f'<dc:subject><rdf:Bag>{words}</rdf:Bag></dc:subject><dc:title><rdf:Alt><rdf:li xml:lang="de">anders</rdf:li><rdf:li xml:lang="x-default">{escape(r["p_name"])}</rdf:li></rdf:Alt></dc:title><xmp:Rating>9</xmp:Rating>'
    text = synthetic.xmp({"xmp:CreateDate": "2026-09-14T18:42:07Z", "xmp:Rating": str(r["p_size"] % 6), "tiff:Make": r["p_brand"], "aux:SerialNumber": f"S{r['p_size']}"}, body)
    kind = r["p_partkey"] % 4
    if kind == 0:
        return synthetic.jpeg(None, segments=[(0xE1, xmp.JPEG_HEADER + text)])
    return synthetic.webp(text) if kind == 3 else synthetic.png([(b"iTXt", synthetic.itxt(text, kind == 2))])


query("xmp_extract", f"""SELECT p_partkey::VARCHAR AS path, ([{", ".join(f"'{x}'" for x in ("JPEG", "PNG", "PNG", "WEBP"))}])[p_partkey % 4 + 1] AS format, p_name AS title, 'sea,' || p_brand AS subject, '2026-09-14T18:42:07Z' AS create_date, (p_size % 6)::BIGINT AS rating, p_brand AS make, 'S' || p_size AS serial FROM part""")(
    lambda s, d: _parts(s, d, _packet).select("path", "format", "xmp.title", F.array_join("xmp.subject", ",").alias("subject"), "xmp.create_date", "xmp.rating",
        *(F.try_element_at("xmp.exif_in_xmp", F.lit(f"{ns}#{n}")).alias(a) for ns, n, a in ((xmp.CAMERA[0], "Make", "make"), (xmp.CAMERA[2], "SerialNumber", "serial")))))


def _record(r: dict) -> bytes:
    date, clock = f"2026{r['p_size'] % 13:02}14".encode(), (b"184207+0000", b"184207", b"250000")[r["p_partkey"] % 3]
    return synthetic.jpeg(None, segments=[(0xED, synthetic.iptc([(0, b"\0\4"), (25, r["p_brand"].encode()), (25, "Küste".encode("latin-1")), (55, date), (60, clock), (120, r["p_name"].encode()), (120, b"again")]))])


query("iptc_extract", """SELECT p_partkey::VARCHAR AS path, 4::BIGINT AS record_version, p_brand || ',Küste' AS keywords, p_name AS caption, CASE WHEN p_size % 13 > 0 THEN printf('2026-%02d-14', p_size % 13) END AS date_created,
  (['18:42:07+00:00', '18:42:07', NULL])[p_partkey % 3 + 1] AS time_created, 7::BIGINT AS datasets FROM part""")(
    lambda s, d: _parts(s, d, _record).select("path", "iptc.record_version", F.array_join("iptc.keywords", ",").alias("keywords"), "iptc.caption", "iptc.date_created", "iptc.time_created", F.array_size("iptc.raw").cast("long").alias("datasets")))


def _profile(r: dict) -> bytes:
    """A profile in a JPEG's chunks or a PNG; of every fifth JPEG a chunk is missing."""
    body = synthetic.icc(1980 + r["p_size"], 200 + r["p_size"])
    if r["p_partkey"] % 2:
        return synthetic.png([(b"iCCP", b"name\0\0" + zlib.compress(body))])
    return synthetic.jpeg(None, segments=synthetic.icc_segments(body, 100)[r["p_partkey"] % 5 == 0 :])


query("icc_extract", """SELECT p_partkey::VARCHAR AS path, p_partkey % 10 <> 0 AS present, x.version, x.device_class, x.created, x.size_bytes, x.signature_valid, x.tags FROM part LEFT JOIN
  (SELECT p_partkey AS k, '2.1.0' AS version, 'display device' AS device_class, (1980 + p_size) || '-09-14T18:42:07' AS created, (200 + p_size)::BIGINT AS size_bytes, true AS signature_valid, 'desc' AS tags FROM part WHERE p_partkey % 10 <> 0) x ON k = p_partkey""")(
    lambda s, d: _parts(s, d, _profile).select("path", "icc.present", "icc.version", F.col("icc.device_class_name").alias("device_class"), "icc.created", F.when(c("icc.present"), c("icc.size_bytes")).alias("size_bytes"), "icc.signature_valid", F.array_join("icc.tags.signature", ",").alias("tags")))

_TABLE = bytes(65)


def _small(r: dict) -> bytes:
    """A JPEG with a thumbnail; their quantization tables and Huffman tables go by the part."""
    tables = lambda n, huffman: [(0xDB, _TABLE * n)] + [(0xC4, bytes(20))] * huffman
    blob = synthetic.jpeg(None, 100 + r["p_size"], 120, tables(1 + r["p_size"] % 2, r["p_partkey"] % 2))
    return synthetic.jpeg(synthetic.with_thumbnail(synthetic.tiff([(0x010F, 2, r["p_brand"])]), blob), 640, 480, tables(2, 1))


query("jpeg_encoder_signals", "SELECT p_partkey::VARCHAR AS path, 2::BIGINT AS main_dqt, true AS main_dht, (1 + p_size % 2)::BIGINT AS thumb_dqt, p_partkey % 2 = 1 AS thumb_dht FROM part")(
    lambda s, d: _parts(s, d, _small).select("path", "main_dqt", "main_dht", F.get("thumbnails", 0)["dqt"].alias("thumb_dqt"), F.get("thumbnails", 0)["dht"].alias("thumb_dht")))
query("thumbnail_extract", "SELECT p_partkey::VARCHAR AS path, 0::BIGINT AS index, 'EXIF IFD1 (JPEG blob)' AS source, 'JPEG' AS format, (100 + p_size)::BIGINT AS width, 120::BIGINT AS height, (92 + (p_size % 2) * 65 + (p_partkey % 2) * 24)::BIGINT AS byte_size FROM part")(
    lambda s, d: _parts(s, d, _small).select("path", F.inline("thumbnails")).select("path", "index", "source", "format", "width", "height", "byte_size"))


@query("scan_files", "SELECT 'r' || n_regionkey || '/' || n_nationkey || '.jpg' AS path, 'ok' AS status, n_name AS make, NULL::VARCHAR AS error FROM nation UNION ALL SELECT 'r' || r_regionkey || '/.hidden.txt', 'skipped', NULL, 'not a recognized image format (magic bytes)' FROM region")
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder with a file for each nation, in a subfolder for each region with a hidden file that is no image, listed and decoded."""
    root = shared_dir(spark, "scan")
    for r in table(spark, sf_dir, "region").select("r_regionkey").collect():  # region and nation are of fixed size
        storage.write_file(spark, f"{root}/r{r.r_regionkey}/.hidden.txt", b"no image")
    for n in table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect():
        storage.write_file(spark, f"{root}/r{n.n_regionkey}/{n.n_nationkey}.jpg", synthetic.jpeg(synthetic.tiff([(0x010F, 2, n.n_name)])))
    found = images.extract(storage.scan(spark, root, recursive=True))
    return found.select(F.regexp_extract("path", r"(r\d+/[^/]+)$", 1).alias("path"), "status", "make", "error")


query("file_analysis", """SELECT p_partkey::VARCHAR AS path, 'ok' AS status, '2026-09-14' AS capture_day, 'EXIF DateTimeOriginal' AS sources, true AS has_gps, p_partkey % 90 < 90 AND p_size < 180 AS gps_valid, 0 AS flags FROM part""")(
    lambda s, d: files.analyze(_parts(s, d, lambda r: synthetic.jpeg(_exif(r)))).select("path", "status", "capture_day", F.array_join("timestamps.source", ",").alias("sources"), "has_gps", "gps_valid", F.size("flags").alias("flags")))
