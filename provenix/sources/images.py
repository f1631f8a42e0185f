"""Image files: listing them, and one Arrow stage that decodes each file's bytes into a row."""

from __future__ import annotations

import os
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from provenix.config import Limits
from provenix.sources import icc, iptc, storage, thumbnails, xmp
from provenix.sources.containers import dimensions, encoding
from provenix.sources.magic import detect_format
from provenix.sources.tiff import Directories, exif_payload

#: Tags of the columns, by what they hold.
TEXTS = {
    "make": 0x010F, "model": 0x0110, "software": 0x0131, "datetime_file": 0x0132, "datetime_original": 0x9003, "datetime_digitized": 0x9004, "offset_time": 0x9010, "offset_time_original": 0x9011,
    "offset_time_digitized": 0x9012, "camera_owner": 0xA430, "body_serial": 0xA431, "lens_serial": 0xA433, "lens_model": 0xA434,
}
NUMBERS = {"orientation": 0x0112, "iso": 0x8827, "flash": 0x9209}
RATIOS = {"exposure_seconds": 0x829A, "f_number": 0x829D, "focal_length_mm": 0x920A}
GPS_RATIOS = {"gps_altitude": 6, "gps_dop": 0xB, "gps_direction": 0xD}
scan, list_files = storage.scan, storage.list_files

#: Bytes from a file's start in which metadata are looked for; bytes of contents that a batch brings to a worker, about.
REACH, BATCH_BYTES = 4 << 20, 64 << 20

XMP = "packet string, truncated boolean, namespaces array<string>, title string, creator array<string>, description string, rights string, subject array<string>, create_date string, modify_date string, creator_tool string, rating long, authors_position string, credit string, source string, date_created string, exif_in_xmp map<string,string>, properties map<string,string>, warnings array<string>"
IPTC = ", ".join([*(f"{n} string" for n in iptc.ONE.values()), *(f"{n} array<string>" for n in iptc.MANY.values())]) + ", date_created string, time_created string, record_version long, raw array<struct<record long, dataset long, value string, hex string>>, warnings array<string>"
ICC = "present boolean, size_bytes long, size_claimed long, preferred_cmm string, version string, device_class string, device_class_name string, color_space string, pcs string, created string, signature_valid boolean, platform string, device_manufacturer string, device_model string, rendering_intent long, rendering_intent_name string, creator string, tags array<struct<signature string, offset long, size long, readable boolean>>, tag_count long, warnings array<string>"
THUMBNAIL = "index long, source string, byte_size long, sha256 string, width long, height long, format string, dqt long, dht boolean"
SCHEMA = ", ".join([
    "path string, sha256 string, sha512 string, size_bytes long, modified timestamp_ntz, mtime double, status string, error string, format string, encoding string, width long, height long", *(f"{n} string" for n in TEXTS), *(f"{n} long" for n in NUMBERS),
    *(f"{n} double" for n in (*RATIOS, *GPS_RATIOS)), "exposure_time string, flash_fired boolean, timezone_known boolean, lat double, lon double, gps_altitude_ref long, gps_direction_ref string, gps_date string, gps_time array<double>",
    f"xmp struct<{XMP}>, iptc struct<{IPTC}>, icc struct<{ICC}>, thumbnails array<struct<{THUMBNAIL}>>, thumbnail_claimed boolean, thumbnail_warnings array<string>, main_dqt long, main_dht boolean, warnings array<string>",
])


def _ratio(value: object) -> Fraction | None:
    return Fraction(*value) if isinstance(value, tuple) and value[1] else None


def _ratios(value: object) -> list[Fraction] | None:
    """Three fractions, as places and times of day are given."""
    out = [_ratio(x) for x in value] if isinstance(value, list) and len(value) == 3 else [None]
    return None if None in out else out


def _text(value: object) -> str | None:
    return (value.strip() or None) if isinstance(value, str) else None


def _degrees(value: object, ref: object, positive: str, negative: str) -> float | None:
    parts, side = _ratios(value), (_text(ref) or "").upper()
    if parts is None or side not in (positive, negative):
        return None
    d, m, s = map(float, parts)
    return (-1 if side == negative else 1) * (abs(d) + m / 60 + s / 3600)


def _exif(payload: bytes, limits: Limits) -> dict:
    found = Directories(payload, limits.exif_max_tags, limits.exif_max_value_bytes)
    tags, gps = found.tags, found.gps
    row: dict = {n: _text(tags.get(t)) for n, t in TEXTS.items()}
    row |= {n: tags[t] if isinstance(tags.get(t), int) else None for n, t in NUMBERS.items()}
    for source, names in ((tags, RATIOS), (gps, GPS_RATIOS)):
        row |= {n: float(x) if (x := _ratio(source.get(t))) is not None else None for n, t in names.items()}
    exposure, clock = _ratio(tags.get(RATIOS["exposure_seconds"])), _ratios(gps.get(7))
    return row | {
        "exposure_time": None if exposure is None else str(exposure), "flash_fired": None if row["flash"] is None else bool(row["flash"] & 1), "timezone_known": any(row[n] for n in ("offset_time", "offset_time_original", "offset_time_digitized")),
        "lat": _degrees(gps.get(2), gps.get(1), "N", "S"), "lon": _degrees(gps.get(4), gps.get(3), "E", "W"), "gps_altitude_ref": gps[5] if isinstance(gps.get(5), int) else None, "gps_direction_ref": _text(gps.get(0xC)),
        "gps_date": _text(gps.get(0x1D)), "gps_time": None if clock is None else [float(x) for x in clock], "warnings": found.warnings,
    }


def decode(fmt: str, content: bytes, limits: Limits | None = None) -> dict:
    """One file's columns; whatever goes wrong is the row's error."""
    limits = limits or Limits()
    data = content[:REACH]
    header = data[: limits.identify_header_bytes]
    row: dict = {"status": "ok", "warnings": []}
    try:
        row["width"], row["height"] = dimensions(fmt, header)
        row["encoding"] = encoding(fmt, header)
        payload = exif_payload(fmt, data)
        if payload is not None:
            row |= _exif(payload, limits)
        row |= {"xmp": xmp.decode(fmt, data, limits.xmp_max_packet_bytes), "iptc": iptc.decode(fmt, data), "icc": icc.decode(fmt, data, limits.icc_max_profile_bytes)}
        small = thumbnails.decode(fmt, data)
        if small:
            row |= {"thumbnails": small["found"], "thumbnail_claimed": small["claimed"], "main_dqt": small["main_dqt"], "main_dht": small["main_dht"], "thumbnail_warnings": small["warnings"]}
    except Exception as e:  # one bad file is a row, not a failed job
        row |= {"status": "error", "error": f"{type(e).__name__}: {e}"}
    return row


def _with_format(files: DataFrame) -> DataFrame:
    """What a worker needs of each file: hashes and the format are found in the JVM, and only the first REACH bytes go on."""
    modified = F.col("modified") if "modified" in files.columns else F.lit(None)
    modified = modified.cast("timestamp_ntz")
    mtime = F.col("mtime") if "mtime" in files.columns else F.unix_micros(modified.cast("timestamp")) / 1e6
    known = F.coalesce(detect_format(F.col("content")), F.lit("UNKNOWN")).alias("format")
    return files.select(
        "path", F.substring("content", 1, REACH).alias("content"), known, F.sha2("content", 256).alias("sha256"), F.sha2("content", 512).alias("sha512"), F.octet_length("content").cast("long").alias("size_bytes"), modified.alias("modified"),
        mtime.alias("mtime"), (F.col("error") if "error" in files.columns else F.lit(None)).cast("string").alias("error"),
    )


def extract(files: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Decoded rows of (path, content, and of modified, mtime and error what there is); unknown formats are skipped, files without content are errors.

    Works on streams too. At most REACH bytes of a file reach a worker, in batches of about BATCH_BYTES.
    """
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))
    limits = limits or Limits()
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        for path, content, fmt, sha256, sha512, size, modified, mtime, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            row = {"path": path, "format": fmt, "sha256": sha256, "sha512": sha512 if "sha512" in limits.hash_algorithms else None, "size_bytes": size, "modified": modified, "mtime": mtime, "warnings": []}
            if content is None:
                row |= {"status": "error", "error": error or "cannot be read"}
            elif fmt == "UNKNOWN":
                row |= {"status": "skipped", "error": "not a recognized image format (magic bytes)"}
            elif limits.max_file_size_bytes and size > limits.max_file_size_bytes:
                row |= {"status": "error", "error": storage.too_large(size, limits.max_file_size_bytes)}
            else:
                row |= decode(fmt, content, limits)
            yield row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                yield pa.RecordBatch.from_pylist(list(rows(batch.slice(at, 64))), schema=schema)

    return _with_format(files).mapInArrow(run, SCHEMA)


def thumbnail_files(files: DataFrame) -> DataFrame:
    """(path, name, index, format, sha256, blob) of every embedded thumbnail, named for its file."""
    schema = "path string, name string, index long, format string, sha256 string, blob binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, fmt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                small = thumbnails.decode(fmt, content) if content is not None else None
                rows = [{k: v for k, v in t.items() if k in arrow.names} | {"path": path, "name": thumbnails.file_name(path, t["index"], t["format"])} for t in (small["found"] if small else [])]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return _with_format(files).select("path", "content", "format").mapInArrow(run, schema)


def write_thumbnails(files: DataFrame, folder: str, force: bool = False) -> DataFrame:
    """Writes thumbnails into a folder that all executors see, a path or a URI: (path, name, written). Files that are there stay unless forced; a file appears whole or not at all. Nothing is written before an action, and a second action finds the files there."""
    folder = storage.as_uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [storage.put(f"{folder}/{row['name']}", row["blob"], force) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("name"), pa.array(done, pa.bool_())], names=["path", "name", "written"])

    return thumbnail_files(files).mapInArrow(run, "path string, name string, written boolean")
