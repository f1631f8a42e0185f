"""Batch operators over per-file records: duplicates, buckets, summary, timelines, CSV rows and the report of them all.

Groups are given as one row each with its count, and their members as rows of (key, path): no group is
gathered, however large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenix.functions import geo
from provenix.functions.time import rank_and_key, sorted_claims
from provenix.sources.shared import written

#: The groups of a report: key and label columns.
GROUPS = {"by_device": ("device_key", "device_display"), "by_capture_day": ("capture_day", "capture_day_display"), "by_location": ("location_key", "location_label")}
#: Columns of the batch CSV and of the timeline CSV.
BATCH_CSV = ("path", "filename", "status", "format", "width", "height", "size_bytes", "sha256", "make", "model", "software", "capture_day", "gps_latitude", "gps_longitude", "duplicate_group", "thumbnails", "warnings", "error")
TIMELINE_CSV = ("path", "filename", "timestamp", "source", "label", "timezone_status", "raw")


def ok(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "ok")


def duplicates(df: DataFrame, key: str = "sha256") -> DataFrame:
    """(key, n) of values that two or more rows share."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def members(df: DataFrame, key: str, member: str = "path", groups: DataFrame | None = None) -> DataFrame:
    """(key, member) of every row that has a key, or of those in the given groups."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), member)
    return rows if groups is None else rows.join(groups.select(F.col(groups.columns[0]).alias("key")), "key", "left_semi")


def buckets(df: DataFrame, key: str, display: str, member: str = "path") -> DataFrame:
    """(key, display, n): the display of the first member stands for its bucket. Rows without a key are in none."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min_by(display, member).alias("display"), F.count("*").alias("n"))


def display_counts(groups: DataFrame) -> DataFrame:
    """(display, n): of buckets that are shown alike the last key's count stands."""
    return groups.groupBy("display").agg(F.max_by("n", "key").alias("n"))


def with_location(df: DataFrame) -> DataFrame:
    """Adds location_key and location_label, the cell of about 1 km of valid coordinates."""
    key, label = geo.location_cell(F.col("lat"), F.col("lon"), F.col("has_gps") & F.col("gps_valid"))
    return df.withColumns({"location_key": key, "location_label": label})


def counters(df: DataFrame, n_flags: Column, n_thumbnails: Column) -> DataFrame:
    """One row with the counts of files by status, and of analyzed files with coordinates, conflicts, flags and thumbnails."""
    done = F.col("status") == "ok"
    each = {"scanned": F.lit(True), "analyzed": done, "skipped": F.col("status") == "skipped", "errors": F.col("status") == "error", "with_gps": done & F.col("has_gps"), "with_conflicts": done & F.col("has_conflicts"),
            "with_anomalies": done & (n_flags > 0), "with_thumbnails": done & (n_thumbnails > 0)}
    sums = {"anomaly_flags": n_flags, "thumbnails": n_thumbnails}
    return df.agg(*(F.count_if(x).alias(n) for n, x in each.items()), *(F.coalesce(F.sum(F.when(done, x)), F.lit(0)).cast("long").alias(n) for n, x in sums.items()))


def duplicate_counts(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_files"))


def totals(analyzed: DataFrame, n_flags: Column) -> DataFrame:
    """The row of a report's summary."""
    return counters(analyzed, n_flags, F.col("thumbnail_count")).join(duplicate_counts(duplicates(ok(analyzed))))


def report(analyzed: DataFrame, timeline_too: bool = False) -> dict[str, DataFrame]:
    """All tables of a batch report over analyzed files, off one written base: summary (a row), files, by_format, duplicates and each group, with their members, and the timeline if asked for."""
    base = written(with_location(analyzed), "batch-files")
    done = ok(base)
    same = duplicates(done)
    out = {"files": base, "summary": totals(base, F.size("flags")), "by_format": done.groupBy("format").agg(F.count("*").alias("n"))}
    out |= {"duplicates": same, "duplicates_members": members(done, "sha256", groups=same)}
    for name, (key, display) in GROUPS.items():
        out[name], out[f"{name}_members"] = buckets(done, key, display), members(done, key)
    if timeline_too:
        out["timeline"] = ordered(timeline(done))
    return out


def csv_rows(df: DataFrame) -> DataFrame:
    """The rows of the batch CSV; files that aren't ok have only their path, name, status and error."""
    done = F.col("status") == "ok"
    day = F.when(F.col("capture_day") != "unknown", F.col("capture_day"))
    given = {"format": F.col("format"), "width": F.col("width"), "height": F.col("height"), "size_bytes": F.col("size_bytes"), "sha256": F.col("sha256"), "make": F.col("device_make"), "model": F.col("device_model"), "software": F.col("device_software"),
             "capture_day": day, "gps_latitude": F.col("lat"), "gps_longitude": F.col("lon"), "thumbnails": F.nullif(F.col("thumbnail_count"), F.lit(0)), "warnings": F.col("warning_count")}
    groups = duplicates(ok(df)).select(F.col("sha256").alias("_sha256"), F.substring("sha256", 1, 16).alias("duplicate_group"))
    joined = df.join(groups, done & (F.col("sha256") == F.col("_sha256")), "left")
    return joined.select("path", "filename", "status", *(F.when(done, F.nullif(x.cast("string"), F.lit(""))).alias(n) for n, x in given.items()), "duplicate_group", F.when(~done, F.col("error")).alias("error")).select(*BATCH_CSV)


def timeline(df: DataFrame) -> DataFrame:
    """Claims of all files with their order: instants, wall times, observed strings; ties by file name, path and place."""
    each = df.select("path", "filename", F.posexplode("timestamps").alias("pos", "t"))
    rank, key = rank_and_key(F.col("t"))
    return each.select("path", "filename", "pos", rank.alias("rank"), key.alias("key"), "t.source", "t.label", "t.timezone_status", "t.raw", F.coalesce("t.value_utc", "t.wall", F.lit("")).alias("timestamp"))


def ordered(claims: DataFrame) -> DataFrame:
    """The timeline sorted; sorting is by range over all executors."""
    return claims.orderBy("rank", "key", "filename", "path", "pos")


def file_timeline(df: DataFrame) -> DataFrame:
    """path and the file's own claims in order of time, equal ones in the order of their sources."""
    return df.select("path", F.posexplode(sorted_claims(F.col("timestamps"))).alias("place", "t")).select("path", "place", "t.*")


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV files with a header below a folder; values are quoted where they have to be, and nulls are empty."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def first_by(df: DataFrame, by: str, *order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_n = 1").drop("_n")
