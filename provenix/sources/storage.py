"""Files on any storage that Spark reads: listing folders, contents as rows, and small files written whole."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FILES = "path string, content binary, modified timestamp_ntz, mtime double, error string"


def as_uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"


def local(path: str) -> str | None:
    """The path of a local file or folder; None on other storage."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else None if "://" in path else path


def too_large(size: int, most: int) -> str:
    return f"file is {size} bytes, over the {most}-byte limit"


def hadoop(spark: SparkSession, uri: str) -> tuple:
    """Hadoop's file system of a URI and the path in it, on the driver."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def write_file(spark: SparkSession, uri: str, data: bytes) -> None:
    """A small file, written by the driver: a local one itself, others through Hadoop's file systems."""
    place = local(uri)
    if place is not None:
        os.makedirs(os.path.dirname(place), exist_ok=True)
        Path(place).write_bytes(data)
        return
    fs, path = hadoop(spark, uri)
    out = fs.create(path, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def put(uri: str, data: bytes, force: bool) -> bool:
    """A small file, written by a task; it appears whole or not at all. False where one is there and isn't to be replaced."""
    fs, path = pafs.FileSystem.from_uri("file://" + local(uri) if local(uri) else uri)
    if not force and fs.get_file_info(path).type != pafs.FileType.NotFound:
        return False
    folder, _, name = path.rpartition("/")
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)
    return True


def list_files(root: str, recursive: bool = False) -> list[str]:
    """Regular files below a local folder, sorted; links to folders are not followed, hidden names count."""
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    if not recursive:
        return sorted(e.path for e in os.scandir(root) if e.is_file())
    return sorted(os.path.join(d, f) for d, _, files in os.walk(root) for f in files if os.path.isfile(os.path.join(d, f)))


def _read(most: int):
    arrow = to_arrow_schema(StructType.fromDDL(FILES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                row = dict.fromkeys(arrow.names) | {"path": path}
                try:
                    about = os.stat(path)
                    row |= {"mtime": about.st_mtime, "modified": int(about.st_mtime * 1_000_000)}
                    if most and about.st_size > most:
                        row["error"] = too_large(about.st_size, most)
                    else:
                        row["content"] = Path(path).read_bytes()
                except OSError as e:
                    row["error"] = f"cannot read {path}: {e.strerror}"
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    return run


def scan(spark: SparkSession, root: str, recursive: bool = False, largest: int = 512 << 20) -> DataFrame:
    """(path, content, modified, mtime, error) of a folder's files. Unreadable files and those over ``largest`` bytes (0: no limit) have null content and say why.

    A local folder is listed by the driver and read by the tasks, one file a batch; hidden names count
    and links to folders aren't followed. On other storage Spark lists and reads: names that start with
    . or _ are left out, as its file sources do. A folder that isn't there is a FileNotFoundError, a
    file in its place a NotADirectoryError.
    """
    place = local(root)
    if place is not None:
        paths = spark.createDataFrame([(p,) for p in list_files(place, recursive)], "path string")
        return paths.repartition("path").mapInArrow(_read(largest), FILES)
    fs, path = hadoop(spark, root)
    if not fs.exists(path):
        raise FileNotFoundError(root)
    if not fs.getFileStatus(path).isDirectory():
        raise NotADirectoryError(root)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    found = (found if recursive else found.option("pathGlobFilter", "*")).load(root)
    times = [F.col("modificationTime").cast("timestamp_ntz").alias("modified"), (F.unix_micros("modificationTime") / 1e6).alias("mtime")]
    read = found.where(F.col("length") <= largest) if largest else found  # the filter reaches the source: contents beyond aren't read
    out = read.select("path", "content", *times, F.lit(None).cast("string").alias("error"))
    if largest:
        error = F.concat(F.lit("file is "), F.col("length").cast("string"), F.lit(f" bytes, over the {largest}-byte limit"))
        out = out.unionByName(found.where(F.col("length") > largest).select("path", F.lit(None).cast("binary").alias("content"), *times, error.alias("error")))
    return out


def snapshot(row: dict) -> str:
    """An analyzed file as the JSON that a case freezes: the analysis, its flags and notes."""
    flags, note = row["flags"], row.get("zone_note")
    rest = {k: v for k, v in row.items() if k not in ("flags", "zone_note", "content") and not k.startswith("f_")}
    return json.dumps({"analysis": rest, "anomalies": flags, "notes": [note] if note else []}, sort_keys=True, default=str)
