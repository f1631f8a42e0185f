"""The folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new place in the session's checkpoint folder. Where none is set, a temporary one is set on a local master (tests); on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = f"file://{os.path.join(tempfile.gettempdir(), f'provenix-{os.getpid()}')}"
        spark.conf.set("spark.checkpoint.dir", root)
    root = root if "://" in root or root.startswith("file:") else f"file://{root}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """A folder of ``shared_dir`` that nothing reads any more is deleted."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, read again: computed once, and lineage is cut and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
