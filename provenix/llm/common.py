"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch, whichever is reached first.
BATCH_ROWS, BATCH_BYTES = 512, 2 << 20
#: A key that holds over 1 / HOT_KEYS of the rows, and over HOT_ROWS, is hot: there are HOT_KEYS of them at most. Its rows are dealt to SALTS tasks.
HOT_KEYS, HOT_ROWS, SALTS = 1000, 4096, 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once: a lambda variable cannot be inlined again."""
    return F.get(F.transform(F.array(value), body), 0)


def tune(spark: SparkSession) -> None:
    """Arrow batches bounded in rows and bytes, the same for every operator: a frame that runs later isn't changed by another one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's. Where none is set, a temporary one on a local master (tests); on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"provenix-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", root)
    return root if "://" in root or root.startswith("file:") else "file://" + root


def work_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, read again: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop_table(df: DataFrame) -> None:
    """Removes a table that ``written`` made, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    return pafs.FileSystem.from_uri("file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def words(text: Column) -> Column:
    """The ``[^\\x20\\x09-\\x0D]+`` of a text; of null none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+"), "")


def shielded(df: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """The rows under names that nothing else has, the new name of each column, and a way back: so no column of the input can clash with a helper's."""
    inner = [f"_in{i}_" for i in range(len(df.columns))]
    return df.toDF(*inner), dict(zip(df.columns, inner, strict=True)), lambda out: out.select(*inner).toDF(*df.columns)


def located(df: DataFrame, name: str = "_at") -> DataFrame:
    """The rows with a hash of their place in the files that they are read from, or else in a written copy."""
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    try:
        return df.select("*", place.alias(name))
    except AnalysisException:  # not read from files directly
        return written(df, "located-copy").select("*", place.alias(name))


def hot_keys(counts: DataFrame, key: str, rows: int, n: str) -> list:
    """The hot keys, HOT_KEYS at most, of ``rows`` rows in all, from (key, n) with each key once."""
    if rows <= HOT_ROWS:
        return []
    return [r[0] for r in counts.where(F.col(key).isNotNull() & (F.col(n) > max(rows // HOT_KEYS, HOT_ROWS))).select(key).collect()]


def spread_join(rows: DataFrame, side: DataFrame, key: str, salt: str, hot: list, how: str = "inner", also: tuple[str, ...] = ()) -> DataFrame:
    """rows joined with side, which has each key (with the columns in ``also``) once. Rows of hot keys are dealt to SALTS tasks by their ``salt``, and the side's rows of these keys go to each."""
    if not hot:
        return rows.join(side, [key, *also], how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    dealt = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).otherwise(0))
    copies = side.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [key, *also, "_salt"], how).drop("_salt")
