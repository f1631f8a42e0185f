"""Ingest of files as they arrive: the batch's decode stage and analysis on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from provenix.operators import files
from provenix.sources import images


#: Columns of the binary file source.
FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """Decoded rows of files that appear below a folder; names that start with . or _ are left out, as Spark's file sources do."""
    found = spark.readStream.schema(FILES).format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(root)
    return images.extract(found.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content", F.col("modificationTime").alias("modified")))


def ingest(spark: SparkSession, root: str, table: str, checkpoint: str, per_trigger: int = 1000) -> StreamingQuery:
    """Appends analyzed files to a Parquet folder, then stops; called again it goes on where it stopped. A micro-batch that is repeated after a failure writes its own folder anew, so no row comes twice."""

    def append(batch: DataFrame, number: int) -> None:
        files.analyze(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return arriving(spark, root, per_trigger).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
