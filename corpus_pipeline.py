"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

Quality rules reject documents; near-dedup leaves one document of each group; secrets are masked in the
texts; the mix leaves out or repeats documents to meet its sources' targets; the last stage encodes the
texts and returns ids in place of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenix.llm import bpe, mixing, near_dedup, quality, secrets
from provenix.llm.common import table, work_dir, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Decisions of near-dedup go to every executor up to so many (17 bytes each); beyond, texts are shuffled once to meet them.
BROADCAST_ODD = 1_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's certified cutoffs."""
    return quality.passing(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near-duplicates; of repeated rows of one id and text, one.

    Decided by id and text, null-safe: other texts of a dropped copy's id stay, and a copy without an id goes.
    Of repeated rows the one of least lang, source and n_chars stays. Texts of one id that are linked, and
    linked texts none of which has an id, are kept together as near_duplicates says. Null and empty texts
    stand alone, and stay; an empty table gives no rows.
    """
    docs = docs.select(*COLUMNS).withColumn("_hash", F.xxhash64(F.sha2("text", 256)))
    decided = near_dedup.near_duplicates(docs, 80, carry=("_hash",)).groupBy("doc_id", "_hash").agg(F.bool_and("kept").alias("_kept"), F.count("*").alias("_rows"))
    odd = written(decided.where("not _kept or _rows > 1").select(F.col("doc_id").alias("_odd"), F.col("_hash").alias("_odd_hash"), "_kept"), "dedup-odd")
    odd = F.broadcast(odd) if odd.count() <= BROADCAST_ODD else odd
    same = F.col("doc_id").eqNullSafe(F.col("_odd")) & (F.col("_hash") == F.col("_odd_hash"))
    repeated = docs.join(odd.where("_kept"), same, "left_semi").groupBy("doc_id", "_hash").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("_row")).select("doc_id", "_row.*")
    return docs.join(odd, same, "left_anti").select(*COLUMNS).unionByName(repeated.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; found secrets are masked, and n_chars follows."""
    clean = secrets.redacted(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.mixed(docs.select(*COLUMNS))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the ids (little-endian unsigned 32-bit), checked by decoding them."""
    out = bpe.encode_documents(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.json"), decoded_col="_decoded")
    checked = F.when(F.coalesce(F.col("text"), F.lit("")) == F.col("_decoded"), F.col("ids")).otherwise(F.raise_error(F.lit("decoded ids differ from the text")))
    return out.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), checked.alias("ids"))


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup_stage), ("secret scan", secret_scan), ("mixing", mixing_stage), ("bpe encoding", bpe_stage)]

#: The last stage has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    folder = work_dir(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
