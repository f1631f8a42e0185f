"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by the sum of one codeword from each of several full-dimensional codebooks,
trained one after the other on what the ones before leave over. Encoding keeps the best few partial
sums at every codebook (beam search). The index stores each vector's codes, its own norm and that of
its reconstruction. A query makes one table of inner products with all codewords, so a score is a sum of
table entries, corrected by the stored norms. The best candidates are scored again exactly on the
original vectors.

The training sample is bounded; every vector is encoded. Queries meet the index in blocks: chunks of
codes, a few bytes a vector, against blocks of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenix.llm.common import hot_keys, spread_join, tune, written

#: Codebooks and codewords of each; partial sums kept in encoding; vectors trained on at most.
BOOKS, WORDS, BEAM, SAMPLE = 16, 256, 8, 16_384
#: Candidates scored exactly for each neighbour wanted; queries in a block; vectors in a chunk.
RERANK, QUERIES, VECTORS = 10, 512, 16_384
#: Chunks that one task meets with a block of queries, and from which it returns the block's best.
SPAN = 64
#: Packed query blocks go to every executor up to this size; beyond, they are joined by shuffle.
BROADCAST_BYTES = 32 << 20


@dataclass
class Codebooks:
    words: np.ndarray  # (books, words, dims) float32

    @property
    def cross(self) -> np.ndarray:
        """Inner products of all codewords with all, (books * words, books * words)."""
        flat = self.words.reshape(-1, self.words.shape[2])
        return flat @ flat.T

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, books) uint8 and squared norms of the reconstructions, by beam search over squared error."""
        books, n_words, dims = self.words.shape
        flat = self.words.reshape(-1, dims)
        own = (flat * flat).sum(axis=1)
        rows = len(x)
        sums = np.zeros((rows, 1, dims), np.float32)
        codes = np.zeros((rows, 1, 0), np.uint8)
        for m in range(books):
            book = self.words[m]
            left = x[:, None, :] - sums
            # error of adding a codeword, but for the constant |left|^2 of each partial sum
            gain = own[m * n_words : (m + 1) * n_words] - 2 * (left.reshape(-1, dims) @ book.T).reshape(rows, -1, n_words)
            error = ((left * left).sum(axis=2)[:, :, None] + gain).reshape(rows, -1)
            keep = min(beam, error.shape[1]) if m + 1 < books else 1
            best = np.argpartition(error, keep - 1, axis=1)[:, :keep]
            parent, word = best // n_words, best % n_words
            sums = np.take_along_axis(sums, parent[:, :, None], axis=1) + book[word]
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
        return codes[:, 0], (sums[:, 0].astype(np.float64) ** 2).sum(axis=1)


def train(sample: np.ndarray, books: int = BOOKS, n_words: int = WORDS, rounds: int = 6) -> Codebooks:
    """Codebooks on residuals, each by Lloyd's rounds from an evenly spaced start; deterministic for a sample."""
    rest = sample.astype(np.float32).copy()
    out = np.zeros((books, n_words, sample.shape[1]), np.float32)
    for m in range(books):
        k = min(n_words, len(rest))
        words = rest[np.linspace(0, len(rest) - 1, k).astype(int)].copy()
        for _ in range(rounds):
            near = np.argmin((words * words).sum(axis=1) - 2 * (rest @ words.T), axis=1)
            count = np.bincount(near, minlength=k)
            total = np.zeros_like(words)
            np.add.at(total, near, rest)
            words = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], words).astype(np.float32)
        near = np.argmin((words * words).sum(axis=1) - 2 * (rest @ words.T), axis=1)
        out[m, :k] = words
        out[m, k:] = words[0]
        rest -= words[near]
    return Codebooks(out)


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding as array<double>, row, dims) of rows that take part: not null, not zero, all components finite."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False))).withColumns({"row": F.monotonically_increasing_id(), "dims": F.size("embedding")})


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def build(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, row, codes, scale) of each vector; scales are the vector's norm over its reconstruction's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2))
            codes, squares = books.encode(x.astype(np.float32))
            scale = np.sqrt((x * x).sum(axis=1) / np.maximum(squares, 1e-300)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale)], names=["vec_id", "row", "codes", "scale"])

    return vectors.select("vec_id", "row", "embedding").mapInArrow(run, "vec_id long, row long, codes binary, scale float")


def _pack_chunks(key: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by([("vec_id", "ascending"), ("row", "ascending")])
    packed = {name: table.column(c).to_numpy().astype(t).tobytes() for name, c, t in (("ids", "vec_id", "<i8"), ("rows", "row", "<i8"), ("scales", "scale", "<f4"))} | {"codes": b"".join(table.column("codes").to_pylist())}
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), **{n: pa.array([packed[n]], pa.binary()) for n in ("ids", "rows", "codes", "scales")}})


def _pack_queries(table: pa.Table) -> pa.Table:
    x = _matrix(table.column("embedding"))
    return pa.table({"q_ids": pa.array([table.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()), "q_vectors": pa.array([x.astype("<f8").tobytes()], pa.binary())})


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _score(books: Codebooks, keep: int):
    """The best candidates of each query over all chunks that a group of rows (block, span) brings, one chunk in memory at a time."""
    dims = books.words.shape[2]
    flat = books.words.reshape(-1, dims).astype(np.float32)
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))

    def made(now: dict) -> pa.RecordBatch:
        n = [len(v) for v, _, _ in now["best"]]
        columns = [np.repeat(now["q_ids"], n), *(np.concatenate(x) for x in zip(*now["best"], strict=True))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "row", "approximate"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict = {}
        for batch in batches:
            for given in batch.to_pylist():
                if now.get("key") != (given["block"], given["span"]):
                    if now:
                        yield made(now)
                    q_ids = np.frombuffer(given["q_ids"], "<i8")
                    q = np.frombuffer(given["q_vectors"], "<f8").reshape(len(q_ids), dims).astype(np.float32)
                    now = {"key": (given["block"], given["span"]), "q_ids": q_ids, "tables": q @ flat.T, "best": [nothing] * len(q_ids)}
                ids, rows, scales = (np.frombuffer(given[c], t) for c, t in (("ids", "<i8"), ("rows", "<i8"), ("scales", "<f4")))
                places = np.frombuffer(given["codes"], np.uint8).reshape(len(ids), -1).T.astype(np.int32) + np.arange(len(books.words), dtype=np.int32)[:, None] * books.words.shape[1]
                for i, (query, table) in enumerate(zip(now["q_ids"], now["tables"], strict=True)):
                    scores = table[places[0]]
                    for at in places[1:]:
                        scores += table[at]
                    scores = scores * scales
                    top = best(np.where(ids == query, -np.inf, scores), ids, keep)
                    top = top[ids[top] != query]
                    v, r, s = (np.concatenate((x, y[top])) for x, y in zip(now["best"][i], (ids, rows, scores), strict=True))
                    top = best(s, v, keep)
                    now["best"][i] = v[top], r[top], s[top]
        if now:
            yield made(now)

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = (_matrix(batch.column(2)) * _matrix(batch.column(3))).sum(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])


def search(df: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by ``every`` the k nearest others found.

    Nearest is the largest inner product, in double precision; ties go to the smaller id. Vectors null,
    zero, with null or non-finite components or of a null id take no part. A vector meets those of its
    own length, as there is no inner product with others. Rows with one id are candidates each, and
    never their own neighbours; the least vector of an id asks. With fewer candidates than k all are
    returned; an empty table gives no rows. Other columns are not read.
    """
    spark = df.sparkSession
    tune(spark)
    vectors = written(usable(df, id_col, vector_col), "ann-vectors")
    asked = written(vectors.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "ann-queries")
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for length in sorted(r["dims"] for r in vectors.select("dims").distinct().collect()):  # a row a length
        out = out.union(_search(vectors.where(F.col("dims") == length), asked.where(F.size("embedding") == length), length, k))
    return out


def _search(vectors: DataFrame, asked: DataFrame, dims: int, k: int) -> DataFrame:
    """search among vectors of one length."""
    n, n_asked = vectors.count(), asked.count()
    if not n_asked:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    part = max(1, math.ceil(n / SAMPLE))
    # a hash picks about SAMPLE vectors; the limit only guards the bound
    sample = vectors.where(F.pmod(F.xxhash64("vec_id", "row"), F.lit(part)) == 0).orderBy("vec_id", "row").limit(2 * SAMPLE).select("embedding").toArrow()
    if not sample.num_rows:
        sample = vectors.orderBy("vec_id", "row").limit(WORDS).select("embedding").toArrow()
    books = train(_matrix(sample.column(0)))
    chunks = max(1, math.ceil(n / VECTORS))
    coded = build(vectors, books).withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))
    coded = written(coded.groupBy("chunk").applyInArrow(_pack_chunks, "chunk int, ids binary, rows binary, codes binary, scales binary"), "ann-index")
    blocks = math.ceil(n_asked / QUERIES)
    blocks_of = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    packed = blocks_of.groupBy("block").applyInArrow(_pack_queries_with_block, "block int, q_ids binary, q_vectors binary")
    # every chunk of codes meets every block of queries: the stated query set against all rows, in blocks
    met = coded.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.floor(F.col("chunk") / SPAN).cast("int").alias("span"))
    met = met.join(F.broadcast(packed) if 8 * (dims + 1) * n_asked <= BROADCAST_BYTES else packed, "block").repartition("block", "span").sortWithinPartitions("block", "span")
    found = met.select("block", "span", "ids", "rows", "codes", "scales", "q_ids", "q_vectors").mapInArrow(_score(books, RERANK * k), "query_id long, vec_id long, row long, approximate float")
    first = Window.partitionBy("query_id").orderBy(F.desc("approximate"), "vec_id", "row")
    found = written(found.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= RERANK * k).select("query_id", "row"), "ann-found")
    popular = hot_keys(found.groupBy("row").agg(F.count("*").alias("_n")), "row", found.count(), "_n")
    scored = spread_join(found, vectors.select("row", "vec_id", "embedding"), "row", "query_id", popular).join(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q")), "query_id")
    scored = scored.select("query_id", "vec_id", "_q", "embedding").mapInArrow(_exact, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pack_queries_with_block(key: tuple, table: pa.Table) -> pa.Table:
    packed = _pack_queries(table)
    return packed.add_column(0, "block", pa.array([key[0].as_py()], pa.int32()))
