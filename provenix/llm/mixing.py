"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every copy of a document gets a virtual finish time: the words that its source has sent when the copy
ends, in an order shuffled by a hash, divided by the source's target. Copies of all sources are then
taken in the order of these times until the budget is used up, so at any moment each source has sent
its share. Running sums never gather a source: documents are dealt to (source, range of the hash)
groups of about GROUP rows, and the totals of the ranges before give each group its start. The cut in
the global order is found the same way, from ranges of the finish time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenix.llm.common import shielded, words, written

#: Weights by rank of the source, repeating; budget as a part of all sizes; copies of a document at most.
WEIGHTS, BUDGET, COPIES = (5, 2, 1), 1.5, 2
#: Rows of a running sum's group, about; finish times from here on share a range.
GROUP, LATE = 4096, 64.0
#: A source table of more rows isn't broadcast but joined by Spark's choice.
BROADCAST_ROWS = 20_000
#: Decisions about rows go to every executor up to so many (24 bytes each); beyond, they are joined by shuffle.
BROADCAST_TAKEN = 1_000_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, copies: int = COPIES) -> DataFrame:
    """source, source_size, weight, rank, target: shares by weight, none above ``copies`` times its source's size.

    Sources (one row each) are ranked by code point, null last. In order of the fill level at which a
    source is full, its level is the budget left by the sources before it for each unit of the weight
    left; the first level below a source's own is the final one.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_full = Window.orderBy("full", "rank")
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = src.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    src = src.withColumn("weight", F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    src = src.withColumn("cap", F.col("source_size") * copies).withColumn("full", F.col("cap") / F.col("weight"))
    src = src.withColumn("budget", F.lit(budget) * F.sum("source_size").over(everything))
    before = by_full.rowsBetween(Window.unboundedPreceding, -1)
    after = by_full.rowsBetween(0, Window.unboundedFollowing)
    src = src.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    src = src.withColumn("final", F.min(F.when(F.col("full") > F.col("level"), F.struct("full", "rank", "level"))).over(everything)["level"])
    target = F.when(F.col("final").isNull() | (F.col("full") <= F.col("final")), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("final"))
    return src.select("source", "source_size", "weight", "rank", target.alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", row_col: str | None = None, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (size * copies) of every row; ``row_col`` is passed on.

    Null texts have size 0; such rows are never copied, and take nothing. A null source is a source of
    its own, ranked last. The order within a source is that of the md5 of seed and id, then id, size and
    a hash of the text, so reruns agree whatever the partitions; repeated rows are taken one after the
    other. An empty table gives no rows; other columns are not read.
    """
    extra = {row_col: F.col(f"`{row_col}`")} if row_col else {}
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"), key.alias("key"), F.xxhash64(F.col(text_col)).alias("tie"),
        *(c.alias(n) for n, c in extra.items()),
    )
    rows = written(rows, "mix-rows")
    ranges = max(1, rows.count() // GROUP)
    src = written(source_targets(rows, weights, budget), "mix-sources")
    joined = F.broadcast(src) if src.count() <= BROADCAST_ROWS else src
    rows = rows.withColumn("range", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / F.lit(2.0**32)).cast("long"))

    group = Window.partitionBy("source", "range")
    inner = rows.withColumn("within", F.sum("size").over(group.orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)))
    totals = rows.groupBy("source", "range").agg(F.sum("size").alias("total"))
    by_range = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("source").alias("_s"), F.col("range").alias("_r"), F.coalesce(F.sum("total").over(by_range), F.lit(0)).alias("_start"))
    placed = inner.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r"))).drop("_s", "_r")
    timed = placed.join(joined.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    sent = F.col("_start") + F.col("within")
    timed = timed.withColumns({f"time{c + 1}": F.when((F.col("size") > 0) & (F.col("target") > 0), (F.col("source_size") * c + sent) / F.col("target")) for c in range(COPIES)})
    timed = written(timed.select("doc_id", "source", "size", "source_size", "target", "rank", *extra, *(f"time{c + 1}" for c in range(COPIES))), "mix-times")

    copies = timed.select("size", "rank", F.explode(F.array(*(F.col(f"time{c + 1}") for c in range(COPIES)))).alias("time")).where("time is not null")
    span = F.floor(F.least(F.col("time"), F.lit(LATE)) * ranges)
    spans = copies.groupBy(span.alias("span")).agg(F.sum("size").alias("total"))
    spans = spans.withColumn("end", F.sum("total").over(Window.orderBy("span")))
    all_of_it = src.agg(F.sum("source_size")).first()[0] or 0
    most = budget * all_of_it
    crossed = spans.where(F.col("end") > F.lit(most)).orderBy("span").limit(1).first()
    if crossed is None:
        taken = [F.col(f"time{c + 1}").isNotNull() for c in range(COPIES)]
    else:
        last = copies.where(span == crossed["span"]).withColumn("end", F.lit(crossed["end"] - crossed["total"]) + F.sum("size").over(Window.orderBy("time", "rank")))
        cut = last.where(F.col("end") > F.lit(most)).orderBy("time", "rank").limit(1).first()  # the first copy that is not taken
        taken = [F.coalesce((F.col(t) < cut["time"]) | ((F.col(t) == cut["time"]) & (F.col("rank") < cut["rank"])), F.lit(False)) for t in (f"time{c + 1}" for c in range(COPIES))]
    n = sum((t.cast("int") for t in taken[1:]), taken[0].cast("int"))
    return timed.select(*extra, "doc_id", "source", "size", "source_size", "target", n.alias("copies"), (F.col("size") * n).alias("taken"))


def mixed(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options: object) -> DataFrame:
    """Every row as many times as the mix takes it, with its columns, whatever their names.

    Rows are known by their place in the files they are read from, or else in a written copy. Rows that
    mix gives no words, those without text or words too, are left out; an empty table gives no rows.
    """
    rows, name, back = shielded(df)
    place = (F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    try:
        rows = rows.select("*", *place)
    except AnalysisException:  # not read from files directly
        rows = written(rows, "mix-copy").select("*", *place)
    taken = mix(rows.withColumn("_row", F.struct("_file", "_place")), name[id_col], name[source_col], name[text_col], row_col="_row", **options).where("copies > 0")
    taken = written(taken.select("_row._file", "_row._place", "copies"), "mix-taken")
    taken = F.broadcast(taken) if taken.count() <= BROADCAST_TAKEN else taken
    return back(rows.join(taken, ["_file", "_place"]).withColumn("_copy", F.explode(F.expr("sequence(1, copies)"))))


ORACLE = """
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> ''))::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
s1 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM d GROUP BY source),
s2 AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s1),
s3 AS (SELECT *, 2 * source_size AS cap, (2 * source_size)::DOUBLE / weight::DOUBLE AS filled, 1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT AS budget FROM s2),
s4 AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY filled, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
              / (sum(weight) OVER (ORDER BY filled, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM s3),
s5 AS (SELECT *, (SELECT arg_min(level, (filled, rank)) FROM s4 WHERE filled > level) AS final FROM s4),
s AS (SELECT source, rank, source_size, budget, CASE WHEN final IS NULL OR filled <= final THEN cap::DOUBLE ELSE weight * final END AS target FROM s5),
q AS (SELECT d.doc_id, d.source, d.size, s.source_size, s.target, s.rank, s.budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS sent, row_number() OVER () AS i
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
c AS (SELECT i, size, rank, budget, (source_size * e + sent)::DOUBLE / target AS t FROM q, (VALUES (0), (1)) v(e) WHERE size > 0 AND target > 0),
k AS (SELECT i, size, sum(size) OVER (ORDER BY t, rank ROWS UNBOUNDED PRECEDING) <= budget AS ok FROM c),
n AS (SELECT i, count(*) FILTER (WHERE ok) AS n FROM k GROUP BY i)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(n.n, 0))::BIGINT AS taken, q.source, coalesce(n.n, 0)::INTEGER AS copies
FROM q LEFT JOIN n USING (i)
"""
