"""Sharding by a k-d tree over document metadata, split at distributed weighted medians.

Each document is a point: its size, source, language and id. A node is split along its widest dimension
where the bytes before the cut fill half of its leaves, until every leaf is one shard of about the
target bytes. Splits are found for all nodes of a level together, from histograms of bytes that are
refined until the bin of the split is a small part of a shard; nothing but histograms of fixed size
reaches the driver, and the tree of the number of shards is the only state.

Documents of equal text share one point, so they stay in one shard, and a cut that falls in a group
goes to its nearer edge. Groups of over a quarter of a shard, at most four a shard, would spoil that
balance: they are dealt whole to the least loaded shards first, the largest before the others, and the
tree fills up what they leave. Only a group that is larger than a whole shard is split: its documents
are points of their own, apart by a hash of id and number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenix.llm.common import hot_keys, spread_join, written

SHARDS = 24
#: Bits of a coordinate, of the text's hash after it and of the row's salt: 62 in all.
VALUE_BITS, GROUP_BITS, SALT_BITS = 20, 26, 16
#: log2 of the bins of a histogram; the split may miss its place by this part of a shard's bytes.
BIN_BITS, TOLERANCE = 10, 0.002
#: Equal texts with more than this part of a shard's bytes are dealt to a shard before the tree grows; rows of a numbering group.
BIG, GROUP = 0.25, 4096

DIMENSIONS = ("_size", "_source", "_lang", "_id")
#: What equal texts agree on.
TEXT = ("_hash", "text_crc32", "size")


@dataclass
class Node:
    """Leaves first to first + count - 1; a split sends keys of ``dim`` below ``cut`` to ``low``."""

    first: int
    count: int
    dim: str = ""
    cut: int = 0
    low_key: int = 0
    high_key: int = 0
    low: Node | None = None
    high: Node | None = None

    def half(self, room: list[float]) -> float:
        """The part of the node's room that its lower leaves have."""
        mine = room[self.first : self.first + self.count]
        return sum(mine[: self.count // 2]) / sum(mine) if sum(mine) else self.count // 2 / self.count

    def leaf(self) -> Column:
        if self.low is None:
            return F.lit(self.first)
        return F.when(F.col(self.dim) < F.lit(self.cut), self.low.leaf()).otherwise(self.high.leaf())


def points(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """doc_id, size, text_crc32, _hash (of the text), _row (a number) and what its coordinates follow from, of every row, as a written table."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    of = lambda c: F.shiftright(F.crc32(F.encode(F.coalesce(F.col(c), F.lit("")), "UTF-8")), 32 - VALUE_BITS)
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("_hash"),
        of(source_col).alias("_s"), of(lang_col).alias("_l"), F.monotonically_increasing_id().alias("_row"),
    )
    return written(rows, "shard-rows")


def cloud_of(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame, list[float], list[int]]:
    """The points that the tree splits (doc_id, size, text_crc32, _hash, _row, a sortable long a dimension), the rows dealt before it (with their shard), both written tables, the bytes left for each shard, and the hashes of texts that very many rows share."""
    low, high, total, n_rows = rows.agg(F.min("doc_id"), F.max("doc_id"), F.sum("size"), F.count("*")).first()
    target = (total or 0) / shards
    groups = written(rows.groupBy(*TEXT).agg(F.min("doc_id").alias("_first"), F.min("_s").alias("_gs"), F.min("_l").alias("_gl"), F.count("*").alias("_n")).where("_n > 1"), "shard-groups")
    held = F.col("_n") * F.col("size")
    large = groups.where(held > BIG * target).select(*TEXT, held.alias("bytes")).collect()  # shards / BIG at most
    loads, dealt = [0.0] * shards, []
    for g in sorted(large, key=lambda g: (-g.bytes, g["_hash"], g.text_crc32, g.size)):
        if g.bytes <= target:
            shard = loads.index(min(loads))
            loads[shard] += g.bytes
        dealt.append((g["_hash"], g.text_crc32, g.size, shard if g.bytes <= target else -1))
    places = F.broadcast(rows.sparkSession.createDataFrame(dealt, "_hash long, text_crc32 long, size long, _shard int"))
    rows = written(rows.join(places, list(TEXT), "left"), "shard-dealt")
    whole = rows.where("_shard >= 0").select("doc_id", "size", "text_crc32", "_hash", "_row", F.col("_shard").alias("shard"))

    top = (1 << VALUE_BITS) - 1
    split = rows.where("_shard < 0").withColumn("_same", F.xxhash64(*TEXT, "doc_id"))
    split = numbered(split, "_same", ["_row"], ["_row"], "_number").select("*", F.col("doc_id").alias("_first"), F.col("_s").alias("_gs"), F.col("_l").alias("_gl"), F.pmod(F.xxhash64("doc_id", "_number"), F.lit(1 << SALT_BITS)).alias("_apart"))
    often = hot_keys(groups, "_hash", n_rows, "_n")
    joined = spread_join(rows.where("_shard is null"), groups.drop("_n"), "_hash", "_row", often, "left", TEXT[1:]).withColumn("_apart", F.lit(0))
    columns = ["doc_id", "size", "text_crc32", "_hash", "_row", "_s", "_l", "_first", "_gs", "_gl", "_apart"]
    joined = joined.select(*columns).unionByName(split.select(*columns))
    tail = F.shiftrightunsigned("_hash", 64 - GROUP_BITS) * (1 << SALT_BITS) + F.col("_apart")
    place = (F.coalesce(F.col("_first"), F.col("doc_id"), F.lit(low or 0)) - F.lit(low or 0)) / F.lit(float(max(1, (high or 0) - (low or 0))))
    value = {"_size": F.least(F.log2(F.col("size").cast("double")) * F.lit(2.0**VALUE_BITS / 40), F.lit(top)), "_source": F.coalesce("_gs", "_s"), "_lang": F.coalesce("_gl", "_l"), "_id": place * top}
    keys = {name: F.floor(x).cast("long") * F.lit(1 << (GROUP_BITS + SALT_BITS)) + tail for name, x in value.items()}
    cloud = written(joined.select("doc_id", "size", "text_crc32", "_hash", "_row", *(k.alias(n) for n, k in keys.items())), "shard-points")
    return cloud, whole, [max(0.0, target - x) for x in loads], often


def _choose(nodes: dict[int, Node], cloud: DataFrame) -> None:
    """Sets dim and the span of keys of each node that has points."""
    ends = cloud.groupBy("_node").agg(*(f(d).alias(f"{d}{n}") for d in DIMENSIONS for n, f in (("0", F.min), ("1", F.max))))
    for row in ends.collect():  # a row a node
        node = nodes[row["_node"]]
        node.dim = max(DIMENSIONS, key=lambda d: row[f"{d}1"] - row[f"{d}0"])
        node.low_key, node.high_key = row[f"{node.dim}0"], row[f"{node.dim}1"] + 1


def _split(nodes: dict[int, Node], cloud: DataFrame, room: list[float], tolerance: float) -> None:
    """Sets cut of each node at its weighted median, by histograms of 2**BIN_BITS bins on ever narrower spans."""
    keys = cloud.select("_node", "size", F.array(*DIMENSIONS).alias("_keys"))
    spans = {k: (n.low_key, n.high_key) for k, n in nodes.items()}
    before = dict.fromkeys(nodes, 0)
    want: dict[int, float] = {}
    while spans:
        step = {k: max(1, -(-(high - low) // (1 << BIN_BITS))) for k, (low, high) in spans.items()}
        asked = [(k, DIMENSIONS.index(nodes[k].dim), low, high, step[k]) for k, (low, high) in spans.items()]
        asked = F.broadcast(cloud.sparkSession.createDataFrame(asked, "_node int, _dim int, _low long, _high long, _step long"))  # a row a node
        inside = keys.join(asked, "_node").withColumn("_key", F.get("_keys", F.col("_dim"))).where("_key >= _low and _key < _high")
        bins = inside.groupBy("_node", F.expr("(_key - _low) div _step").alias("_bin")).agg(F.sum("size").alias("bytes"))
        found: dict[int, list[tuple[int, int]]] = {k: [] for k in spans}
        for row in bins.collect():
            found[row["_node"]].append((row["_bin"], row["bytes"]))
        for k, (low, _) in list(spans.items()):
            histogram = sorted(found[k])
            want.setdefault(k, sum(b for _, b in histogram) * nodes[k].half(room))
            for number, held in histogram:
                if before[k] + held > want[k]:
                    break
                before[k] += held
            at, end = low + number * step[k], low + (number + 1) * step[k]
            if step[k] == 1 or held <= tolerance:
                nodes[k].cut = at if want[k] - before[k] <= before[k] + held - want[k] else end  # the edge that is nearer
                del spans[k]
            else:
                spans[k] = (at, end)


def grow(cloud: DataFrame, room: list[float]) -> Node:
    """The tree over a written table of points, a level at a time, with a leaf for each shard that fills its room; a node is known by its first leaf."""
    root = Node(0, len(room))
    level = [root]
    while opened := {n.first: n for n in level if n.count > 1}:
        now = cloud.withColumn("_node", root.leaf()).where(F.col("_node").isin([*opened]))
        _choose(opened, now)
        if filled := {k: n for k, n in opened.items() if n.dim}:
            _split(filled, now, room, TOLERANCE * sum(room) / len(room))
        level = []
        for n in opened.values():
            n.dim = n.dim or DIMENSIONS[0]  # no points: any cut will do
            half = n.count // 2
            n.low, n.high = Node(n.first, half), Node(n.first + half, n.count - half)
            level += [n.low, n.high]
    return root


def numbered(df: DataFrame, by: str, deal: list[str], order: list[str], name: str) -> DataFrame:
    """Gapless ``name`` from 0 within each value of ``by``, without gathering a value's rows: ranges of a hash of ``deal`` get their starts from counts, and are sorted by ``order``."""
    rows = df.count()
    ranges = max(1, rows // (GROUP * SHARDS))
    dealt = df.withColumn("_range", F.pmod(F.xxhash64(*deal), F.lit(ranges)))
    counts = dealt.groupBy(by, "_range").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inner = dealt.withColumn("_i", F.row_number().over(Window.partitionBy(by, "_range").orderBy(*order)))
    return inner.join(starts, [by, "_range"]).withColumn(name, F.col("_start") + F.col("_i") - 1).drop("_range", "_start", "_i")


def shard_documents(df: DataFrame, shards: int = SHARDS, **columns: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    The law is ``bytes``: shards hold nearly equal bytes. Null texts are empty (size 8); null ids,
    sources and languages lie at the low end or with the empty string; repeated rows each get a slot.
    An empty table gives no rows. grown_shard is null, as this law doesn't speak of more shards. Equal
    texts are in one shard unless they are larger than one. Other columns are not read.
    """
    cloud, whole, room, often = cloud_of(points(df, **columns), shards)
    tree = grow(cloud, room)
    placed = cloud.select("doc_id", "size", "text_crc32", "_hash", "_row", tree.leaf().cast("int").alias("shard")).unionByName(whole)
    placed = placed.withColumn("_deal", F.when(F.col("_hash").isin(often), F.col("_row")).otherwise(0))  # texts that many rows share are dealt by row
    out = numbered(placed, "shard", ["doc_id", "_hash", "_deal"], ["doc_id", "_hash", "_row"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
