"""MinHash near-dedup by a signature-coordinate inverted join.

A text's set of word shingles has a signature of COORDINATES MinHash values of 64 bits. Every document
is posted under each (coordinate, value). Two texts whose sets agree by the threshold collide on at
least least_matches(percent) coordinates but for a chance of MISS at most (1.5e-7 at 38 matches for
0.85, 8.2e-8 at 33 for 0.80), so, with each document's postings in one global order, rarest first, they
meet within the first (shared - least + 1) of their shared postings (prefix): only those lists are
merged, and a document with fewer shared postings than that is skipped altogether. What many unrelated
documents share, like a licence text, has long lists, which come last and are hardly ever merged.

Pairs are never expanded within a group that is known to be one. Equal sets are one representative
first. Then each document is compared with the document that is the least one of most of its lists (a
star), which joins groups of near copies. Lists that still hold several components are merged: their
signatures are dealt into blocks of bounded size, two blocks meet in one task, and collisions are
counted over the whole signature. Of long lists first no more pairs are returned than join the
components that a task sees (a forest). What is open after those are confirmed is merged once more:
short lists, of SHORT documents at most, return their pairs above the match threshold, and in long ones
the documents that have such a partner meet again with their full sets, in parts of bounded size, in a
task that tests them itself and returns no more than one link for each document that it joins. All links are confirmed on
full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenix.llm.common import drop_table, hot_keys, located, spread_join, tune, written
from provenix.llm.memory import Memo, claim

COORDINATES, SHINGLE = 64, 5
#: Chance that two sets at the threshold's similarity miss the match threshold, at most.
MISS = 2e-7
#: Words whose hashes a worker remembers; shingles hashed at a time.
KEPT, CHUNK = 100_000, 2048
#: A list of more documents is long. Documents of a block, about: a task holds the signatures (4 bytes a coordinate) of two blocks.
#: Shingles of a part of a block, about: a task holds the full sets (8 bytes a shingle) of two parts. A block's number times PARTS is its first part's. Documents compared with a block at a time.
SHORT, BLOCK, SHINGLES, PARTS, TILE = 32, 4096, 1 << 20, 1 << 20, 256
#: Places of documents whose sets are needed go to every executor up to so many (8 bytes each); beyond, texts are joined by shuffle.
BROADCAST_PLACES = 1_000_000

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@lru_cache(maxsize=1)
def _words() -> Memo:
    return Memo(xxhash.xxh64_intdigest, KEPT)


@lru_cache(maxsize=4)
def _family(coordinates: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers and addends of the hash functions, and a mark of each coordinate, from a rule."""
    draw = lambda s: np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little"), s) for i in range(coordinates)], np.uint64)
    return draw(1) | np.uint64(1), draw(2), draw(3)


@lru_cache(maxsize=8)
def least_matches(percent: int) -> int:
    """The most matches that two sets at this similarity miss with a chance of MISS at most: matches are binomial."""
    p, chance = percent / 100, 0.0
    for k in range(COORDINATES):
        chance += comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k)
        if chance > MISS:
            return max(k, 1)
    return COORDINATES


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of fewer words the whole sequence is one."""
    ws = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not ws:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_words().__getitem__, ws), np.uint64, len(ws))
    n = min(size, len(ws))
    out = np.full(len(ws) - n + 1, n, np.uint64)
    for j in range(n):
        out = (out ^ hashes[j : len(ws) - n + 1 + j]) * _ODD[0]
        out = (out ^ (out >> np.uint64(29))) * _ODD[1]
    return np.unique(out)


def signature(items: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The least 64-bit value of each hash function."""
    a, b, _ = _family(coordinates)
    out = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(items), CHUNK):
        values = items[lo : lo + CHUNK, None] * a
        values += b
        np.minimum(out, values.min(axis=0), out=out)
    return out


def tokens(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit number of each (coordinate, value): values of one coordinate never share one, and those of two only by chance."""
    out = (signatures ^ _family(COORDINATES)[2]) * _ODD[0]
    out ^= out >> np.uint64(29)
    out *= _ODD[1]
    return out.view(np.int64)


def _set_hash(items: np.ndarray) -> bytes | None:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, COORDINATES)


def sketches(rows: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, _at, n (set size), set_hash and sig (both binary, null without words) of rows (doc_id, _at, text), and their columns named in carry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near-dedup", _words.cache_clear)
        for batch in batches:
            n, hashes, sigs = [], [], []
            for text in batch.column(2).to_pylist():
                items = shingles(text)
                n.append(len(items))
                hashes.append(_set_hash(items))
                sigs.append(signature(items).tobytes() if len(items) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(hashes, pa.binary()), pa.array(sigs, pa.binary()), *batch.columns[3:]], names=["doc_id", "_at", "n", "set_hash", "sig", *carry])

    schema = ", ".join(["doc_id long, _at long, n long, set_hash binary, sig binary", *(f"`{x}` {rows.schema[x].dataType.simpleString()}" for x in carry)])
    return rows.select("doc_id", "_at", "text", *carry).mapInArrow(run, schema)


def sets(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """(id, items): the full set of each needed class (id, at, set_hash), from the text at its place again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near-dedup", _words.cache_clear)
        for batch in batches:
            ids, out = [], []
            for i, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                items = shingles(text)
                if _set_hash(items) == wanted:  # places are known by a hash; another row's text isn't the class's
                    ids.append(i)
                    out.append(items.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "items"])

    places = needed.select(F.col("at").alias("_at"), "id", "set_hash")
    places = F.broadcast(places) if needed.count() <= BROADCAST_PLACES else places
    return rows.select("_at", "text").join(places, "_at").select("id", "text", "set_hash").mapInArrow(run, "id long, items binary")


def postings(reps: DataFrame) -> DataFrame:
    """(id, token) of representatives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), COORDINATES)), pa.array(tokens(_signatures(batch.column(1))).ravel())], names=["id", "token"])

    return reps.select("id", "sig").mapInArrow(run, "id long, token long")


def prefixes(reps: DataFrame, least: int) -> tuple[DataFrame, list]:
    """(id, token) of the lists that have to be merged, and the tokens of very long lists."""
    posted = postings(reps)
    shared = written(posted.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "dedup-shared")
    hot = hot_keys(shared, "token", COORDINATES * reps.count(), "df")
    held = spread_join(posted, shared, "token", "id", hot).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("held"))  # COORDINATES at most
    held = held.where(F.size("held") >= least)
    return held.select("id", F.explode(F.slice("held", F.lit(1), F.size("held") - least + 1)).alias("p")).select("id", F.col("p.token").alias("token")), hot


def _both(pairs: DataFrame, side: DataFrame) -> DataFrame:
    """Pairs (a, b), a written table, with the columns of side (one row an id) of both, as _a* and _b*. An id that many pairs share is dealt to several tasks."""
    n = pairs.count()
    hot = {k: hot_keys(pairs.groupBy(k).agg(F.count("*").alias("_n")), k, n, "_n") for k in "ab"}
    for k, other in (("a", "b"), ("b", "a")):
        named = side.select(F.col("id").alias(k), *(F.col(c).alias(f"_{k}_{c}") for c in side.columns if c != "id"))
        pairs = spread_join(pairs, named, k, other, hot[k])
    return pairs


def _filtered(pairs: DataFrame, columns: list[str], keep: Callable[[list[pa.Array]], np.ndarray]) -> DataFrame:
    """The pairs (a, b) whose columns pass ``keep``, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = pa.array(keep(batch.columns[2:]), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return pairs.select("a", "b", *columns).mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Of written pairs (a, b) those with 100 * intersection >= percent * union, on full sets."""

    def keep(columns: list[pa.Array]) -> np.ndarray:
        ok = []
        for x, y in zip(*columns, strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
            ok.append(100 * both >= percent * (len(x) + len(y) - both))
        return np.array(ok, bool)

    return _filtered(_both(pairs, full), ["_a_items", "_b_items"], keep)


def matching(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of written pairs (a, b) those whose signatures agree on enough coordinates and whose sizes allow a link."""
    least = least_matches(percent)
    keep = lambda columns: (_signatures(columns[0]) == _signatures(columns[1])).sum(axis=1) >= least
    both = _both(pairs, reps.select("id", "sig", "n")).where(f"100 * least(_a_n, _b_n) >= {percent} * greatest(_a_n, _b_n)")
    return _filtered(both, ["_a_sig", "_b_sig"], keep)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, label) of every id in edges (a, b): the least id that it reaches. Least labels go along edges and through labels until none changes; each round is a written table that takes the place of the one before."""
    both = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), f"{name}-edges")
    n = both.count()
    hubs = hot_keys(both.groupBy("v").agg(F.count("*").alias("_n")), "v", n, "_n")
    labels = written(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("label"), F.lit(0).cast("long").alias("moved")), f"{name}-labels")
    while n:
        roots = hot_keys(labels.groupBy("label").agg(F.count("*").alias("_n")), "label", n, "_n")
        near = spread_join(both, labels.select(F.col("id").alias("v"), "label"), "v", "u", hubs).groupBy(F.col("u").alias("id")).agg(F.min("label").alias("near"))
        far = spread_join(labels.select("id", "label"), labels.select(F.col("id").alias("label"), F.col("label").alias("far")), "label", "id", roots)
        new = F.least("label", "near", "far")
        later = written(far.join(near, "id").select("id", new.alias("label"), (F.col("label") - new).alias("moved")), f"{name}-labels")
        drop_table(labels)
        labels = later
        if not labels.where("moved <> 0").limit(1).count():
            break
    drop_table(both)
    return labels.select("id", "label")


def open_lists(lists: DataFrame, labels: DataFrame, hot: list) -> DataFrame:
    """(token, id, n, label, size) of the lists that hold several components, with the documents of each list; ``hot`` are the tokens of very long lists."""
    known = lists.select("id", "token", "n").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    several = known.groupBy("token").agg(F.min("label").alias("_x"), F.max("label").alias("_y"), F.count("*").alias("size")).where("_x <> _y").select("token", "size")
    return spread_join(known, several, "token", "id", hot).select("token", "id", "n", "label", "size")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray | pa.Array]]:
    """The columns of each run of rows that agree on the first ``keys`` columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held:
            batch = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        marks = [batch.column(i).to_numpy() for i in range(keys)]
        cuts = np.flatnonzero(np.logical_or.reduce([m[1:] != m[:-1] for m in marks])) + 1
        for lo, hi in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=False):
            yield batch.slice(lo, hi - lo)
        held = [batch.slice(int(cuts[-1]) if len(cuts) else 0)]
    if held:
        yield held[0]


def _agreeing(x: np.ndarray, y: np.ndarray, least: int) -> np.ndarray:
    """Which rows of x and columns of y (a row a coordinate) agree on at least so many coordinates."""
    if len(x) * y.shape[1] <= 4096:
        return (x[:, :, None] == y[None, :, :]).sum(axis=1) >= least
    count = np.zeros((len(x), y.shape[1]), np.uint8)
    for c in range(len(y)):
        count += x[:, c, None] == y[None, c, :]
    return count >= least


#: Columns of documents that two blocks bring to a task.
MET = "token long, low long, high long, block long, id long, label long, n long, codes binary"


class _Meeting:
    """Two blocks of a list (or one) in a task: which documents of different components agree on enough coordinates."""

    def __init__(self, rows: pa.RecordBatch, percent: int):
        self.low, self.high = rows.column(1)[0].as_py(), rows.column(2)[0].as_py()
        blocks, self.ids, self.labels, n = (rows.column(i).to_numpy() for i in range(3, 7))
        codes = np.frombuffer(b"".join(rows.column(7).to_pylist()), np.uint32).reshape(len(self.ids), COORDINATES)
        self.left = np.flatnonzero(blocks == self.low)
        self.right = self.left if self.low == self.high else np.flatnonzero(blocks == self.high)
        self.near = np.zeros((len(self.left), len(self.right)), bool)
        across = np.ascontiguousarray(codes[self.right].T)
        for lo in range(0, len(self.left), TILE):
            skip = lo if self.low == self.high else 0  # a block with itself: each two documents once
            x, y = self.left[lo : lo + TILE, None], self.right[None, skip:]
            near = _agreeing(codes[x[:, 0]], across[:, skip:], least_matches(percent)) & (self.labels[x] != self.labels[y])
            near &= 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
            self.near[lo : lo + TILE, skip:] = np.triu(near) if self.low == self.high else near
        self.shingles = n
        self.parent = {x: x for x in self.labels.tolist()}

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, i: int, j: int) -> bool:
        """Whether two documents were in different components; they are in one now."""
        x, y = self.root(int(self.labels[i])), self.root(int(self.labels[j]))
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y

    def partners(self) -> Iterator[tuple[int, np.ndarray]]:
        """(document, documents near it), as places in the rows."""
        for i in np.flatnonzero(self.near.any(axis=1)).tolist():
            yield int(self.left[i]), self.right[self.near[i]]

    def forest(self) -> list[tuple[int, int]]:
        """No more pairs than join components, whether they are links or not."""
        return [(i, int(others[k])) for i, others in self.partners() for k in np.unique(self.labels[others], return_index=True)[1].tolist() if self.join(i, int(others[k]))]

    def pairs(self) -> list[tuple[int, int]]:
        return [(i, j) for i, others in self.partners() for j in others.tolist()]

    def parts(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Numbers of two parts of the blocks, each of a bounded number of shingles, and the places of their documents that have a partner in the other one."""
        left, right = (np.cumsum(self.shingles[x]) // SHINGLES for x in (self.left, self.right))
        number = np.unique(left, return_inverse=True)[1], np.unique(right, return_inverse=True)[1]
        rows = np.flatnonzero(self.near.any(axis=1))
        for p in np.unique(number[0][rows]).tolist():
            mine = rows[number[0][rows] == p]
            near = self.near[mine]
            for q in np.unique(number[1][near.any(axis=0)]).tolist():
                here = near & (number[1] == q)
                yield p, q, self.left[mine[here.any(axis=1)]], self.right[here.any(axis=0)]

    def links(self, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
        """No more links, tested on full sets, than join components."""
        every, code = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum([len(x) for x in sets])
        coded = np.split(code, ends[:-1])
        mark, out = np.zeros(len(every), bool), []
        for i, others in self.partners():
            others = np.array([j for j in others.tolist() if self.root(int(self.labels[j])) != self.root(int(self.labels[i]))], np.int64)
            if not len(others):
                continue
            mark[coded[i]] = True
            size = np.array([len(coded[j]) for j in others], np.int64)
            both = np.add.reduceat(mark[np.concatenate([coded[j] for j in others])].astype(np.int64), np.cumsum(size) - size)
            mark[coded[i]] = False
            linked = others[100 * both >= percent * (len(coded[i]) + size - both)]
            out += [(i, j) for j in linked.tolist() if self.join(i, j)]
        return out


def _merge(percent: int, forest: bool):
    """Pairs (a, b), a < b, of the documents that meet: a forest, or all of them."""

    def made(found: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.sort(np.array(found, np.int64).reshape(-1, 2), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for rows in _groups(batches, 3):
            met = _Meeting(rows, percent)
            found += [(met.ids[i], met.ids[j]) for i, j in (met.forest() if forest else met.pairs())]
            if len(found) > 10_000:
                yield made(found)
                found = []
        if found:
            yield made(found)

    return run


def _partnered(percent: int):
    """Of the documents that meet those that have a partner, dealt to meetings of parts of their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            met = _Meeting(rows, percent)
            for p, q, left, right in met.parts():
                low, high = met.low * PARTS + p, met.high * PARTS + q
                places = np.concatenate([left, np.setdiff1d(right, left)])
                block = np.where(np.isin(places, left), low, high)
                taken = rows.take(pa.array(places))
                same = lambda v: pa.array(np.full(len(places), v, np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([taken.column(0), same(low), same(high), pa.array(block), *taken.columns[4:]], names=taken.schema.names)

    return run


def _joined(percent: int):
    """Links (a, b) that join components, of documents that meet with their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            met = _Meeting(rows, percent)
            links = met.links([np.frombuffer(v.as_buffer(), np.uint64) for v in rows.column(8)], percent)
            if links:
                pairs = np.sort(np.array([(met.ids[i], met.ids[j]) for i, j in links], np.int64), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def meetings(opened: DataFrame, reps: DataFrame) -> DataFrame:
    """The documents of open lists (columns MET), each with every block that its own one meets."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # 32 bits of a token are enough to count with: agreeing by chance only makes a candidate
            codes = tokens(_signatures(batch.column(1))).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in codes], pa.binary())], names=["id", "codes"])

    codes = reps.join(opened.select("id").distinct(), "id", "left_semi").select("id", "sig").mapInArrow(folded, "id long, codes binary")
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    met = opened.join(codes, "id").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))  # a block meets every block of its list once
    return dealt(met.select("token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "label", "n", "codes"))


def dealt(met: DataFrame) -> DataFrame:
    return met.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high")


def near_duplicates(df: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links), kept (doc_id = component_id).

    Documents without words, null texts too, have no shingles and stand alone. Rows that share an id
    are a document each, and are kept together or not at all if their sets are linked. Null ids never
    name a component unless all of it has none; then its id is null and its rows are kept. An empty
    table gives no rows; of other columns only those named in carry are read, and returned with their row.
    """
    tune(df.sparkSession)
    least = least_matches(percent)
    docs = located(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carry))
    rows = written(sketches(docs, carry), "dedup-sketches")
    classes = rows.where("set_hash is not null").groupBy("set_hash").agg(F.min("doc_id").alias("doc_id"), F.min("_at").alias("at"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("n_rows"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "dedup-classes")
    lists, long_lists = prefixes(classes, least)
    lists = written(lists.join(classes.select("id", "n"), "id"), "dedup-lists")
    active = written(classes.join(lists.select("id").distinct(), "id", "left_semi"), "dedup-active")
    full = written(sets(docs, active), "dedup-sets")
    # the star: each document against the least one of most of its lists
    firsts = lists.groupBy("token").agg(F.min("id").alias("a"))
    stars = spread_join(lists, firsts, "token", "id", long_lists).where("a < id").groupBy(F.col("id").alias("b"), "a").agg(F.count("*").alias("n"))
    stars = stars.groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("m")))["m"].alias("m")).select((-F.col("m")).alias("a"), "b")
    stars = written(matching(written(stars, "dedup-pairs"), active, percent), "dedup-stars")
    links = written(confirmed(stars, full, percent), "dedup-links")
    labels = components(links, "dedup-star")
    # a forest of what long lists still hold apart, then all that is left
    opened = written(open_lists(lists, labels, long_lists), "dedup-open")
    forest = meetings(opened.where(F.col("size") > SHORT), active).mapInArrow(_merge(percent, True), "a long, b long").distinct()
    forest = written(forest.join(stars, ["a", "b"], "left_anti"), "dedup-forest")
    if forest.limit(1).count():
        links = links.union(written(confirmed(forest, full, percent), "dedup-links"))
        labels = components(links, "dedup-tree")
        opened = written(open_lists(opened, labels, long_lists), "dedup-open")
    short = meetings(opened.where(F.col("size") <= SHORT), active).mapInArrow(_merge(percent, False), "a long, b long").distinct()
    short = written(short.join(stars.union(forest), ["a", "b"], "left_anti"), "dedup-short")
    partnered = written(meetings(opened.where(F.col("size") > SHORT), active).mapInArrow(_partnered(percent), MET), "dedup-long")
    rest = [written(confirmed(short, full, percent), "dedup-links")] if short.limit(1).count() else []
    if partnered.limit(1).count():
        rest.append(written(dealt(partnered.join(full, "id").select(*partnered.columns, "items")).mapInArrow(_joined(percent), "a long, b long").distinct(), "dedup-links"))
    if rest:
        labels = components(reduce(DataFrame.union, rest, links), "dedup-rest")
    # names of components, and back to the rows
    heads = classes.select("id", "set_hash", "doc_id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    names = heads.groupBy("label").agg(F.min("doc_id").alias("_component"))
    big = hot_keys(labels.groupBy("label").agg(F.count("*").alias("_n")), "label", classes.count(), "_n")
    heads = spread_join(heads, names, "label", "id", big).select("set_hash", "_component")
    copied = hot_keys(classes, "set_hash", rows.count(), "n_rows")
    out = spread_join(rows, heads, "set_hash", "_at", copied, "left")
    component = F.when(F.col("set_hash").isNull(), F.col("doc_id")).otherwise(F.col("_component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"), *carry)
