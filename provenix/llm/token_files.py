"""Token-id files: Simple-8b blocks with per-block offsets and a document index.

Layout of a file: the 8 bytes of MAGIC; blocks of Simple-8b words, each of BLOCK ids but the last; a
footer of little-endian 64-bit arrays (block byte offsets, block flags, then doc ids, null flags and
token counts of the documents in order); the lengths of both groups; MAGIC again. Files are numbered
in global document order, so the ids of all documents before one are its file's start, kept in the
manifest, and the counts before it in its file.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenix.llm import simple8b
from provenix.llm.common import filesystem, tune
from provenix.llm.memory import claim
from provenix.llm.pieces import _ODD, cutter

MAGIC = b"PVXTOK01"
#: Ids of a block; documents encoded at a time.
BLOCK, CHUNK = 65_536, 256
#: Bytes of texts that go to one file, about.
FILE_BYTES = 256 << 20
#: Pre-tokens that a worker remembers, and the longest; new ones that reach the library in one string.
KEPT, LONGEST, GROUP = 1_200_000, 64, 256


class Writer:
    """Streams ids into one file. Every attempt at a task has a file of its own, and only those in the manifest count."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.out = fs.open_output_stream(path)
        self.out.write(MAGIC)
        self.at, self.offsets, self.flags, self.ids, self.docs = len(MAGIC), [], [], [], []
        self.waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.ids.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK:
            every = np.concatenate(self.ids)
            whole = len(every) // BLOCK * BLOCK
            for lo in range(0, whole, BLOCK):
                self._block(every[lo : lo + BLOCK])
            self.ids, self.waiting = [every[whole:]], len(every) - whole

    def _block(self, ids: np.ndarray) -> None:
        words = simple8b.pack(ids)
        self.offsets.append(self.at)
        self.flags.append(int(ids.max() >= simple8b.ESCAPE_FROM))
        self.out.write(words.astype("<u8").tobytes())
        self.at += 8 * len(words)

    def close(self) -> None:
        if self.waiting:
            self._block(np.concatenate(self.ids))
        docs = np.array(self.docs, np.int64).reshape(-1, 3)
        footer = [np.array([*self.offsets, self.at], "<i8"), np.array(self.flags, "<i8"), *(docs[:, i].astype("<i8") for i in range(3))]
        self.out.write(b"".join(x.tobytes() for x in footer) + struct.pack("<QQ", len(self.flags), len(docs)) + MAGIC)
        self.out.close()


def read_file(uri: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc id, ids) of each document in order, a block in memory at a time."""
    fs, path = filesystem(uri)
    size = fs.get_file_info(path).size
    with fs.open_input_file(path) as f:
        tail = f.read_at(24, size - 24)
        blocks, n_docs = struct.unpack("<QQ", tail[:16])
        if tail[16:] != MAGIC or f.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri} is no whole token file")
        length = 8 * (2 * blocks + 1 + 3 * n_docs)
        footer = np.frombuffer(f.read_at(length, size - 24 - length), "<i8")
        offsets, flags = footer[: blocks + 1], footer[blocks + 1 : 2 * blocks + 1]
        docs = footer[2 * blocks + 1 :].reshape(3, n_docs)
        block, held, n_held = 0, [], 0
        for doc, null, n in docs.T.tolist():
            while n_held < n:
                lo, hi = int(offsets[block]), int(offsets[block + 1])
                held.append(simple8b.unpack(np.frombuffer(f.read_at(hi - lo, lo), "<u8"), bool(flags[block])))
                n_held += len(held[-1])
                block += 1
            every = np.concatenate(held) if len(held) != 1 else held[0]
            yield None if null else doc, every[:n]
            held, n_held = [every[n:]], len(every) - n


def _places(found: list) -> list[int]:
    """Where a list has None."""
    out, at = [], -1
    try:
        while True:
            at = found.index(None, at + 1)
            out.append(at)
    except ValueError:
        return out


class LibraryEncoder:
    """Ids of texts as the tokenizers library gives them; it encodes a distinct pre-token once while that is remembered, as packed ids.

    New pre-tokens of a space and letters reach the library many in one string, which it cuts apart
    again at the spaces; the lengths of the tokens say which ids belong to which.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.cut = cutter(path)
        self.known: dict[str, bytes] = {}
        vocab = self.cut.read()["model"]["vocab"]
        self.lengths = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each token: a character each in the byte-level alphabet
        for s, i in vocab.items():
            self.lengths[i] = len(s)

    def encode(self, texts: list[str]) -> list[bytes]:
        cut, get = self.cut, self.known.get
        parts = [cut.segments(x) for x in texts]
        pieces = [[w for s, x in ps for w in ([x] if s else cut.pieces(x))] if len(ps) != 1 or ps[0][0] else cut.pieces(ps[0][1]) for ps in parts]
        found = [list(map(get, ws)) for ws in pieces]
        holes = [_places(ks) for ks in found]
        new = {ws[i] for ws, at in zip(pieces, holes, strict=True) for i in at}.difference(cut.specials)
        fresh = self._encode_new(list(new)) | {s: i.to_bytes(4, "little") for s, i in cut.specials.items()}
        for ws, ks, at in zip(pieces, found, holes, strict=True):
            for i in at:
                ks[i] = fresh[ws[i]]
        if len(self.known) + len(fresh) > KEPT:
            self.known.clear()
        self.known.update(fresh)
        for w in [w for w in fresh if len(w) > LONGEST]:
            del self.known[w]
        return list(map(b"".join, found))

    def _encode_new(self, new: list[str]) -> dict[str, bytes]:
        joinable = [w for w in new if w[0] == " " and w[1:].isalpha() and not _ODD.search(w)]
        single = list(set(new).difference(joinable))
        out = {w: array("I", e.ids).tobytes() for w, e in zip(single, self.cut.tokenizer.encode_batch_fast(single, add_special_tokens=False), strict=True)}
        groups = [joinable[i : i + GROUP] for i in range(0, len(joinable), GROUP)]
        for words, e in zip(groups, self.cut.tokenizer.encode_batch_fast(list(map("".join, groups)), add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            at = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(w.encode()) for w in words])) + 1
            packed, ends = ids.tobytes(), (4 * at).tolist()
            out.update(zip(words, [packed[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)], strict=True))
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _encoded(texts: list[str], tokenizer: str, end_id: int) -> Iterator[np.ndarray]:
    end = end_id.to_bytes(4, "little")
    for packed in _encoder(tokenizer).encode(texts):
        yield np.frombuffer(packed + end, "<u4")


def write_token_files(df: DataFrame, uri: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int]]:
    """Writes part files in ascending id order and returns their manifest: (file, ids before it, ids in it).

    Null ids come first, equal ids by text; null texts are empty and get only the end id. Rows are
    range-partitioned, so no id, however often it repeats, has to fit a task with all its rows. There are
    as many files as the texts' bytes ask for, or as the session deals shuffles to if those are more; the
    manifest has a row a file. What tasks that failed or ran twice left behind is removed. Other columns
    are not read; an empty table gives no files.
    """
    tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token-files", _encoder.cache_clear)
        part = TaskContext.get().partitionId()
        name, n, out = f"part-{part:06d}-{uuid.uuid4().hex}.tok", 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                rows = batch.slice(at, CHUNK)
                out = out or Writer(f"{uri}/{name}")
                for doc, ids in zip(rows.column(0).to_pylist(), _encoded(rows.column(1).to_pylist(), tokenizer, end_id), strict=True):
                    out.add(doc, ids)
                    n += len(ids)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), pa.array([n], pa.int64())], names=["part", "file", "n"])

    fs, path = filesystem(uri)
    fs.create_dir(path)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    files = size // FILE_BYTES
    many = [files] if files > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    ordered = rows.repartitionByRange(*many, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    manifest, start = [], 0
    for row in sorted(ordered.mapInArrow(run, "part long, file string, n long").collect()):
        manifest.append((f"{uri}/{row.file}", start, row.n))
        start += row.n
    kept = {name.rpartition("/")[2] for name, _, _ in manifest}
    for left in fs.get_file_info(pafs.FileSelector(path)):
        if left.base_name not in kept:
            fs.delete_file(left.path)
    return manifest


def read_token_files(spark: SparkSession, manifest: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out, start = [], row["start"]
                for doc, ids in read_file(row["file"]):
                    out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                for lo in range(0, len(out), 10_000):
                    columns = zip(*out[lo : lo + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(manifest, "file string, start long, n long")
    if manifest:
        files = files.repartitionByRange(len(manifest), "start")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
