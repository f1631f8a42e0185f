"""BPE encoding and decoding by dynamic programming over prefixes.

A piece's encoding is fixed by one fact for each of its prefixes: the last token of that prefix's
encoding. A token that ends at a place, found by an automaton over the whole vocabulary, is that
last token if it starts the piece, or if the last token of the prefix before it and the token stay
apart when their bytes are merged together. Exactly one token passes, so following the stored tokens
back from the end gives the ids that the merges would give, in time linear in the piece.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenix.llm.common import tune
from provenix.llm.memory import Memo, claim
from provenix.llm.pieces import byte_chars, cutter

#: Bounds of what a worker remembers.
PIECES, PAIRS = 300_000, 300_000


class PrefixCoder:
    def __init__(self, path: str):
        self.cut = cutter(path)
        model = self.cut.read()["model"]
        byte_of = {c: b for b, c in byte_chars().items()}
        vocab = {bytes(byte_of[c] for c in s): i for s, i in model["vocab"].items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self._merges = {}
        for rank, (a, b) in enumerate(pairs):
            left, right = (bytes(byte_of[c] for c in x) for x in (a, b))
            self._merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self._byte_ids = [vocab[bytes([b])] for b in range(256)]
        self.bytes_of = {i: s for s, i in vocab.items()} | {i: s.encode() for s, i in self.cut.specials.items()}
        self._length = {i: len(s) for s, i in vocab.items()}
        self._automaton = ahocorasick.Automaton()
        for s, i in vocab.items():
            if self.merged(s) == [i]:  # a token that its own bytes don't give never ends a prefix
                self._automaton.add_word(s.decode("latin-1"), (i, len(s)))
        self._automaton.make_automaton()
        self._apart = Memo(lambda p: self.merged(self.bytes_of[p[0]] + self.bytes_of[p[1]]) == list(p), PAIRS)
        self.packed = Memo(lambda piece: struct.pack(f"<{len(ids := self.encode_bytes(piece.encode()))}I", *ids), PIECES)

    def merged(self, data: bytes) -> list[int]:
        """The merges applied one by one; for short strings only."""
        ids = [self._byte_ids[b] for b in data]
        while len(ids) > 1:
            (rank, new), at = min((self._merges.get(p, (1 << 60, -1)), i) for i, p in enumerate(zip(ids, ids[1:], strict=False)))
            if new < 0:
                break
            pair, out, i = (ids[at], ids[at + 1]), [], 0
            while i < len(ids):
                if i + 1 < len(ids) and (ids[i], ids[i + 1]) == pair:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        last: list[int] = [-1] * (len(data) + 1)
        apart = self._apart
        for end, (token, length) in self._automaton.iter(data.decode("latin-1")):
            if last[end + 1] < 0:
                start = end + 1 - length
                if not start or apart[last[start], token]:
                    last[end + 1] = token
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at -= self._length[last[at]]
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Ids of a text, packed as little-endian unsigned 32-bit integers."""
        out = []
        for special, s in self.cut.segments(text):
            if special:
                out.append(struct.pack("<I", self.cut.specials[s]))
            else:
                out.extend(map(self.packed.__getitem__, self.cut.pieces(s)))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder(path: str) -> PrefixCoder:
    return PrefixCoder(path)


def encode_documents(df: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """All columns, and the text's ids as packed binary; with ``decoded_col`` also the text decoded from them.

    Null texts count as empty: no ids. Rows are kept one to one, repeated ones too; a column of
    the input named like an output column is replaced.
    """
    tune(df.sparkSession)
    out = [ids_col] + ([decoded_col] if decoded_col else [])
    kept = [c for c in df.columns if c not in out]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept), f"`{ids_col}` binary", *([f"`{decoded_col}` string"] if decoded_col else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", coder.cache_clear)
        code = coder(tokenizer)
        for batch in batches:
            ids = [code.encode(x or "") for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            columns = [*(batch.column(i) for i in range(batch.num_columns)), pa.array(ids, pa.binary())]
            if decoded_col:
                columns.append(pa.array([code.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *out])

    return df.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)


def encoding_digest(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, without the ids leaving the worker."""
    tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", coder.cache_clear)
        code = coder(tokenizer)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = code.encode(text or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(code.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
