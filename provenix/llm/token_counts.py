"""Token counts by the whole-token shortcut.

A vocabulary string that encodes alone as one token, proved once on the driver by encoding it,
counts one wherever it is a pre-token. Only other pre-tokens are merged, by the tokenizers library,
a batch of distinct ones at a time, and remembered within bounds.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenix.llm.common import tune
from provenix.llm.memory import claim
from provenix.llm.pieces import byte_chars, cutter

#: Pre-tokens that a worker remembers beside the vocabulary; documents handled at a time; longest string remembered.
KEPT, CHUNK, LONGEST = 400_000, 64, 64


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and encode alone as one token: at most the vocabulary's size."""
    cut = cutter(path)
    byte_of = {c: b for b, c in byte_chars().items()}
    strings = []
    for s in cut.read()["model"]["vocab"]:
        try:
            strings.append(bytes(byte_of[c] for c in s).decode())
        except UnicodeDecodeError:  # a part of a character is no pre-token
            continue
    own = [s for s in strings if s not in cut.specials and cut.pieces(s) == [s]]
    return frozenset(s for s, e in zip(own, cut.tokenizer.encode_batch(own, add_special_tokens=False), strict=True) if len(e.ids) == 1)


@lru_cache(maxsize=2)
def _worker(path: str) -> tuple:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return cutter(path), {}


def merge_lengths(cut, strings: list[str]) -> list[int]:
    return [len(e.ids) for e in cut.tokenizer.encode_batch(strings, add_special_tokens=False)]


def token_counts(df: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), n_whole (pre-tokens that the shortcut counted).

    Special strings inside a text count one each. Null texts count as empty (zeros, not over the
    limit); repeated rows and null ids are kept one to one; other columns are not read.
    """
    tune(df.sparkSession)
    proved = df.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token-counts", _worker.cache_clear)
        cut, rest = _worker(tokenizer)
        whole = proved.value
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                texts = [x or "" for x in part.column(1).to_pylist()]
                specials, pieces = [], []
                for text in texts:
                    parts = cut.segments(text)
                    specials.append(sum(s for s, _ in parts))
                    pieces.append(cut.pieces(parts[0][1]) if len(parts) == 1 and not parts[0][0] else [w for s, x in parts if not s for w in cut.pieces(x)])
                others = [[w for w in ws if w not in whole] for ws in pieces]
                new = list({w for ws in others for w in ws if w not in rest})
                if len(rest) + len(new) > KEPT:
                    rest.clear()
                    new = list({w for ws in others for w in ws})
                rest.update(zip(new, merge_lengths(cut, new), strict=True))
                short = [len(a) - len(b) for a, b in zip(pieces, others, strict=True)]
                n = [s + k + sum(map(rest.__getitem__, ws)) for s, k, ws in zip(specials, short, others, strict=True)]
                for w in new:
                    if len(w) > LONGEST:
                        del rest[w]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n]), pa.array(short, pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_whole"],
                )

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_whole long")
