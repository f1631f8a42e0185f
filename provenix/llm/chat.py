"""Chat formatting by columnar byte assembly.

A turn is the segments START, role, line feed, text, END. For a slice of turns the lengths of all
segments give their offsets by one cumulative sum; constants and contents are then scattered into one
preallocated buffer by index arrays, and that buffer is the Arrow column. Control strings inside
roles and texts are escaped: ``<``, any backslashes, ``|`` get one backslash more before the bar, so
the control strings cannot occur inside and taking one backslash away restores the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenix.llm.common import tune

START, NEWLINE, END = "<|im_start|>", "\n", "<|im_end|>\n"
LOSS_ROLE = "assistant"
#: Bytes of texts assembled at a time (one longer text is a slice of its own).
SLICE_BYTES = 8 << 20

_MARKED = re.compile(r"<(\\+)\|")
_ROLE_BACK = re.compile(r"\\([\\n])")

PARTS = "conv_id long, part long, formatted string, loss_starts array<long>, loss_lengths array<long>"


def escaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\1\\|")


def unescaped(text: str) -> str:
    return _MARKED.sub(lambda m: f"<{m[1][1:]}|", text)


def escaped_role(roles: pa.Array) -> pa.Array:
    """A role is one line: backslashes and line feeds are escaped first."""
    return escaped(pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n"))


def unescaped_role(role: str) -> str:
    return _ROLE_BACK.sub(lambda m: "\n" if m[1] == "n" else "\\", unescaped(role))


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data bytes, start offsets and lengths of a string column without nulls."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data, offsets[:-1], np.diff(offsets)


def assemble(roles: pa.Array, texts: pa.Array, groups: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted text of each run of turns (``groups``: run number of each turn, from 0, ascending); start and length in code points of each turn's text in its run."""
    roles, texts = escaped_role(roles), escaped(texts)
    n = len(roles)
    consts = [np.frombuffer(x.encode(), np.uint8) for x in (START, NEWLINE, END)]
    sources = [_raw(roles), _raw(texts)]
    lengths = np.empty((n, 5), np.int64)
    for k, x in zip((0, 2, 4), consts, strict=True):
        lengths[:, k] = len(x)
    for k, (_, _, size) in zip((1, 3), sources, strict=True):
        lengths[:, k] = size
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    begins = ends - lengths
    buffer = np.empty(int(ends[-1, 4]) if n else 0, np.uint8)
    for k, x in zip((0, 2, 4), consts, strict=True):
        buffer[begins[:, k, None] + np.arange(len(x))] = x
    for k, (data, at, size) in zip((1, 3), sources, strict=True):
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        buffer[np.repeat(begins[:, k], size) + within] = data[np.repeat(at, size) + within]
    first = np.flatnonzero(np.diff(groups, prepend=-1))
    offsets = np.append(begins[first, 0], len(buffer)).astype(np.int32)
    out = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(buffer))
    chars = np.empty((n, 5), np.int64)  # the same in code points, for the loss mask
    chars[:] = lengths
    for k, column in ((1, roles), (3, texts)):
        chars[:, k] = pc.utf8_length(column).to_numpy(zero_copy_only=False)
    char_ends = np.cumsum(chars.ravel()).reshape(n, 5)
    base = (char_ends - chars)[first, 0][groups] if n else np.zeros(0, np.int64)
    return out, char_ends[:, 2] - base, chars[:, 3]


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, part, formatted, loss_starts, loss_lengths), each conversation's parts in order and within one partition.

    The parts of a conversation joined by part number are its formatted text; most have one. A long
    conversation, however many of the rows it holds, streams through in parts and is never gathered.
    The loss mask is in code points of the part and covers the texts of assistant turns. Null texts
    and roles are empty; null turns come first; equal turns go by role, then text; the rows of a null
    conv_id are one conversation. Repeated rows are turns of their own. Other columns are not read.
    """
    tune(df.sparkSession)
    rows = df.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(_format, PARTS)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before, part = object(), 0
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.flatnonzero(np.diff(size // SLICE_BYTES, prepend=0))
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if lo == hi:
                continue
            rows = batch.slice(lo, hi - lo)
            convs = rows.column(0).to_pylist()
            groups = np.cumsum([i > 0 and a != convs[i - 1] for i, a in enumerate(convs)])
            out, at, length = assemble(rows.column(1), rows.column(2), groups)
            masked = pc.equal(rows.column(1), LOSS_ROLE).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.diff(groups, prepend=-1))
            ids, parts = [], []
            for i in first.tolist():
                part = part + 1 if convs[i] == before else 0
                before = convs[i]
                ids.append(before)
                parts.append(part)
            mask_offsets = np.append(np.concatenate(([0], np.cumsum(masked)))[first], masked.sum()).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(mask_offsets, pa.int32()), pa.array(x[masked], pa.int64())) for x in (at, length)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int64()), out, *lists], names=["conv_id", "part", "formatted", "loss_starts", "loss_lengths"])


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError("a turn doesn't start where the one before ends")
        line = formatted.index(NEWLINE, at)
        stop = formatted.index(END, line + 1)
        yield unescaped_role(formatted[at + len(START) : line]), unescaped(formatted[line + 1 : stop])
        at = stop + len(END)


def read_back(parts: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from formatted parts alone."""
    return parts.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    now, done = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] == 0:
                if now:
                    done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))
                now = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            text = row["formatted"]
            for role, said in parse(text):
                now[1] += 1
                now[2].update(f"{role}\n{said}\n".encode())
            for at, length in zip(row["loss_starts"], row["loss_lengths"], strict=True):
                said = unescaped(text[at : at + length])
                now[3] += len(said)
                now[4].update(said.encode())
            now[5] += len(text)
        if done:
            yield made(done)
            done = []
    if now:
        yield made([(now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])])
