"""Simple-8b: varying counts of small integers in 64-bit words, vectorised both ways.

The top four bits of a word select how many values its other sixty bits hold and how wide each is.
Selector 0 is the escape: that word holds a count, and as many raw 64-bit values follow.
"""

from __future__ import annotations

import numpy as np

#: (values in a word, bits of each) for selectors 1 to 15.
LAYOUTS = [(120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE_FROM = 1 << 60
_COUNT = np.array([0, *(n for n, _ in LAYOUTS)], np.int64)


#: Bits of the values below 2**16, by a rule: one more at each power of two.
_BITS16 = np.repeat(np.arange(17, dtype=np.uint8), np.diff([0, *(1 << np.arange(17))]))


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    if not (values >> np.uint64(16)).any():
        return _BITS16[values]
    out = np.zeros(len(values), np.uint8)
    for shift in (32, 16, 8, 4, 2, 1):
        high = values >> np.uint64(shift)
        big = high > 0
        out[big] += shift
        values = np.where(big, high, values)
    return out + (values > 0)


def _pack(values: np.ndarray) -> np.ndarray:
    """Words of values that all are below ESCAPE_FROM: each word holds as many values from its place on as any selector can."""
    total = len(values)
    take = np.ones(total, np.uint8)  # selector 15 always fits
    chosen = np.full(total, 15, np.uint8)
    widest, held = _widths(values), 1  # the most bits in the next ``held`` values
    for selector in range(14, 0, -1):
        n, bits = LAYOUTS[selector - 1]
        if total < n:
            break
        while held < n:  # windows overlap, as a maximum may count a value twice
            step = min(held, n - held)
            widest = np.maximum(widest[:-step], widest[step:])
            held += step
        fits = np.flatnonzero(widest <= bits)
        if not len(fits):  # nor will any longer run of fewer bits
            break
        take[fits], chosen[fits] = n, selector
    starts, at, steps = [], 0, take.tolist()
    while at < total:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts, np.int64)
    picked = chosen[starts]
    words = picked.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(picked):
        n, bits = LAYOUTS[selector - 1]
        if bits:
            rows = np.flatnonzero(picked == selector)
            block = values[starts[rows, None] + np.arange(n)] << (np.arange(n, dtype=np.uint64) * np.uint64(bits))
            words[rows] |= np.bitwise_or.reduce(block, axis=1)
    return words


def pack(values: np.ndarray) -> np.ndarray:
    """uint64 words of unsigned values."""
    values = np.ascontiguousarray(values, np.uint64)
    big = values >= np.uint64(ESCAPE_FROM)
    if not big.any():
        return _pack(values)
    out, edges = [], np.flatnonzero(np.diff(big)) + 1
    for run in np.split(np.arange(len(values)), edges):
        out.append(np.concatenate((np.array([len(run)], np.uint64), values[run])) if big[run[0]] else _pack(values[run]))
    return np.concatenate(out)


def _unpack(words: np.ndarray) -> np.ndarray:
    selectors = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(_COUNT[selectors])
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for selector in np.unique(selectors):
        n, bits = LAYOUTS[selector - 1]
        if bits:
            rows = np.flatnonzero(selectors == selector)
            mask = np.uint64((1 << bits) - 1)
            out[(ends[rows] - n)[:, None] + np.arange(n)] = (words[rows, None] >> (np.arange(n, dtype=np.uint64) * np.uint64(bits))) & mask
    return out


def unpack(words: np.ndarray, escaped: bool = True) -> np.ndarray:
    """The values again. ``escaped`` False says that no word is an escape, and skips looking for one."""
    words = np.ascontiguousarray(words, np.uint64)
    if not escaped or not ((words >> np.uint64(60)) == 0).any():
        return _unpack(words)
    out, at = [], 0
    while at < len(words):
        stops = np.flatnonzero((words[at:] >> np.uint64(60)) == 0)
        stop = at + int(stops[0]) if len(stops) else len(words)
        out.append(_unpack(words[at:stop]))
        if stop < len(words):
            n = int(words[stop])
            out.append(words[stop + 1 : stop + 1 + n])
            stop += 1 + n
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.uint64)
