"""What a Python worker remembers between batches, within bounds."""

from __future__ import annotations

import ctypes
import gc
from contextlib import suppress

import pyarrow as pa

_held: list = []


def claim(owner: str, *forget) -> None:
    """What a worker remembers for one operator is forgotten once another one runs in it: ``forget`` are calls that drop it."""
    if not _held or _held[0] != owner:
        for drop in _held[1:]:
            drop()
        _held[:] = [owner, *forget]
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # the C library's own call; where there is none, memory is kept
            ctypes.CDLL("libc.so.6").malloc_trim(0)


class Memo(dict):
    """A bounded memory of pieces; ``make`` gives what is missing. Long pieces are not kept."""

    def __init__(self, make, entries: int = 400_000, longest: int = 64):
        super().__init__()
        self.make, self.entries, self.longest = make, entries, longest

    def __missing__(self, piece):
        value = self.make(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.entries:
                self.clear()
            self[piece] = value
        return value
