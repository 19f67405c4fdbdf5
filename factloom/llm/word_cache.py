"""A bounded cache of what a text chunk encodes to, kept by each Python worker during a task."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: Entries in each of the two generations that a cache holds at most.
GENERATION = 150_000


class TwoGenerations:
    """A cache that is asked with ``fill``, which gives back a dict with at least the keys asked for.

    When the young generation is full it becomes the old one, and the former old one goes, so frequent keys stay
    and memory is bounded by two generations plus the distinct keys of one ``fill``.
    """

    def __init__(self, encode: Callable[[list], Iterable], limit: int = GENERATION):
        self.encode, self.limit, self.young, self.old = encode, limit, {}, {}

    def fill(self, wanted: set) -> dict:
        if len(self.young) + len(wanted) > self.limit:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        missing = []
        for k in wanted.difference(young):
            if k in old:
                young[k] = old[k]
            else:
                missing.append(k)
        if missing:
            young.update(zip(missing, self.encode(missing), strict=True))
        return young

    def forget(self) -> None:
        self.young, self.old = {}, {}


def trimmed(batches: Iterator[pa.RecordBatch], *forget: Callable[[], None]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; after the last one the caches go and free memory goes back to the system.

    Meanwhile cyclic garbage is not looked for: large caches would be walked again and again, and make none.
    """
    gc.disable()
    try:
        yield from batches
    finally:
        for f in forget:
            f()
        gc.enable()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not every C library can
            pass
