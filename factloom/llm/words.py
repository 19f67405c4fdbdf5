"""Word hashes of Arrow text columns, windows over them, and slices of batches whose texts have a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
#: Bytes of text that a Python worker expands at once; one longer text stands alone.
SLICE = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts whose texts have at most ``limit`` bytes, or one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        stop = max(int(np.searchsorted(size, before + limit, side="right")), at + 1)
        yield batch.slice(at, stop - at)
        at = stop


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, one after the other, and the bounds of each text in them.

    Words are lower-cased and stand between ASCII white space; a null has none.
    """
    words = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
    flat = words.flatten().dictionary_encode()
    entries = flat.dictionary.to_pylist()
    coded = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in entries), dtype=U, count=len(entries))[flat.indices.to_numpy()]
    if "" in entries:
        full = flat.indices.to_numpy() != entries.index("")
        bounds = np.concatenate([[0], np.cumsum(full)])[bounds]
        coded = coded[full]
    return coded, bounds


def window_hashes(coded: np.ndarray, width: int, factor: int) -> np.ndarray:
    """A 64-bit hash of each window of ``width`` words: a polynomial in ``factor`` (odd), built by doubling and mixed."""
    n = len(coded) - width + 1
    if n <= 0:
        return coded[:0]
    mask = (1 << 64) - 1
    part, size, out, done = coded, 1, None, 0
    left = width
    while left:
        if left & 1:
            # words done .. done + size - 1 of each window
            piece = part[done : done + n]
            out = piece.copy() if out is None else out * U(pow(factor, size, 1 << 64) & mask) + piece
            done += size
        left >>= 1
        if left:
            part = part[:-size] * U(pow(factor, size, 1 << 64) & mask) + part[size:]
            size *= 2
    return mix(out)


def sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) over each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return best(x[: len(x) - rest], x[rest:]) if rest else x
