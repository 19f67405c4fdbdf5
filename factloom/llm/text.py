"""Words, lines and five-word shingles as native columns, shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Words in a shingle.
SHINGLE = 5


def words(text: Column) -> Column:
    """Words of a text in order; none for a null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that rows share only if they have the same id (or none) and the same text; a null text is an empty one."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary")))


def shingle_hash(array: Column, i: Column, width: int = SHINGLE) -> Column:
    """64-bit hash of ``width`` neighbouring words from position ``i`` on."""
    return F.xxhash64(*(F.get(array, i + k) for k in range(width)))


def shingle_hashes(array: Column, width: int = SHINGLE) -> Column:
    """A hash for each window of ``width`` words; none if there are fewer words."""
    n = F.size(array)
    at = F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: shingle_hash(array, i, width))


def lines(text: Column) -> Column:
    """Lines of a text between line feeds; a null is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)
