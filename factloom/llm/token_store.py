"""Token-id output: Parquet list columns in ascending document order, with bounded row groups and page indexes."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import scratch
from factloom.llm.word_cache import trimmed
from factloom.llm.words import slices

#: Chunks whose ids do not depend on case or on what stands beside them: Latin letters without marks of their own, then full stops and commas.
_PLAIN = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[.,]*)$"

#: Writer settings of the file format: small row groups and pages so that a read of few documents touches few bytes,
#: dictionary encoding for ids (delta packing of version 2 pages where a dictionary does not pay).
LAYOUT = {
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.writer.version": "v2",
    "compression": "zstd",
}


#: Token files (a name and a long each) up to which their places are broadcast; beyond, Spark joins by shuffle.
BROADCAST_FILES = 200_000
#: Words, and as many other chunks, that a worker keeps with their ids, about 40 bytes each.
CACHED = 500_000


class ArrowCache:
    """Ids of distinct words as one Arrow array beside the words, so a word costs its bytes and no Python objects.

    It stays between tasks. Beyond ``limit`` words it keeps those asked for last.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = CACHED):
        self.encode, self.limit = encode, limit
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def get(self, wanted: pa.Array) -> pa.Array:
        """Ids of each of the distinct words of ``wanted``, as little-endian bytes."""
        wanted = wanted.cast(pa.string())
        at = pc.index_in(wanted, value_set=self.words)
        missing = wanted.filter(at.is_null())
        if len(missing):
            new = _packed(*self.encode(missing.to_pylist()))
            place = pa.array(np.arange(len(self.words), len(self.words) + len(missing), dtype=np.int32))
            at = pc.replace_with_mask(at, at.is_null(), place)
            self.words, self.ids = pa.concat_arrays([self.words, missing]), pa.concat_arrays([self.ids, new])
        found = self.ids.take(at)
        if len(self.words) > self.limit:
            self.words, self.ids = pa.concat_arrays([wanted[: self.limit]]), pa.concat_arrays([found[: self.limit]])
        return found


def _packed(ids: np.ndarray, size: np.ndarray) -> pa.Array:
    """``size`` ids for each row, one after the other, as an array of bytes."""
    cut = np.concatenate([[0], np.cumsum(size)]).astype(np.int64) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(ids, dtype="<u4"))])


class ChunkEncoder:
    """Ids of whole texts from a tokenizers file whose pre-tokenizer never joins across an ASCII space or line feed.

    The normalizer folds white space to one space and the pre-tokenizer drops it, so a text is the concatenation of
    its chunks between spaces. Distinct chunks are found by Arrow; plain ones fall into a lower-cased word and its
    trailing full stops and commas, and each distinct part is encoded by the library once and then looked up.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.words, self.others = ArrowCache(self._words), ArrowCache(self._library)

    def _library(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all keys, one after the other, and how many each has."""
        coded = [x.ids for x in self.tokenizer.encode_batch_fast(keys, add_special_tokens=False)]
        size = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        return np.fromiter(chain.from_iterable(coded), dtype="<u4", count=int(size.sum())), size

    def _words(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each key is one pre-token or empty, and the last id of a pre-token is one that ends a word."""
        ids, sizes = [], []
        for k in range(0, len(keys), 2000):
            part = keys[k : k + 2000]
            made = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cut = np.flatnonzero(self.ends[made]) + 1
            if len(cut) != len(part):  # an empty key, or a file without word ends
                made, size = self._library(part)
            else:
                size = np.diff(cut, prepend=0)
            ids.append(made)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def _distinct(self, chunks: pa.Array) -> pa.Array:
        """Ids of each chunk, as little-endian bytes."""
        m = pc.extract_regex(chunks, _PLAIN)
        plain = m.is_valid()
        word = pc.utf8_lower(m.field("word")).filter(plain).dictionary_encode()
        tail = m.field("tail").filter(plain).dictionary_encode()
        tails = _packed(*self._library(tail.dictionary.to_pylist()))
        joined = pc.binary_join_element_wise(self.words.get(word.dictionary).take(word.indices), tails.take(tail.indices), pa.scalar(b"", pa.large_binary()))
        others = self.others.get(chunks.filter(pc.invert(plain)))
        flags = plain.to_numpy(zero_copy_only=False)
        at = np.where(flags, np.cumsum(flags) - 1, len(joined) + np.cumsum(~flags) - 1)
        return pa.concat_arrays([joined, others]).take(pa.array(at))

    def encode(self, texts: pa.Array, end: int | None = None) -> pa.ListArray:
        """Ids of each text of an Arrow string array, with ``end`` after each if given; a null is an empty text."""
        texts = pc.fill_null(texts, "")
        chunks = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = chunks.flatten().dictionary_encode()
        known, at = self._distinct(coded.dictionary), coded.indices.to_numpy()
        bounds = chunks.offsets.to_numpy() - chunks.offsets[0].as_py()
        if end is not None:  # one more chunk, of the end id alone, after the chunks of each text
            known = pa.concat_arrays([known, _packed(np.array([end]), np.array([1]))])
            at = np.insert(at, bounds[1:], len(known) - 1)
            bounds = bounds + np.arange(len(bounds))
        _, cut, flat = known.take(pa.array(at)).buffers()
        total = np.frombuffer(cut, dtype=np.int64)[bounds] // 4
        ids = np.frombuffer(flat, dtype="<i4")[: total[-1]] if flat is not None else np.empty(0, dtype="<i4")
        return pa.ListArray.from_arrays(pa.array(total.astype(np.int32)), pa.array(ids))


@lru_cache(2)
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 1, partitions: int | None = None) -> None:
    """Encode ``docs(doc_id, text)`` and write token files to ``path``.

    Rows are dealt by ranges of doc_id and sorted, so the files in order of their partition numbers hold the documents
    in ascending order. Null ids come first; rows with equal ids or none stand in order of a hash of their text, which
    also deals them out, so every run gives each text the same place. A null text is an empty one and gets the end id
    alone. Columns: doc_id, ids (list of int), n_tokens, local_start (ids before the document in its file).
    Other columns of ``docs`` are not written.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = _encoder(tokenizer), 0
        for batch in trimmed(batches):
            for part in slices(batch, limit=8 << 20):
                ids = encoder.encode(part.column("text"), end)
                size = np.diff(ids.offsets.to_numpy()).astype(np.int64)
                start = before + np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)[: len(size)]
                before += int(size.sum())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(size), pa.array(start)], ["doc_id", "ids", "n_tokens", "local_start"])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    ordered = keyed.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(encode, "doc_id long, ids array<int>, n_tokens long, local_start long").write.options(**LAYOUT).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a token folder with ``start``, the ids of all documents before each one.

    Only the sizes are read to place the files one after the other, in order of the partition numbers in their names:
    one row for each file, so the window over them has as many rows as there are files, and they are broadcast if they
    are few enough. Selecting few documents or no ids prunes pages and columns.
    """
    rows = spark.read.schema("doc_id long, ids array<int>, n_tokens long, local_start long").parquet(path).withColumn("file", F.col("_metadata.file_name"))
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("size"))
    number = r"CAST(regexp_extract(file, '^part-(\\d+)', 1) AS BIGINT)"
    placed = scratch.stored(files.selectExpr("file", f"coalesce(sum(size) over (order by {number}, file rows between unbounded preceding and 1 preceding), 0L) as base"), "token-file-places")
    placed = F.broadcast(placed) if placed.count() <= BROADCAST_FILES else placed
    return rows.join(placed, "file").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """``ids_crc32`` of each row of ``read``: crc32 of the ids as little-endian unsigned 32-bit integers."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, cut = memoryview(np.ascontiguousarray(ids.values.to_numpy(), dtype="<i4")).cast("B"), ids.offsets.to_numpy()
            sums = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end: int = 1) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and give back what a reader finds in them, as ``checksums``."""
    path = scratch.new_path(docs.sparkSession, "token-files")
    write(docs, path, tokenizer, end)
    return checksums(read(docs.sparkSession, path))
