"""Token counts through a digest cache: only distinct texts that the cache lacks are encoded."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom import scratch
from factloom.llm.word_cache import TwoGenerations, trimmed
from factloom.llm.words import slices

_CACHE = "tokenizer string, digest binary, n_tokens long"


class PieceCounter:
    """Token counts of whole texts from a sentencepiece file, a chunk at a time.

    No piece of such a file holds a word mark after another character (``splits`` checks it), so merges never cross
    from a character to a following space; nor do they cross a line feed that only bytes can spell. Each distinct
    chunk is encoded by the library once. Texts for which this doesn't hold are encoded whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.splits = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) and [len(self.model.encode(x)) for x in ("\n", " a", "a\n a")] == [2, len(self.model.encode("▁a")), 1 + 2 * len(self.model.encode("a"))]
        self.counts = TwoGenerations(lambda keys: map(len, self.model.encode(keys, num_threads=1)))

    def forget(self) -> None:
        self.counts.forget()

    def __call__(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        whole, cut = [], []
        for k, text in enumerate(texts):
            if not text:
                continue
            if not self.splits or "▁" in text or "  " in text or " \n" in text or text[0] == " " or text[-1] == " ":
                whole.append(k)
            else:
                cut.append((k, text.replace("\n", " \n").split(" "), text.count("\n")))
        for k, n in zip(whole, map(len, self.model.encode([texts[k] for k in whole], num_threads=1)), strict=True):
            out[k] = n
        get = self.counts.fill({x for _, words, _ in cut for x in words}).__getitem__
        for k, words, lines in cut:  # a chunk that begins with a line feed gets a mark that is not in the text
            out[k] = sum(map(get, words)) - lines + (words[0] == "")  # unless the text begins with it
        return out


class JsonCounter:
    """Token counts of whole texts from a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def forget(self) -> None:
        """Nothing is kept."""

    def __call__(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(2)
def counter(path: str) -> PieceCounter | JsonCounter:
    return JsonCounter(path) if path.endswith(".json") else PieceCounter(path)


def version(path: str) -> str:
    """Digest of a tokenizer file: a changed file gets counts of its own."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 4096) -> DataFrame:
    """Tokens of every row of ``docs(doc_id, text)``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    The content is taken as it stands (a null as empty), because any rewriting may change its count; its SHA-256 and
    that of the tokenizer file are the cache's key. ``cache`` is a folder of Parquet files shared by all runs; without
    one each call starts an empty cache of its own. Of the texts that the cache lacks, the row with the least doc_id
    of each digest is encoded (null ids rank last), and its count is appended. Rows that repeat count each; other
    columns are ignored. The texts move once, to meet the rows that stand for their digests, by digest and id, so that
    neither a third of all rows without an id nor a third with one text meets in a task; the last join carries digests and counts only, which Spark can split for a hot key.
    """
    spark = docs.sparkSession
    cache = cache or scratch.new_path(spark, "token-cache")
    file = version(tokenizer)
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
    known = scratch.stored(docs.select("doc_id", digest, F.octet_length(text).cast("long").alias("n_bytes")), "token-digests")
    spark.createDataFrame([], _CACHE).write.mode("append").parquet(cache)
    stored = spark.read.schema(_CACHE).parquet(cache).where(F.col("tokenizer") == file).select("digest", "n_tokens")
    missing = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(stored, "digest", "left_anti")
    stands = missing.select(F.col("doc_id").alias("key"), F.col("digest").alias("wanted"))
    texts = docs.select("doc_id", digest, text.alias("text"))
    fresh = texts.join(stands.hint("shuffle_hash"), (texts["digest"] == stands["wanted"]) & texts["doc_id"].eqNullSafe(stands["key"]))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in trimmed(batches, count.forget):
            for part in slices(batch):
                n = count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(n), pa.string()), part.column("wanted"), pa.array(n, pa.int64())], ["tokenizer", "digest", "n_tokens"])

    fresh.select("wanted", "text").mapInArrow(encode, _CACHE).write.mode("append").parquet(cache)
    counts = spark.read.schema(_CACHE).parquet(cache).where(F.col("tokenizer") == file).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return known.join(scratch.stored(counts, "token-counts"), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
