"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted-shingle check."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import scratch
from factloom.llm import text as tx

#: A word for this comparison: letters and digits, in lower case.
WORD = r"[\p{L}\p{N}]+"
#: Weighted Jaccard similarity from which a window is a leak, as tenths.
TENTHS = 8
#: Fingerprints of 64 bits fall into 8 blocks of 8 bits. Two that differ in at most 8 * 3 - 1 bits differ in at most
#: 2 bits in some block, so looking up all values within 2 bits of each block finds every pair within RADIUS.
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
_NEAR = sorted(sum(1 << b for b in c) for k in range(BLOCK_RADIUS + 1) for c in combinations(range(BLOCK_BITS), k))
#: Rows of a side (a few longs each) up to which it is broadcast; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 400_000

_FINGERPRINT = """aggregate(sequence(0, 63), 0L, (a, b) -> a | CASE WHEN 2 * aggregate(hashes, 0, (c, x) -> c + CAST(shiftrightunsigned(x, b) & 1L AS INT)) > size(hashes)
    THEN shiftleft(1L, b) ELSE 0L END)"""


def _small(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a stored table, marked for broadcast if it is small enough."""
    kept = scratch.stored(df, name)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item_id, width (words), hashes of shingles and fingerprint; items of fewer than five words have none and go."""
    w = benchmark.select("item_id", _words(F.col("text")).alias("w"))
    rows = w.select("item_id", F.size("w").alias("width"), tx.shingle_hashes(F.col("w")).alias("hashes")).where("width >= 5")
    return rows.withColumn("print", F.expr(_FINGERPRINT))


def _windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """key, starts (width and start of each window to look at): all windows that can reach the similarity.

    A window as long as its item (or a shorter document as a whole) reaches it only if it holds so many positions
    whose shingle is in the item; all starts for which it does are kept, so no leak is lost here.
    """
    held = _small(items.select(F.explode(F.array_distinct("hashes")).alias("hash"), "item_id", "width"), "item-shingles")
    w = docs.select("key", _words(F.col("text")).alias("w")).withColumn("n", F.size("w")).where("n >= 5")
    at = w.select("key", "n", "w", F.explode(F.sequence(F.lit(0), F.col("n") - tx.SHINGLE)).alias("i"))
    hits = at.select("key", "n", "i", tx.shingle_hash(F.col("w"), F.col("i")).alias("hash")).join(held, "hash")
    found = hits.groupBy("key", "n", "item_id", "width").agg(F.array_sort(F.collect_set("i")).alias("p"))
    span = "least(width, n) - 4"
    sized = found.selectExpr("key", "n", "width", "p", f"{span} as span", f"CAST(ceil({TENTHS} * ({span} + width - 4) / {10 + TENTHS}.0) AS INT) as need").where("size(p) >= need")
    each = sized.select("key", "n", "width", "span", F.explode(F.expr("transform(sequence(0, size(p) - need), j -> named_struct('first', p[j], 'last', p[j + need - 1]))")).alias("r"))
    low, high = F.greatest(F.lit(0), F.col("r.last") - F.col("span") + 1), F.least(F.col("r.first"), F.greatest(F.lit(0), F.col("n") - F.col("width")))
    ranged = each.select("key", "width", low.alias("low"), high.alias("high")).where("low <= high")
    starts = ranged.select("key", "width", F.explode(F.sequence("low", "high")).alias("start"))
    return starts.groupBy("key").agg(F.collect_set(F.struct("width", "start")).alias("starts"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Leaks of ``benchmark(item_id, text)`` in ``docs(doc_id, text)``, a row for each document and item.

    doc_id, item_id, start and n_words of the best window (from word 0; the earliest of equals), shared and total
    shingle weight, similarity = shared / total, at least 0.8. Weights are how often a five-word shingle occurs.
    A document shorter than an item is one window. Null and empty texts, texts and items of fewer than five words
    match nothing. Rows with equal ids (or none) are looked at each for itself; those that repeat id and text give one
    row for each item. Other columns are ignored. Documents are read twice; their texts are shuffled only if more documents than can be
    broadcast hold windows to look at.
    """
    return _row_leaks(docs, benchmark).drop("key")


def _row_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The leaks, each with the row key of its document."""
    docs = docs.select(tx.row_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", "text")
    items = scratch.stored(benchmark_items(benchmark), "benchmark-items")
    wanted = _small(_windows(docs, items), "windows")
    texts = docs.join(wanted, "key").select("key", "doc_id", "starts", _words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    each = texts.select("key", "doc_id", "w", "n", F.explode("starts").alias("s")).select("key", "doc_id", "w", "n", "s.width", "s.start")
    span = F.least(F.col("width"), F.col("n")) - F.lit(tx.SHINGLE)
    each = each.where((F.col("start") + F.least("width", "n") <= F.col("n")) & (F.col("n") >= tx.SHINGLE))
    hashed = each.select("key", "doc_id", "width", "start", F.least("width", "n").alias("n_words"), F.transform(F.sequence(F.col("start"), F.col("start") + span), lambda i: tx.shingle_hash(F.col("w"), i)).alias("hashes"))
    printed = hashed.withColumn("print", F.expr(_FINGERPRINT))
    blocks = printed.withColumn("block", F.explode(F.array(*map(F.lit, range(BLOCKS)))))
    value = "CAST(shiftrightunsigned(print, 8 * block) & 255L AS INT)"
    probes = blocks.selectExpr("*", f"{value} as value")
    near = F.explode(F.array(*map(F.lit, _NEAR)))
    keyed = items.select("item_id", "width", F.col("print"), F.explode(F.array(*map(F.lit, range(BLOCKS)))).alias("block"))
    index = keyed.selectExpr("item_id", "width", "print", "block", f"{value} as own").select("item_id", "width", F.col("print").alias("item_print"), "block", "own", near.alias("flip")).selectExpr("item_id", "width", "item_print", "block", "own ^ flip as value")
    met = probes.join(_small(index, "hamming-index"), ["width", "block", "value"])
    differ = F.col("print").bitwiseXOR(F.col("item_print"))
    # a pair that meets in several blocks is taken in the first
    first = F.expr(f"NOT exists(sequence(0, 7), b -> b < block AND bit_count(shiftrightunsigned(print ^ item_print, 8 * b) & 255L) <= {BLOCK_RADIUS})")
    close = met.where((F.bit_count(differ) <= RADIUS) & first)
    other = _small(items.select("item_id", F.col("hashes").alias("item_hashes")), "item-hashes")
    pair = close.join(other, "item_id")
    shared = F.expr("aggregate(array_intersect(hashes, item_hashes), 0, (a, h) -> a + least(size(filter(hashes, x -> x = h)), size(filter(item_hashes, x -> x = h))))")
    total = F.size("hashes") + F.size("item_hashes") - F.col("shared")
    sure = pair.withColumn("shared", shared).withColumn("total", total).where(10 * F.col("shared") >= TENTHS * F.col("total"))
    best = sure.groupBy("key", "doc_id", "item_id").agg(F.max(F.struct((F.col("shared") / F.col("total")).alias("similarity"), (-F.col("start")).alias("back"), "n_words", "shared", "total")).alias("b"))
    return best.select("key", "doc_id", "item_id", (-F.col("b.back")).cast("long").alias("start"), *(F.col(f"b.{c}").cast("long").alias(c) for c in ("n_words", "shared", "total")), F.col("b.similarity").alias("similarity"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with all their columns."""
    bad = _small(_row_leaks(docs, benchmark).select(F.col("key").alias("_leaks")).distinct(), "leaking-documents")
    return docs.join(bad, tx.row_key(docs["doc_id"], docs["text"]) == bad["_leaks"], "left_anti")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
d AS (SELECT doc_id, len(w) AS n, i - 1 AS i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM w)),
t AS (SELECT item_id, len(w) AS l, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM b)),
c AS (SELECT item_id, l, g, count(*) AS k FROM t GROUP BY ALL),
h AS (SELECT doc_id, n, i, item_id, l, g, k FROM d JOIN c USING (g)),
s AS (SELECT DISTINCT doc_id, item_id, unnest(range(greatest(0, i - (least(l, n) - 5)), least(i, greatest(n - l, 0)) + 1)) AS s FROM h),
m AS (SELECT doc_id, item_id, n, l, s, g, least(count(*), any_value(k)) AS m FROM h JOIN s USING (doc_id, item_id)
      WHERE i BETWEEN s AND s + least(l, n) - 5 GROUP BY doc_id, item_id, n, l, s, g),
j AS (SELECT doc_id, item_id, s, least(l, n) AS n_words, CAST(sum(m) AS BIGINT) AS shared, CAST(least(l, n) - 4 + l - 4 - sum(m) AS BIGINT) AS total
      FROM m GROUP BY doc_id, item_id, n, l, s),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / total DESC, s) AS rank FROM j WHERE 10 * shared >= 8 * total)
SELECT doc_id, item_id, s AS start, n_words, shared, total, shared / total AS similarity FROM r WHERE rank = 1"""
