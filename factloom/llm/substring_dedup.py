"""Substring dedup by hashing of lines and paragraphs, then of passages inside them: of what repeats, the earliest ranked occurrence stays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import scratch
from factloom.llm import text as tx
from factloom.llm import words as wd

#: Words that a unit or passage has at least; what is shorter repeats by chance or custom.
LEAST_WORDS = 50
#: Bytes of spans (64 for a row and 24 for an entry, at most) up to which they are broadcast; beyond, they meet the texts by shuffle.
BROADCAST_BYTES = 32 << 20

_WORD = re.compile(tx.WORD)
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_RANGES = "array<struct<a:int,b:int>>"


def _small(df: DataFrame, name: str, entries: str) -> DataFrame:
    """``df`` as a stored table, marked for broadcast if its rows and their ``entries`` are small enough."""
    kept = scratch.stored(df, name)
    size = kept.agg((64 * F.count(F.lit(1)) + 24 * F.coalesce(F.sum(F.size(entries)), F.lit(0))).alias("bytes")).collect()[0][0]
    return F.broadcast(kept) if size <= BROADCAST_BYTES else kept.hint("shuffle_hash")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", tx.row_key(F.col("doc_id"), F.col("text")).alias("row"), "text")


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "a")


def units(keyed: DataFrame, least_words: int) -> DataFrame:
    """doc_id, row, whole (boolean), a, b (first word and the one after the last), digest: the units of each text.

    Units are the whole text, its paragraphs (between blank lines) and its lines, if they have enough words; a unit that
    is all of a greater one is taken once. Normalised, a unit is its words, lower-cased, between single spaces; the
    digest is 128 bits of their hashes.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wd.slices(batch):
                lines = pc.split_pattern(pc.fill_null(part.column("text"), ""), "\n")
                coded, at = wd.word_hashes(lines.flatten())
                of = lines.offsets.to_numpy() - lines.offsets[0].as_py()
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for doc, row, x, y in zip(part.column("doc_id").to_pylist(), part.column("row").to_pylist(), of[:-1].tolist(), of[1:].tolist(), strict=True):
                    start, stop = int(at[x]), int(at[y])
                    if stop - start < least_words:
                        continue
                    cuts = at[x : y + 1]
                    full = np.flatnonzero(cuts[1:] > cuts[:-1])
                    breaks = np.flatnonzero(np.diff(full) > 1)  # a line without a word ends a paragraph
                    heads, tails = full[np.concatenate([[0], breaks + 1])], full[np.concatenate([breaks, [len(full) - 1]])]
                    spans = {(start, stop): True}
                    for a, b in (*zip(cuts[heads].tolist(), cuts[tails + 1].tolist(), strict=True), *zip(cuts[full].tolist(), cuts[full + 1].tolist(), strict=True)):
                        if b - a >= least_words:
                            spans.setdefault((a, b), False)
                    for (a, b), whole in spans.items():
                        for column, value in zip(out, (doc, row, whole, a - start, b - start, xxhash.xxh3_128_digest(coded[a:b].tobytes())), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.binary(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["doc_id", "row", "whole", "a", "b", "digest"])

    return keyed.mapInArrow(cut, "doc_id long, row binary, whole boolean, a int, b int, digest binary")


def repeats(found: DataFrame) -> DataFrame:
    """row, gone (ranges of words, in order): the units of ``found`` (stored units) whose digest occurs at a lesser place too.

    Places are ordered by doc_id (null ids last), row key and word. The first occurrence of a digest is found with
    partial sums before the shuffle and stored; the units then meet the digests that repeat in a join that Spark can
    split for a digest with any share of the rows.
    """
    first = found.groupBy("digest").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    late = found.join(scratch.stored(first, "first-units"), "digest").where(_place() > F.col("first"))
    return late.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("gone"))


def _left(n: int, gone: list | None) -> np.ndarray:
    """Which of ``n`` words no range of ``gone`` holds."""
    keep = np.ones(n, dtype=bool)
    for s in gone or ():
        keep[s["a"] : s["b"]] = False
    return keep


def _rest(part: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and hashes of the words that unit hashing has left, for each text."""
    coded, bounds = wd.word_hashes(part.column("text"))
    gone = part.column("gone").to_pylist()
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        yield k, coded[a:b][_left(b - a, gone[k])] if gone[k] else coded[a:b]


def _anchors(coded: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the content-chosen runs of half the width, and for each window of ``width`` words the one that it chose.

    A window chooses the run with the least hash, so windows of equal words choose equal runs: a window that repeats
    has an anchor that repeats.
    """
    half = max(width // 2, 1)
    runs = wd.window_hashes(coded, half, _FACTORS[0])
    span = width - half + 1
    least = wd.sliding(runs, span, np.minimum)
    edge = np.zeros(span - 1, dtype=wd.U)
    chosen = wd.sliding(np.concatenate([edge, least, edge]), span, np.maximum) == runs
    return runs[chosen], least


def _windows(texts: DataFrame, width: int) -> DataFrame:
    """doc_id, row, a (word among those left), h and g: every window of ``texts(doc_id, row, text, gone)`` that can repeat.

    Only windows whose anchor occurs at two places are made; none that repeats is lost.
    """

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wd.slices(batch):
                found = {k: _anchors(x, width)[0] for k, x in _rest(part) if len(x) >= width}
                flat = np.concatenate([np.empty(0, dtype=wd.U), *found.values()]).view(np.int64)
                of = np.repeat(np.array(list(found), dtype=np.int64), [len(x) for x in found.values()])
                yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(of)), pa.array(flat)], ["row", "print"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wd.slices(batch):
                prints = part.column("prints").to_pylist()
                of, at, h, g = [], [], [], []
                for k, x in _rest(part):
                    if len(x) >= width:
                        s = np.flatnonzero(np.isin(_anchors(x, width)[1].view(np.int64), np.array(prints[k], dtype=np.int64)))
                        of.append(np.full(len(s), k))
                        at.append(s)
                        h.append(wd.window_hashes(x, width, _FACTORS[1])[s])
                        g.append(wd.window_hashes(x, width, _FACTORS[2])[s])
                of, at = (np.concatenate([np.empty(0, dtype=np.int64), *v]) for v in (of, at))
                h, g = (np.concatenate([np.empty(0, dtype=wd.U), *v]).view(np.int64) for v in (h, g))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(of)), part.column("row").take(pa.array(of)), pa.array(at.astype(np.int32)), pa.array(h), pa.array(g)], ["doc_id", "row", "a", "h", "g"])

    prints = scratch.stored(texts.select("row", "text", "gone").mapInArrow(anchors, "row binary, print long"), "prints")
    often = scratch.stored(prints.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print"), "repeated-prints")
    wanted = _small(prints.join(often, "print").groupBy("row").agg(F.collect_set("print").alias("prints")), "wanted-prints", "prints")
    return scratch.stored(texts.join(wanted, "row").select("doc_id", "row", "text", "gone", "prints").mapInArrow(made, "doc_id long, row binary, a int, h long, g long"), "windows")


def passages(texts: DataFrame, width: int) -> DataFrame:
    """row, passages (ranges among the words left): the repeated windows of ``width`` words, in lines or across them.

    Of a window that occurs at several places all occurrences but the earliest go; words of an overlapping earliest
    occurrence in the same row stay.
    """
    found = _windows(texts, width)
    first = scratch.stored(found.groupBy("h", "g").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "g", "first"), "first-windows")
    late = found.join(first, ["h", "g"]).where(_place() > F.col("first"))
    begin = F.when(F.col("row") == F.col("first.row"), F.greatest("a", F.col("first.a") + width)).otherwise(F.col("a"))
    ranges = late.select("row", begin.alias("a"), (F.col("a") + width).alias("b"))
    order = Window.partitionBy("row").orderBy("a", "b")
    reached = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("a") <= F.col("reached"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = ranges.withColumn("reached", reached).withColumn("island", island).groupBy("row", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("passages"))


def _cut(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, text, gone, passages)`` without the words of both."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wd.slices(batch):
                out: tuple[list, ...] = ([], [], [], [])
                for text, gone, passed in zip(*(part.column(c).to_pylist() for c in ("text", "gone", "passages")), strict=True):
                    spans: list[tuple[int, int]] = []
                    if gone or passed:
                        places = [m.span() for m in _WORD.finditer(text)]
                        left = _left(len(places), gone)
                        rest = np.flatnonzero(left)
                        for s in passed or ():
                            left[rest[s["a"] : s["b"]]] = False
                        edge = np.diff(np.concatenate([[0], ~left, [0]]).astype(np.int8))
                        spans = [(places[a][0], places[b - 1][1]) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
                    if spans:
                        ends = [0, *(x for s in spans for x in s), len(text)]
                        text = "".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                    for column, value in zip(out, (text, len(spans), sum(b - a for a, b in spans), ",".join(f"{a}-{b}" for a, b in spans)), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v, t) for v, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "text", "n_removed", "chars_removed", "spans"])

    return rows.select("doc_id", "text", "gone", "passages").mapInArrow(cut, "doc_id long, text string, n_removed long, chars_removed long, spans string")


def substring_dedup(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs(doc_id, text)`` without repeated units and passages: doc_id, text, n_removed, chars_removed, spans.

    Whole texts, paragraphs and lines of at least ``least_words`` words are hashed, and of those that repeat the
    earliest stays (``repeats``). Of the words that this leaves, every window of ``least_words`` that repeats goes too,
    but for its earliest place (``passages``): this catches what stands inside a longer line or is broken into lines
    another way. Words stand between ASCII white space and are compared in lower case.

    ``spans`` lists the places of the runs of words removed in the original text, in code points, as "a-b,c-d";
    n_removed is their number and chars_removed their length. White space around a span stays. Every row of ``docs``
    comes back; a null stays null, an empty text and one of fewer words lose nothing. Each row loses its own late
    occurrences only, whatever its id: rows with equal ids or none are told apart by their text, and of rows that
    repeat both one is the first and the others lose all their words. Other columns are ignored. Texts are read four
    times and shuffled only if more rows lose something than can be broadcast.
    """
    keyed = _keyed(docs)
    found = scratch.stored(units(keyed, least_words), "units")
    gone = _small(repeats(found), "unit-spans", "gone")
    texts = keyed.join(gone, "row", "left")
    late = _small(passages(texts, least_words), "passage-spans", "passages")
    copies = scratch.stored(found.where("whole").groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-rows")
    cut = texts.join(late, "row", "left")
    if copies.isEmpty():
        return _cut(cut)
    once = cut.join(copies, "row").groupBy("row").agg(*(F.first(c).alias(c) for c in ("doc_id", "text", "gone", "passages")), F.first("n").alias("n"))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.lit((1 << 31) - 1).alias("b"))).cast(_RANGES)
    number = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")
    many = once.select("doc_id", "text", "gone", "passages", number).withColumn("gone", F.when(F.col("copy") > 1, whole).otherwise(F.col("gone")))
    return _cut(cut.join(copies, "row", "left_anti").select("doc_id", "text", "gone", "passages").unionByName(many.drop("copy")))


_SQL = r"""
WITH c AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+')) AS chunk,
                  generate_subscripts(regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+'), 1) - 1 AS i FROM {docs}),
w AS (SELECT doc_id, i, chunk, length(chunk) - length(ltrim(chunk, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS gap,
             sum(length(chunk)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM c),
v AS (SELECT doc_id, i, chunk, gap, stop, lower(substr(chunk, gap + 1)) AS k,
             sum(CASE WHEN position(chr(10) IN left(chunk, gap)) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS line,
             sum(CASE WHEN regexp_matches(left(chunk, gap), '\n[\x20\x09-\x0D]*\n') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS para FROM w),
u AS (SELECT DISTINCT * FROM (
        SELECT doc_id, min(i) AS a, max(i) + 1 AS b, string_agg(k, ' ' ORDER BY i) AS s FROM v GROUP BY doc_id HAVING count(*) >= {least}
        UNION ALL SELECT doc_id, min(i), max(i) + 1, string_agg(k, ' ' ORDER BY i) FROM v GROUP BY doc_id, para HAVING count(*) >= {least}
        UNION ALL SELECT doc_id, min(i), max(i) + 1, string_agg(k, ' ' ORDER BY i) FROM v GROUP BY doc_id, line HAVING count(*) >= {least})),
g AS (SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, a) AS n FROM u) WHERE n > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(a, b)) AS i FROM g),
r AS (SELECT v.doc_id, v.i, k, row_number() OVER (PARTITION BY v.doc_id ORDER BY v.i) - 1 AS j FROM v ANTI JOIN x ON v.doc_id = x.doc_id AND v.i = x.i),
l AS (SELECT doc_id, list(k ORDER BY j) AS ks, list(i ORDER BY j) AS places FROM r GROUP BY doc_id HAVING count(*) >= {least}),
p AS (SELECT doc_id, a - 1 AS a, md5(array_to_string(ks[a:a + {least} - 1], ' ')) AS s FROM (SELECT doc_id, ks, unnest(range(1, len(ks) - {least} + 2)) AS a FROM l)),
f AS (SELECT doc_id, a, first_value(doc_id) OVER o AS first_doc, first_value(a) OVER o AS first_a, row_number() OVER o AS n FROM p WINDOW o AS (PARTITION BY s ORDER BY doc_id, a)),
q AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = first_doc THEN greatest(a, first_a + {least}) ELSE a END, a + {least})) AS j FROM f WHERE n > 1),
z AS (SELECT doc_id, i FROM x UNION SELECT q.doc_id, places[j + 1] FROM q JOIN l ON q.doc_id = l.doc_id),
m AS (SELECT v.*, z.i IS NOT NULL AS late, coalesce(lag(z.i IS NOT NULL) OVER (PARTITION BY v.doc_id ORDER BY v.i), false) AS before
      FROM v LEFT JOIN z ON v.doc_id = z.doc_id AND v.i = z.i),
h AS (SELECT *, sum(CASE WHEN late AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m),
e AS (SELECT doc_id, run, CAST(min(stop - length(chunk) + gap) AS BIGINT) AS start, CAST(max(stop) AS BIGINT) AS stop FROM h WHERE late GROUP BY doc_id, run),
t AS (SELECT doc_id, string_agg(CASE WHEN late AND before THEN '' WHEN late THEN left(chunk, gap) ELSE chunk END, '' ORDER BY i) AS kept, max(stop) AS stop FROM m GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed, sum(stop - start) AS chars_removed, string_agg(start || '-' || stop, ',' ORDER BY start) AS spans FROM e GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept, '') || substr(d.text, coalesce(CAST(t.stop AS BIGINT), 0) + 1) END AS text,
       coalesce(n_removed, 0) AS n_removed, CAST(coalesce(chars_removed, 0) AS BIGINT) AS chars_removed, coalesce(spans, '') AS spans
FROM {docs} d LEFT JOIN t USING (doc_id) LEFT JOIN n USING (doc_id)"""


def sql(docs: str = "documents") -> str:
    return _SQL.format(docs=docs, least=LEAST_WORDS)
