"""Quality rules as a short-circuit cascade, ordered by rejection per cost as measured on a sample."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import text as tx


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a text that has to go; a null verdict is no rejection."""

    name: str
    rejects: Column


def _count(text: Column, other: str) -> Column:
    """Characters that are not in the character class ``other``."""
    return F.length(F.regexp_replace(text, f"[{other}]+", ""))


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with word_chars, n_words, n_symbols, n_dup_lines and n_repeat_words for each whole text, all long.

    A null text has none of anything. n_repeat_words counts the words that stand in a five-word window found twice
    or more in the text, each word once. Columns of ``docs`` by other names stay as they are.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns]
    t = F.coalesce("text", F.lit(""))
    has_word = lambda x: x.rlike(tx.WORD)
    cut = docs.select(*keep, tx.words(F.col("text")).alias("_w"), F.filter(tx.lines(F.col("text")), has_word).alias("_l"))
    hashed = cut.select(*keep, "_l", tx.shingle_hashes(F.col("_w")).alias("_h"), F.size("_w").alias("_n"), F.length(F.concat_ws("", "_w")).alias("_c"))
    pair = F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    twice = hashed.withColumn("_p", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(pair)).otherwise(none))
    p, last = F.col("_p"), F.size("_p") - 1
    met = lambda s, i: ((i > 0) & (F.get(p, i - 1)["h"] == s["h"])) | ((i < last) & (F.get(p, i + 1)["h"] == s["h"]))
    found = twice.withColumn("_r", F.sort_array(F.transform(F.filter(p, met), lambda s: s["i"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(-tx.SHINGLE).alias("at"))
    # a filter on what is made of the measures must not be pushed below them: it would compute them again for each use
    apart = F.monotonically_increasing_id() * 0
    covered = F.aggregate("_r", start, lambda a, i: F.struct((a["n"] + F.least(F.lit(tx.SHINGLE), i - a["at"])).alias("n"), i.alias("at")), lambda a: a["n"])
    return found.select(
        *keep,
        F.col("_n").cast("long").alias("n_words"),
        F.col("_c").cast("long").alias("word_chars"),
        _count(t, r"^#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        (covered + apart).cast("long").alias("n_repeat_words"),
    )


#: Fails a text whatever the rules say.
BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def default_rules() -> list[Rule]:
    """Rules over the columns of ``measures``; each leaves running prose in any language alone."""
    t = F.coalesce("text", F.lit(""))
    shout = F.length(F.regexp_replace(t, "[^!?]+", ""))
    upper = F.length(F.regexp_replace(t, r"[^\p{Lu}]+", ""))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    return [
        Rule("symbols", F.expr("10 * n_symbols > 3 * n_words")),
        Rule("duplicate_lines", (F.col("n_dup_lines") >= 3) & (10 * F.col("n_dup_lines") > 3 * F.size(F.filter(tx.lines(t), lambda x: x.rlike(tx.WORD))))),
        Rule("word_length", F.expr("word_chars < 2 * n_words or word_chars > 20 * n_words")),
        Rule("shouting", 10 * shout > 4 * F.col("n_words")),
        Rule("capitals", 10 * upper > 6 * letters),
        Rule("letters", 2 * letters < F.col("word_chars")),
    ]


@dataclass(frozen=True)
class Profile:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def rank(self) -> float:
        """Rejections per second."""
        return self.rejected / max(self.seconds, 1e-6)


def profile(rows: DataFrame, rules: Sequence[Rule], sample_rows: int = 256, sample_bytes: int = 4 << 20, fraction: float = 0.1, seed: int = 7) -> list[Profile]:
    """Cost and rejection share of each rule on a sample, best rank first; ties keep their order.

    The sample holds at most ``sample_rows`` rows whose texts have at most ``sample_bytes`` together, from the first
    partitions that yield it, so its reading does not grow with the table; it decides the order of the rules only, never
    a verdict. A rule runs over as many repetitions of the sample as make some 4 MB of text, and its cost is the least
    time of two runs less that of a job without a rule, for one sample.
    """
    spark = rows.sparkSession
    size = F.octet_length("text")
    short = rows.where(F.coalesce(size, F.lit(0)) <= sample_bytes // 16)
    picked = short.sample(fraction, seed).limit(sample_rows).collect() or short.limit(sample_rows).collect()
    total, sample = 0, []
    for row in picked:
        total += len((row["text"] or "").encode())
        if total > sample_bytes:
            break
        sample.append(row)
    times = min(max((4 << 20) // max(total, 1), 1), 400)
    held = spark.createDataFrame(sample, rows.schema).coalesce(1).cache()

    def timed(rejects: Column) -> tuple[float, int]:
        # the rule sees a text that differs in each repetition, so it can't be computed below it
        again = held.select("*", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("_k")).withColumn("text", F.when(F.col("_k") > 0, F.col("text")))
        seconds, hit = [], 0
        for _ in range(2):
            began = time.perf_counter()
            hit = again.agg(F.sum(F.coalesce(rejects, F.lit(False)).cast("int"))).collect()[0][0] or 0
            seconds.append(time.perf_counter() - began)
        return min(seconds), hit // times

    try:
        n = max(held.count(), 1)
        timed(F.lit(False))
        empty = timed(F.lit(False))[0]
        out = []
        for rule in rules:
            seconds, hit = timed(rule.rejects)
            out.append(Profile(rule, max(seconds - empty, 0.0) / times, hit / n))
    finally:
        held.unpersist()
    return sorted(out, key=lambda p: -p.rank)


def verdict(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects, else null. CASE stops at the first hit, so later rules are not computed."""
    out = F
    for rule in rules:
        out = out.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name))
    return F.lit(None).cast("string") if out is F else out


def quality_cascade(docs: DataFrame, rules: Sequence[Rule] | None = None, base: str = BASE_FAILED) -> DataFrame:
    """``docs`` with the columns of ``measures``, base_failed and kept.

    ``kept`` is false if ``base`` holds or any rule rejects. The rules run in the order that ``profile`` finds, and a
    rule is computed only for texts that all before it let pass; ``kept`` is the same for every order. An empty table
    gives an empty result; repeated rows are judged each. Input columns named like an output column are replaced.
    """
    rules = list(default_rules() if rules is None else rules)
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    rows = measures(docs.select("text", F.struct(*(f"`{c}`" for c in docs.columns)).alias("_row")))
    needed = rows.drop("_row")
    ordered = [p.rule for p in profile(needed, rules)] if len(rules) > 1 else rules
    judged = rows.withColumn("base_failed", F.expr(base))
    judged = judged.withColumn("kept", ~F.col("base_failed") & verdict(ordered).isNull())
    return judged.select(*(F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in made), *made)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the cascade keeps, with their own columns."""
    whole = docs.select("text", F.struct(*(f"`{c}`" for c in docs.columns)).alias("document"))
    return quality_cascade(whole).where("kept").select("document.*")


_RULES_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {docs}),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
             row_number() OVER () AS r FROM d),
s AS (SELECT r, i, w[i:i+4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM s) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM p, (SELECT unnest(range(5)) AS k) GROUP BY r),
m AS (SELECT w.doc_id, t, l, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
             length(regexp_replace(t, '[^!?]', '', 'g')) AS shout, length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS upper_,
             length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS letters
      FROM w LEFT JOIN c USING (r)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * len(l))
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * shout > 4 * n_words
            OR 10 * upper_ > 6 * letters OR 2 * letters < word_chars) AS kept
FROM v"""


def sql(docs: str = "documents") -> str:
    return _RULES_SQL.format(docs=docs)
