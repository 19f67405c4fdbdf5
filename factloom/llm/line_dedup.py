"""Site-relative line frequency: lines that stand on too many pages of their host are boilerplate and go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import scratch
from factloom.llm import text as tx

#: Share of a host's pages above which a line is boilerplate.
RATIO = 0.1
#: Pages of a host that must hold a line before it can be boilerplate: shares on smaller hosts mean nothing.
LEAST_PAGES = 5
#: Boilerplate lines of all hosts (two longs each) up to which they are broadcast.
BROADCAST_LINES = 500_000


def _key(line: Column) -> Column:
    return F.xxhash64(line)


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Hosts with their boilerplate lines: _host, _bad (hashes; no more than a page's mean line count over ``ratio``).

    A page counts once for each line that it has, and lines without a word do not count. Counts are added up before
    the shuffle, so a host or line with any share of the rows meets as one row from each task.
    """
    site = F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host")
    held = F.transform(F.filter(tx.lines(F.col("text")), lambda x: x.rlike(tx.WORD)), _key)
    seen = docs.select(site, F.explode(F.array_distinct(held)).alias("_line")).groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n"))
    total = docs.groupBy(site).agg(F.count(F.lit(1)).alias("_pages"))
    often = seen.where(F.col("_n") >= least_pages)
    # shares above the ratio are at most lines a page / ratio for each host, however many pages the host has
    over = often.join(total, "_host").where(F.col("_n") > F.lit(ratio) * F.col("_pages"))
    return over.groupBy("_host").agg(F.array_sort(F.collect_set("_line")).alias("_bad"))


def line_dedup(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``docs`` with its texts without boilerplate lines, and n_lines and n_dropped (long).

    The lines of a host are those of all its rows, repeated rows included; null hosts are one host of their own (as
    the empty name). Lines without a word stay. A null text stays null. A row never goes, even if all its lines do:
    its text is then empty. Input columns named n_lines or n_dropped are replaced. Texts are not shuffled unless the
    boilerplate of all hosts is more than ``BROADCAST_LINES`` lines.
    """
    bad = scratch.stored(boilerplate(docs, host, ratio, least_pages), "boilerplate")
    size = bad.agg(F.coalesce(F.sum(F.size("_bad")), F.lit(0))).collect()[0][0]
    site = F.coalesce(F.col(host).cast("string"), F.lit(""))
    whole = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("_row"), "text", site.alias("_host"))
    joined = whole.join(F.broadcast(bad) if size <= BROADCAST_LINES else bad, "_host", "left")
    all_lines = tx.lines(F.col("text"))
    stay = F.when(F.col("_bad").isNull(), all_lines).otherwise(F.filter(all_lines, lambda x: ~(F.array_contains("_bad", _key(x)) & x.rlike(tx.WORD))))
    cut = joined.withColumn("_stay", stay)
    text = F.when(F.col("text").isNotNull(), F.array_join("_stay", "\n")).alias("text")
    return cut.select(
        *(text if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")),
        F.size(all_lines).cast("long").alias("n_lines"),
        (F.size(all_lines) - F.size("_stay")).cast("long").alias("n_dropped"),
    )


_SQL = """
WITH d AS (SELECT *, coalesce(source, '') AS h, row_number() OVER () AS r FROM {docs}),
l AS (SELECT r, h, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM d),
t AS (SELECT h, count(*) AS pages FROM d GROUP BY h),
b AS (SELECT h, line FROM l JOIN t USING (h) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
      GROUP BY h, line, pages HAVING count(DISTINCT r) >= {least} AND count(DISTINCT r) > {ratio} * pages),
k AS (SELECT l.r, count(*) AS n_lines, count(b.line) AS n_dropped,
             string_agg(CASE WHEN b.line IS NULL THEN l.line END, chr(10) ORDER BY i) AS kept
      FROM l LEFT JOIN b ON l.h = b.h AND l.line = b.line GROUP BY l.r)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS text, n_lines, n_dropped FROM d JOIN k USING (r)"""


def sql(docs: str = "documents") -> str:
    return _SQL.format(docs=docs, ratio=RATIO, least=LEAST_PAGES)
