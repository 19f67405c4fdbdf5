"""Evidence ranking, bundles and result windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def rank(items: DataFrame, roles: dict[str, int], weights: dict[str, int], by: str | None = None) -> DataFrame:
    """``items`` with rank from 1 on: role, weight of the kind, status (resolved first), direct first, confidence (high
    first), distance, within the shard first, id."""
    of = W.partitionBy(by) if by else W.partitionBy()
    place = lambda c, order: F.coalesce(*(F.when(F.col(c) == k, F.lit(v)) for k, v in order.items()), F.lit(99))
    status = F.when(F.col("status") == "resolved", 0).when(F.col("status") == "ambiguous", 1).otherwise(2)
    keys = (place("role", roles), place("kind", weights), status, F.desc("direct"), F.desc("confidence"), "distance", "boundary", "id")
    return items.withColumn("rank", F.row_number().over(of.orderBy(*keys)).cast("long"))


def bundle(ranked: DataFrame, by: str, primary: int, total: int) -> DataFrame:
    """Up to ``primary`` items of role primary for each ``by``, then others as far as ``total`` allows, by rank."""
    of = W.partitionBy(by, "is_primary").orderBy("rank")
    rows = ranked.withColumn("is_primary", F.col("role") == "primary").withColumn("_k", F.row_number().over(of))
    shown = F.sum((F.col("is_primary") & (F.col("_k") <= primary)).cast("int")).over(W.partitionBy(by))
    keep = F.when(F.col("is_primary"), F.col("_k") <= primary).otherwise(F.col("_k") <= F.greatest(F.lit(0), F.lit(total) - F.col("_shown")))
    return rows.withColumn("_shown", shown).where(keep).drop("_k", "_shown")


def select_window(items: DataFrame, limit: int, gate: float = 0.3) -> DataFrame:
    """``items(family, confidence, rank)``: those below the gate go; each family gets max(1, limit // families) places
    by rank, the rest is filled by rank."""
    kept = items.where(F.col("confidence") >= gate)
    families = kept.select(F.countDistinct("family").alias("_families"))
    rows = kept.crossJoin(F.broadcast(families))  # one row
    floor = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("_families")))
    rows = rows.withColumn("_f", F.row_number().over(W.partitionBy("family").orderBy("rank"))).withColumn("_first", F.col("_f") <= floor)
    # no family can place more than limit rows, so the last ranking sees limit rows of each family at most
    rows = rows.where(F.col("_f") <= limit).withColumn("_k", F.row_number().over(W.orderBy(F.desc("_first"), "rank")))
    return rows.where(F.col("_k") <= limit).drop("_f", "_k", "_first", "_families")


def top_with_ties(items: DataFrame, score: str, k: int, cap: int, by: str) -> DataFrame:
    """For each ``by`` the first ``k`` by score, with all that tie with the last, and ``cap`` at most."""
    of = W.partitionBy(by)
    rows = items.withColumn("_r", F.rank().over(of.orderBy(F.desc(score)))).withColumn("_n", F.row_number().over(of.orderBy(F.desc(score), "id")))
    return rows.where((F.col("_r") <= k) & (F.col("_n") <= cap)).drop("_r", "_n")
