"""What changed between two generations, and how far it reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key and change (added, deleted, modified) between two tables of digests."""
    a, b = old.select(key, F.col(digest).alias("_old")), new.select(key, F.col(digest).alias("_new"))
    rows = a.join(b, key, "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))
    return rows.select(key, F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").otherwise("modified").alias("change"))


def affected_names(old: DataFrame, new: DataFrame, facts: list[str]) -> DataFrame:
    """Names of symbols of which one side has a fact that the other lacks."""
    a, b = old.select("name", *facts).distinct(), new.select("name", *facts).distinct()
    return a.exceptAll(b).unionByName(b.exceptAll(a)).select("name").distinct()


def impact_frontier(changed: DataFrame, old: DataFrame, new: DataFrame, wide: int = 8) -> DataFrame:
    """Unchanged shards whose boundary edges into ``changed(shard)`` appeared or went; wide if there are more than ``wide``."""
    # what can't count goes before the grouping moves it: only edges into changed shards from others are left
    into, out = changed.select(F.col("shard").alias("dst_shard")), changed.select(F.col("shard").alias("src_shard"))
    side = lambda rows, k: rows.join(into, "dst_shard", "left_semi").join(out, "src_shard", "left_anti").select("id", "src_shard", "dst_shard", F.lit(k).alias("old"))
    both = side(old, 1).unionByName(side(new, 0))
    hit = both.groupBy("id", "src_shard", "dst_shard").agg(F.min("old").alias("least"), F.max("old").alias("most")).where("least = most")
    shards = hit.groupBy("src_shard").agg(F.count(F.lit(1)).alias("edges")).withColumnRenamed("src_shard", "shard")
    total = shards.agg((F.count(F.lit(1)) > wide).alias("wide"))
    return shards.crossJoin(F.broadcast(total))  # one row of totals
