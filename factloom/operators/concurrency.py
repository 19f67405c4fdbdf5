"""Thread context, shared subjects and the scenarios that they make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def lifetimes(points: DataFrame, spawn: str = "ALLOC", join: str = "CHECK") -> DataFrame:
    """Each spawn with the first later join of its owner and subject; without one the thread may outlive its owner."""
    after = W.partitionBy("owner", "subject").orderBy("position").rowsBetween(1, W.unboundedFollowing)
    end = F.first_value(F.when(F.col("type") == join, F.col("event_id")), True).over(after)
    return points.withColumn("joined", end).where(F.col("type") == spawn).select("owner", "subject", F.col("event_id").alias("spawn"), "joined", F.col("joined").isNull().alias("detached"))


def shared_subjects(points: DataFrame) -> DataFrame:
    """Subjects with their owners, reads, writes and whether two owners may touch them in parallel."""
    write = F.col("type").isin("WRITE", "ALLOC", "RELEASE")
    return points.groupBy("subject").agg(F.countDistinct("owner").alias("owners"), F.sum((~write).cast("long")).alias("reads"), F.sum(write.cast("long")).alias("writes")).withColumn("may_parallel", F.col("owners") >= 2)


def race_scenarios(points: DataFrame) -> DataFrame:
    """shared_state_race for parallel subjects that are written; read_write_race if they are read too."""
    rows = shared_subjects(points).where("may_parallel and writes > 0")
    kinds = F.when(F.col("reads") > 0, F.array(F.lit("shared_state_race"), F.lit("read_write_race"))).otherwise(F.array(F.lit("shared_state_race")))
    return rows.select("subject", F.explode(kinds).alias("scenario"), "owners")


def dereference_targets(points: DataFrame) -> DataFrame:
    """What each dereference may see: unknown without a write of its owner and subject before it, must with one, else may."""
    before = W.partitionBy("owner", "subject").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    n = F.sum((F.col("type") == "WRITE").cast("long")).over(before)
    rows = points.withColumn("writers", F.coalesce(n, F.lit(0))).where("type = 'DEREFERENCE'")
    return rows.select("event_id", "writers", F.when(F.col("writers") == 0, "unknown").when(F.col("writers") == 1, "must").otherwise("may").alias("target"))


#: States from harmless to severe; fixed order.
SEVERITY = ("current", "partial", "stale", "unsupported", "not_built")


def worst_state(states: DataFrame, by: str) -> DataFrame:
    """The most severe state of each ``by``."""
    place = F.coalesce(*(F.when(F.col("state") == s, F.lit(k)) for k, s in enumerate(SEVERITY)), F.lit(len(SEVERITY)))
    return states.groupBy(by).agg(F.max_by("state", place).alias("state"))
