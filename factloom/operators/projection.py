"""Candidates as located evidence: accesses, ranked locations, traces and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Access kinds by what engines call them; fixed values.
KINDS = {"READ": "READ", "DEREFERENCE": "READ", "CHECK": "READ", "WRITE": "WRITE", "ALLOC": "WRITE", "RELEASE": "WRITE"}


def norm_kind(kind: Column) -> Column:
    return F.coalesce(*(F.when(F.upper(kind) == k, F.lit(v)) for k, v in KINDS.items()), F.lit("UNKNOWN"))


def accesses(candidates: DataFrame, points: DataFrame) -> DataFrame:
    """A row for each event that ``candidates(candidate, cited array)`` cites, located if the event is known; each once."""
    each = candidates.select("candidate", F.posexplode("cited").alias("place", "event_id")).groupBy("candidate", "event_id").agg(F.min("place").alias("place"))
    rows = each.join(points.select("event_id", "owner", "position", norm_kind(F.col("type")).alias("kind")), "event_id", "left")
    return rows.withColumn("located", F.col("position").isNotNull()).withColumn("kind", F.coalesce("kind", F.lit("UNKNOWN")))


def locations(found: DataFrame, primary: int = 2) -> DataFrame:
    """Accesses with their role (primary, supporting, unresolved) and number within the candidate, in order of place."""
    role = F.when(~F.col("located"), "unresolved").when(F.col("place") < primary, "primary").otherwise("supporting")
    rank = F.when(~F.col("located"), 2).when(F.col("place") < primary, 0).otherwise(1)
    number = F.row_number().over(W.partitionBy("candidate").orderBy("rank", "place"))
    return found.withColumn("role", role).withColumn("rank", rank).withColumn("number", number).drop("rank")


def coverage(found: DataFrame) -> DataFrame:
    """Candidates that have a located access and those that have none."""
    per = found.groupBy("candidate").agg(F.max(F.col("located").cast("int")).alias("any"))
    return per.agg(F.sum("any").cast("long").alias("located"), F.sum(1 - F.col("any")).cast("long").alias("unlocated"))


def unbound(located: DataFrame, candidates: DataFrame) -> DataFrame:
    """Locations of no candidate, and candidates without a location: both must be empty."""
    a = located.join(candidates, "candidate", "left_anti").select("candidate", F.lit("location").alias("side"))
    return a.unionByName(candidates.join(located, "candidate", "left_anti").select("candidate", F.lit("candidate").alias("side"))).distinct()


def trace(found: DataFrame, locks: DataFrame) -> DataFrame:
    """Numbered steps of each candidate: its located accesses in order, then the locks held at them, then what is unknown."""
    a = found.where("located").select("candidate", F.lit(0).alias("block"), F.col("place").alias("k"), F.concat(F.lit("access:"), "kind", F.lit("@"), F.col("position").cast("string")).alias("step"))
    held = found.where("located").join(locks.select("event_id", F.explode("held").alias("lock")), "event_id").select("candidate", F.lit(1).alias("block"), F.col("lock").alias("k"), F.concat(F.lit("lock:"), F.col("lock").cast("string")).alias("step")).distinct()
    none = found.where(~F.col("located")).select("candidate", F.lit(2).alias("block"), F.col("place").alias("k"), F.concat(F.lit("unknown:"), F.col("event_id").cast("string")).alias("step"))
    rows = a.unionByName(held).unionByName(none)
    return rows.withColumn("number", F.row_number().over(W.partitionBy("candidate").orderBy("block", "k", "step"))).select("candidate", "number", "step")
