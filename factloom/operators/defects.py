"""Typed defect queries over points, flows and locks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.operators import dataflow


def double_free(points: DataFrame) -> DataFrame:
    """Two releases of a subject in one owner with no definition between: the later release and the one before it."""
    of = W.partitionBy("owner", "subject").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    last = F.last_value(F.when(F.col("type").isin("RELEASE", "ALLOC", "WRITE"), F.struct("event_id", "type")), True).over(of)
    rows = points.withColumn("last", last).where("type = 'RELEASE' and last.type = 'RELEASE'")
    return rows.select("owner", "subject", F.col("last.event_id").alias("first"), F.col("event_id").alias("second"))


def use_after_free(points: DataFrame) -> DataFrame:
    """Dereferences whose newest source is a release."""
    uses = points.where("type = 'DEREFERENCE'").select(F.col("event_id").alias("dst"))
    return dataflow.flow_edges(points).where("flow = 'free_to_use'").join(uses, "dst", "left_semi").select("owner", "subject", F.col("src").alias("release"), F.col("dst").alias("use"))


def null_flow(points: DataFrame) -> DataFrame:
    """Allocations that reach a dereference with no check of the subject between."""
    flows = dataflow.flow_edges(points).where("flow = 'alloc_to_use'")
    uses = points.where("type = 'DEREFERENCE'").select(F.col("event_id").alias("dst"))
    checks = points.where("type = 'CHECK'").select("owner", "subject", F.col("position").alias("at"))
    rows = flows.join(uses, "dst", "left_semi")
    guarded = rows.join(checks, ["owner", "subject"]).where("at > src_position and at < dst_position").select("src", "dst").distinct()
    return rows.join(guarded, ["src", "dst"], "left_anti").select("owner", "subject", F.col("src").alias("alloc"), F.col("dst").alias("use"))


def resource_leak(points: DataFrame) -> DataFrame:
    """Allocations that no release of the subject follows before its next definition or the owner's end."""
    after = W.partitionBy("owner", "subject").orderBy("position").rowsBetween(1, W.unboundedFollowing)
    nxt = F.first_value(F.when(F.col("type").isin("RELEASE", "ALLOC", "WRITE"), F.col("type")), True).over(after)
    rows = points.withColumn("next", nxt).where("type = 'ALLOC' and (next is null or next <> 'RELEASE')")
    return rows.select("owner", "subject", F.col("event_id").alias("alloc"), F.coalesce("next", F.lit("EXIT")).alias("lost_at"))


def race(points: DataFrame, k: int = 3) -> DataFrame:
    """Identities that several owners touch and at least one writes, and for each its owner pairs of greatest weight.

    Owners are summed up first, so what is paired are the strongest owners of an identity (a report of the first
    ``k`` writers against the first ``k`` others), never its points. The cut comes before the pairing; every owner is in
    ``race_owners``, and ``race_report`` says what its own cut leaves out.
    """
    kind = F.col("type").isin("WRITE", "ALLOC")
    per = points.groupBy("subject", "owner").agg(F.sum(kind.cast("long")).alias("writes"), F.count(F.lit(1)).alias("touches"))
    shared = W.partitionBy("subject")
    rows = per.withColumn("owners", F.count(F.lit(1)).over(shared)).withColumn("all_writes", F.sum("writes").over(shared)).where("owners > 1 and all_writes > 0")
    writers = rows.withColumn("k", F.row_number().over(shared.orderBy(F.desc("writes"), "owner"))).where(f"writes > 0 and k <= {k}")
    others = rows.withColumn("k", F.row_number().over(shared.orderBy(F.desc("touches"), "owner"))).where(f"k <= {k}")
    w = writers.select("subject", F.col("owner").alias("writer"), "writes", "owners")
    o = others.select("subject", F.col("owner").alias("other"), "touches")
    return w.join(o, "subject").where("writer <> other")


def _touches(points: DataFrame) -> DataFrame:
    """subject, owner, writes, touches, and how many owners and writers the subject has; only where a race can be."""
    kind = F.col("type").isin("WRITE", "ALLOC")
    per = points.groupBy("subject", "owner").agg(F.sum(kind.cast("long")).alias("writes"), F.count(F.lit(1)).alias("touches"))
    of = per.groupBy("subject").agg(F.count(F.lit(1)).alias("owners"), F.sum((F.col("writes") > 0).cast("long")).alias("writers"))
    return per.join(of.where("owners > 1 and writers > 0").withColumnRenamed("subject", "_s"), F.col("subject").eqNullSafe(F.col("_s"))).drop("_s")


def race_owners(points: DataFrame) -> DataFrame:
    """Every owner of every identity that several owners touch and at least one writes; no pair is left out or built.

    writing_partners counts the other owners that write the identity; partners those that the owner may race with
    (all others if it writes itself).
    """
    writing = F.col("writers") - (F.col("writes") > 0).cast("long")
    partners = F.when(F.col("writes") > 0, F.col("owners") - 1).otherwise(F.col("writers"))
    return _touches(points).select("subject", "owner", "writes", "touches", writing.alias("writing_partners"), partners.alias("partners"))


def race_report(points: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` writers of each identity, each with its first ``k`` other owners, as a report on ``race_owners``.

    ``total`` counts all pairs of a writer and another owner of the identity; ``truncated`` tells that not all are shown.
    """
    rows = _touches(points)
    shared = W.partitionBy("subject")
    w = rows.where("writes > 0").withColumn("k", F.row_number().over(shared.orderBy(F.desc("writes"), "owner"))).where(f"k <= {k}")
    o = rows.withColumn("k", F.row_number().over(shared.orderBy(F.desc("touches"), "owner"))).where(f"k <= {k + 1}")  # one may be the writer
    w = w.select("subject", F.col("owner").alias("writer"), "writes", (F.col("writers") * (F.col("owners") - 1)).alias("total"))
    o = o.select(F.col("subject").alias("_s"), F.col("owner").alias("other"), "touches")
    met = w.join(o, F.col("subject").eqNullSafe(F.col("_s"))).where("NOT writer <=> other")
    met = met.withColumn("k", F.row_number().over(W.partitionBy("subject", "writer").orderBy(F.desc("touches"), "other"))).where(f"k <= {k}")
    return met.withColumn("truncated", F.col("total") > F.count(F.lit(1)).over(shared)).select("subject", "writer", "writes", "other", "touches", "total", "truncated")


def lock_order(locks: DataFrame) -> DataFrame:
    """Inverted lock pairs: how many owners take first then second, and how many the other way round."""
    pairs = dataflow.acquisition_pairs(locks).groupBy("first", "second").agg(F.count(F.lit(1)).alias("owners"))
    back = pairs.select(F.col("second").alias("first"), F.col("first").alias("second"), F.col("owners").alias("inverse"))
    return pairs.join(back, ["first", "second"]).where("first < second")


def self_deadlock(locks: DataFrame) -> DataFrame:
    """Acquires of a lock that the owner already holds."""
    of = W.partitionBy("owner", "lock").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    newest = F.last_value(F.when(F.col("type").isin("LOCK", "UNLOCK"), F.col("type")), True).over(of)
    return locks.withColumn("before", newest).where("type = 'LOCK' and before = 'LOCK'").select("owner", "lock", "event_id")


def state_machine(points: DataFrame, compared: str = "CHECK", assigned: str = "WRITE") -> DataFrame:
    """Subjects that an owner compares but never assigns."""
    a = points.where(F.col("type") == compared).groupBy("owner", "subject").agg(F.count(F.lit(1)).alias("checks"))
    return a.join(points.where(F.col("type") == assigned).select("owner", "subject").distinct(), ["owner", "subject"], "left_anti")


def error_handling(points: DataFrame) -> DataFrame:
    """Allocations whose next point of the subject is a use instead of a check."""
    of = W.partitionBy("owner", "subject").orderBy("position")
    return points.withColumn("next", F.lead("type").over(of)).where("type = 'ALLOC' and next = 'DEREFERENCE'").select("owner", "subject", "event_id")


def mismatched_free(points: DataFrame, verdict: str) -> DataFrame:
    """Releases whose newest definition is an allocation that the pair rule ``verdict`` (SQL over a and r) calls a mismatch."""
    before = W.partitionBy("owner", "subject").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    source = F.last_value(F.when(F.col("type").isin("ALLOC", "WRITE", "RELEASE"), F.struct("event_id", "type")), True).over(before)
    rows = points.withColumn("source", source).where("type = 'RELEASE' and source.type = 'ALLOC'")
    return rows.select("owner", "subject", F.col("source.event_id").alias("a"), F.col("event_id").alias("r")).where(F.expr(verdict) == "mismatch")


def taint(flows: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """Flows from a declared source to a declared sink; both sides keep their names. ``sources(src, source)``, ``sinks(dst, sink)``."""
    return flows.join(sources, "src").join(sinks, "dst").select("src", "dst", "source", "sink")
