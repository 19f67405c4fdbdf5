"""Overlay algebra: deltas over a base, their capture, reading, merging, conflicts and rebasing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.functions import ids


def capture(base: DataFrame, target: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Deltas that turn ``base`` into ``target``: key, operation (ADD, UPDATE, DELETE), base_version, new_version."""
    b = base.select(F.col(key).alias("entity_id"), ids.entity_version(*columns).alias("base_version"))
    t = target.select(F.col(key).alias("entity_id"), ids.entity_version(*columns).alias("new_version"))
    rows = b.join(t, "entity_id", "full_outer").where(~F.col("base_version").eqNullSafe(F.col("new_version")))
    return rows.withColumn("operation", F.when(F.col("base_version").isNull(), "ADD").when(F.col("new_version").isNull(), "DELETE").otherwise("UPDATE"))


def upsert(deltas: DataFrame, order: str) -> DataFrame:
    """The last delta of each (entity_type, entity_id) by ``order``. A tombstone that holds a value is refused: the job fails."""
    last = F.row_number().over(W.partitionBy("entity_type", "entity_id").orderBy(F.desc(order)))
    bad = (F.col("operation") == "DELETE") & F.col("new_value").isNotNull()
    sound = F.when(bad, F.raise_error(F.lit("a tombstone holds a value")).cast("boolean")).otherwise(F.lit(True))
    return deltas.where(sound).withColumn("_k", last).where("_k = 1").drop("_k")


def read(base: DataFrame, *layers: DataFrame, key: str = "entity_id") -> DataFrame:
    """``base`` under each layer in turn: rows a layer touches go, its rows that aren't deletions come. Filter after it."""
    out = base
    for layer in layers:
        fresh = layer.where("operation <> 'DELETE'").select(*out.columns)
        out = out.join(layer.select(key), key, "left_anti").select(*out.columns).unionByName(fresh)
    return out


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, as often as it has them more; none if both are equal as multisets."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def counts(deltas: DataFrame, types: list[str]) -> DataFrame:
    """Deltas for each type and operation, zero where there are none (a grid of constants, so no row is lost)."""
    grid = deltas.sparkSession.createDataFrame([(t, o) for t in types for o in ("ADD", "UPDATE", "DELETE")], "entity_type string, operation string")
    found = deltas.groupBy("entity_type", "operation").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(grid).join(found, ["entity_type", "operation"], "left").fillna(0, ["n"])


def conflicts(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """Entities that both sides change differently: DELETE_UPDATE, ADD_ADD or ENTITY."""
    r = right.select("entity_id", F.col("operation").alias("other_operation"), F.col(value).alias("other_value"))
    rows = left.join(r, "entity_id").where((F.col("operation") != F.col("other_operation")) | ~F.col(value).eqNullSafe(F.col("other_value")))
    either = lambda o: (F.col("operation") == o) | (F.col("other_operation") == o)
    kind = F.when(either("DELETE"), "DELETE_UPDATE").when((F.col("operation") == "ADD") & (F.col("other_operation") == "ADD"), "ADD_ADD").otherwise("ENTITY")
    return rows.select("entity_id", kind.alias("conflict"))


def merge(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """Deltas of both sides without those in conflict."""
    bad = conflicts(left, right, value)
    return left.unionByName(right).join(bad, "entity_id", "left_anti").dropDuplicates(["entity_id", "operation", value])


def rebase(deltas: DataFrame, old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each delta with kept: its entity has the same version (or absence) in both bases."""
    version = lambda df, name: df.select(F.col(key).alias("entity_id"), ids.entity_version(*columns).alias(name))
    rows = deltas.join(version(old, "_old"), "entity_id", "left").join(version(new, "_new"), "entity_id", "left")
    return rows.withColumn("kept", F.col("_old").eqNullSafe(F.col("_new"))).drop("_old", "_new")
