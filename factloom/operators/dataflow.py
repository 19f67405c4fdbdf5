"""Ordered walks of an owner's points: ordinals, control order, data flow and lock pairing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType


def ordinals(points: DataFrame) -> DataFrame:
    """Each point's place among the points of its owner and type, from 0."""
    of = W.partitionBy("owner", "type").orderBy("position")
    return points.withColumn("ordinal", (F.row_number().over(of) - 1).cast("long"))


def control_edges(points: DataFrame) -> DataFrame:
    """An edge from each point to the next of its owner."""
    of = W.partitionBy("owner").orderBy("position")
    return points.select(F.col("event_id").alias("src"), F.lead("event_id").over(of).alias("dst"), "owner").where("dst is not null")


def flow_edges(points: DataFrame) -> DataFrame:
    """From the newest definition or release of a subject before it to each use, with the class of the flow.

    ALLOC and WRITE define, RELEASE starts the free chain; DEREFERENCE and CHECK use whichever is newer.
    """
    before = W.partitionBy("owner", "subject").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    source = F.last_value(F.when(F.col("type").isin("ALLOC", "WRITE", "RELEASE"), F.struct("event_id", "type", "position")), True).over(before)
    rows = points.withColumn("source", source).where(F.col("type").isin("DEREFERENCE", "CHECK") & F.col("source").isNotNull())
    kind = F.when(F.col("source.type") == "RELEASE", "free_to_use").when(F.col("source.type") == "ALLOC", "alloc_to_use").otherwise("value_flow")
    return rows.select("owner", "subject", F.col("source.event_id").alias("src"), F.col("event_id").alias("dst"), kind.alias("flow"), F.col("source.position").alias("src_position"), F.col("position").alias("dst_position"))


def between(flows: DataFrame, points: DataFrame) -> DataFrame:
    """How many points of the same owner and subject lie strictly between the ends of each flow."""
    p = points.select("owner", "subject", "position")
    met = flows.join(p, ["owner", "subject"]).where("position > src_position and position < dst_position")
    found = met.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("via"))
    return flows.join(found, ["src", "dst"], "left").fillna(0, ["via"])


def lock_pairing(locks: DataFrame) -> DataFrame:
    """Per owner and lock: acquires, releases, and the last acquires or first releases that have no partner."""
    rows = locks.where("type in ('LOCK', 'UNLOCK')")
    return rows.groupBy("owner", "lock").agg(
        F.sum((F.col("type") == "LOCK").cast("long")).alias("acquires"),
        F.sum((F.col("type") == "UNLOCK").cast("long")).alias("releases"),
    ).selectExpr("owner", "lock", "acquires", "releases", "greatest(acquires - releases, 0L) as unpaired_acquires", "greatest(releases - acquires, 0L) as unpaired_releases")


def _walked(locks: DataFrame, wanted: str, columns: list[str]) -> DataFrame:
    """``columns`` of the rows of type ``wanted``, and ``held``: the locks whose newest event before them in the owner is an acquire.

    Each owner is walked once in order of position with the set of held locks, however many and of whatever type.
    """
    fields = [locks.schema[c] for c in columns]
    schema = StructType([*fields, StructField("held", ArrayType(locks.schema["lock"].dataType))])
    made = to_arrow_schema(schema)
    read = list(dict.fromkeys(["owner", "position", "type", "lock", *columns]))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, held = None, {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["owner"] != owner:
                    owner, held = row["owner"], {}
                if row["type"] == wanted:
                    out.append({**{c: row[c] for c in columns}, "held": list(held)})
                if row["type"] == "LOCK" and row["lock"] is not None:
                    held[row["lock"]] = True
                elif row["type"] == "UNLOCK":
                    held.pop(row["lock"], None)
            yield pa.RecordBatch.from_pylist(out, made)

    return locks.select(*read).repartition("owner").sortWithinPartitions("owner", "position").mapInArrow(walk, schema)


def held_locks(locks: DataFrame) -> DataFrame:
    """Locks that are held at each access: those whose newest event before it in the owner is an acquire.

    A row for each access with the array of its held locks. A straight line of points gives the must-hold set.
    """
    return _walked(locks, "ACCESS", ["event_id", "owner", "subject", "position"])


def acquisition_pairs(locks: DataFrame) -> DataFrame:
    """owner, first, second: a lock taken while another is held, each once."""
    rows = _walked(locks, "LOCK", ["owner", "lock"])
    return rows.select("owner", F.explode("held").alias("first"), F.col("lock").alias("second")).where("first <> second").distinct()
