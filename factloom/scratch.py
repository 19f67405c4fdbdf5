"""Shared scratch space: lineage is cut by Parquet tables that every executor and the driver can read."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch that goes to a Python worker; 10,000 rows of long texts or sets have many times that.
BATCH = 8 << 20


def folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset (local tests) a temporary one, set for the session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='factloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to a new shared Parquet table and read it back: what follows survives the loss of any executor."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, which an executor and its Python workers hold several times; a bound that the session has stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH))


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver has it, whatever folder it was started in."""
    root = str(Path(__file__).resolve().parent.parent)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{paths}".rstrip(":")
