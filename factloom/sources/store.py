"""Generations of fact tables as Parquet, with a log whose newest row names the current one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG = "generation long, mode string, tables array<string>"


class Store:
    """A folder of tables, each split by generation. A generation counts once its row is in the log, so a job that dies
    midway leaves readers on the one before."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        spark.createDataFrame([], _LOG).write.mode("append").parquet(f"{self.root}/log")

    def current(self) -> int:
        """The newest complete generation, 0 if there is none."""
        log = self.spark.read.schema(_LOG).parquet(f"{self.root}/log")
        return log.agg(F.coalesce(F.max("generation"), F.lit(0))).collect()[0][0]

    def replace(self, mode: str = "full", keep_layer: str | None = None, **tables: DataFrame) -> int:
        """Write a new generation and give back its number. Rows of ``keep_layer`` in the current one are carried over."""
        now = self.current()
        for name, df in tables.items():
            if keep_layer and now and "layer" in df.columns:
                df = df.unionByName(self.read(name).where(F.col("layer") == keep_layer))
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/generation={now + 1}")
        self.spark.createDataFrame([(now + 1, mode, sorted(tables))], _LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")
        return now + 1

    def read(self, name: str, generation: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/generation={generation or self.current()}")
