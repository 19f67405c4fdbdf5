"""Point lookups over symbols and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Kinds that count as symbols.
SYMBOL_KINDS = ("Namespace", "Class", "Struct", "Interface", "Function", "Method", "Type")


def find_symbol(nodes: DataFrame, name: str) -> DataFrame:
    """Symbols whose name or qualified name is ``name`` or whose qualified name ends in ``.name``."""
    q = F.col("qualified_name")
    return nodes.where(F.col("kind").isin(*SYMBOL_KINDS) & ((F.col("name") == name) | (q == name) | q.endswith("." + name))).orderBy("qualified_name", "id")


def candidates(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each ``wanted(symbol)`` every node with that id, qualified name or name, with its rank (0, 1, 2 in that
    order) and choice: 1 for the one to take. A sole definition goes before declarations."""
    by = [nodes.select(F.col(c).alias("symbol"), F.lit(k).alias("rank"), "id", "qualified_name", "definition") for k, c in enumerate(("id", "qualified_name", "name"))]
    keys = F.broadcast(wanted.select("symbol").distinct())
    met = by[0].join(keys, "symbol").unionByName(by[1].join(keys, "symbol")).unionByName(by[2].join(keys, "symbol"))
    once = met.groupBy("symbol", "id", "qualified_name", "definition").agg(F.min("rank").alias("rank"))
    definitions = F.sum(F.col("definition").cast("int")).over(W.partitionBy("symbol"))
    first = F.when((definitions == 1) & F.col("definition"), 0).otherwise(1)
    order = W.partitionBy("symbol").orderBy("first", "rank", "qualified_name", "id")
    return once.withColumn("first", first).withColumn("choice", F.row_number().over(order)).drop("first")


def definition(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The chosen symbol for each wanted one, with how many definitions and declarations compete."""
    rows = candidates(nodes, wanted)
    return rows.groupBy("symbol").agg(
        F.min(F.when(F.col("choice") == 1, F.col("id"))).alias("id"),
        F.sum(F.col("definition").cast("int")).alias("definitions"),
        F.sum((~F.col("definition")).cast("int")).alias("declarations"),
        (F.sum(F.col("definition").cast("int")) > 1).alias("ambiguous"),
    )


def where_equal(rows: DataFrame, order: list[Column | str], **wanted: object) -> DataFrame:
    """Rows that equal every given value (None: any), in ``order``."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    return rows.orderBy(*order)


def status(**tables: DataFrame) -> DataFrame:
    """Row count of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
