"""Checks of stored trees, graphs and events: one row for each kind of problem that a scope has, none if it is sound."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _found(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("scope", "problem").agg(F.sum("n").cast("long").alias("n"))


def _rows(df: DataFrame, problem: str, bad: Column | None = None) -> DataFrame:
    rows = df if bad is None else df.where(bad)
    return rows.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).select("scope", F.lit(problem).alias("problem"), "n")


def _ends(edges: DataFrame, nodes: DataFrame, *ends: str) -> list[DataFrame]:
    """Edges of a scope that have an end which isn't a node of it."""
    known = nodes.select("scope", "id").distinct()
    return [edges.join(known.withColumnRenamed("id", end), ["scope", end], "left_anti") for end in ends]


def tree(nodes: DataFrame) -> DataFrame:
    """scope, problem, n of ``nodes(scope, id, parent)``: root_missing, multiple_roots (n roots), parent_missing."""
    roots = nodes.groupBy("scope").agg(F.sum(F.col("parent").isNull().cast("int")).alias("roots"))
    none = _rows(roots.where("roots = 0"), "root_missing")
    many = roots.where("roots > 1").select("scope", F.lit("multiple_roots").alias("problem"), F.col("roots").alias("n"))
    return _found(none, many, *(_rows(x, "parent_missing") for x in _ends(nodes.where("parent IS NOT NULL"), nodes, "parent")))


def control_flow(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """scope, problem, n of ``nodes(scope, id, owner, kind)`` and ``edges(scope, src, dst, owner)``.

    node_missing_owner; entry_missing and exit_missing (owners without exactly one); edge_endpoint_missing;
    edge_owner_mismatch (the source belongs to another owner, null included).
    """
    of = nodes.where("owner IS NOT NULL").groupBy("scope", "owner")
    ends = of.agg(*(F.sum((F.col("kind") == k).cast("int")).alias(k) for k in ("entry", "exit")))
    owner = nodes.select("scope", F.col("id").alias("src"), F.col("owner").alias("of")).dropDuplicates(["scope", "src"])
    other = edges.join(owner, ["scope", "src"]).where(~F.col("of").eqNullSafe(F.col("owner")))
    return _found(
        _rows(nodes, "node_missing_owner", F.col("owner").isNull()),
        _rows(ends, "entry_missing", F.coalesce("entry", F.lit(0)) != 1),
        _rows(ends, "exit_missing", F.coalesce("exit", F.lit(0)) != 1),
        *(_rows(x, "edge_endpoint_missing") for x in _ends(edges, nodes, "src", "dst")),
        _rows(other, "edge_owner_mismatch"),
    )


def events(nodes: DataFrame, kinds: list[str], level: str) -> DataFrame:
    """scope, problem, n of ``nodes(scope, id, owner, kind, level)``: duplicate_event_ids (ids that stand more than
    once), event_id_prefix_missing, unknown_event_type, event_owner_missing, event_level_missing."""
    twice = nodes.groupBy("scope", "id").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    known = F.coalesce(F.col("kind").isin(kinds), F.lit(False))
    return _found(
        _rows(twice, "duplicate_event_ids"),
        _rows(nodes, "event_id_prefix_missing", ~F.coalesce(F.col("id").startswith("event:"), F.lit(False))),
        _rows(nodes, "unknown_event_type", ~known),
        _rows(nodes, "event_owner_missing", F.coalesce("owner", F.lit("")) == ""),
        _rows(nodes, "event_level_missing", ~F.col("level").eqNullSafe(F.lit(level))),
    )


def sparse_flow(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """scope, problem, n of ``edges(scope, src, dst, kind)`` between events ``nodes(scope, id)``: unknown_sparse_relation,
    sparse_edge_endpoint_missing. An exit (``cfg-exit:``) has no row of its own and may only be an end."""
    inner = edges.where(~F.coalesce(F.col("dst").startswith("cfg-exit:"), F.lit(False)))
    (src,), (dst,) = _ends(edges, nodes, "src"), _ends(inner, nodes, "dst")
    return _found(_rows(edges, "unknown_sparse_relation", ~F.col("kind").eqNullSafe(F.lit("CONTROL_REACHES"))), _rows(src, "sparse_edge_endpoint_missing"), _rows(dst, "sparse_edge_endpoint_missing"))


def data_flow(edges: DataFrame) -> DataFrame:
    """scope, problem, n of ``edges(scope, id, src, dst, kind)``: duplicate_dfg_edge_ids, unknown_dfg_relation,
    dfg_endpoint_missing (the source is no event, or the end neither an event nor an exit)."""
    twice = edges.groupBy("scope", "id").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    event = lambda c: F.coalesce(F.col(c).startswith("event:"), F.lit(False))
    leaves = F.coalesce(F.col("dst").startswith("cfg-exit:"), F.lit(False))
    known = F.coalesce(F.col("kind").isin("DATA_FLOW_TO", "CONSUMES", "MAY_ALIAS"), F.lit(False))
    return _found(_rows(twice, "duplicate_dfg_edge_ids"), _rows(edges, "unknown_dfg_relation", ~known), _rows(edges, "dfg_endpoint_missing", ~event("src") | ~(event("dst") | leaves)))


def staleness(built: DataFrame, registry: DataFrame) -> DataFrame:
    """analysis, reason: the first dependency by name of ``built(analysis, analyzer, contract)`` that ``registry(analyzer,
    contract)`` doesn't hold (dependency_unregistered) or holds otherwise (dependency_changed). Sound ones have no row."""
    now = registry.select("analyzer", F.col("contract").alias("now"), F.lit(True).alias("known"))
    rows = built.join(now, "analyzer", "left").where(F.col("known").isNull() | ~F.col("now").eqNullSafe(F.col("contract")))
    reason = F.concat(F.when(F.col("known").isNull(), "dependency_unregistered:").otherwise("dependency_changed:"), "analyzer")
    return rows.groupBy("analysis").agg(F.min_by(reason, "analyzer").alias("reason"))


def references_for_names(references: DataFrame, names: DataFrame) -> DataFrame:
    """Ids of the references whose raw name is one of ``names(name)`` or what follows the last dot of one."""
    wanted = names.select(F.explode(F.array("name", F.element_at(F.split("name", r"\."), -1))).alias("raw_name")).distinct()
    return references.join(wanted, "raw_name", "left_semi").select("id")
