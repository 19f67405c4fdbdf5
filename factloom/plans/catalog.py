"""Registered queries, each an operator over the fact tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import ids
from factloom.operators import branches, concurrency, context, contracts, dataflow, defects, evidence, governance, incremental, integrity, knowledge, lookup, neighbours, overlay, projection, resolve, shards, spans, traversal
from factloom.sources import keyed
from factloom.sources.facts import Facts, duckdb_with

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _keyed(g: Facts) -> keyed.KeyedFacts:
    """The same facts with short keys for ids, for joins as wide as the facts."""
    return keyed.KeyedFacts(g.spark, g.folder)


def _query(sql: str | None = None, uses: tuple[str, ...] = ()) -> Callable:
    """Register a query under its name, with the SQL over fact tables that must give its rows."""

    def add(f: Callable[[Facts], DataFrame]) -> Callable[[Facts], DataFrame]:
        name = f.__name__.strip("_")
        _QUERIES[name] = lambda spark, sf_dir: f(Facts(spark, sf_dir))
        if sql is not None:
            _SQL[name] = (duckdb_with(*uses) + ", " + sql[5:] if sql.startswith("WITH ") else duckdb_with(*uses) + " " + sql) if uses else sql
        return f

    return add


# Lookups


@_query("SELECT id, kind, qualified_name FROM nodes WHERE name = 'ASIA' OR qualified_name = 'ASIA' OR ends_with(qualified_name, '.ASIA')", ("nodes",))
def find_symbol(g: Facts) -> DataFrame:
    return lookup.find_symbol(g.nodes, "ASIA").select("id", "kind", "qualified_name")


_WANTED = "SELECT DISTINCT name AS symbol FROM nodes WHERE kind = 'Function'"
_CANDIDATES = f"""WITH s AS ({_WANTED}),
m AS (SELECT symbol, id, qualified_name, definition, CASE WHEN id = symbol THEN 0 WHEN qualified_name = symbol THEN 1 ELSE 2 END AS rank FROM nodes JOIN s ON name = symbol OR qualified_name = symbol OR id = symbol),
c AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY CASE WHEN definition AND (SELECT count(*) FROM m x WHERE x.symbol = m.symbol AND x.definition) = 1 THEN 0 ELSE 1 END, rank, qualified_name, id) AS choice FROM m)
"""


@_query(_CANDIDATES + "SELECT symbol, id, rank, choice FROM c", ("nodes",))
def resolve_candidates(g: Facts) -> DataFrame:
    nodes = g.nodes
    return lookup.candidates(nodes, nodes.where("kind = 'Function'").select(F.col("name").alias("symbol"))).select("symbol", "id", "rank", "choice")


@_query(_CANDIDATES + "SELECT symbol, min(id) FILTER (WHERE choice = 1) AS id, count(*) FILTER (WHERE definition) AS definitions, count(*) FILTER (WHERE NOT definition) AS declarations, count(*) FILTER (WHERE definition) > 1 AS ambiguous FROM c GROUP BY symbol", ("nodes",))
def get_definition(g: Facts) -> DataFrame:
    nodes = g.nodes
    return lookup.definition(nodes, nodes.where("kind = 'Function'").select(F.col("name").alias("symbol")))


@_query("SELECT id, raw_name, start_line FROM raw_references WHERE file = 'NATION_3' AND call_kind = 'direct'", ("raw_references",))
def raw_references_filter(g: Facts) -> DataFrame:
    return lookup.where_equal(g.raw_references, ["file", F.coalesce("start_line", F.lit(0)), "id"], file="NATION_3", call_kind="direct", owner_id=None).select("id", "raw_name", "start_line")


@_query("SELECT 'nodes' AS table_name, count(*) AS rows FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'points', count(*) FROM points", ("nodes", "edges", "points"))
def status(g: Facts) -> DataFrame:
    return lookup.status(nodes=g.nodes, edges=g.edges, points=g.points)


# Ids and names


@_query("SELECT p_partkey, 'symbol:' || sha256(concat_ws(chr(31), 'r', p_brand, 'Function', p_name, p_type)) AS id, p_type[1:3] AS head, list_last(string_split(p_brand || '.' || p_name, '.')) AS short FROM part")
def symbol_ids(g: Facts) -> DataFrame:
    part = g.table("part")
    qualified = F.concat_ws(".", "p_brand", "p_name")
    return part.select("p_partkey", ids.symbol_id(F.lit("r"), "p_brand", F.lit("Function"), "p_name", "p_type").alias("id"), F.substring("p_type", 1, 3).alias("head"), ids.short_name(qualified).alias("short"))


@_query("SELECT event_id, 'event:' || sha256(concat_ws(chr(31), 'r', owner, type, CAST(ordinal AS STRING))) AS id FROM (SELECT *, row_number() OVER (PARTITION BY owner, type ORDER BY position) - 1 AS ordinal FROM points)", ("points",))
def event_ids(g: Facts) -> DataFrame:
    return dataflow.ordinals(g.points).select("event_id", ids.event_id(F.lit("r"), "owner", "type", "ordinal").alias("id"))


@_query("""SELECT id, 'cfg-exit:' || sha256(concat_ws(chr(31), 'r', owner_id)) AS exit_id, 'shard:' || sha256(concat_ws(chr(31), 'r', replace(file, chr(92), '/'))) AS shard_id,
'reference:' || sha256(concat_ws(chr(31), 'r', file, owner_id, call_kind, raw_name, CAST(start_line AS STRING))) AS reference_id FROM raw_references""", ("raw_references",))
def reference_ids(g: Facts) -> DataFrame:
    made = (ids.exit_id(F.lit("r"), "owner_id").alias("exit_id"), ids.shard_id(F.lit("r"), "file").alias("shard_id"), ids.reference_id(F.lit("r"), "file", "owner_id", "call_kind", "raw_name", "start_line").alias("reference_id"))
    return g.raw_references.select("id", *made)


@_query("SELECT s_suppkey, 'E-EDGE-' || sha256('[\"' || s_name || '\",\"' || CAST(s_nationkey AS STRING) || '\"]')[1:24] AS id FROM supplier")
def evidence_ids(g: Facts) -> DataFrame:
    return g.table("supplier").select("s_suppkey", ids.evidence_id("EDGE", "s_name", "s_nationkey").alias("id"))


@_query("SELECT page_id, CASE WHEN len(f) = 0 THEN '.' ELSE array_to_string(f[1:2], '/') END AS shard, replace(regexp_replace(p, '\\.[^./]*$', ''), '/', '.') AS module FROM (SELECT page_id, p, string_split(p, '/')[1:len(string_split(p, '/')) - 1] AS f FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '\\?.*$', '') AS p FROM pages))")
def path_rules(g: Facts) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"\?.*$", "")
    return g.table("pages").select("page_id", ids.directory_shard(path).alias("shard"), ids.module_name(path).alias("module"))


# One-hop joins


@_query("WITH t AS (SELECT dst_id FROM edges WHERE type = 'CALLS' GROUP BY dst_id ORDER BY count(*) DESC, dst_id LIMIT 1) SELECT n.id, n.qualified_name, count(*) AS lines FROM edges e JOIN t ON e.dst_id = t.dst_id JOIN nodes n ON e.src_id = n.id WHERE e.type = 'CALLS' GROUP BY n.id, n.qualified_name", ("nodes", "edges"))
def callers(g: Facts) -> DataFrame:
    edges = g.edges
    top = edges.where("type = 'CALLS'").groupBy("dst_id").count().orderBy(F.desc("count"), "dst_id").limit(1).select(F.col("dst_id").alias("id"))
    return neighbours.callers(edges, g.nodes, top).groupBy("id", "qualified_name").agg(F.count(F.lit(1)).alias("lines"))


@_query("SELECT src_id AS anchor, count(*) AS calls, count(DISTINCT n.id) AS functions FROM edges JOIN nodes n ON dst_id = n.id WHERE type = 'CALLS' GROUP BY src_id", ("nodes", "edges"))
def callees(g: Facts) -> DataFrame:
    return neighbours.callees(g.edges, g.nodes).groupBy("anchor").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("id").alias("functions"))


@_query("SELECT dst_id AS anchor, n.id, n.qualified_name FROM edges JOIN nodes n ON src_id = n.id WHERE type = 'REFERENCES'", ("nodes", "edges"))
def references_to(g: Facts) -> DataFrame:
    return neighbours.referrers(g.edges, g.nodes).select("anchor", "id", "qualified_name")


@_query("SELECT src_id AS anchor, type, n.id, n.kind FROM edges JOIN nodes n ON dst_id = n.id WHERE type IN ('CONTAINS', 'REFERENCES')", ("nodes", "edges"))
def cross_layer_neighbours(g: Facts) -> DataFrame:
    return neighbours.neighbours(g.edges, g.nodes, ["CONTAINS", "REFERENCES"], False).select("anchor", "type", "id", "kind")


_BOUNDARY = "WITH b AS (SELECT e.id, s.shard AS src_shard, d.shard AS dst_shard, e.type FROM edges e JOIN nodes s ON src_id = s.id JOIN nodes d ON dst_id = d.id WHERE s.shard <> d.shard) "


@_query(_BOUNDARY + "SELECT src_shard, dst_shard, type, count(*) AS edges FROM b GROUP BY ALL", ("nodes", "edges"))
def boundary_edges(g: Facts) -> DataFrame:
    return neighbours.shard_edges(g.edges, g.nodes).groupBy("src_shard", "dst_shard", "type").agg(F.count(F.lit(1)).alias("edges"))


@_query(_BOUNDARY + "SELECT DISTINCT src_shard AS shard, dst_shard AS other FROM b", ("nodes", "edges"))
def shard_dependencies(g: Facts) -> DataFrame:
    return neighbours.dependencies(neighbours.shard_edges(g.edges, g.nodes))


@_query(_BOUNDARY + "SELECT DISTINCT dst_shard AS shard, src_shard AS other FROM b", ("nodes", "edges"))
def shard_dependents(g: Facts) -> DataFrame:
    return neighbours.dependencies(neighbours.shard_edges(g.edges, g.nodes), incoming=True)


# Reference resolution

_LADDER = """WITH f AS (SELECT id AS node, name, qualified_name, file AS node_file, signature, definition FROM nodes),
u AS (SELECT DISTINCT raw_name, target_module, file, string_split(raw_name, '.')[-1] AS short FROM raw_references),
w AS (SELECT raw_name, target_module, file, 1 AS tier, node, signature, definition FROM u JOIN f ON name = short AND node_file = file
      UNION ALL SELECT raw_name, target_module, file, 2, node, signature, definition FROM u JOIN f ON qualified_name = raw_name
      UNION ALL SELECT raw_name, target_module, file, 3, node, signature, definition FROM u JOIN f ON qualified_name = target_module || '.' || raw_name
      UNION ALL SELECT raw_name, target_module, file, 4, node, signature, definition FROM u JOIN f ON name = short),
t AS (SELECT raw_name, target_module, file, tier, list_sort(list(DISTINCT node)) AS candidates, count(DISTINCT signature) AS sigs, list(DISTINCT node) FILTER (WHERE definition) AS defs FROM w GROUP BY ALL),
p AS (SELECT *, CASE WHEN len(candidates) = 1 THEN candidates[1] WHEN tier IN (2, 3) AND sigs = 1 AND len(defs) = 1 THEN defs[1] END AS picked, row_number() OVER (PARTITION BY raw_name, target_module, file ORDER BY tier) AS k FROM t),
r AS (SELECT r.id, r.owner_id, r.call_kind, CASE WHEN call_kind = 'indirect' THEN NULL ELSE tier END AS tier, CASE WHEN call_kind <> 'indirect' THEN picked END AS picked, CASE WHEN call_kind <> 'indirect' THEN len(candidates) ELSE 0 END AS n
      FROM raw_references r LEFT JOIN p ON r.raw_name = p.raw_name AND r.target_module IS NOT DISTINCT FROM p.target_module AND r.file = p.file AND k = 1),
s AS (SELECT *, CASE WHEN picked IS NOT NULL THEN 'resolved' WHEN coalesce(n, 0) > 0 THEN 'ambiguous' ELSE 'unresolved' END AS status FROM r)
"""


def _resolved(g: Facts) -> DataFrame:
    k = _keyed(g)
    return resolve.resolve_counts(k.raw_references, k.nodes.where("kind = 'Function'"))


_FUNCTIONS = _LADDER.replace("FROM nodes)", "FROM nodes WHERE kind = 'Function')", 1)


@_query(_FUNCTIONS + "SELECT id, status, picked AS resolved_id, coalesce(n, 0) AS candidates, CASE WHEN status = 'resolved' THEN CASE tier WHEN 1 THEN 0.98::DOUBLE WHEN 2 THEN 0.99 WHEN 3 THEN 1.0 ELSE 0.75 END ELSE 0.0 END AS confidence FROM s", ("nodes", "raw_references"))
def resolve_references(g: Facts) -> DataFrame:
    return _resolved(g).select(keyed.reference_text("id").alias("id"), "status", keyed.node_text("resolved_id").alias("resolved_id"), F.col("n_candidates").alias("candidates"), "confidence")


@_query(_FUNCTIONS + "SELECT owner_id, CASE WHEN call_kind = 'indirect' THEN 'indirect' WHEN status = 'resolved' THEN 'direct' ELSE status END AS call_class, count(*) AS calls FROM s GROUP BY ALL", ("nodes", "raw_references"))
def call_semantics(g: Facts) -> DataFrame:
    k = _keyed(g)
    resolved = resolve.resolve_named(k.calls.select("owner_id", "name_id"), k.call_names, k.call_owners, k.nodes.where("kind = 'Function'"))
    return neighbours.call_semantics(resolved).withColumn("owner_id", keyed.node_text("owner_id"))


@_query(_FUNCTIONS + "SELECT s.id, o.shard AS owner_shard, t.shard AS target_shard FROM s LEFT JOIN nodes o ON owner_id = o.id LEFT JOIN nodes t ON picked = t.id WHERE status = 'resolved' AND o.shard IS DISTINCT FROM t.shard", ("nodes", "raw_references"))
def boundary_references(g: Facts) -> DataFrame:
    k = _keyed(g)
    functions = k.nodes.where("kind = 'Function'")
    targets = functions.select(F.col("id").alias("resolved_id"), F.col("shard").alias("target_shard"))
    resolved = resolve.resolve_named(k.calls, k.call_names, k.call_owners, functions, targets, resolved_only=True)
    return neighbours.boundary_references(resolved, k.nodes).select(keyed.call_text("owner_id", "name_id", "place").alias("id"), "owner_shard", "target_shard")


# Shards

_PRINTS = """WITH q AS (SELECT DISTINCT shard, kind || '|' || qualified_name || '|' || coalesce(signature, '') AS s FROM nodes WHERE NOT starts_with(name, '_')),
fp AS (SELECT shard, count(*) AS symbols, sha256(string_agg(s, chr(10) ORDER BY s)) AS fingerprint FROM q GROUP BY shard)
"""


@_query(_PRINTS + "SELECT * FROM fp", ("nodes",))
def shard_fingerprints(g: Facts) -> DataFrame:
    return shards.fingerprints(g.nodes)


@_query(_PRINTS + ", n AS (SELECT shard, count(*) AS nodes FROM nodes GROUP BY shard), o AS (SELECT s.shard, count(*) AS edges, count(*) FILTER (WHERE s.shard <> d.shard) AS boundary_edges FROM edges JOIN nodes s ON src_id = s.id JOIN nodes d ON dst_id = d.id GROUP BY s.shard) SELECT shard, nodes, coalesce(edges, 0) AS edges, coalesce(boundary_edges, 0) AS boundary_edges, fingerprint FROM n LEFT JOIN o USING (shard) LEFT JOIN fp USING (shard)", ("nodes", "edges"))
def build_shards(g: Facts) -> DataFrame:
    return shards.build_shards(g.nodes, g.edges)


@_query("WITH n AS (SELECT shard, count(*) AS c FROM nodes GROUP BY shard), k AS (SELECT c, row_number() OVER (ORDER BY c, shard) AS k, count(*) OVER () AS n FROM n) SELECT max(n) AS shards, min(c) AS least, max(c) FILTER (WHERE k = (n - 1) // 2 + 1) AS median, max(c) FILTER (WHERE k = CAST(ceil(n * 0.95) AS BIGINT)) AS p95, max(c) AS most, round(max(c) / sum(c), 6) AS giant_share FROM k", ("nodes",))
def shard_quality(g: Facts) -> DataFrame:
    return shards.qualify(g.nodes.groupBy("shard").agg(F.count(F.lit(1)).alias("nodes")))


@_query("SELECT base, path, (row_number() OVER (PARTITION BY base ORDER BY density DESC, path) - 1) % CAST(ceil(count(*) OVER (PARTITION BY base) / 80) AS BIGINT) AS bucket FROM (SELECT c_nationkey AS base, c_name AS path, c_acctbal AS density FROM customer)")
def structural_buckets(g: Facts) -> DataFrame:
    return shards.structural_buckets(g.table("customer").selectExpr("c_nationkey as base", "c_name as path", "c_acctbal as density")).select("base", "path", "bucket")


# Overlays

_BASE = "WITH base AS (SELECT CAST(o_orderkey AS STRING) AS entity_id, o_orderstatus AS status FROM orders), "
_VIEW = _BASE + "v AS (SELECT * FROM base WHERE entity_id NOT IN (SELECT entity_id FROM overlay) UNION ALL SELECT entity_id, status FROM overlay WHERE operation <> 'DELETE') "


def _base(g: Facts) -> DataFrame:
    return g.table("orders").select(F.col("o_orderkey").cast("string").alias("entity_id"), F.col("o_orderstatus").alias("status"))


@_query(_VIEW + "SELECT status, count(*) AS entities, min(entity_id) AS first FROM v GROUP BY status", ("overlay",))
def overlay_view(g: Facts) -> DataFrame:
    return overlay.read(_base(g), g.overlay).groupBy("status").agg(F.count(F.lit(1)).alias("entities"), F.min("entity_id").alias("first"))


@_query(_VIEW + "SELECT coalesce(b.entity_id, v.entity_id) AS entity_id, CASE WHEN b.entity_id IS NULL THEN 'ADD' WHEN v.entity_id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS operation FROM base b FULL JOIN v ON b.entity_id = v.entity_id WHERE b.entity_id IS NULL OR v.entity_id IS NULL OR b.status IS DISTINCT FROM v.status", ("overlay",))
def capture_delta(g: Facts) -> DataFrame:
    base = _base(g)
    return overlay.capture(base, overlay.read(base, g.overlay), "entity_id", ["entity_id", "status"]).select("entity_id", "operation")


@_query("SELECT 0::BIGINT AS differences")
def overlay_parity(g: Facts) -> DataFrame:
    base, layer = _base(g), g.overlay
    full = base.join(layer.select("entity_id", F.col("status").alias("new"), "operation"), "entity_id", "full_outer").where("operation is null or operation <> 'DELETE'").select("entity_id", F.when(F.col("operation").isNull(), F.col("status")).otherwise(F.col("new")).alias("status"))
    return overlay.parity(overlay.read(base, layer), full).agg(F.count(F.lit(1)).alias("differences"))


@_query("SELECT t AS entity_type, o AS operation, count(entity_id) AS n FROM (SELECT * FROM (SELECT unnest(['edges', 'nodes']) AS t), (SELECT unnest(['ADD', 'UPDATE', 'DELETE']) AS o)) AS g LEFT JOIN overlay ON t = 'nodes' AND operation = o GROUP BY t, o", ("overlay",))
def overlay_counts(g: Facts) -> DataFrame:
    return overlay.counts(g.overlay.withColumn("entity_type", F.lit("nodes")), ["nodes", "edges"]).select("entity_type", "operation", "n")


_OTHER = "x AS (SELECT entity_id, CASE WHEN operation = 'UPDATE' THEN 'DELETE' ELSE operation END AS operation, CASE WHEN operation = 'UPDATE' THEN NULL WHEN operation = 'ADD' THEN 'M' ELSE status END AS status FROM overlay) "


def _other(layer: DataFrame) -> DataFrame:
    update, add = F.col("operation") == "UPDATE", F.col("operation") == "ADD"
    return layer.select("entity_id", F.when(update, "DELETE").otherwise(F.col("operation")).alias("operation"), F.when(update, None).when(add, "M").otherwise(F.col("status")).alias("status"))


@_query("WITH " + _OTHER + "SELECT entity_id, CASE WHEN 'DELETE' IN (o.operation, x.operation) THEN 'DELETE_UPDATE' WHEN o.operation = 'ADD' AND x.operation = 'ADD' THEN 'ADD_ADD' ELSE 'ENTITY' END AS conflict FROM overlay o JOIN x USING (entity_id) WHERE o.operation <> x.operation OR o.status IS DISTINCT FROM x.status", ("overlay",))
def overlay_conflicts(g: Facts) -> DataFrame:
    layer = g.overlay
    return overlay.conflicts(layer, _other(layer), "status")


@_query("WITH " + _OTHER + "SELECT DISTINCT entity_id, operation FROM (SELECT * FROM overlay UNION ALL SELECT * FROM x) WHERE entity_id NOT IN (SELECT o.entity_id FROM overlay o JOIN x USING (entity_id) WHERE o.operation <> x.operation OR o.status IS DISTINCT FROM x.status)", ("overlay",))
def overlay_merge(g: Facts) -> DataFrame:
    layer = g.overlay
    return overlay.merge(layer, _other(layer), "status").select("entity_id", "operation")


@_query("SELECT entity_id, operation, TRY_CAST(entity_id AS BIGINT) IS NULL OR TRY_CAST(entity_id AS BIGINT) % 4 <> 0 AS kept FROM overlay", ("overlay",))
def overlay_rebase(g: Facts) -> DataFrame:
    old = _base(g)
    new = old.withColumn("status", F.when(F.expr("cast(entity_id as bigint) % 4 = 0"), F.concat("status", F.lit("!"))).otherwise(F.col("status")))
    return overlay.rebase(g.overlay, old, new, "entity_id", ["entity_id", "status"]).select("entity_id", "operation", "kept")


# Incremental

_DAY = "TIMESTAMP '1996-01-01'"


@_query(f"WITH o AS (SELECT l_orderkey AS k, sum(l_linenumber) AS d FROM lineitem WHERE l_shipdate < {_DAY} GROUP BY 1), n AS (SELECT l_orderkey AS k, sum(l_linenumber) AS d FROM lineitem WHERE l_shipdate < {_DAY} + INTERVAL 300 DAY AND l_shipdate >= {_DAY} - INTERVAL 900 DAY GROUP BY 1) SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM o FULL JOIN n ON o.k = n.k WHERE o.d IS DISTINCT FROM n.d")
def incremental_changes(g: Facts) -> DataFrame:
    rows = g.table("lineitem")
    side = lambda cond: rows.where(cond).groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_linenumber").alias("d"))
    return incremental.changes(side(f"l_shipdate < {_DAY}"), side(f"l_shipdate < {_DAY} + INTERVAL 300 DAYS and l_shipdate >= {_DAY} - INTERVAL 900 DAYS"), "k", "d")


_FRONTIER = _BOUNDARY.replace(" WHERE s.shard <> d.shard)", " WHERE s.shard <> d.shard AND type = 'CALLS')")


@_query(_FRONTIER + "SELECT src_shard AS shard, count(*) AS edges, count(*) OVER () > 8 AS wide FROM b WHERE dst_shard IN ('Brand#11', 'Brand#12') AND src_shard NOT IN ('Brand#11', 'Brand#12') AND right(id, 1) IN ('0', '1') GROUP BY src_shard", ("nodes", "edges"))
def impact_frontier(g: Facts) -> DataFrame:
    k = _keyed(g)
    changed = g.spark.createDataFrame([("Brand#11",), ("Brand#12",)], "shard string")
    edges = k.edges.where("type = 'CALLS'")
    gone = F.right(keyed.edge_text(F.col("src_id"), F.col("dst_id"), F.col("type"), F.col("id")), F.lit(1)).isin("0", "1")
    met = neighbours.shard_edges(edges.select(F.struct("src_id", "dst_id", "id").alias("id"), "src_id", "dst_id", gone.alias("gone")), k.nodes, into=changed)
    return incremental.impact_frontier(changed, met.where("not gone"), met)


@_query("WITH a AS (SELECT DISTINCT p_name AS name, p_type FROM part WHERE p_partkey % 10 <> 0), b AS (SELECT DISTINCT p_name AS name, p_type FROM part WHERE p_partkey % 10 <> 1) SELECT DISTINCT name FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))")
def affected_names(g: Facts) -> DataFrame:
    part = g.table("part").withColumnRenamed("p_name", "name")
    return incremental.affected_names(part.where("p_partkey % 10 <> 0"), part.where("p_partkey % 10 <> 1"), ["p_type"])


# Evidence

_ITEMS = """WITH i AS (SELECT CAST(doc_id AS STRING) AS id, source AS anchor, CASE WHEN quality = 1 THEN 'primary' ELSE 'supporting' END AS role, lang AS kind,
CASE WHEN toxic = 1 THEN 'unresolved' WHEN doc_id % 3 = 0 THEN 'ambiguous' ELSE 'resolved' END AS status, doc_id % 2 = 0 AS direct, CAST(doc_id % 7 AS DOUBLE) / 8 AS confidence, n_chars AS distance, doc_id % 5 = 0 AS boundary FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY CASE role WHEN 'primary' THEN 0 ELSE 1 END, CASE kind WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 99 END, CASE status WHEN 'resolved' THEN 0 WHEN 'ambiguous' THEN 1 ELSE 2 END, direct DESC, confidence DESC, distance, boundary, id) AS rank FROM i)
"""


def _items(g: Facts) -> DataFrame:
    rows = g.table("documents").join(g.table("labels"), "doc_id")
    return rows.selectExpr(
        "cast(doc_id as string) as id", "source as anchor", "if(quality = 1, 'primary', 'supporting') as role", "lang as kind",
        "case when toxic = 1 then 'unresolved' when doc_id % 3 = 0 then 'ambiguous' else 'resolved' end as status", "doc_id % 2 = 0 as direct", "cast(doc_id % 7 as double) / 8 as confidence", "n_chars as distance", "doc_id % 5 = 0 as boundary",
    )


def _ranked(g: Facts) -> DataFrame:
    return evidence.rank(_items(g), {"primary": 0, "supporting": 1}, {"en": 0, "de": 1}, "anchor")


@_query(_ITEMS + "SELECT id, anchor, rank FROM r", ("points",))
def rank_evidence(g: Facts) -> DataFrame:
    return _ranked(g).select("id", "anchor", "rank")


@_query(_ITEMS + ", k AS (SELECT *, row_number() OVER (PARTITION BY anchor, role = 'primary' ORDER BY rank) AS k FROM r), c AS (SELECT *, count(*) FILTER (WHERE role = 'primary' AND k <= 5) OVER (PARTITION BY anchor) AS shown FROM k) SELECT id, anchor, rank FROM c WHERE CASE WHEN role = 'primary' THEN k <= 5 ELSE k <= greatest(0, 8 - shown) END", ("points",))
def evidence_bundle(g: Facts) -> DataFrame:
    return evidence.bundle(_ranked(g), "anchor", 5, 8).select("id", "anchor", "rank")


@_query(_ITEMS + ", o AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, id) AS place FROM i WHERE confidence >= 0.3), f AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY place) <= greatest(1, 50 // (SELECT count(DISTINCT anchor) FROM o)) AS floor FROM o) SELECT id, anchor FROM (SELECT *, row_number() OVER (ORDER BY floor DESC, place) AS k FROM f) WHERE k <= 50", ("points",))
def result_window(g: Facts) -> DataFrame:
    items = _items(g).withColumnRenamed("anchor", "family").withColumn("rank", F.struct((-F.col("confidence")).alias("c"), "id"))
    return evidence.select_window(items, 50).select("id", F.col("family").alias("anchor"))


@_query(_ITEMS + "SELECT id, anchor FROM (SELECT *, rank() OVER (PARTITION BY anchor ORDER BY confidence DESC) AS a, row_number() OVER (PARTITION BY anchor ORDER BY confidence DESC, id) AS b FROM i) WHERE a <= 3 AND b <= 6", ("points",))
def top_with_ties(g: Facts) -> DataFrame:
    return evidence.top_with_ties(_items(g), "confidence", 3, 6, "anchor").select("id", "anchor")


# Data flow

_FLOW = """WITH w AS (SELECT *, last_value(CASE WHEN type IN ('ALLOC', 'WRITE', 'RELEASE') THEN position END IGNORE NULLS) OVER (PARTITION BY owner, subject ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at FROM points),
fl AS (SELECT w.owner, w.subject, s.event_id AS src, w.event_id AS dst, s.position AS sp, w.position AS dp, w.type, CASE s.type WHEN 'RELEASE' THEN 'free_to_use' WHEN 'ALLOC' THEN 'alloc_to_use' ELSE 'value_flow' END AS flow
      FROM w JOIN points s ON s.owner = w.owner AND s.position = w.at WHERE w.type IN ('DEREFERENCE', 'CHECK'))
"""


@_query("SELECT event_id, row_number() OVER (PARTITION BY owner, type ORDER BY position) - 1 AS ordinal FROM points", ("points",))
def event_ordinals(g: Facts) -> DataFrame:
    return dataflow.ordinals(g.points).select("event_id", "ordinal")


@_query("SELECT * FROM (SELECT event_id AS src, lead(event_id) OVER (PARTITION BY owner ORDER BY position) AS dst, owner FROM points) WHERE dst IS NOT NULL", ("points",))
def control_reaches(g: Facts) -> DataFrame:
    return dataflow.control_edges(g.points)


@_query(_FLOW + "SELECT owner, subject, src, dst, flow FROM fl", ("points",))
def data_flow(g: Facts) -> DataFrame:
    return dataflow.flow_edges(g.points).select("owner", "subject", "src", "dst", "flow")


@_query(_FLOW + "SELECT src, dst, (SELECT count(*) FROM points p WHERE p.owner = fl.owner AND p.subject = fl.subject AND p.position > sp AND p.position < dp) AS via FROM fl", ("points",))
def flow_via(g: Facts) -> DataFrame:
    points = g.points
    return dataflow.between(dataflow.flow_edges(points), points).select("src", "dst", "via")


@_query("SELECT owner, lock, count(*) FILTER (WHERE type = 'LOCK') AS acquires, count(*) FILTER (WHERE type = 'UNLOCK') AS releases, greatest(0, count(*) FILTER (WHERE type = 'LOCK') - count(*) FILTER (WHERE type = 'UNLOCK')) AS unpaired_acquires, greatest(0, count(*) FILTER (WHERE type = 'UNLOCK') - count(*) FILTER (WHERE type = 'LOCK')) AS unpaired_releases FROM locks WHERE type <> 'ACCESS' GROUP BY owner, lock", ("points", "locks"))
def lock_pairing(g: Facts) -> DataFrame:
    return dataflow.lock_pairing(g.locks)


_HELD = "WITH h AS (SELECT a.event_id, a.owner, a.type, a.lock AS own, l.lock, arg_max(l.type, l.position) AS state FROM locks a JOIN locks l ON l.owner = a.owner AND l.position < a.position AND l.type <> 'ACCESS' GROUP BY ALL) "


@_query(_HELD + "SELECT a.event_id, coalesce(string_agg(CAST(h.lock AS STRING), ',' ORDER BY h.lock) FILTER (WHERE state = 'LOCK'), '') AS held FROM locks a LEFT JOIN h USING (event_id) WHERE a.type = 'ACCESS' GROUP BY a.event_id", ("points", "locks"))
def access_locksets(g: Facts) -> DataFrame:
    return dataflow.held_locks(g.locks).select("event_id", F.array_join(F.array_sort("held"), ",").alias("held"))


@_query(_HELD + ", p AS (SELECT DISTINCT owner, lock AS first, own AS second FROM h WHERE type = 'LOCK' AND state = 'LOCK' AND lock <> own), c AS (SELECT first, second, count(*) AS owners FROM p GROUP BY ALL) SELECT c.first, c.second, c.owners, d.owners AS inverse FROM c JOIN c d ON c.first = d.second AND c.second = d.first WHERE c.first < c.second", ("points", "locks"))
def lock_order(g: Facts) -> DataFrame:
    return defects.lock_order(g.locks)


@_query(_HELD + "SELECT owner, own AS lock, event_id FROM h WHERE type = 'LOCK' AND own = lock AND state = 'LOCK'", ("points", "locks"))
def self_deadlock(g: Facts) -> DataFrame:
    return defects.self_deadlock(g.locks)


# Defects


@_query("WITH w AS (SELECT *, last_value(CASE WHEN type IN ('RELEASE', 'ALLOC', 'WRITE') THEN position END IGNORE NULLS) OVER (PARTITION BY owner, subject ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at FROM points) SELECT w.owner, w.subject, s.event_id AS first, w.event_id AS second FROM w JOIN points s ON s.owner = w.owner AND s.position = w.at WHERE w.type = 'RELEASE' AND s.type = 'RELEASE'", ("points",))
def double_free(g: Facts) -> DataFrame:
    return defects.double_free(g.points)


@_query(_FLOW + "SELECT owner, subject, src AS release, dst AS use FROM fl WHERE flow = 'free_to_use' AND type = 'DEREFERENCE'", ("points",))
def use_after_free(g: Facts) -> DataFrame:
    return defects.use_after_free(g.points)


@_query(_FLOW + "SELECT owner, subject, src AS alloc, dst AS use FROM fl WHERE flow = 'alloc_to_use' AND type = 'DEREFERENCE' AND NOT EXISTS (SELECT 1 FROM points p WHERE p.owner = fl.owner AND p.subject = fl.subject AND p.type = 'CHECK' AND p.position > sp AND p.position < dp)", ("points",))
def null_flow(g: Facts) -> DataFrame:
    return defects.null_flow(g.points)


@_query("SELECT owner, subject, event_id AS alloc, coalesce(nxt, 'EXIT') AS lost_at FROM (SELECT *, (SELECT arg_min(q.type, q.position) FROM points q WHERE q.owner = p.owner AND q.subject = p.subject AND q.position > p.position AND q.type IN ('RELEASE', 'ALLOC', 'WRITE')) AS nxt FROM points p WHERE type = 'ALLOC') WHERE nxt IS NULL OR nxt <> 'RELEASE'", ("points",))
def resource_lifetime(g: Facts) -> DataFrame:
    return defects.resource_leak(g.points)


@_query("WITH p AS (SELECT subject, owner, count(*) FILTER (WHERE type IN ('WRITE', 'ALLOC')) AS writes, count(*) AS touches FROM points GROUP BY ALL), t AS (SELECT *, count(*) OVER (PARTITION BY subject) AS owners, row_number() OVER (PARTITION BY subject ORDER BY writes DESC, owner) AS a, row_number() OVER (PARTITION BY subject ORDER BY touches DESC, owner) AS b FROM p) SELECT w.subject, w.owner AS writer, w.writes, w.owners, o.owner AS other, o.touches FROM t w JOIN t o USING (subject) WHERE w.owners > 1 AND w.writes > 0 AND w.a <= 3 AND o.b <= 3 AND w.owner <> o.owner", ("points",))
def race_condition(g: Facts) -> DataFrame:
    return defects.race(g.points)


_TOUCHES = "WITH p AS (SELECT subject, owner, count(*) FILTER (WHERE type IN ('WRITE', 'ALLOC')) AS writes, count(*) AS touches FROM points GROUP BY ALL), t AS (SELECT *, count(*) OVER (PARTITION BY subject) AS owners, count(*) FILTER (WHERE writes > 0) OVER (PARTITION BY subject) AS writers FROM p)"


@_query(_TOUCHES + " SELECT subject, owner, writes, touches, writers - CAST(writes > 0 AS INT) AS writing_partners, CASE WHEN writes > 0 THEN owners - 1 ELSE writers END AS partners FROM t WHERE owners > 1 AND writers > 0", ("points",))
def race_owners(g: Facts) -> DataFrame:
    return defects.race_owners(g.points)


@_query(_TOUCHES + ", w AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY writes DESC, owner) AS a FROM t WHERE writes > 0 AND owners > 1), m AS (SELECT w.subject, w.owner AS writer, w.writes, o.owner AS other, o.touches, w.writers * (w.owners - 1) AS total, row_number() OVER (PARTITION BY w.subject, w.owner ORDER BY o.touches DESC, o.owner) AS b FROM w JOIN t o ON o.subject = w.subject AND o.owner <> w.owner WHERE w.a <= 3), s AS (SELECT * FROM m WHERE b <= 3) SELECT subject, writer, writes, other, touches, total, total > count(*) OVER (PARTITION BY subject) AS truncated FROM s", ("points",))
def race_report(g: Facts) -> DataFrame:
    return defects.race_report(g.points)


@_query("SELECT owner, subject, count(*) AS checks FROM points p WHERE type = 'CHECK' AND NOT EXISTS (SELECT 1 FROM points w WHERE w.owner = p.owner AND w.subject = p.subject AND w.type = 'WRITE') GROUP BY ALL", ("points",))
def state_machine(g: Facts) -> DataFrame:
    return defects.state_machine(g.points)


@_query("SELECT owner, subject, event_id FROM (SELECT *, lead(type) OVER (PARTITION BY owner, subject ORDER BY position) AS nxt FROM points) WHERE type = 'ALLOC' AND nxt = 'DEREFERENCE'", ("points",))
def error_handling(g: Facts) -> DataFrame:
    return defects.error_handling(g.points)


# Traversal


@_query("SELECT src_id, count(*) AS degree, min(dst_id) AS first FROM edges WHERE type = 'CONTAINS' GROUP BY src_id", ("edges",))
def adjacency(g: Facts) -> DataFrame:
    return traversal.adjacency(g.edges.where("type = 'CONTAINS'")).select("src_id", F.size("out").cast("long").alias("degree"), F.col("out")[0]["dst"].alias("first"))


_ANCHOR = "(SELECT min(id) FROM nodes WHERE kind = 'Namespace')"


@_query(f"WITH e AS (SELECT id, src_id AS a, dst_id AS b FROM edges UNION ALL SELECT id, dst_id, src_id FROM edges), o AS (SELECT b AS id, min(e.id) AS edge FROM e WHERE a = {_ANCHOR} AND b <> {_ANCHOR} GROUP BY b ORDER BY edge LIMIT 99), w AS (SELECT b AS id, min(e.id) AS edge FROM e JOIN o ON a = o.id WHERE b <> {_ANCHOR} AND b NOT IN (SELECT id FROM o) GROUP BY b ORDER BY edge LIMIT (SELECT 99 - count(*) FROM o)) SELECT {_ANCHOR} AS id, 0 AS distance UNION ALL SELECT id, 1 FROM o UNION ALL SELECT id, 2 FROM w", ("nodes", "edges"))
def subgraph(g: Facts) -> DataFrame:
    anchor = g.nodes.where("kind = 'Namespace'").agg(F.min("id")).collect()[0][0]
    return traversal.subgraph(g.edges, anchor)


_STEPS = "WITH s AS (SELECT DISTINCT n_regionkey * 1000 AS src, n_nationkey AS dst FROM nation UNION SELECT n_nationkey, 100000 + s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT n_nationkey, n_regionkey * 1000 FROM nation), "


@_query(_STEPS.replace("WITH s AS", "WITH RECURSIVE s AS") + "r AS (SELECT src AS start, dst AS node FROM s WHERE src IN (0, 1000) UNION SELECT start, dst FROM r JOIN s ON node = src) SELECT start, node FROM r")
def reachability(g: Facts) -> DataFrame:
    nation, supplier = g.table("nation"), g.table("supplier")
    down = nation.selectExpr("cast(n_regionkey * 1000 as long) as src", "cast(n_nationkey as long) as dst")
    leaf = supplier.selectExpr("cast(s_nationkey as long) as src", "100000 + s_suppkey as dst")
    up = nation.selectExpr("cast(n_nationkey as long) as src", "cast(n_regionkey * 1000 as long) as dst")
    starts = g.spark.createDataFrame([(0,), (1000,)], "start long")
    return traversal.reachable(down.unionByName(leaf).unionByName(up), starts)


@_query()
def find_paths(g: Facts) -> DataFrame:
    points = g.points
    edges = dataflow.control_edges(points)
    marks = points.selectExpr("owner", "event_id as point", "type = 'ALLOC' as is_start", "type = 'RELEASE' as is_target", "type = 'CHECK' as is_blocked")
    return traversal.find_paths(edges, marks)


# Knowledge

_DOCS = """WITH md AS (SELECT p_partkey AS doc, '# ' || p_brand || chr(10) || 'see `' || p_brand || '.' || p_name || '` and `' || p_name || '`, [module:' || p_brand || '] `x.py`' || chr(10) || '## REQ-' || CAST(p_partkey AS STRING) || ' ' || p_type || chr(10) || 'body' || chr(10)
|| CASE WHEN p_partkey % 2 = 0 THEN '### Deep' || chr(10) || 'x' || chr(10) ELSE '' END || '## REQ-' || CAST(p_partkey AS STRING) || ' ' || p_type || chr(10) || '# Other' || chr(10) || '### Low' AS text FROM part)"""


def _markdown(g: Facts) -> DataFrame:
    part = g.table("part")
    return g.spark.sql(_DOCS.replace("FROM part", "FROM {part}") + " SELECT doc, text FROM md", part=part)


@_query(_DOCS + """, l AS (SELECT doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos, len(string_split(text, chr(10))) AS n FROM md),
h AS (SELECT doc, pos, n, length(regexp_extract(line, '^(#{1,6})\\s', 1)) AS level, regexp_replace(line, '^#+\\s+', '') AS title FROM l WHERE line LIKE '#%'),
a AS (SELECT h.doc, h.pos, h.n, h.level, h.title, (SELECT string_agg(u.title, ' / ' ORDER BY u.pos) FROM h u WHERE u.doc = h.doc AND u.pos < h.pos AND u.level < h.level AND NOT EXISTS (SELECT 1 FROM h w WHERE w.doc = h.doc AND w.pos > u.pos AND w.pos < h.pos AND w.level <= u.level)) AS above FROM h),
p AS (SELECT *, coalesce(above || ' / ', '') || title AS path FROM a), k AS (SELECT *, row_number() OVER (PARTITION BY doc, path ORDER BY pos) AS k FROM p)
SELECT doc, level, title, path || CASE WHEN k > 1 THEN '[' || k || ']' ELSE '' END AS heading_path, pos AS start_line, coalesce(lead(pos) OVER (PARTITION BY doc ORDER BY pos) - 1, n) AS end_line FROM k""")
def markdown_sections(g: Facts) -> DataFrame:
    return knowledge.sections(_markdown(g))


_LINKS = _DOCS + """, r AS (SELECT doc, 'symbol' AS kind, unnest(regexp_extract_all(text, '`([^`\\n]+)`', 1)) AS anchor FROM md UNION SELECT doc, 'module', unnest(regexp_extract_all(text, '\\[module:([^\\]]+)\\]', 1)) FROM md UNION SELECT doc, 'requirement', unnest(regexp_extract_all(text, 'REQ-[0-9]+')) FROM md),
f AS (SELECT DISTINCT doc, CASE WHEN kind = 'symbol' AND ends_with(anchor, '.py') THEN 'file' ELSE kind END AS kind, anchor FROM r)
"""


@_query(_LINKS + "SELECT doc, kind, anchor FROM f")
def document_anchors(g: Facts) -> DataFrame:
    return knowledge.anchors(_markdown(g))


@_query(_LINKS + """, t AS (SELECT 'requirement' AS kind, 'REQ-' || CAST(p_partkey AS STRING) AS anchor, CAST(p_partkey AS STRING) AS target, 1.0 AS sure, 0 AS tier FROM part WHERE p_partkey % 3 = 0 UNION SELECT 'module', shard, shard, 0.9, 0 FROM nodes UNION SELECT 'file', file, file, 1.0, 0 FROM nodes
UNION SELECT 'symbol', qualified_name, id, 1.0, 0 FROM nodes UNION SELECT 'symbol', name, id, 0.7, 1 FROM nodes WHERE name <> qualified_name),
c AS (SELECT kind, anchor, tier, sure, count(*) AS n, min(target) AS target FROM t GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY kind, anchor ORDER BY tier) AS k FROM c)
SELECT doc, kind, anchor, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status, CASE WHEN n = 1 THEN target END AS target, coalesce(n, 0) AS candidates, CASE WHEN n = 1 THEN CAST(sure AS DOUBLE) ELSE 0.0 END AS confidence FROM f LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (kind, anchor)""", ("nodes",))
def link_documents(g: Facts) -> DataFrame:
    needs = g.table("part").where("p_partkey % 3 = 0").selectExpr("'REQ-' || cast(p_partkey as string) as anchor", "cast(p_partkey as string) as target")
    return knowledge.link(knowledge.anchors(_markdown(g)), g.nodes, needs)


# Spans

_SPANS = "WITH s AS (SELECT c_custkey AS span, CAST(floor(c_custkey / 60.0) AS BIGINT) AS file, c_custkey * 7 % 997 AS start, c_custkey * 7 % 997 + c_custkey % 131 AS stop FROM customer), p AS (SELECT o_orderkey AS place, CAST(floor(o_custkey / 60.0) AS BIGINT) AS file, o_orderkey % 997 AS a, o_orderkey % 997 + o_orderkey % 5 AS z FROM orders) "


def _spans(g: Facts) -> tuple[DataFrame, DataFrame]:
    s = g.table("customer").selectExpr("c_custkey as span", "c_custkey div 60 as file", "c_custkey * 7 % 997 as start", "c_custkey * 7 % 997 + c_custkey % 131 as stop")
    p = g.table("orders").selectExpr("o_orderkey as place", "o_custkey div 60 as file", "o_orderkey % 997 as at", "o_orderkey % 997 + o_orderkey % 5 as until")
    return s, p


@_query(_SPANS + "SELECT place, span FROM s JOIN p ON s.file = p.file AND start <= a AND z <= stop")
def contained_accesses(g: Facts) -> DataFrame:
    return spans.containing(*_spans(g)).select("place", "span")


@_query(_SPANS + "SELECT place, span, file FROM (SELECT place, span, s.file, row_number() OVER (PARTITION BY place ORDER BY start DESC, stop, span) AS k FROM s JOIN p ON s.file = p.file AND start <= a AND z <= stop) WHERE k = 1")
def owner_of(g: Facts) -> DataFrame:
    return spans.innermost(*_spans(g))


# Concurrency


@_query("WITH j AS (SELECT owner, subject, event_id AS spawn, (SELECT arg_min(q.event_id, q.position) FROM points q WHERE q.owner = p.owner AND q.subject = p.subject AND q.type = 'CHECK' AND q.position > p.position) AS joined FROM points p WHERE type = 'ALLOC') SELECT *, joined IS NULL AS detached FROM j", ("points",))
def thread_lifetimes(g: Facts) -> DataFrame:
    return concurrency.lifetimes(g.points)


@_query("SELECT subject, count(DISTINCT owner) AS owners, count(*) FILTER (WHERE type NOT IN ('WRITE', 'ALLOC', 'RELEASE')) AS reads, count(*) FILTER (WHERE type IN ('WRITE', 'ALLOC', 'RELEASE')) AS writes, count(DISTINCT owner) >= 2 AS may_parallel FROM points GROUP BY subject", ("points",))
def concurrency_context(g: Facts) -> DataFrame:
    return concurrency.shared_subjects(g.points)


@_query("WITH s AS (SELECT subject, count(DISTINCT owner) AS owners, count(*) FILTER (WHERE type NOT IN ('WRITE', 'ALLOC', 'RELEASE')) AS r, count(*) FILTER (WHERE type IN ('WRITE', 'ALLOC', 'RELEASE')) AS w FROM points GROUP BY subject) SELECT subject, 'shared_state_race' AS scenario, owners FROM s WHERE owners > 1 AND w > 0 UNION ALL SELECT subject, 'read_write_race', owners FROM s WHERE owners > 1 AND w > 0 AND r > 0", ("points",))
def race_scenarios(g: Facts) -> DataFrame:
    return concurrency.race_scenarios(g.points)


@_query("WITH d AS (SELECT event_id, (SELECT count(*) FROM points q WHERE q.owner = p.owner AND q.subject = p.subject AND q.type = 'WRITE' AND q.position < p.position) AS writers FROM points p WHERE type = 'DEREFERENCE') SELECT *, CASE writers WHEN 0 THEN 'unknown' WHEN 1 THEN 'must' ELSE 'may' END AS target FROM d", ("points",))
def dereference_resolution(g: Facts) -> DataFrame:
    return concurrency.dereference_targets(g.points)


@_query("SELECT CAST(floor(o_orderkey / 3.0) AS BIGINT) AS profile, CASE max(CASE o_orderpriority[1:1] WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 WHEN '4' THEN 3 ELSE 4 END) WHEN 0 THEN 'current' WHEN 1 THEN 'partial' WHEN 2 THEN 'stale' WHEN 3 THEN 'unsupported' ELSE 'not_built' END AS state FROM orders GROUP BY 1")
def merged_states(g: Facts) -> DataFrame:
    state = F.coalesce(*(F.when(F.col("o_orderpriority").startswith(str(k + 1)), F.lit(v)) for k, v in enumerate(concurrency.SEVERITY[:4])), F.lit("not_built"))
    return concurrency.worst_state(g.table("orders").select(F.expr("o_orderkey div 3").alias("profile"), state.alias("state")), "profile")


# Governance


@_query("SELECT o_orderkey AS file, r = '' AS fresh, r AS reason FROM (SELECT o_orderkey, concat_ws('+', CASE WHEN o_orderstatus <> 'F' THEN 'status_' || o_orderstatus END, CASE WHEN o_orderkey % 17 = 0 THEN 'missing_base' END, CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 7 = 0 THEN 'hash' END, CASE WHEN o_orderkey % 2 <> 1 THEN 'version' END) AS r FROM orders)")
def analysis_freshness(g: Facts) -> DataFrame:
    orders = g.table("orders")
    states = orders.selectExpr("o_orderkey as file", "if(o_orderstatus = 'F', 'current', o_orderstatus) as status", "o_orderkey % 5 as hash", "o_orderkey % 2 as version")
    base = orders.where("o_orderkey % 17 <> 0").selectExpr("o_orderkey as file", "if(o_orderkey % 7 = 0, -1L, o_orderkey % 5) as hash")
    return governance.freshness(states, base, 1)


@_query("SELECT c_custkey AS file FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 4 = 0)")
def uncovered_files(g: Facts) -> DataFrame:
    return governance.uncovered(g.table("customer").select(F.col("c_custkey").alias("file")), g.table("orders").where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("file")))


@_query("SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_ids(g: Facts) -> DataFrame:
    return governance.duplicates(g.table("part"), "p_name")


# Contracts


@_query("SELECT file, owner_id AS owner, start_line AS line, min(raw_name) AS callee FROM raw_references GROUP BY ALL HAVING count(DISTINCT raw_name) = 1", ("raw_references",))
def agreed_callees(g: Facts) -> DataFrame:
    calls = g.raw_references.select("file", F.col("owner_id").alias("owner"), F.col("start_line").alias("line"), F.col("raw_name").alias("callee"))
    return contracts.agreed_callees(calls)


_NAMED = "WITH f AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'acquire_' WHEN 1 THEN 'release_' ELSE 'use_' END || replace(p_name, ' ', '_') AS name, p_size % 5 AS subject FROM part) "


@_query(_NAMED + ", h AS (SELECT DISTINCT name, subject, split_part(name, '_', 1) AS half, replace(substr(name, strpos(name, '_') + 1), '_', '') AS stem FROM f) SELECT DISTINCT a.stem, a.name AS acquire, r.name AS release FROM h a JOIN h r USING (stem, subject) WHERE a.half = 'acquire' AND r.half = 'release'")
def acquire_release_pairs(g: Facts) -> DataFrame:
    part = g.table("part")
    return contracts.pairs(g.spark.sql(_NAMED.replace("FROM part", "FROM {part}") + "SELECT name, subject FROM f", part=part))


@_query("WITH c AS (SELECT o_orderkey AS site, o_custkey % 50 AS callee, ['a' || (o_orderkey % 3), CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'b' END, 'c'] AS args FROM orders), e AS (SELECT site, callee, unnest(args) AS argument, generate_subscripts(args, 1) - 1 AS ordinal FROM c) SELECT site, callee, ordinal, argument, ['x', 'y', 'z'][ordinal + 1] AS parameter FROM e WHERE argument <> '' AND ordinal < callee % 4 AND callee % 7 <> 0")
def bind_parameters(g: Facts) -> DataFrame:
    orders = g.table("orders")
    calls = orders.selectExpr("o_orderkey as site", "o_custkey % 50 as callee", "array(concat('a', cast(o_orderkey % 3 as string)), if(o_orderkey % 2 = 0, '', 'b'), 'c') as arguments")
    ids_ = g.spark.range(50).selectExpr("id as callee", "slice(array('x', 'y', 'z'), 1, cast(id % 4 as int)) as params")
    other = g.spark.range(50).where("id % 7 = 0").selectExpr("id as callee", "array('q') as params")
    return contracts.bind_parameters(calls, ids_.unionByName(other))


@_query("SELECT site, n AS calls, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS state FROM (SELECT s.id AS site, CAST(coalesce(sum(CASE WHEN ends_with(lower(c.raw_name), lower(s.raw_name)) THEN 1 ELSE 0 END), 0) AS BIGINT) AS n FROM raw_references s LEFT JOIN raw_references c ON c.call_kind = 'direct' AND s.owner_id = c.owner_id AND s.start_line = c.start_line GROUP BY s.id)", ("raw_references",))
def merge_external_sites(g: Facts) -> DataFrame:
    rows = g.raw_references
    sites = rows.select(F.col("id").alias("site"), F.col("owner_id").alias("file"), F.col("start_line").alias("line"), F.upper("raw_name").alias("root"))
    return contracts.merge_sites(sites, rows.where("call_kind = 'direct'").select(F.col("owner_id").alias("file"), F.col("start_line").alias("line"), "raw_name"))


@_query("WITH e AS (SELECT s_nationkey AS path, min(s_suppkey) AS position FROM supplier GROUP BY 1) SELECT count(*) AS entries, 'cp:' || sha256(string_agg('lib/' || path || '.jar', chr(10) ORDER BY position)) AS fingerprint FROM e")
def classpath(g: Facts) -> DataFrame:
    return contracts.classpath(g.table("supplier").selectExpr("s_suppkey as position", "concat('lib', chr(92), cast(s_nationkey as string), '.jar/') as path"))


@_query("WITH w AS (SELECT *, last_value(CASE WHEN type IN ('RELEASE', 'ALLOC', 'WRITE') THEN position END IGNORE NULLS) OVER (PARTITION BY owner, subject ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at_ FROM points) SELECT w.owner, w.subject, s.event_id AS a, w.event_id AS r FROM w JOIN points s ON s.owner = w.owner AND s.position = w.at_ WHERE w.type = 'RELEASE' AND s.type = 'ALLOC' AND s.event_id % 3 <> w.event_id % 3", ("points",))
def mismatched_free(g: Facts) -> DataFrame:
    return defects.mismatched_free(g.points, "if(a % 3 = r % 3, 'valid', 'mismatch')")


@_query(_FLOW + "SELECT src, dst, 'read' || CAST(src % 5 AS STRING) AS source, 'exec' || CAST(dst % 7 AS STRING) AS sink FROM fl WHERE src % 5 < 2 AND dst % 7 < 3", ("points",))
def taint_path(g: Facts) -> DataFrame:
    points = g.points
    sources = points.where("event_id % 5 < 2").selectExpr("event_id as src", "concat('read', cast(event_id % 5 as string)) as source")
    sinks = points.where("event_id % 7 < 3").selectExpr("event_id as dst", "concat('exec', cast(event_id % 7 as string)) as sink")
    return defects.taint(dataflow.flow_edges(points), sources, sinks)


# Projection

_CITED = _FLOW + ", ci AS (SELECT dst AS candidate, src AS event_id, 0 AS place FROM fl WHERE flow = 'free_to_use' UNION ALL SELECT dst, dst, 1 FROM fl WHERE flow = 'free_to_use' UNION ALL SELECT dst, -dst, 2 FROM fl WHERE flow = 'free_to_use'), ac AS (SELECT ci.*, p.owner, p.position, p.position IS NOT NULL AS located, CASE WHEN p.type IN ('READ', 'DEREFERENCE', 'CHECK') THEN 'READ' WHEN p.type IN ('WRITE', 'ALLOC', 'RELEASE') THEN 'WRITE' ELSE 'UNKNOWN' END AS kind FROM ci LEFT JOIN points p ON p.event_id = ci.event_id) "


def _cited(g: Facts) -> DataFrame:
    flows = dataflow.flow_edges(g.points).where("flow = 'free_to_use'")
    return projection.accesses(flows.select(F.col("dst").alias("candidate"), F.array(F.col("src"), F.col("dst"), -F.col("dst")).alias("cited")), g.points)


@_query(_CITED + "SELECT candidate, event_id, kind, located FROM ac", ("points",))
def candidate_accesses(g: Facts) -> DataFrame:
    return _cited(g).select("candidate", "event_id", "kind", "located")


@_query(_CITED + "SELECT candidate, event_id, CASE WHEN NOT located THEN 'unresolved' WHEN place < 2 THEN 'primary' ELSE 'supporting' END AS role, row_number() OVER (PARTITION BY candidate ORDER BY CASE WHEN NOT located THEN 2 WHEN place < 2 THEN 0 ELSE 1 END, place) AS number FROM ac", ("points",))
def supporting_locations(g: Facts) -> DataFrame:
    return projection.locations(_cited(g)).select("candidate", "event_id", "role", F.col("number").cast("long").alias("number"))


@_query(_CITED + "SELECT CAST(sum(a) AS BIGINT) AS located, CAST(sum(1 - a) AS BIGINT) AS unlocated FROM (SELECT candidate, max(CAST(located AS INT)) AS a FROM ac GROUP BY candidate)", ("points",))
def location_coverage(g: Facts) -> DataFrame:
    return projection.coverage(_cited(g))


@_query(_CITED + ", hl AS (SELECT a.event_id, l.lock, arg_max(l.type, l.position) AS state FROM locks a JOIN locks l ON l.owner = a.owner AND l.position < a.position AND l.type <> 'ACCESS' WHERE a.type = 'ACCESS' GROUP BY ALL), st AS (SELECT candidate, 0 AS block, place AS k, 'access:' || kind || '@' || position AS step FROM ac WHERE located UNION ALL SELECT DISTINCT candidate, 1, hl.lock, 'lock:' || hl.lock FROM ac JOIN hl ON hl.event_id = ac.event_id AND state = 'LOCK' WHERE located UNION ALL SELECT candidate, 2, place, 'unknown:' || event_id FROM ac WHERE NOT located) SELECT candidate, row_number() OVER (PARTITION BY candidate ORDER BY block, k, step) AS number, step FROM st", ("points", "locks"))
def trace_chain(g: Facts) -> DataFrame:
    return projection.trace(_cited(g), dataflow.held_locks(g.locks)).select("candidate", F.col("number").cast("long").alias("number"), "step")


# Control flow with branches: an owner's points in order, with a jump over two points where a check fails

_FLOW = """WITH q AS (SELECT owner, event_id AS point, type, CAST(subject AS BIGINT) AS subject, position, lead(event_id) OVER w AS one, lead(event_id, 3) OVER w AS far FROM points WINDOW w AS (PARTITION BY owner ORDER BY position)),
x AS (SELECT owner, -min(point) - 1 AS exit FROM q GROUP BY owner),
e AS (SELECT owner, point AS src, coalesce(one, exit) AS dst, CAST(NULL AS BIGINT) AS null_of FROM q JOIN x USING (owner)
      UNION ALL SELECT owner, point, coalesce(far, exit), subject FROM q JOIN x USING (owner) WHERE type = 'CHECK'),
p AS (SELECT owner, point, type, subject FROM q UNION ALL SELECT owner, exit, 'EXIT', NULL FROM x)
"""


def _flow(g: Facts) -> tuple[DataFrame, DataFrame]:
    of = "over (partition by owner order by position)"
    q = g.points.selectExpr("owner", "event_id as point", "type", "cast(subject as long) as subject", f"lead(event_id) {of} as one", f"lead(event_id, 3) {of} as far", "-min(event_id) over (partition by owner) - 1 as exit")
    step = q.selectExpr("owner", "point as src", "coalesce(one, exit) as dst", "cast(null as long) as null_of")
    jump = q.where("type = 'CHECK'").selectExpr("owner", "point as src", "coalesce(far, exit) as dst", "subject as null_of")
    edges = step.unionByName(jump)
    return edges, branches.materialize_points(q, edges)


def _reach(start: str, target: str, cut: str, first: str = "", skip: str = "") -> str:
    return _FLOW + f""", r AS (SELECT s.owner, s.subject, s.point AS start, e.dst AS node FROM p s JOIN e ON e.src = s.point WHERE s.type = '{start}'{first}
      UNION SELECT r.owner, r.subject, r.start, e.dst FROM r JOIN p c ON c.point = r.node JOIN e ON e.src = r.node WHERE NOT (c.type IN ({cut}) AND c.subject = r.subject){skip})
SELECT DISTINCT r.owner, r.subject, r.start, r.node AS target FROM r JOIN p t ON t.point = r.node WHERE t.type = '{target}'""" + ("" if target == "EXIT" else " AND t.subject = r.subject")


_SKIP = " AND e.null_of IS DISTINCT FROM {}.subject"


@_query(_reach("ALLOC", "EXIT", "'RELEASE'", _SKIP.format("s"), _SKIP.format("r")), ("points",))
def unreleased_resources(g: Facts) -> DataFrame:
    return branches.unreleased(*_flow(g))


@_query(_reach("CHECK", "DEREFERENCE", "'ALLOC', 'WRITE'", " AND e.null_of = s.subject"), ("points",))
def unchecked_dereferences(g: Facts) -> DataFrame:
    return branches.unchecked_dereferences(*_flow(g))


@_query(_reach("RELEASE", "DEREFERENCE", "'ALLOC', 'WRITE'"), ("points",))
def branch_use_after_release(g: Facts) -> DataFrame:
    return branches.use_after_release(*_flow(g))


@_query(_reach("RELEASE", "RELEASE", "'ALLOC', 'WRITE'"), ("points",))
def branch_double_release(g: Facts) -> DataFrame:
    return branches.double_release(*_flow(g))


@_query(_FLOW + "SELECT type, count(*) AS n FROM p GROUP BY type", ("points",))
def flow_points(g: Facts) -> DataFrame:
    return _flow(g)[1].groupBy("type").agg(F.count(F.lit(1)).alias("n"))


# Context of symbols, documents and shards

_IS_CROSS = "relation IN ('DESCRIBES', 'CONSTRAINS', 'IMPLEMENTED_BY', 'VERIFIED_BY', 'BELONGS_TO', 'DOCUMENTS')"


@_query("SELECT id, source_id, raw_anchor FROM doc_links WHERE status = 'ambiguous' AND anchor_type = 'symbol'", ("doc_links",))
def evidence_links(g: Facts) -> DataFrame:
    return lookup.where_equal(g.doc_links, ["source_id", "raw_anchor", "id"], source_id=None, target_id=None, status="ambiguous", anchor_type="symbol").select("id", "source_id", "raw_anchor")


@_query("SELECT DISTINCT source_id AS anchor, n.id, n.qualified_name FROM doc_links l JOIN nodes n ON target_id = n.id WHERE status = 'resolved' AND relation = 'IMPLEMENTED_BY'", ("nodes", "doc_links"))
def implemented_code(g: Facts) -> DataFrame:
    return context.linked(g.doc_links, g.nodes, ["IMPLEMENTED_BY"], False).select("anchor", "id", "qualified_name")


@_query("SELECT DISTINCT target_id AS anchor, d.id, d.qualified_name FROM doc_links l JOIN doc_nodes d ON source_id = d.id WHERE status = 'resolved' AND relation = 'IMPLEMENTED_BY' AND d.kind = 'Requirement'", ("doc_nodes", "doc_links"))
def requirements_of(g: Facts) -> DataFrame:
    return context.linked(g.doc_links, g.doc_nodes, ["IMPLEMENTED_BY"], True).where("kind = 'Requirement'").select("anchor", "id", "qualified_name")


@_query(f"SELECT DISTINCT source_id AS anchor, relation, n.id FROM doc_links l JOIN nodes n ON target_id = n.id WHERE status = 'resolved' AND {_IS_CROSS}", ("nodes", "doc_links"))
def document_targets(g: Facts) -> DataFrame:
    return context.linked(g.doc_links, g.nodes, context.CROSS, False).select("anchor", "relation", "id")


@_query("SELECT id, CASE WHEN lower(id) = q OR lower(name) = q OR lower(qualified_name) = q OR lower(path) = q THEN 0 ELSE 1 END AS rank FROM doc_nodes, (SELECT 'supplier#000000003' AS q) WHERE contains(lower(id || chr(0) || name || chr(0) || qualified_name || chr(0) || path), q) ORDER BY rank, qualified_name, id LIMIT 1", ("doc_nodes",))
def resolve_document(g: Facts) -> DataFrame:
    return context.resolve_document(g.doc_nodes, "Supplier#000000003").select("id", "rank")


_CODE = f"""WITH r AS (SELECT DISTINCT source_id AS document, 'resolved' AS role, relation, n.id, n.qualified_name AS name FROM doc_links l JOIN nodes n ON target_id = n.id WHERE status = 'resolved' AND {_IS_CROSS}
UNION SELECT source_id, 'candidate', 'CANDIDATE', id, raw_anchor FROM doc_links WHERE status <> 'resolved'),
k AS (SELECT *, row_number() OVER (PARTITION BY document, role ORDER BY name, id, relation) AS place, count(*) OVER (PARTITION BY document, role) AS total FROM r)
"""


@_query(_CODE + "SELECT document, role, relation, id, name, place, total FROM k WHERE place <= 12", ("nodes", "doc_links"))
def find_related_code(g: Facts) -> DataFrame:
    return context.related_code(g.doc_links, g.nodes)


@_query(f"""WITH r AS (SELECT source_id, count(*) AS links, count(DISTINCT shard) AS shards FROM doc_links JOIN nodes n ON target_id = n.id WHERE status = 'resolved' AND {_IS_CROSS} GROUP BY source_id),
c AS (SELECT source_id, count(*) AS candidates FROM doc_links WHERE status <> 'resolved' GROUP BY source_id)
SELECT d.id, coalesce(links, 0) AS links, coalesce(shards, 0) AS shards, coalesce(candidates, 0) AS candidates, coalesce(candidates, 0) > 0 OR coalesce(links, 0) = 0 AS uncertain FROM doc_nodes d LEFT JOIN r ON r.source_id = d.id LEFT JOIN c ON c.source_id = d.id""", ("nodes", "doc_nodes", "doc_links"))
def related_code_summary(g: Facts) -> DataFrame:
    return context.related_code_summary(g.doc_links, g.doc_nodes, g.nodes)


_TOLD = f"""WITH t AS (SELECT DISTINCT target_id AS symbol, d.id, d.qualified_name FROM doc_links JOIN doc_nodes d ON source_id = d.id WHERE status = 'resolved' AND {_IS_CROSS}),
td AS (SELECT symbol, id, qualified_name, row_number() OVER (PARTITION BY symbol ORDER BY qualified_name, id) AS place, count(*) OVER (PARTITION BY symbol) AS total FROM t)
"""


@_query(_TOLD + "SELECT * FROM td WHERE place <= 6", ("doc_nodes", "doc_links"))
def find_related_documents(g: Facts) -> DataFrame:
    return context.related_documents(g.doc_links, g.doc_nodes).select("symbol", "id", "qualified_name", "place", "total")


_NEAR = """a AS (SELECT dst_id AS symbol, 0 AS section, src_id AS id FROM edges WHERE type = 'CALLS' UNION SELECT src_id, 1, dst_id FROM edges WHERE type = 'CALLS' UNION SELECT dst_id, 2, src_id FROM edges WHERE type = 'REFERENCES'),
ad AS (SELECT a.symbol, section, a.id, row_number() OVER (PARTITION BY a.symbol ORDER BY section, n.qualified_name, a.id) AS place, count(*) OVER (PARTITION BY a.symbol) AS total FROM a JOIN nodes n ON n.id = a.id JOIN nodes s ON s.id = a.symbol)
"""


@_query(_TOLD + ", " + _NEAR + """SELECT id AS symbol, 'definition' AS section, id, 1 AS place, CAST(1 AS BIGINT) AS total FROM nodes UNION ALL SELECT id, 'shard', shard, 1, 1 FROM nodes
UNION ALL SELECT symbol, CASE section WHEN 0 THEN 'caller' WHEN 1 THEN 'callee' ELSE 'reference' END, id, place, total FROM ad WHERE place <= 12 UNION ALL SELECT symbol, 'document', id, place, total FROM td WHERE place <= 6""", ("nodes", "edges", "doc_nodes", "doc_links"))
def explain_symbol(g: Facts) -> DataFrame:
    k = _keyed(g)
    return context.explain_symbol(k.nodes, k.edges, k.doc_links, k.doc_nodes, text=keyed.node_text)


_MET = _BOUNDARY[:-2].replace("SELECT e.id,", "SELECT dst_id,") + ")"


@_query(_MET + f""", o AS (SELECT src_shard AS shard, count(DISTINCT dst_shard) AS outbound FROM b GROUP BY 1), i AS (SELECT dst_shard AS shard, count(DISTINCT src_shard) AS inbound, count(DISTINCT dst_id) AS public_symbols FROM b GROUP BY 1),
t AS (SELECT shard, count(DISTINCT source_id) AS documents FROM doc_links JOIN nodes n ON n.id = target_id WHERE status = 'resolved' AND {_IS_CROSS} GROUP BY 1), s AS (SELECT shard, count(*) AS symbols FROM nodes GROUP BY 1)
SELECT shard, symbols, coalesce(public_symbols, 0) AS public_symbols, coalesce(outbound, 0) AS outbound, coalesce(inbound, 0) AS inbound, coalesce(documents, 0) AS documents FROM s LEFT JOIN o USING (shard) LEFT JOIN i USING (shard) LEFT JOIN t USING (shard)""", ("nodes", "edges", "doc_links"))
def explain_module(g: Facts) -> DataFrame:
    return context.explain_module(g.nodes, neighbours.shard_edges(g.edges, g.nodes), g.doc_links)


@_query(_MET + """, k AS (SELECT shard, id, id IN (SELECT dst_id FROM b) AS public, row_number() OVER (PARTITION BY shard ORDER BY id IN (SELECT dst_id FROM b) DESC, qualified_name, id) AS place FROM nodes) SELECT * FROM k WHERE place <= 8""", ("nodes", "edges"))
def module_symbols(g: Facts) -> DataFrame:
    return context.module_symbols(g.nodes, neighbours.shard_edges(g.edges, g.nodes))


_UNSURE = "SELECT id, owner_id, start_line, CASE WHEN raw_name LIKE 'missing%' THEN 'unresolved' WHEN raw_name LIKE '%#%' THEN 'ambiguous' ELSE 'resolved' END AS status, raw_name FROM "


@_query("WITH " + _NEAR + f""", u AS ({_UNSURE}raw_references),
c AS (SELECT u.owner_id AS symbol, u.id AS reference, start_line, unnest(CASE WHEN status = 'ambiguous' THEN [raw_name, raw_name || '!'] ELSE [NULL] END) AS id FROM u WHERE status <> 'resolved'),
cd AS (SELECT symbol, reference, c.id, row_number() OVER (PARTITION BY symbol ORDER BY c.start_line, reference, c.id NULLS FIRST) AS place FROM c JOIN nodes n ON n.id = symbol),
m AS (SELECT id AS symbol, 0 AS o, 'primary' AS section, 1 AS place, 'symbol:' || id AS fact_id, id FROM nodes UNION ALL SELECT symbol, 0, 'primary', 2, 'symbol:' || id, id FROM ad WHERE place = 1
UNION ALL SELECT symbol, 1, 'relation', place, concat_ws(':', 'relation', CASE section WHEN 0 THEN 'caller' WHEN 1 THEN 'callee' ELSE 'reference' END, symbol, id), id FROM ad WHERE place <= 12
UNION ALL SELECT symbol, 2, 'candidate', place, CASE WHEN id IS NULL THEN 'unresolved:' || reference ELSE concat_ws(':', 'candidate', reference, id) END, id FROM cd WHERE place <= 6)
SELECT symbol, section, place, fact_id, id, (section = 'primary' AND place = 1) OR sum(strlen(CAST(to_json({{'section': section, 'fact_id': fact_id}}) AS VARCHAR))) OVER (PARTITION BY symbol ORDER BY o, place ROWS UNBOUNDED PRECEDING) <= 6000 AS kept FROM m""", ("nodes", "edges", "raw_references"))
def task_context(g: Facts) -> DataFrame:
    k = _keyed(g)
    unsure = g.spark.sql(_UNSURE + "{r}", r=k.raw_references)
    either = F.when(F.col("status") == "ambiguous", F.array("raw_name", F.concat("raw_name", F.lit("!"))))
    return context.task_context(k.nodes, k.edges, unsure.withColumn("candidates", either), text=keyed.node_text, reference_text=keyed.reference_text)


@_query("""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS l, CAST(1 + doc_id % 3 AS INT) AS a, CAST(1 + doc_id % 3 + doc_id % 30 AS INT) AS z FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, a AS start_line, least(z, len(l), a + 19) AS end_line, l[1:a - 1] AS head, l FROM t WHERE a <= len(l)),
c AS (SELECT doc_id, start_line, end_line, CASE WHEN start_line > 1 THEN strlen(array_to_string(head, chr(10))) + 1 ELSE 0 END AS start_byte, array_to_string(l[start_line:end_line], chr(10)) AS content FROM s)
SELECT doc_id, start_line, end_line, start_byte, start_byte + strlen(content) AS end_byte, content FROM c""")
def source_spans(g: Facts) -> DataFrame:
    docs = g.table("documents")
    found = context.span(F.col("text"), 1 + F.col("doc_id") % 3, 1 + F.col("doc_id") % 3 + F.col("doc_id") % 30)
    return docs.select("doc_id", found.alias("s")).where("s IS NOT NULL").select("doc_id", "s.*")


def _evidence(prefix: str, kind: str, source: str, relation: str, target: str, rows: str) -> str:
    digest = f"sha256(CAST(to_json(['r', '{kind}', {source}, {relation}, {target}, id]) AS VARCHAR))[1:24]"
    return f"SELECT 'E-{prefix}-' || {digest} AS evidence_id, id AS fact, {source} AS source, {relation} AS relation, {target} AS target FROM {rows}"


_EVIDENCE = "WITH f AS (" + " UNION ALL ".join([
    _evidence("CODE", "CODE_DEFINITION", "coalesce(file, id)", "'DEFINES'", "id", "nodes"),
    _evidence("DOC", "DOCUMENT_SECTION", "id", "'DOCUMENTS'", "id", "doc_nodes"),
    _evidence("CALL", "CALL_RELATION", "src_id", "type", "dst_id", "edges WHERE type = 'CALLS'"),
    _evidence("REF", "REFERENCE", "src_id", "type", "dst_id", "edges WHERE type = 'REFERENCES'"),
    _evidence("DEP", "DEPENDENCY", "src_id", "type", "dst_id", "edges WHERE type NOT IN ('CALLS', 'REFERENCES')"),
    _evidence("XLINK", "CROSS_LAYER_LINK", "source_id", "CASE status WHEN 'resolved' THEN 'DOCUMENTS' ELSE 'CANDIDATE' END", "coalesce(target_id, 'raw:' || raw_anchor)", "doc_links"),
]) + ")"


@_query(_EVIDENCE + """, q AS (SELECT DISTINCT evidence_id FROM f UNION SELECT 'E-CODE-' || sha256(CAST(r_regionkey AS STRING))[1:24] FROM region)
SELECT q.evidence_id, fact, source, relation, target, fact IS NOT NULL AS found FROM q LEFT JOIN f USING (evidence_id)""", ("nodes", "edges", "doc_nodes", "doc_links"))
def trace_evidence(g: Facts) -> DataFrame:
    k = _keyed(g)
    columns = context.evidence_columns("r", keyed.node_text, keyed.edge_text, keyed.link_text)
    facts = context.evidence_rows(k.nodes, k.doc_nodes, k.edges, k.doc_links).select(columns[0], "*")
    unknown = g.table("region").select(F.concat(F.lit("E-CODE-"), F.substring(F.sha2(F.col("r_regionkey").cast("string"), 256), 1, 24)).alias("evidence_id"))
    return context.trace_evidence(facts.select("evidence_id").unionByName(unknown), facts, columns)


# Integrity of stored facts


_TREE = "SELECT shard AS scope, id, CASE WHEN start_line % 7 > 0 THEN 'x' || CAST(start_line AS STRING) WHEN start_line % 2 > 0 THEN id END AS parent FROM "


@_query(f"""WITH t AS ({_TREE}nodes), r AS (SELECT scope, count(*) FILTER (WHERE parent IS NULL) AS roots FROM t GROUP BY scope)
SELECT scope, 'root_missing' AS problem, CAST(1 AS BIGINT) AS n FROM r WHERE roots = 0 UNION ALL SELECT scope, 'multiple_roots', roots FROM r WHERE roots > 1
UNION ALL SELECT scope, 'parent_missing', count(*) FROM t WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t p WHERE p.scope = t.scope AND p.id = t.parent) GROUP BY scope""", ("nodes",))
def tree_integrity(g: Facts) -> DataFrame:
    return integrity.tree(g.spark.sql(_TREE + "{n}", n=g.nodes))


_CONTROL = ("SELECT owner AS scope, event_id AS id, CASE WHEN type = 'CHECK' AND subject = 3 THEN NULL ELSE owner END AS owner, CASE WHEN position = 1 THEN 'entry' WHEN type = 'RELEASE' AND subject = 1 THEN 'exit' ELSE 'node' END AS kind FROM ",
            "SELECT owner AS scope, event_id AS src, CASE WHEN subject = 2 THEN -event_id ELSE event_id END AS dst, CASE WHEN subject = 5 THEN 'other' ELSE owner END AS owner FROM ")


@_query(f"""WITH n AS ({_CONTROL[0]}points), e AS ({_CONTROL[1]}points), o AS (SELECT scope, owner, count(*) FILTER (WHERE kind = 'entry') AS a, count(*) FILTER (WHERE kind = 'exit') AS z FROM n WHERE owner IS NOT NULL GROUP BY ALL),
p AS (SELECT scope, 'node_missing_owner' AS problem FROM n WHERE owner IS NULL UNION ALL SELECT scope, 'entry_missing' FROM o WHERE a <> 1 UNION ALL SELECT scope, 'exit_missing' FROM o WHERE z <> 1
UNION ALL SELECT scope, 'edge_endpoint_missing' FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.scope = e.scope AND n.id = e.dst)
UNION ALL SELECT e.scope, 'edge_owner_mismatch' FROM e JOIN n ON n.scope = e.scope AND n.id = e.src WHERE n.owner IS DISTINCT FROM e.owner) SELECT scope, problem, count(*) AS n FROM p GROUP BY ALL""", ("points",))
def control_flow_integrity(g: Facts) -> DataFrame:
    return integrity.control_flow(g.spark.sql(_CONTROL[0] + "{p}", p=g.points), g.spark.sql(_CONTROL[1] + "{p}", p=g.points))


_EVENTS = "SELECT owner AS scope, CASE WHEN subject = 4 THEN 'event:' || owner ELSE CASE WHEN subject = 6 THEN 'point:' ELSE 'event:' END || CAST(event_id AS STRING) END AS id, CASE WHEN subject = 7 THEN '' ELSE owner END AS owner, type AS kind, CASE WHEN subject = 8 THEN 'level1' ELSE 'level0' END AS level FROM "


@_query(f"""WITH n AS ({_EVENTS}points), p AS (SELECT scope, 'duplicate_event_ids' AS problem FROM n GROUP BY scope, id HAVING count(*) > 1 UNION ALL SELECT scope, 'event_id_prefix_missing' FROM n WHERE id NOT LIKE 'event:%'
UNION ALL SELECT scope, 'unknown_event_type' FROM n WHERE kind NOT IN ('ALLOC', 'RELEASE', 'DEREFERENCE', 'WRITE') UNION ALL SELECT scope, 'event_owner_missing' FROM n WHERE owner = '' UNION ALL SELECT scope, 'event_level_missing' FROM n WHERE level <> 'level0')
SELECT scope, problem, count(*) AS n FROM p GROUP BY ALL""", ("points",))
def events_integrity(g: Facts) -> DataFrame:
    return integrity.events(g.spark.sql(_EVENTS + "{p}", p=g.points), ["ALLOC", "RELEASE", "DEREFERENCE", "WRITE"], "level0")


_SPARSE = "SELECT owner AS scope, CASE WHEN subject = 1 THEN 'cfg-exit:a' ELSE 'event:' || CAST(event_id AS STRING) END AS src, CASE WHEN subject = 2 THEN 'event:gone' WHEN subject = 3 THEN 'cfg-exit:b' ELSE 'event:' || CAST(event_id AS STRING) END AS dst, CASE WHEN type = 'CHECK' THEN 'DATA_FLOW_TO' ELSE 'CONTROL_REACHES' END AS kind, CAST(event_id - event_id % 2 AS STRING) AS id FROM "


@_query(f"""WITH e AS ({_SPARSE}points), n AS (SELECT owner AS scope, 'event:' || CAST(event_id AS STRING) AS id FROM points),
p AS (SELECT scope, 'unknown_sparse_relation' AS problem FROM e WHERE kind <> 'CONTROL_REACHES' UNION ALL SELECT scope, 'sparse_edge_endpoint_missing' FROM e WHERE (scope, src) NOT IN (SELECT scope, id FROM n)
UNION ALL SELECT scope, 'sparse_edge_endpoint_missing' FROM e WHERE dst NOT LIKE 'cfg-exit:%' AND (scope, dst) NOT IN (SELECT scope, id FROM n)) SELECT scope, problem, count(*) AS n FROM p GROUP BY ALL""", ("points",))
def sparse_flow_integrity(g: Facts) -> DataFrame:
    points = g.points
    return integrity.sparse_flow(points.selectExpr("owner AS scope", "'event:' || CAST(event_id AS STRING) AS id"), g.spark.sql(_SPARSE + "{p}", p=points))


@_query(f"""WITH e AS ({_SPARSE}points), p AS (SELECT scope, 'duplicate_dfg_edge_ids' AS problem FROM e GROUP BY scope, id HAVING count(*) > 1 UNION ALL SELECT scope, 'unknown_dfg_relation' FROM e WHERE kind <> 'DATA_FLOW_TO'
UNION ALL SELECT scope, 'dfg_endpoint_missing' FROM e WHERE src NOT LIKE 'event:%') SELECT scope, problem, count(*) AS n FROM p GROUP BY ALL""", ("points",))
def data_flow_integrity(g: Facts) -> DataFrame:
    return integrity.data_flow(g.spark.sql(_SPARSE + "{p}", p=g.points))


@_query("""WITH r AS (SELECT n_name AS analyzer, CAST(n_regionkey AS STRING) AS contract FROM nation WHERE n_nationkey % 5 > 0),
b AS (SELECT c_custkey AS analysis, n_name AS analyzer, CAST(c_custkey % 3 AS STRING) AS contract FROM customer JOIN nation ON n_nationkey = c_nationkey OR n_nationkey = (c_nationkey + 1) % 25),
x AS (SELECT analysis, analyzer, CASE WHEN r.analyzer IS NULL THEN 'dependency_unregistered:' ELSE 'dependency_changed:' END || b.analyzer AS reason FROM b LEFT JOIN r USING (analyzer) WHERE r.analyzer IS NULL OR r.contract <> b.contract)
SELECT analysis, min_by(reason, analyzer) AS reason FROM x GROUP BY analysis""")
def dependency_staleness(g: Facts) -> DataFrame:
    nation, customer = g.table("nation"), g.table("customer")
    registry = nation.where("n_nationkey % 5 > 0").selectExpr("n_name AS analyzer", "CAST(n_regionkey AS STRING) AS contract")
    built = customer.selectExpr("c_custkey AS analysis", "explode(array(c_nationkey, (c_nationkey + 1) % 25)) AS n_nationkey", "CAST(c_custkey % 3 AS STRING) AS contract").join(nation, "n_nationkey")
    return integrity.staleness(built.select("analysis", F.col("n_name").alias("analyzer"), "contract"), registry)


@_query("SELECT id FROM raw_references WHERE raw_name IN (SELECT qualified_name FROM nodes WHERE kind = 'Function' AND definition UNION SELECT list_last(string_split(qualified_name, '.')) FROM nodes WHERE kind = 'Function' AND definition)", ("nodes", "raw_references"))
def references_for_names(g: Facts) -> DataFrame:
    return integrity.references_for_names(g.raw_references, g.nodes.where("kind = 'Function' AND definition").select(F.col("qualified_name").alias("name")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
