"""Graph facts made from relational tables; the same SELECT runs on Spark and on any SQL engine with SHA-256."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom import scratch

TABLES = "region nation customer supplier part orders lineitem events documents labels conversations benchmark".split()


def _id(sha: Callable[[str], str], prefix: str, *parts: str) -> str:
    return f"'{prefix}:' || " + sha("concat_ws(chr(31), " + ", ".join(f"CAST({p} AS STRING)" for p in parts) + ")")


def called(key: str) -> str:
    """What a reference to a part says, as columns; ``key`` names the part's number."""
    return (
        f"CASE WHEN {key} % 11 = 0 THEN 'missing' || CAST({key} AS STRING) WHEN {key} % 7 = 0 THEN p_brand || '.' || p_name || '#' || CAST(p_partkey AS STRING) ELSE p_name END AS raw_name, "
        f"CASE WHEN {key} % 13 = 0 THEN 'indirect' ELSE 'direct' END AS call_kind, CASE WHEN {key} % 5 = 0 THEN p_brand END AS target_module"
    )


def statements(sha: Callable[[str], str], made: Callable[..., str] = _id) -> dict[str, str]:
    """SELECT of each fact table by name. Later ones may name earlier ones. ``made`` writes the ids."""
    node = lambda kind, key: made(sha, "node", f"'{kind}'", key)
    nodes = " UNION ALL ".join(
        [
            f"SELECT {node('Namespace', 'r_regionkey')} AS id, 'Namespace' AS kind, r_name AS name, r_name AS qualified_name, r_name AS shard, 'geo' AS file, CAST(r_regionkey AS INT) AS start_line, '' AS signature, true AS definition FROM region",
            f"SELECT {node('Class', 'n_nationkey')}, 'Class', n_name, r_name || '.' || n_name, r_name, 'geo', CAST(n_nationkey AS INT), '', true FROM nation JOIN region ON n_regionkey = r_regionkey",
            f"SELECT {node('Struct', 'c_custkey')}, 'Struct', c_name, r_name || '.' || n_name || '.' || c_name, n_name, n_name, CAST(c_custkey % 1000 AS INT), c_mktsegment, true FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
            f"SELECT {node('Interface', 's_suppkey')}, 'Interface', s_name, r_name || '.' || n_name || '.' || s_name, n_name, n_name, CAST(s_suppkey % 1000 AS INT), '', true FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
            f"SELECT {node('Function', 'p_partkey')}, 'Function', p_name, p_brand || '.' || p_name, p_brand, p_brand, CAST(p_partkey % 1000 AS INT), p_type, p_size % 3 = 0 FROM part",
            f"SELECT {node('Method', 'o_orderkey')}, 'Method', 'order' || CAST(o_orderkey AS STRING), c_name || '.order' || CAST(o_orderkey AS STRING), n_name, n_name, CAST(o_orderkey % 1000 AS INT), o_orderpriority, true FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
        ]
    )
    edge = lambda src, dst, kind, extra="''": f"{made(sha, 'edge', src, dst, repr(kind), extra)} AS id, {src} AS src_id, {dst} AS dst_id, '{kind}' AS type"
    edges = " UNION ALL ".join(
        [
            f"SELECT {edge(node('Namespace', 'n_regionkey'), node('Class', 'n_nationkey'), 'CONTAINS')} FROM nation",
            f"SELECT {edge(node('Class', 'c_nationkey'), node('Struct', 'c_custkey'), 'CONTAINS')} FROM customer",
            f"SELECT {edge(node('Class', 's_nationkey'), node('Interface', 's_suppkey'), 'CONTAINS')} FROM supplier",
            f"SELECT {edge(node('Method', 'o_orderkey'), node('Struct', 'o_custkey'), 'REFERENCES')} FROM orders",
            f"SELECT {edge(node('Method', 'l_orderkey'), node('Function', 'l_partkey'), 'CALLS', 'l_suppkey')} FROM lineitem",
        ]
    )
    raw = (
        f"SELECT {made(sha, 'reference', 'l_orderkey', 'l_partkey', 'l_suppkey')} AS id, {node('Method', 'l_orderkey')} AS owner_id, "
        f"{called('l_partkey')}, "
        "CAST(l_linenumber AS INT) AS start_line, n_name AS file "
        "FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
    )
    points = (
        "SELECT event_id, CAST(user_id AS STRING) AS owner, CASE event_type WHEN 'signup' THEN 'ALLOC' WHEN 'purchase' THEN 'RELEASE' WHEN 'view' THEN 'DEREFERENCE' WHEN 'click' THEN 'WRITE' ELSE 'CHECK' END AS type, "
        "CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 10 AS subject, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events"
    )
    locks = (
        "SELECT event_id, owner, CASE WHEN type IN ('ALLOC', 'WRITE') THEN 'LOCK' WHEN type IN ('RELEASE', 'CHECK') THEN 'UNLOCK' ELSE 'ACCESS' END AS type, CAST(subject % 4 AS INT) AS lock, subject, position FROM points"
    )
    overlay = (
        "SELECT CAST(o_orderkey AS STRING) AS entity_id, CASE o_orderkey % 10 WHEN 1 THEN 'DELETE' WHEN 2 THEN 'UPDATE' ELSE 'ADD' END AS operation, "
        "CASE o_orderkey % 10 WHEN 1 THEN NULL WHEN 2 THEN 'U' ELSE 'N' END AS status FROM orders WHERE o_orderkey % 10 IN (1, 2) "
        "UNION ALL SELECT 'new' || CAST(o_orderkey AS STRING), 'ADD', 'N' FROM orders WHERE o_orderkey % 50 = 3"
    )
    doc_nodes = (
        f"SELECT {node('Document', 's_suppkey')} AS id, CASE s_suppkey % 4 WHEN 0 THEN 'Requirement' WHEN 1 THEN 'DocumentSection' WHEN 2 THEN 'Spec' ELSE 'Document' END AS kind, "
        "s_name AS name, 'docs/' || s_name AS qualified_name, 'docs/' || s_name || '.md' AS path FROM supplier"
    )
    doc_links = (
        f"SELECT {made(sha, 'link', 'l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey')} AS id, {node('Document', 'l_suppkey')} AS source_id, 'part' || CAST(l_partkey AS STRING) AS raw_anchor, 'symbol' AS anchor_type, "
        f"CASE l_partkey % 8 WHEN 0 THEN 'ambiguous' WHEN 1 THEN 'unresolved' ELSE 'resolved' END AS status, CASE WHEN l_partkey % 8 > 1 THEN {node('Function', 'l_partkey')} END AS target_id, "
        "CASE l_orderkey % 7 WHEN 0 THEN 'DESCRIBES' WHEN 1 THEN 'CONSTRAINS' WHEN 2 THEN 'IMPLEMENTED_BY' WHEN 3 THEN 'VERIFIED_BY' WHEN 4 THEN 'BELONGS_TO' WHEN 5 THEN 'DOCUMENTS' ELSE 'MENTIONS' END AS relation FROM lineitem"
    )
    return {"nodes": nodes, "edges": edges, "raw_references": raw, "points": points, "locks": locks, "overlay": overlay, "doc_nodes": doc_nodes, "doc_links": doc_links}


def duckdb_with(*names: str) -> str:
    """A WITH clause of the named fact tables, for the SQL that checks a query."""
    made = statements(lambda e: f"sha256({e})")
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({made[n]})" for n in names)


_SHA: Callable[[str], str] = lambda e: f"sha2({e}, 256)"

#: Fact tables that are written once and then read by all queries, and the column that their files are split by.
STORED = {"nodes": "kind", "edges": "type", "raw_references": "call_kind"}
_PLACES: dict[tuple, str] = {}


def _state(spark: SparkSession, folder: str) -> tuple:
    """Name, size and time of every file of the tables below ``folder``, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


class Facts:
    """Fact tables of one folder of Parquet tables, as DataFrames; columns that a query doesn't use are never read.

    Nodes, edges and references are made once for a session and stored in the shared folder, split by kind, so that a
    lookup reads the files of its kinds only; they are made anew when a file below the folder has changed.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.folder = spark, sf_dir
        self._sql = statements(_SHA)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _made(self, name: str) -> DataFrame:
        import re

        text = self._sql[name]
        used = {t for t in (*TABLES, *self._sql) if re.search(rf"(?:FROM|JOIN) {t}\b", text)}
        frames = {t: (self.table(t) if t in TABLES else getattr(self, t)) for t in used}
        for t in used:
            text = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
        return self.spark.sql(text, **frames)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._sql:
            raise AttributeError(name)
        if name not in STORED:
            return self._made(name)
        rows = self._made(name)
        key = (self.spark.sparkContext.applicationId, scratch.folder(self.spark), _state(self.spark, self.folder), name)
        if key not in _PLACES:
            path = scratch.new_path(self.spark, name)
            rows.write.partitionBy(STORED[name]).parquet(path)
            _PLACES[key] = path
        return self.spark.read.schema(rows.schema).parquet(_PLACES[key]).select(rows.columns)
