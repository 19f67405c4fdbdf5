"""What queries over wide joins leave on disk, and the short keys that keep it small."""

import shutil

import pytest
from pyspark.sql import functions as F

from factloom.operators import context
from factloom.plans import catalog
from factloom.sources import keyed
from factloom.sources.facts import Facts

SMALL = "/root/testdata/sf0.001"


def _written(spark, path):
    """Bytes that tasks have written so far, to shuffle files and below ``path``."""
    jvm = spark._jvm.org.apache.hadoop.fs
    there = jvm.Path(path)
    system = there.getFileSystem(spark._jsc.hadoopConfiguration())
    stored = system.getContentSummary(there).getLength() if system.exists(there) else 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return stored + sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


#: MB on sf0.001 that each query may write; with texts for ids each wrote more.
@pytest.mark.parametrize(("name", "most"), [("explain_symbol", 1.0), ("task_context", 1.6), ("impact_frontier", 0.5), ("trace_evidence", 1.1), ("resolve_references", 0.7), ("boundary_references", 0.7), ("call_semantics", 0.8)])
def test_a_query_writes_little(spark, name, most, tmp_path):
    """A folder of its own, so that nothing that another query stored is used."""
    folder = shutil.copytree(SMALL, tmp_path / "tables")
    from factloom import scratch

    path = scratch.folder(spark)
    before = _written(spark, path)
    catalog.queries()[name](spark, str(folder)).write.format("noop").mode("overwrite").save()
    assert (_written(spark, path) - before) / 1e6 < most


def test_keys_stand_for_the_texts_of_ids(spark, tmp_path):
    folder = shutil.copytree(SMALL, tmp_path / "tables")
    # a row without a number keeps its id, and one with a negative number
    odd = spark.read.parquet(f"{SMALL}/part.parquet").limit(2).withColumn("p_partkey", F.when(F.monotonically_increasing_id() == 0, F.lit(-7)).cast("long"))
    spark.read.parquet(f"{SMALL}/part.parquet").unionByName(odd).write.parquet(str(tmp_path / "part"))
    (folder / "part.parquet").chmod(0o644)
    (folder / "part.parquet").unlink()
    shutil.copytree(tmp_path / "part", folder / "part.parquet")
    a, b = Facts(spark, str(folder)), keyed.KeyedFacts(spark, str(folder))
    edges, links = b.edges, b.doc_links
    pairs = [
        (a.nodes, b.nodes.withColumn("id", keyed.node_text("id"))),
        (a.doc_nodes, b.doc_nodes.withColumn("id", keyed.node_text("id"))),
        (a.edges, edges.select(keyed.edge_text(edges["src_id"], edges["dst_id"], edges["type"], edges["id"]).alias("id"), keyed.node_text("src_id").alias("src_id"), keyed.node_text("dst_id").alias("dst_id"), "type")),
        (a.doc_links, links.withColumn("id", keyed.link_text(links["id"])).withColumn("source_id", keyed.node_text("source_id")).withColumn("target_id", keyed.node_text("target_id"))),
        (a.raw_references, b.raw_references.withColumn("id", keyed.reference_text("id")).withColumn("owner_id", keyed.node_text("owner_id"))),
    ]
    for texts, keys in pairs:
        assert texts.count() == keys.count() and texts.exceptAll(keys).isEmpty()


def test_neighbours_come_by_name_then_by_text_of_the_key(spark):
    nodes = spark.createDataFrame([(k, "same" if k else "z") for k in range(8)], "id long, qualified_name string").withColumn("shard", F.lit("s"))
    nodes = nodes.unionByName(nodes.where("id = 0"))  # a symbol that stands twice has every row twice
    edges = spark.createDataFrame([(k, 0, "CALLS") for k in range(1, 8)] * 2, "src_id long, dst_id long, type string")
    links = spark.createDataFrame([], "id long, source_id long, raw_anchor string, status string, target_id long, relation string")
    text = lambda c: F.concat(F.lit("n"), (9 - F.col(c)).cast("string"))  # noqa: E731  # the texts go the other way
    rows = context.explain_symbol(nodes, edges, links, nodes.limit(0), max_edges=5, text=text).where("section = 'caller'").collect()
    assert sorted((r.place, r.id, r.total) for r in rows) == [(1, "n2", 14), (2, "n2", 14), (3, "n3", 14), (4, "n3", 14), (5, "n4", 14)]


def test_packed_evidence_ids_come_back(spark):
    ids = ["E-CALL-" + "0a" * 12, "E-XLINK-" + "ff" * 12, "E-CALL-" + "0A" * 12, "E-CALL-" + "0a" * 12 + "\n", "E-call-" + "0a" * 12, "", "other", "E-DOC-0a"]
    rows = spark.createDataFrame([(i,) for i in ids], "evidence_id string").withColumn("p", context.packed("evidence_id")).withColumn("back", context.unpacked("p")).collect()
    assert [r.back for r in rows] == ids and len({bytes(r.p) for r in rows}) == len(ids) and len(rows[0].p) == 16
    facts = spark.createDataFrame([(ids[0], "f")], "evidence_id string, fact string")
    got = context.trace_evidence(spark.createDataFrame([(i,) for i in ids], "evidence_id string"), facts).collect()
    assert {r.evidence_id: (r.fact, r.found) for r in got} == {i: ("f", True) if i == ids[0] else (None, False) for i in ids}
