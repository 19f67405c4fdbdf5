"""References in three tables: what they resolve to, and what that leaves on disk."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from factloom.operators import neighbours, resolve
from factloom.plans import catalog
from factloom.sources import keyed
from factloom.sources.facts import Facts
from tests.test_disk import _written
from tests.test_resolve_counts import SYMBOLS

NAMES = "name_id long, raw_name string, target_module string, call_kind string, type_use boolean, receiver_unsafe boolean"


def _made(spark, files):
    rng = random.Random(11)
    pick = rng.choice
    symbols = [(f"s{k}", pick("abc"), pick(["m.a", "m.b", "a", "n.a", "q"]), pick("xy"), pick(["", "i", None]), rng.random() < 0.4, pick(["Function", "Class"])) for k in range(14)]
    symbols += symbols[:2] + [("s20", "u", "m.u", "x", "", True, "Function"), ("s21", "u", "m.w", "y", "", True, "Class")]
    names = [(k, pick(["a", "b", "c", ".m.a.", "n.a", "zz", "m.c", "q", "u", "m.u", "", None]), pick(["m", "n", None]), pick(["direct", "direct", "direct", "indirect", None]), pick([True, False, None]), pick([True, False, False])) for k in range(90)]
    names += [names[3], (None, "a", None, "direct", False, False)]  # a name that stands twice gives each reference twice
    owners = [(o, pick(files)) for o in ["o", "p", "s1", "s2", "s5", "s9", "s20", "s21"]] + [("p", files[0]), (None, files[0])]
    calls = [(pick(["o", "p", "s1", "s2", "s5", "s9", "s20", "s21", "gone", None]), rng.randrange(92) if rng.random() < 0.97 else None, k) for k in range(900)]
    frame = spark.createDataFrame
    return frame(calls, "owner_id string, name_id long, place long"), frame(names, NAMES), frame(owners, "owner_id string, file string"), frame(symbols, SYMBOLS)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("files", [["x", "y", "z", None], ["z", None]], ids=["files of symbols", "other files"])
@pytest.mark.parametrize("most", [50_000, 0], ids=["broadcast", "by shuffle"])
def test_three_tables_resolve_as_their_rows_do(spark, monkeypatch, files, most):
    calls, names, owners, symbols = _made(spark, files)
    nodes = symbols.select("id", F.concat(F.lit("of "), "file").alias("shard")).distinct()
    nodes = nodes.unionByName(nodes.where("id = 's21'"))
    rows = calls.join(names, "name_id").join(owners, "owner_id")
    columns = ["owner_id", "name_id", "place", "call_kind", "strategy", "resolved_id", "status"]
    lists = resolve.resolve(rows, symbols)
    want, bound = _rows(lists.select(columns)), _rows(neighbours.boundary_references(lists, nodes).select("place", "resolved_id", "owner_shard", "target_shard"))
    assert {w[-1] for w in want} == {"resolved", "ambiguous", "unresolved"} and len({w[4] for w in want}) == (5 if "x" in files else 4) and bound
    monkeypatch.setattr(resolve, "BROADCAST_ANSWERS", most)
    assert _rows(resolve.resolve_named(calls, names, owners, symbols).select(columns)) == want
    assert _rows(resolve.resolve_named(calls, names, owners, symbols, resolved_only=True).select(columns)) == [w for w in want if w[-1] == "resolved"]
    targets = nodes.select(F.col("id").alias("resolved_id"), F.col("shard").alias("target_shard"))
    named = resolve.resolve_named(calls, names, owners, symbols, targets, resolved_only=True)
    assert _rows(neighbours.boundary_references(named, nodes).select("place", "resolved_id", "owner_shard", "target_shard")) == bound
    # without the flags
    plain = names.drop("type_use", "receiver_unsafe")
    want = _rows(resolve.resolve(rows.drop("type_use", "receiver_unsafe"), symbols).select(columns))
    assert _rows(resolve.resolve_named(calls, plain, owners, symbols).select(columns)) == want


def test_the_three_tables_hold_the_references(spark, tmp_path):
    folder = shutil.copytree("/root/testdata/sf0.001", tmp_path / "tables")
    for name, key, odd in (("orders", "o_orderkey", "null"), ("lineitem", "l_orderkey", "null"), ("lineitem", "l_suppkey", "null"), ("part", "p_partkey", "-26"), ("lineitem", "l_partkey", "-26")):
        path = folder / f"{name}.parquet"
        rows = spark.read.parquet(str(path))
        rows.unionByName(rows.limit(3).withColumn(key, F.expr(f"cast({odd} as bigint)"))).write.parquet(str(tmp_path / key))
        shutil.rmtree(path) if path.is_dir() else (path.chmod(0o644), path.unlink())
        shutil.copytree(tmp_path / key, path)
    k = keyed.KeyedFacts(spark, str(folder))
    columns = ["id", "owner_id", "raw_name", "call_kind", "target_module", "file"]
    whole = Facts(spark, str(folder)).raw_references.select(columns)
    parts = k.calls.join(k.call_names, "name_id").join(k.call_owners, "owner_id")
    parts = parts.select(keyed.call_text("owner_id", "name_id", "place").alias("id"), keyed.node_text("owner_id").alias("owner_id"), *columns[2:])
    assert whole.count() == parts.count() and whole.exceptAll(parts).isEmpty()


#: MB on sf0.01 that each query may write; a reference that carries texts or its digest wrote more.
@pytest.mark.parametrize(("name", "most"), [("boundary_references", 1.2), ("call_semantics", 1.2)])
def test_references_move_by_keys(spark, name, most, tmp_path):
    folder = shutil.copytree("/root/testdata/sf0.01", tmp_path / "tables")
    from factloom import scratch

    path = scratch.folder(spark)
    before = _written(spark, path)
    catalog.queries()[name](spark, str(folder)).write.format("noop").mode("overwrite").save()
    assert (_written(spark, path) - before) / 1e6 < most
