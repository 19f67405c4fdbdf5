"""Engine operators against SQL on the smoke tables, and rules that SQL doesn't cover on small fixtures."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from factloom.functions import ids
from factloom.operators import dataflow, defects, governance, overlay, traversal
from factloom.plans import catalog
from factloom.sources import repository, store
from factloom.streaming import increments

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(catalog.oracle_sql()[name]).select(", ".join(columns)).fetchall()
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want))


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_ids_do_not_shift_over_nulls(spark):
    row = spark.range(1).select(ids.stable("x", F.lit(None), F.lit("a")).alias("a"), ids.stable("x", F.lit("a"), F.lit(None)).alias("b"), ids.edge_id(F.lit("s"), F.lit("d"), F.lit("t")).alias("e")).first()
    assert row.a != row.b and row.e.startswith("edge:")


def test_names(spark):
    row = spark.range(1).select(ids.module_name(F.lit("a/b/__init__.py")).alias("m"), ids.directory_shard(F.lit("a/b/c/d.py")).alias("s"), ids.directory_shard(F.lit("d.py")).alias("r"), ids.citations(F.lit("see E-EDGE-0123456789abcdef01234567.")).alias("c")).first()
    assert (row.m, row.s, row.r, row.c) == ("a.b", "a/b", ".", ["E-EDGE-0123456789abcdef01234567"])


def test_overlay_round_trip(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "entity_id string, v int")
    target = spark.createDataFrame([("a", 1), ("b", 5), ("d", 4)], "entity_id string, v int")
    deltas = overlay.capture(base, target, "entity_id", ["entity_id", "v"]).join(target, "entity_id", "left")
    assert overlay.parity(overlay.read(base, deltas), target).count() == 0
    assert {(r.entity_id, r.operation) for r in deltas.collect()} == {("b", "UPDATE"), ("c", "DELETE"), ("d", "ADD")}


def test_upsert_keeps_the_last_and_rejects_tombstones_with_values(spark):
    rows = [("n", "1", "ADD", "x", 1), ("n", "1", "UPDATE", "y", 2), ("n", "2", "DELETE", None, 1)]
    schema = "entity_type string, entity_id string, operation string, new_value string, seq int"
    got = overlay.upsert(spark.createDataFrame(rows, schema), "seq")
    assert sorted((r.entity_id, r.new_value) for r in got.collect()) == [("1", "y"), ("2", None)]
    with pytest.raises(Exception, match="a tombstone holds a value"):
        overlay.upsert(spark.createDataFrame([*rows, ("n", "3", "DELETE", "z", 1)], schema), "seq").collect()


def _paths(edges, starts, targets, blocked, hops, most):
    queue, found = [[s] for s in sorted(starts)], []
    while queue and len(found) < most:
        p = queue.pop(0)
        if len(p) > 1 and p[-1] in targets:
            found.append(p)
            if len(found) >= most:
                break
        if len(p) - 1 < hops:
            queue += [[*p, b] for a, b in sorted(edges) if a == p[-1] and b not in p and b not in blocked]
    return sorted(found, key=lambda p: (len(p), p))


def test_find_paths_equals_brute_force(spark):
    r = random.Random(4)
    edges, marks, want = [], [], {}
    for owner in "abcdef":
        e = {(r.randint(0, 9), r.randint(0, 9)) for _ in range(18)}
        roles = {k: (r.random() < 0.3, r.random() < 0.4, r.random() < 0.2) for k in range(10)}
        edges += [(owner, *x) for x in e]
        marks += [(owner, k, *v) for k, v in roles.items()]
        want[owner] = _paths(e, [k for k in roles if roles[k][0]], {k for k in roles if roles[k][1]}, {k for k in roles if roles[k][2]}, 6, 8)
    got = traversal.find_paths(spark.createDataFrame(edges, "owner string, src long, dst long"), spark.createDataFrame(marks, "owner string, point long, is_start boolean, is_target boolean, is_blocked boolean"), 6, 8)
    found = {}
    for row in got.collect():
        found.setdefault(row.owner, []).append([int(x) for x in row.path.split(">")])
    assert {k: sorted(v, key=lambda p: (len(p), p)) for k, v in found.items()} == {k: v for k, v in want.items() if v}


def test_reachability_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    got = traversal.reachable(edges, spark.createDataFrame([(1,), (4,)], "start long"))
    assert {(r.start, r.node) for r in got.collect()} == {(1, 2), (1, 3), (1, 1), (4, 5)}


def test_plan():
    assert governance.closure(["defects"])[0] == "foundation"
    assert governance.plan(["cfg"], "python", {"foundation": True, "ast": False}) == [("foundation", "reuse", "fresh"), ("ast", "build", "stale"), ("cfg", "build", "not_built")]
    assert {d for _, d, _ in governance.plan(["cfg"], "cobol", {})} == {"skip"}
    with pytest.raises(KeyError):
        governance.closure(["unknown"])


def test_integrity(spark):
    nodes = spark.createDataFrame([("f", "1", "entry"), ("f", "2", "exit"), ("g", "3", "entry")], "owner string, id string, kind string")
    edges = spark.createDataFrame([("f", "1", "2"), ("f", "1", "9")], "owner string, src string, dst string")
    assert {(r.owner, r.exits, r.outside) for r in governance.owner_integrity(nodes, edges).collect()} == {("f", 1, 1), ("g", 0, 0)}


def test_store_generations(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    assert s.current() == 0
    rows = spark.createDataFrame([("a", "code"), ("k", "knowledge")], "id string, layer string")
    assert s.replace(nodes=rows) == 1
    assert s.replace(nodes=spark.createDataFrame([("b", "code")], "id string, layer string"), keep_layer="knowledge") == 2
    assert {r.id for r in s.read("nodes").collect()} == {"b", "k"} and s.read("nodes", 1).count() == 2


def test_repository(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "build").mkdir()
    (tmp_path / "build" / "x.py").write_text("x = 1")
    (tmp_path / "pkg" / "a.py").write_text("from pkg.b import helper as h\nclass S(Base):\n    def run(self, n: int) -> int:\n        return h(n)\n")
    (tmp_path / "pkg" / "bad.py").write_text("def (")
    files = repository.scan(spark, str(tmp_path))
    assert {r.path for r in files.collect()} == {"pkg/a.py", "pkg/bad.py"}
    got = {r.path: r for r in repository.parse_python(files).collect()}
    assert got["pkg/bad.py"].has_error and not got["pkg/a.py"].has_error
    assert [(s.kind, s.qualified_name) for s in got["pkg/a.py"].symbols] == [("Class", "pkg.a.S"), ("Method", "pkg.a.S.run")]
    assert {(x.type, x.raw_name, x.target_module) for x in got["pkg/a.py"].references} == {("IMPORTS", "helper", "pkg.b"), ("IMPLEMENTS", "Base", None), ("CALLS", "helper", "pkg.b")}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    seen = []
    increments.generations(increments.first_of_each(stream, "event_id", "ts", "1 day"), lambda df, k: seen.extend(r.event_id for r in df.collect()), f"{tmp_path}/check").awaitTermination(120)
    assert sorted(seen) == sorted(r.event_id for r in events.select("event_id").collect())


def test_contract_names(spark):
    from factloom.operators import contracts

    rows = spark.createDataFrame([("lockFile", "(int a, void (*cb)(int, int), char *s = 0)"), ("file_unlocked", "(self, x: dict[str, int] = {}, *args)"), ("lock_release", "(void)"), ("read", None)], "name string, signature string")
    got = [(r.half, r.stem, r.p) for r in rows.select(contracts.pair_half(F.col("name")).alias("half"), contracts.pair_stem(F.col("name")).alias("stem"), contracts.parameters("signature").alias("p")).collect()]
    assert got[0][:2] == ("acquire", "file") and got[1] == ("release", "file", ["self", "x", "args"]) and got[2] == (None, None, []) and got[3] == (None, None, [])
    assert got[0][2] == ["a", "cb", "s"]


def test_consumed_parameters(spark):
    from factloom.operators import contracts

    functions = spark.createDataFrame([(1, "f", ["a", "b"]), (2, "f", ["x", "y"]), (3, "g", ["p"]), (4, "g", ["q", "p"])], "owner int, name string, params array<string>")
    releases = spark.createDataFrame([(1, "b"), (2, "y"), (3, "p"), (4, "p")], "owner int, subject string")
    assert [(r.name, r.ordinal) for r in contracts.consumed(functions, releases).collect()] == [("f", 1)]


def test_verdict(spark):
    from factloom.operators import contracts

    rows = spark.createDataFrame([("malloc", "free"), ("malloc", "delete"), ("mmap", "free"), ("malloc", "odd")], "a string, r string")
    rule = contracts.verdict(F.col("a"), F.col("r"), {"malloc": ("free",), "new": ("delete",)})
    assert [r.v for r in rows.select(rule.alias("v")).collect()] == ["valid", "mismatch", "unknown", "unknown"]


def test_bindings_are_whole(spark):
    from factloom.operators import projection

    located = spark.createDataFrame([(1,), (2,)], "candidate int")
    assert {(r.candidate, r.side) for r in projection.unbound(located, spark.createDataFrame([(2,), (3,)], "candidate int")).collect()} == {(1, "location"), (3, "candidate")}


CPP = """#include "api.hpp"
namespace demo {
class Widget : public Base {
 public:
  int run(int n) { return helper(n) + obj->call(n); }
};
}
int demo::Widget::stop() { /* not(this) */ const char* s = "nor(this)"; if (ok()) { go(); } return 0; }
int main(void)
{
    demo::start(1);
}
"""
JAVA = "import java.util.List;\nclass A implements B {\n  int f(int x) { return this.g(x) + new C(x).h(); }\n}\n"


def test_scope_scanner():
    from factloom.sources import syntax

    symbols, references = syntax.scan_braces(CPP)
    assert [(s["kind"], s["qualified_name"]) for s in symbols] == [("Namespace", "demo"), ("Class", "demo.Widget"), ("Method", "demo.Widget.run"), ("Method", "demo.Widget.stop"), ("Function", "main")]
    assert {(r["owner"], r["raw_name"], r["call_kind"]) for r in references if r["type"] == "CALLS"} == {("demo.Widget.run", "helper", "direct"), ("demo.Widget.run", "call", "indirect"), ("demo.Widget.stop", "ok", "direct"), ("demo.Widget.stop", "go", "direct"), ("main", "demo.start", "direct")}
    symbols, references = syntax.scan_braces(JAVA, java=True)
    assert [s["qualified_name"] for s in symbols] == ["A", "A.f"] and {r["raw_name"] for r in references} >= {"java.util.List", "g", "C", "h"}


def test_syntax_rows(spark, tmp_path):
    from factloom.sources import syntax

    (tmp_path / "a.py").write_text("def f(x):\n    return x + 1\n")
    (tmp_path / "b.c").write_text("int f(int x) { return g(x); }")
    files = repository.scan(spark, str(tmp_path))
    rows = syntax.python_syntax(files).collect()
    known = {r.node_id for r in rows}
    assert len(known) == len(rows) and sum(r.parent_id is None for r in rows) == 1 and all(r.parent_id in known for r in rows if r.parent_id)
    assert syntax.parse_braces(files).first().references[0].raw_name == "g"


@pytest.mark.parametrize("named", [False, True])
def test_any_number_of_locks(spark, named):
    r = random.Random(4)
    rows, held_at, pairs = [], {}, {}
    for owner in ("a", "b", "c", None):
        held = set()
        for position in range(60):
            kind, lock = r.choice(["LOCK", "LOCK", "UNLOCK", "ACCESS"]), r.randrange(9)
            lock = f"lock{lock}" if named else lock
            rows.append((len(rows), owner, kind, lock, 0, position))
            if kind == "ACCESS":
                held_at[len(rows) - 1] = sorted(held)
            elif kind == "LOCK":
                for other in held - {lock}:
                    pairs.setdefault((other, lock), set()).add(owner)
                held.add(lock)
            else:
                held.discard(lock)
    r.shuffle(rows)
    locks = spark.createDataFrame(rows, f"event_id long, owner string, type string, lock {'string' if named else 'int'}, subject int, position long")
    assert {x.event_id: sorted(x.held) for x in dataflow.held_locks(locks).collect()} == held_at
    want = {(a, b): (len(o), len(pairs[b, a])) for (a, b), o in pairs.items() if a < b and (b, a) in pairs}
    assert {(x.first, x.second): (x.owners, x.inverse) for x in defects.lock_order(locks).collect()} == want


def test_race_owners_leave_none_out(spark):
    rows = [(1, f"o{k}", "WRITE") for k in range(5) for _ in range(5 - k)] + [(1, f"r{k}", "CHECK") for k in range(4)] + [(2, "o0", "WRITE"), (2, "r0", "CHECK")] + [(3, "r0", "CHECK"), (3, "r1", "CHECK")] + [(4, "o0", "WRITE")]
    points = spark.createDataFrame(rows, "subject int, owner string, type string")
    got = {(r.subject, r.owner): (r.writing_partners, r.partners) for r in defects.race_owners(points).collect()}
    assert got == {**{(1, f"o{k}"): (4, 8) for k in range(5)}, **{(1, f"r{k}"): (5, 5) for k in range(4)}, (2, "o0"): (0, 1), (2, "r0"): (1, 1)}
    report = defects.race_report(points).collect()
    assert {(r.subject, r.total, r.truncated) for r in report} == {(1, 40, True), (2, 1, False)}
    assert {(r.writer, r.other) for r in report if r.subject == 1} == {("o0", "o1"), ("o0", "o2"), ("o0", "o3"), ("o1", "o0"), ("o1", "o2"), ("o1", "o3"), ("o2", "o0"), ("o2", "o1"), ("o2", "o3")}


FLOW = """
def f(a, b):
    x = a
    while x:
        if b:
            break
        if a:
            continue
        x = g(x)
    for y in b:
        x += y
    return x

class C:
    def m(self):
        if self.a:
            return 1
        def inner():
            pass
        return 2

    def t(self):
        try:
            pass
        finally:
            pass

async def co():
    return 1

def e(x):
    for y in x:
        pass
    else:
        pass
"""


def _walks(nodes, edges):
    """Kinds of statements on every path from ENTRY to EXIT that takes no edge twice."""
    out, stack = set(), [(0, ())]
    while stack:
        at, used = stack.pop()
        if nodes[at] == "EXIT":
            out.add("".join(nodes[edges[k][1]][0] for k in used))
        stack.extend((d, (*used, k)) for k, (s, d, _) in enumerate(edges) if s == at and k not in used)
    return out


def test_control_flow_of_python(spark, tmp_path):
    from factloom.operators import branches
    from factloom.sources import control_flow

    (tmp_path / "a.py").write_text(FLOW)
    (tmp_path / "b.py").write_text("def broken(:")
    (tmp_path / "c.py").write_text("")
    (tmp_path / "vendor").mkdir()
    (tmp_path / "vendor" / "d.py").write_text(FLOW)
    rows = control_flow.control_flow(repository.scan(spark, str(tmp_path)))
    got = {r.owner: r for r in rows.collect()}
    assert {k: r.unsupported for k, r in got.items()} == {"f": None, "C.m": None, "C.m.inner": None, "C.t": "Try", "co": "async", "e": "loop_else"}
    f = got["f"]
    kinds = [n.kind for n in f.nodes]
    edges = [(kinds[e.src], kinds[e.dst], e.kind) for e in f.edges]
    assert sorted(edges) == sorted(
        [("ENTRY", "Assign", "next"), ("Assign", "While", "next"), ("While", "If", "true"), ("If", "Break", "true"), ("Break", "For", "break"), ("If", "If", "false"), ("If", "Continue", "true"), ("Continue", "While", "continue")]
        + [("If", "Assign", "false"), ("Assign", "While", "back"), ("While", "For", "false"), ("For", "AugAssign", "true"), ("AugAssign", "For", "back"), ("For", "Return", "false"), ("Return", "EXIT", "return")]
    )
    m = got["C.m"]
    assert _walks([n.kind for n in m.nodes], [(e.src, e.dst, e.kind) for e in m.edges]) == {"IRE", "IFRE"}
    assert {e.kind for r in got.values() for e in r.edges} <= set(control_flow.EDGE_KINDS)
    nodes = rows.select("owner", F.explode("nodes").alias("n")).select("owner", "n.node", "n.kind")
    flow = rows.select("owner", F.explode("edges").alias("e")).select("owner", "e.src", "e.dst")
    assert branches.integrity(nodes, flow).count() == 0
    bad = nodes.where("owner <> 'f' or kind <> 'EXIT'")
    assert {(r.owner, r.wrong) for r in branches.integrity(bad, flow).collect()} == {("f", "entry_exit"), ("f", "unknown_node")}


def test_branch_rules(spark):
    from factloom.operators import branches

    edges = [(1, 2, None), (2, 3, None), (2, 4, 7), (3, 9, None), (4, 9, None), (1, 5, None), (5, 9, None), (3, 3, None)]
    points = [(1, "ALLOC", 7), (2, "CHECK", 7), (3, "RELEASE", 7), (4, "DEREFERENCE", 7), (5, "RELEASE", 8)]
    e = spark.createDataFrame([("o", *x) for x in edges], "owner string, src long, dst long, null_of long")
    p = branches.materialize_points(spark.createDataFrame([("o", *x) for x in points], "owner string, point long, type string, subject long"), e)
    assert {(r.point, r.type) for r in p.collect() if r.type == "EXIT"} == {(9, "EXIT")}
    rule = lambda f: {(r.start, r.target) for r in f(e, p).collect()}
    assert rule(branches.unreleased) == {(1, 9)}  # by 5, which releases another subject; the null arm does not count
    assert rule(branches.unchecked_dereferences) == {(2, 4)}
    assert rule(branches.double_release) == {(3, 3)} and rule(branches.use_after_release) == set()
    assert branches.unreleased(e.limit(0), p.limit(0)).count() == 0


def test_resolver_rules(spark):
    from factloom.operators import resolve

    symbols = [("s1", "run", "a.run", "f1", "()", True, "Function"), ("s2", "run", "b.run", "f1", "()", False, "Function"), ("s3", "one", "a.one", "f1", "()", True, "Function"), ("s4", "two", "p.two", "f2", "(x)", True, "Function"), ("s5", "two", "p.two", "f3", "(x)", False, "Function"), ("s6", "T", "q.T", "f1", "", True, "Function"), ("s7", "T", "q.r.T", "f2", "", True, "Class"), ("s8", "far", "m.far", "f4", "()", True, "Function")]
    s = spark.createDataFrame(symbols, "id string, name string, qualified_name string, file string, signature string, definition boolean, kind string")
    schema = "id string, owner_id string, raw_name string, call_kind string, target_module string, file string, type_use boolean, receiver_unsafe boolean"
    refs = [("1", "o", "run", "direct", None, "f1", None, None), ("2", "o", "x.one", "direct", None, "f1", None, None), ("3", "o", "x.one", "direct", None, "f1", None, True), ("4", "o", "p.two", "direct", None, "f9", None, None), ("5", "o", "two", "direct", "p", "f9", None, None), ("6", "o", "two", "direct", None, "f9", None, None), ("7", "o", "T", "direct", None, "f1", True, None), ("8", "o", "alias", "direct", None, "f9", None, None), ("9", "o", "far", "indirect", None, "f9", None, None), ("10", "o", "far", "direct", None, "f9", None, None), ("11", "s8", "far", "direct", None, "f9", None, None), ("12", "o", "nothing", "direct", "p", None, None, None)]
    imports = spark.createDataFrame([("f9", "alias", "m", "far"), ("f1", "alias", "m", "none")], "file string, local string, module string, target string")
    rows = resolve.resolve(spark.createDataFrame(refs, schema), s, imports).collect()
    got = {int(r.id): (r.status, r.resolved_id, r.strategy, r.confidence) for r in rows}
    assert got[1] == ("ambiguous", None, "same_file", 0.0) and got[2] == ("resolved", "s3", "same_file", 0.98) and got[3][:3] == ("ambiguous", None, "same_file")
    assert got[4] == ("resolved", "s4", "qualified", 0.99) and got[5] == ("resolved", "s4", "module", 1.0) and got[6][:3] == ("ambiguous", None, "global")
    assert got[7] == ("resolved", "s7", "global", 0.75) and got[8] == ("resolved", "s8", "alias", 0.95)
    assert got[9][:2] == ("unresolved", None) and got[10] == ("resolved", "s8", "global", 0.75) and got[11][:2] == ("unresolved", None)
    assert len(rows) == len(refs) and got[12] == ("unresolved", None, None, 0.0)


def test_facts_are_made_anew_when_a_table_changes(spark, tmp_path):
    import shutil

    from factloom.sources.facts import Facts

    shutil.copytree("/root/testdata/sf0.001", tmp_path / "sf")
    folder = str(tmp_path / "sf")
    before = Facts(spark, folder).nodes.where("kind = 'Namespace'").count()
    some = spark.read.parquet(f"{folder}/region.parquet").limit(2).toPandas()
    os.chmod(tmp_path / "sf", 0o755)
    (tmp_path / "sf" / "region.parquet").unlink()
    some.to_parquet(tmp_path / "sf" / "region.parquet")
    assert (before, Facts(spark, folder).nodes.where("kind = 'Namespace'").count()) == (5, 2)
