"""Context of symbols and documents and integrity checks: cases that the tables of the SQL comparison don't hold."""

import random

from factloom.operators import context, integrity

_LINK = "id string, source_id string, raw_anchor string, status string, target_id string, relation string"
_NODE = "id string, kind string, name string, qualified_name string, path string, shard string"


def _nodes(spark, *names):
    return spark.createDataFrame([(n, "Function", n, n, n, "s") for n in names], _NODE)


def test_a_document_is_named_by_an_equal_field_first(spark):
    docs = spark.createDataFrame([("1", "Spec", "Lock order", "a/Lock order", None, None), ("2", "Spec", "lock", "z/lock", "x", None), ("3", "Spec", None, None, None, None)], _NODE)
    assert [r.id for r in context.resolve_document(docs, "LOCK").collect()] == ["2"]
    assert [r.id for r in context.resolve_document(docs, "order").collect()] == ["1"]
    assert context.resolve_document(docs, "nothing").isEmpty()


def test_shown_links_are_few_and_counted_in_full(spark):
    links = [(str(k), "d", f"a{k}", "resolved", f"n{k:03d}", "DOCUMENTS") for k in range(40)]
    links += [(f"c{k}", "d", f"a{k:02d}", "ambiguous", None, "DOCUMENTS") for k in range(30)] + [("x", None, None, "resolved", None, None), ("y", "d", "a", "resolved", "n000", "MENTIONS")]
    links = spark.createDataFrame(links + links[:5], _LINK)
    rows = context.related_code(links, _nodes(spark, *(f"n{k:03d}" for k in range(40)))).collect()
    assert sorted({(r.role, r.total) for r in rows}) == [("candidate", 30), ("resolved", 40)]
    assert sorted(r.id for r in rows if r.role == "resolved") == [f"n{k:03d}" for k in range(12)]
    summary = context.related_code_summary(links, _nodes(spark, "d", "e"), _nodes(spark, "n001")).collect()
    assert sorted((r.id, r.links, r.shards, r.candidates, r.uncertain) for r in summary) == [("d", 2, 1, 30, True), ("e", 0, 0, 0, True)]


def test_context_of_empty_tables(spark):
    none, links = _nodes(spark).limit(0), spark.createDataFrame([], _LINK)
    edges = spark.createDataFrame([], "src_id string, dst_id string, type string")
    references = spark.createDataFrame([], "id string, owner_id string, status string, start_line int, candidates array<string>")
    boundary = spark.createDataFrame([], "src_shard string, dst_shard string, dst_id string")
    for rows in (
        context.related_code(links, none), context.related_documents(links, none), context.explain_symbol(none, edges, links, none),
        context.explain_module(none, boundary, links), context.module_symbols(none, boundary), context.task_context(none, edges, references),
    ):
        assert rows.isEmpty()


def test_task_context_keeps_a_prefix_below_its_cap(spark):
    names = [f"f{k:02d}" for k in range(20)]
    edges = spark.createDataFrame([(n, "f00", "CALLS") for n in names[1:]] * 2 + [("gone", "f00", "CALLS"), (None, "f00", "CALLS")], "src_id string, dst_id string, type string")
    refs = [("r1", "f00", "unresolved", 1, None), ("r2", "f00", "ambiguous", 1, ["p", "q"]), ("r3", "f00", "resolved", 1, ["p"]), ("r4", None, "unresolved", 1, None)]
    references = spark.createDataFrame(refs, "id string, owner_id string, status string, start_line int, candidates array<string>")
    rank = {"primary": 0, "relation": 1, "candidate": 2}
    for cap in (0, 200, 700, 6000):
        rows = [r for r in context.task_context(_nodes(spark, *names), edges, references, cap=cap).collect() if r.symbol == "f00"]
        rows.sort(key=lambda r: (rank[r.section], r.place))
        assert [r.section for r in rows] == ["primary"] * 2 + ["relation"] * 12 + ["candidate"] * 3
        assert [r.id for r in rows[2:14]] == names[1:13]
        assert [r.fact_id for r in rows[14:]] == ["unresolved:r1", "candidate:r2:p", "candidate:r2:q"]
        used = 0
        for k, r in enumerate(rows):
            used += len(f'{{"section":"{r.section}","fact_id":"{r.fact_id}"}}')
            assert r.kept == (k == 0 or used <= cap)


def test_spans_equal_slices_of_lines(spark):
    draw = random.Random(5)
    rows = [(k, "\n".join(draw.choice(["", "ä", "x y", "日本"]) for _ in range(draw.randint(1, 30))), draw.randint(-1, 32), draw.randint(-1, 40)) for k in range(200)]
    rows += [(200, None, 1, 2), (201, "", 1, 1), (202, "a\nb", None, None)]
    frame = spark.createDataFrame(rows, "id int, text string, a int, z int")
    got = {r.id: r.s for r in frame.select("id", context.span(frame.text, frame.a, frame.z).alias("s")).collect()}
    for key, text, a, z in rows:
        lines = None if text is None else text.split("\n")
        a = max(a or 1, 1)
        if lines is None or a > len(lines):
            assert got[key] is None
            continue
        z = min(max(a if z is None else z, a), len(lines), a + 19)
        content = "\n".join(lines[a - 1 : z])
        start = len("".join(x + "\n" for x in lines[: a - 1]).encode())
        assert tuple(got[key]) == (a, z, start, start + len(content.encode()), content)
        assert text.encode()[start : start + len(content.encode())].decode() == content


def test_integrity_names_each_problem_and_passes_sound_scopes(spark):
    tree = spark.createDataFrame([("ok", "a", None), ("ok", "b", "a"), ("two", "a", None), ("two", "b", None), ("none", "a", "b"), ("none", "b", "x")], "scope string, id string, parent string")
    assert sorted(map(tuple, integrity.tree(tree).collect())) == [("none", "parent_missing", 1), ("none", "root_missing", 1), ("two", "multiple_roots", 2)]
    node, edge = "scope string, id string, owner string, kind string", "scope string, src string, dst string, owner string"
    nodes = spark.createDataFrame([("ok", "1", "f", "entry"), ("ok", "2", "f", "exit"), ("bad", "1", "f", "entry"), ("bad", "2", "f", None), ("bad", "3", None, "exit")], node)
    edges = spark.createDataFrame([("ok", "1", "2", "f"), ("bad", "1", "9", "f"), ("bad", "3", "1", "g"), ("bad", None, "1", "f")], edge)
    assert sorted(map(tuple, integrity.control_flow(nodes, edges).collect())) == [("bad", "edge_endpoint_missing", 2), ("bad", "edge_owner_mismatch", 1), ("bad", "exit_missing", 1), ("bad", "node_missing_owner", 1)]
    assert integrity.control_flow(nodes.limit(0), edges.limit(0)).isEmpty() and integrity.tree(tree.limit(0)).isEmpty()
    events = spark.createDataFrame([("ok", "event:1", "f", "LOCK", "l"), ("bad", None, None, None, None)], "scope string, id string, owner string, kind string, level string")
    assert sorted(r.problem for r in integrity.events(events, ["LOCK"], "l").collect()) == ["event_id_prefix_missing", "event_level_missing", "event_owner_missing", "unknown_event_type"]
    built = spark.createDataFrame([(1, "b", "x"), (1, "a", "x"), (2, "a", "y"), (3, "z", "y")], "analysis int, analyzer string, contract string")
    registry = spark.createDataFrame([("a", "y"), ("b", "y")], "analyzer string, contract string")
    assert sorted(map(tuple, integrity.staleness(built, registry).collect())) == [(1, "dependency_changed:a"), (3, "dependency_unregistered:z")]
