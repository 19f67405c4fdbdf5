"""Life of an overlay: batches, replacement, discarding, commits, merges and refused deltas."""

import pytest

from factloom.sources import overlays

_DELTA = "entity_type string, entity_id string, operation string, base_version string, new_value string, generation long"


def _store(spark, folder, kind="SESSION"):
    return overlays.OverlayStore.create(spark, str(folder), kind, "r", "c1", 4, f"overlay:{folder.name}")


def _rows(store, kind=None):
    return sorted((r.entity_type, r.entity_id, r.operation, r.new_value) for r in store.deltas(kind).collect())


def _deltas(spark, *rows):
    return spark.createDataFrame([(t, e, o, None, v, 1) for t, e, o, v in rows], _DELTA)


def test_later_deltas_replace_earlier_ones_until_they_are_dropped(spark, tmp_path):
    store = _store(spark, tmp_path / "a")
    assert _rows(store) == [] and store.metadata().status == "ACTIVE"
    store.put(_deltas(spark, ("Node", "1", "ADD", "x"), ("Node", "2", "ADD", "y"), ("Edge", "1", "ADD", "z")))
    store.put(_deltas(spark, ("Node", "1", "DELETE", None), ("Node", "1", "DELETE", None)))
    store.put(_deltas(spark).limit(0))
    assert _rows(store) == [("Edge", "1", "ADD", "z"), ("Node", "1", "DELETE", None), ("Node", "2", "ADD", "y")]
    assert _rows(store, "Edge") == [("Edge", "1", "ADD", "z")]
    assert sorted(map(tuple, store.counts(["Node"]).collect())) == [("Node", "ADD", 1), ("Node", "DELETE", 1), ("Node", "UPDATE", 0)]
    assert store.mark_base("c2", 4) == "REBASE_REQUIRED" and store.mark_base("c1", 4) == "ACTIVE"
    store.clear()
    assert _rows(store) == [] and store.metadata().status == "ACTIVE"
    store.put(_deltas(spark, ("Node", "9", "ADD", "x")))
    assert len(_rows(overlays.OverlayStore(spark, str(tmp_path / "a")))) == 1
    store.discard()
    assert _rows(store) == [] and store.metadata().status == "DISCARDED"


def test_unsound_deltas_leave_the_overlay_as_it_was(spark, tmp_path):
    store = _store(spark, tmp_path / "a")
    store.put(_deltas(spark, ("Node", "1", "ADD", "x")))
    for row in (("Node", "1", "DELETE", "x"), ("Node", "1", "MOVE", "x"), ("Node", None, "ADD", "x"), ("Node", "1", None, "x"), ("Word", "1", "ADD", "x"), (None, "1", "ADD", "x")):
        with pytest.raises(Exception, match="not a sound delta"):
            store.put(_deltas(spark, row))
        assert _rows(store) == [("Node", "1", "ADD", "x")]
    store.put(_deltas(spark, ("Node", "2", "ADD", "y")))
    assert len(_rows(store)) == 2
    for kind, commit in (("other", "c"), ("BRANCH", "")):
        with pytest.raises(ValueError):
            overlays.OverlayStore.create(spark, str(tmp_path / "b"), kind, "r", commit, 1)


def test_commit_and_merge(spark, tmp_path):
    session, branch = _store(spark, tmp_path / "s"), _store(spark, tmp_path / "b", "BRANCH")
    branch.put(_deltas(spark, ("Node", "1", "ADD", "old"), ("Node", "3", "ADD", "c")))
    session.put(_deltas(spark, ("Node", "1", "UPDATE", "new"), ("Node", "2", "ADD", "b")))
    assert overlays.commit_to_branch(session, branch) == 2
    assert _rows(branch) == [("Node", "1", "UPDATE", "new"), ("Node", "2", "ADD", "b"), ("Node", "3", "ADD", "c")]
    assert session.metadata().status == "DISCARDED" and _rows(session) == []
    with pytest.raises(ValueError):
        overlays.commit_to_branch(branch, session)
    session.clear()
    session.put(_deltas(spark, ("Node", "4", "ADD", "d"), ("Node", "3", "ADD", "c"), ("Edge", "1", "DELETE", None)))
    target = _store(spark, tmp_path / "t", "BRANCH")
    assert overlays.merge_overlays(branch, session, target).isEmpty() and len(_rows(target)) == 5
    session.put(_deltas(spark, ("Node", "1", "DELETE", None)))
    assert [tuple(r) for r in overlays.merge_overlays(branch, session, target).collect()] == [("Node", "1", "DELETE_UPDATE")]
    assert target.metadata().status == "CONFLICT" and len(_rows(target)) == 5


def test_touched_shards(spark, tmp_path):
    store = _store(spark, tmp_path / "a")
    store.put(_deltas(spark, ("Node", "1", "ADD", '{"shard_id":"a"}'), ("Shard", "b", "DELETE", None), ("BoundaryEdge", "e", "ADD", '{"src_shard_id":"a","dst_shard_id":"c"}'), ("Edge", "e", "ADD", '{"src_shard_id":"x"}'), ("Node", "2", "ADD", "not json")))
    assert sorted(r.shard for r in store.touched_shards().collect()) == ["a", "b", "c"]
