"""Rules over control flow with branches: what a point reaches on some path that certain points do not cut."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Type of the point that stands for the end of an owner.
EXIT = "EXIT"
_REACHED = "owner string, subject long, start long, target long"


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """owner and what is wrong: not one ENTRY and one EXIT, or an edge with an end that is no node of its owner."""
    n = nodes.groupBy("owner").agg(F.count_if(F.col("kind") == "ENTRY").alias("a"), F.count_if(F.col("kind") == EXIT).alias("b"))
    ends = n.where("a <> 1 or b <> 1").select("owner", F.lit("entry_exit").alias("wrong"))
    both = edges.select("owner", F.explode(F.array("src", "dst")).alias("node"))
    return ends.unionByName(both.join(nodes, ["owner", "node"], "left_anti").select("owner", F.lit("unknown_node").alias("wrong")).distinct())


def materialize_points(events: DataFrame, edges: DataFrame) -> DataFrame:
    """``events(owner, point, type, subject)`` and an EXIT for each edge end of an owner that is no event."""
    exits = edges.select("owner", F.col("dst").alias("point")).distinct().join(events, ["owner", "point"], "left_anti")
    return events.select("owner", "point", "type", "subject").unionByName(exits.select("owner", "point", F.lit(EXIT).alias("type"), F.lit(None).cast("long").alias("subject")))


def _reached(edges: DataFrame, points: DataFrame, starts: tuple[str, ...], targets: tuple[str, ...], cuts: tuple[str, ...], from_null: bool = False, skip_null: bool = False) -> DataFrame:
    """(owner, subject, start, target): targets that a start reaches on a path without a cut of its subject.

    ``edges(owner, src, dst, null_of)``: ``null_of`` is the subject that is null on this edge, if any. With ``from_null``
    a path leaves its start by such an edge of its subject, with ``skip_null`` it never takes one. An EXIT is a target
    of any subject, other targets are those of the start's. Breadth first with every point once for each start, so the
    work is starts times edges of one owner: a method, whose size does not grow with the corpus.
    """

    def search(key: tuple, at: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        out: dict[int, list] = defaultdict(list)
        for src, dst, null in zip(at["src"], at["dst"], at["null_of"], strict=True):
            out[src].append((dst, None if pd.isna(null) else int(null)))
        of = {p: (t, None if pd.isna(s) else int(s)) for p, t, s in zip(points["point"], points["type"], points["subject"], strict=True)}
        rows = []
        for start, (kind, subject) in of.items():
            if kind not in starts:
                continue
            front = [d for d, null in out.get(start, ()) if (null == subject) == from_null or not (from_null or skip_null)]
            seen = set(front)
            while front:
                point = front.pop()
                kind, its = of.get(point, ("", None))
                if kind in targets and (kind == EXIT or its == subject):
                    rows.append((key[0], subject, start, point))
                if kind in cuts and its == subject:
                    continue
                for d, null in out.get(point, ()):
                    if d not in seen and not (skip_null and null == subject):
                        seen.add(d)
                        front.append(d)
        return pd.DataFrame(rows, columns=["owner", "subject", "start", "target"])

    # new names: both sides may come from one table
    steps, marked = edges.select("owner", "src", "dst", "null_of").toDF("of", "src", "dst", "null_of"), points.select("owner", "point", "type", "subject").toDF("within", "point", "type", "subject")
    both = steps.groupBy("of").cogroup(marked.groupBy("within"))
    return both.applyInPandas(search, _REACHED)


def unreleased(edges: DataFrame, points: DataFrame, acquire: str = "ALLOC", release: str = "RELEASE") -> DataFrame:
    """(owner, subject, start, target): an acquire that reaches an EXIT past every release of its subject, but for paths on which it is null."""
    return _reached(edges, points, (acquire,), (EXIT,), (release,), skip_null=True)


def unchecked_dereferences(edges: DataFrame, points: DataFrame) -> DataFrame:
    """(owner, subject, start, target): from the null arm of a CHECK to a DEREFERENCE of its subject that no definition precedes."""
    return _reached(edges, points, ("CHECK",), ("DEREFERENCE",), ("ALLOC", "WRITE"), from_null=True)


def use_after_release(edges: DataFrame, points: DataFrame) -> DataFrame:
    """(owner, subject, start, target): from a RELEASE to a DEREFERENCE of its subject that no definition precedes."""
    return _reached(edges, points, ("RELEASE",), ("DEREFERENCE",), ("ALLOC", "WRITE"))


def double_release(edges: DataFrame, points: DataFrame) -> DataFrame:
    """(owner, subject, start, target): from a RELEASE to another of its subject without a definition in between."""
    return _reached(edges, points, ("RELEASE",), ("RELEASE",), ("ALLOC", "WRITE"))
