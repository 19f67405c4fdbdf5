"""Bounded graph traversal: capped neighbourhoods, adjacency, reachability and simple paths."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom import scratch


def adjacency(edges: DataFrame) -> DataFrame:
    """Out-neighbours of each source in order of (dst, id)."""
    return edges.groupBy("src_id").agg(F.array_sort(F.collect_list(F.struct(F.col("dst_id").alias("dst"), "id"))).alias("out"))


def subgraph(edges: DataFrame, anchor: str, hops: int = 2, most: int = 100) -> DataFrame:
    """Nodes within ``hops`` undirected steps of ``anchor``: id and distance; new ends are taken in order of edge id
    until ``most`` nodes are seen (the operator's own budget)."""
    spark = edges.sparkSession
    seen = spark.createDataFrame([(anchor, 0)], "id string, distance int")
    front = seen
    size = 1
    for hop in range(1, hops + 1):
        a, b = F.broadcast(front.select(F.col("id").alias("src_id"))), F.broadcast(front.select(F.col("id").alias("dst_id")))
        out = edges.join(a, "src_id", "left_semi").select(F.col("id").alias("edge"), F.col("dst_id").alias("id"))
        back = edges.join(b, "dst_id", "left_semi").select(F.col("id").alias("edge"), F.col("src_id").alias("id"))
        new = out.unionByName(back).join(F.broadcast(seen), "id", "left_anti").groupBy("id").agg(F.min("edge").alias("edge"))
        # no more than the budget enters the next round or the broadcast
        front = scratch.stored(new.orderBy("edge").limit(max(0, most - size)).select("id", F.lit(hop).alias("distance")), "front")
        added = front.count()
        size += added
        seen = seen.unionByName(front)
        if not added or size >= most:
            break
    return seen


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node) for every node that a path from a start reaches; a round for each step, until nothing is new."""
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    front = scratch.stored(starts.select(F.col("start"), F.col("start").alias("node")), "reach")
    seen = front.limit(0)
    while True:
        new = front.join(step, "node").select("start", F.col("next").alias("node")).distinct().join(seen, ["start", "node"], "left_anti")
        front = scratch.stored(new, "reach")
        if front.isEmpty():
            return seen
        seen = scratch.stored(seen.unionByName(front), "reached")


def find_paths(edges: DataFrame, marks: DataFrame, most_hops: int = 64, most_paths: int = 8) -> DataFrame:
    """Simple paths of each owner from its start points to its targets that meet no blocked point.

    ``edges(owner, src, dst)``, ``marks(owner, point, is_start, is_target, is_blocked)``. Breadth first; starts and
    neighbours in order; only points that can still reach a target are entered; a target is recorded and walked through; the search of an owner ends at ``most_paths``, with
    truncated if work was left. owner, length, path (points joined by ">"), truncated. An owner's points meet in one
    task: owners are methods, whose size doesn't grow with the corpus.
    """

    def search(batches: pd.DataFrame) -> pd.DataFrame:
        rows = batches
        kind = rows["kind"].to_numpy()
        out: dict[int, list[int]] = {}
        for a, b in sorted(set(zip(rows["a"][kind == 0].tolist(), rows["b"][kind == 0].tolist(), strict=True))):
            out.setdefault(a, []).append(b)
        target = set(rows["a"][kind == 2].tolist())
        blocked = set(rows["a"][kind == 3].tolist())
        back: dict[int, list[int]] = {}
        for a, following in out.items():
            for b in following:
                back.setdefault(b, []).append(a)
        useful, front = set(target), list(target)
        while front:
            before = [a for a in back.get(front.pop(), ()) if a not in useful]
            useful.update(before)
            front.extend(before)
        found: list[list[int]] = []
        queue = deque([s] for s in sorted(set(rows["a"][kind == 1].tolist())))
        while queue and len(found) < most_paths:
            path = queue.popleft()
            if len(path) > 1 and path[-1] in target:
                found.append(path)
                if len(found) >= most_paths:
                    break
            if len(path) - 1 < most_hops:
                queue.extend([*path, n] for n in out.get(path[-1], ()) if n in useful and n not in path and n not in blocked)
        found.sort(key=lambda p: (len(p), p))
        owner = rows["owner"].iloc[0]
        text = lambda values: pd.Series(values, dtype=object)
        return pd.DataFrame({"owner": text([owner] * len(found)), "length": [len(p) - 1 for p in found], "path": text([">".join(map(str, p)) for p in found]), "truncated": [bool(queue)] * len(found)})

    rows = edges.select("owner", F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0).alias("kind"))
    for kind, flag in ((1, "is_start"), (2, "is_target"), (3, "is_blocked")):
        rows = rows.unionByName(marks.where(flag).select("owner", F.col("point").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(kind).alias("kind")))
    return rows.groupBy("owner").applyInPandas(search, "owner string, length long, path string, truncated boolean")
