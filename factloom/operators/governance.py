"""Freshness of stored analyses, capability plans and integrity checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def freshness(states: DataFrame, base: DataFrame, version: int) -> DataFrame:
    """fresh and reason of each ``states(file, status, hash, version)`` against ``base(file, hash)``; reasons are joined by +."""
    rows = states.join(base.select("file", F.col("hash").alias("base_hash")), "file", "left")
    reasons = [
        F.when(F.col("status") != "current", F.concat(F.lit("status_"), F.col("status"))),
        F.when(F.col("base_hash").isNull(), "missing_base"),
        F.when(F.col("base_hash") != F.col("hash"), "hash"),
        F.when(F.col("version") != version, "version"),
    ]
    reason = F.concat_ws("+", *reasons)
    return rows.select("file", (reason == "").alias("fresh"), reason.alias("reason"))


def uncovered(base: DataFrame, states: DataFrame) -> DataFrame:
    """Files of the base that no analysis covers."""
    return base.join(states, "file", "left_anti")


def owner_integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Owners whose graph lacks exactly one entry and exit or whose edges leave it: owner, entries, exits, outside."""
    ends = nodes.groupBy("owner").agg(F.sum((F.col("kind") == "entry").cast("long")).alias("entries"), F.sum((F.col("kind") == "exit").cast("long")).alias("exits"))
    known = nodes.select(F.col("owner"), F.col("id").alias("dst"))
    out = edges.join(known, ["owner", "dst"], "left_anti").groupBy("owner").agg(F.count(F.lit(1)).alias("outside"))
    return ends.join(out, "owner", "left").fillna(0, ["outside"]).where("entries <> 1 or exits <> 1 or outside > 0")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@dataclass(frozen=True)
class Capability:
    name: str
    needs: tuple[str, ...] = ()
    languages: frozenset[str] = field(default_factory=lambda: frozenset({"python", "c", "cpp", "java"}))


#: What the engine can build and what each needs first.
CAPABILITIES = {
    c.name: c
    for c in (
        Capability("foundation"),
        Capability("ast", ("foundation",)),
        Capability("cfg", ("ast",)),
        Capability("events", ("foundation",)),
        Capability("sparse_cfg", ("events",)),
        Capability("sparse_dfg", ("events", "sparse_cfg")),
        Capability("defects", ("sparse_dfg", "sparse_cfg")),
        Capability("knowledge", ("foundation",)),
    )
}


def closure(names: list[str]) -> list[str]:
    """The named capabilities and all they need, needs first, equals by name; an unknown name is an error."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name not in CAPABILITIES:
            raise KeyError(name)
        for need in sorted(CAPABILITIES[name].needs):
            visit(need)
        if name not in out:
            out.append(name)

    for name in sorted(set(names)):
        visit(name)
    return out


def plan(names: list[str], language: str, fresh: dict[str, bool]) -> list[tuple[str, str, str]]:
    """(capability, decision, reason) in build order: skip if the language isn't supported or a need was skipped, reuse
    if it and all it needs are fresh, else build."""
    out: dict[str, tuple[str, str]] = {}
    for name in closure(names):
        c = CAPABILITIES[name]
        if language not in c.languages:
            out[name] = ("skip", "unsupported_language")
        elif any(out[n][0] == "skip" for n in c.needs):
            out[name] = ("skip", "missing_need")
        elif fresh.get(name) and all(out[n][0] == "reuse" for n in c.needs):
            out[name] = ("reuse", "fresh")
        else:
            out[name] = ("build", "stale" if name in fresh else "not_built")
    return [(k, *v) for k, v in out.items()]
