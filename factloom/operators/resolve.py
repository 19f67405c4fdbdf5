"""Reference resolution: a ladder of lookups of which the first that answers decides."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import scratch

#: Confidence of each way to resolve, in order; fixed values.
CONFIDENCE = {"same_file": 0.98, "qualified": 0.99, "module": 1.0, "alias": 0.95, "global": 0.75}
#: Ways that take the only definition among candidates of one signature; the others need a single candidate.
_BY_DEFINITION = ("qualified", "module")
#: Symbols that a use of a type can't mean.
CALLABLE = ("Function", "Method", "Constructor")
#: Rows of a table of answers up to which it is broadcast; beyond, distinct names meet it by shuffle.
BROADCAST_ANSWERS = 50_000


def _select(found: DataFrame, *key: str) -> DataFrame:
    """``key``, picked and candidates: one distinct candidate, or for some ways one signature with exactly one definition."""
    sole = F.when(F.size("candidates") == 1, F.col("candidates")[0])
    defined = F.when(F.col("way").isin(*_BY_DEFINITION) & (F.col("signatures") == 1) & (F.size("defined") == 1), F.col("defined")[0])
    rows = found.groupBy(*key, "way").agg(
        F.array_sort(F.collect_set("node")).alias("candidates"),
        F.size(F.collect_set("signature")).alias("signatures"),
        F.collect_set(F.when(F.col("definition"), F.col("node"))).alias("defined"),
    )
    return rows.select(*key, "way", F.struct(F.coalesce(sole, defined).alias("picked"), "candidates").alias("met"))


def resolve(references: DataFrame, symbols: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """status (resolved, ambiguous, unresolved), candidates (sorted), resolved_id, strategy and confidence of every
    reference.

    Order of the lookups, of which the first that finds a candidate decides: indirect calls stay unresolved; a symbol of
    the same file with the last part of the name; the qualified name; module and name; what ``imports(file, local,
    module, target)`` binds to the name in the file; the last part of the name anywhere. Several candidates are
    ambiguous, but for qualified names of which one signature has a single definition. References with a true
    ``type_use`` mean no callable in the lookups by last part, and those with a true ``receiver_unsafe`` (a call on an
    unknown receiver) are never bound by them: their candidates stay ambiguous. Both columns may be missing. Names are
    looked up once each, in one union and one grouping, not once a reference, so a name that a third of all references
    use is one row of the lookup and the references meet it in a join that Spark can split. A reference never resolves
    to its owner.
    """
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(f"_{c}") if c in references.columns else F.lit(False).alias(f"_{c}") for c in ("type_use", "receiver_unsafe")]
    refs = references.select("*", *flags)
    s = symbols.select(F.col("id").alias("node"), "name", "qualified_name", F.col("file").alias("node_file"), "signature", "definition", *(["kind"] if "kind" in symbols.columns else [F.lit("").alias("kind")]))
    target = F.regexp_replace("raw_name", r"^\.+|\.+$", "")
    names = refs.select("raw_name", "target_module", "file", "_type_use").distinct()
    names = names.withColumn("target", target).withColumn("short", F.element_at(F.split("target", r"\."), -1)).withColumn("id", F.xxhash64("raw_name", "target_module", "file", "_type_use"))
    fits = ~F.col("_type_use") | ~F.col("kind").isin(*CALLABLE)
    cols = ("id", "node", "signature", "definition")
    met = [
        ("same_file", names.join(s, (s["name"] == names["short"]) & (s["node_file"] == names["file"])).where(fits)),
        ("qualified", names.join(s, s["qualified_name"] == names["target"])),
        ("module", names.where("target_module is not null").join(s, s["qualified_name"] == F.concat_ws(".", names["target_module"], names["target"]))),
    ]
    if imports is not None:
        bound = imports.select(F.col("file").alias("_file"), "local", F.concat_ws(".", "module", F.col("target")).alias("_whole"))
        local = names.join(bound, (bound["_file"] == names["file"]) & ((bound["local"] == names["target"]) | (bound["local"] == names["short"])))
        met.append(("alias", local.join(s, s["qualified_name"] == local["_whole"])))
    rows = None
    for way, found in met:
        part = found.select(*cols, F.lit(way).alias("way"))
        rows = part if rows is None else rows.unionByName(part)
    ways = [w for w in CONFIDENCE if w in dict(met)]
    near = _select(rows, "id").groupBy("id").agg(*(F.first(F.when(F.col("way") == w, F.col("met")), True).alias(w) for w in ways))
    asked = names.select("short", "_type_use").distinct()
    anywhere = asked.join(s, s["name"] == asked["short"]).where(fits).select("short", "_type_use", "node", "signature", "definition", F.lit("global").alias("way"))
    wide = _select(anywhere, "short", "_type_use").select("short", "_type_use", F.col("met").alias("global"))
    looked = names.join(near, "id", "left").join(wide, ["short", "_type_use"], "left")
    ways.append("global")
    same = (refs["_type_use"] == looked["_type_use"]) & functools.reduce(operator.and_, (refs[c].eqNullSafe(looked[c]) for c in ("raw_name", "target_module", "file")))
    out = refs.join(looked, same).select(refs["*"], *(looked[w] for w in ways))
    way = F.when(F.col("call_kind") == "indirect", F.lit(None).cast("string"))
    for name in ways:
        way = way.when(F.col(name).isNotNull(), F.lit(name))
    out = out.withColumn("strategy", way)
    out = out.withColumn("chosen", F.coalesce(*(F.when(F.col("strategy") == w, F.col(w)) for w in ways)))
    unsafe = F.col("_receiver_unsafe") & F.col("strategy").isin("same_file", "global")
    found = F.array_remove(F.coalesce("chosen.candidates", F.array().cast("array<string>")), F.col("owner_id"))
    picked = F.when((F.col("chosen.picked") != F.col("owner_id")) & ~unsafe, F.col("chosen.picked"))
    out = out.withColumn("candidates", found).withColumn("resolved_id", picked)
    state = F.when(F.col("resolved_id").isNotNull(), "resolved").when((F.size("candidates") > 0) & (F.col("chosen.picked").isNull() | unsafe), "ambiguous").otherwise("unresolved")
    out = out.withColumn("status", state)
    sure = F.lit(0.0)
    for name, value in CONFIDENCE.items():
        sure = F.when((F.col("status") == "resolved") & (F.col("strategy") == name), F.lit(value)).otherwise(sure)
    return out.withColumn("confidence", sure).drop("chosen", "_type_use", "_receiver_unsafe", *ways)


def _answers(symbols: DataFrame, key: list[str], by_definition: bool) -> DataFrame:
    """``key``, n and picked for names of any use, and both for names of types: what a way finds, without the candidates."""
    free = ~F.col("kind").isin(*CALLABLE)
    out = []
    for suffix, fits in (("", F.lit(True)), ("_type", F.coalesce(free, F.lit(False)))):
        node, defined = F.when(fits, F.col("node")), F.when(fits & F.col("definition"), F.col("node"))
        n, picked = F.countDistinct(node), F.when(F.countDistinct(node) == 1, F.min(node))
        if by_definition:
            one = (F.countDistinct(F.when(fits, F.col("signature"))) == 1) & (F.countDistinct(defined) == 1)
            picked = F.coalesce(picked, F.when(one, F.min(defined)))
        out += [n.alias("n" + suffix), picked.alias("picked" + suffix)]
    return symbols.where(" and ".join(f"{c} is not null" for c in key)).groupBy(*key).agg(*out)


def resolve_counts(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """``resolve`` without imports, for whoever needs no list: n_candidates stands in place of candidates.

    A name that a million symbols bear gives a million candidates; here it is one row of counts, and no reference ever
    carries a list. Ids may be of any type.
    """
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(f"_{c}") if c in references.columns else F.lit(False).alias(f"_{c}") for c in ("type_use", "receiver_unsafe")]
    target = F.regexp_replace("raw_name", r"^\.+|\.+$", "")
    short = F.element_at(F.split(target, r"\."), -1)
    whole = F.when(F.col("target_module").isNotNull(), F.concat_ws(".", "target_module", target))
    refs = references.select("*", *flags)
    s = symbols.select(F.col("id").alias("node"), "name", "qualified_name", F.col("file").alias("node_file"), "signature", "definition", *(["kind"] if "kind" in symbols.columns else [F.lit("").alias("kind")]))
    # each way: the columns that it looks up, what a reference looks for in them, whether one definition decides, whether type uses matter
    ladder: dict[str, tuple[list[str], list[Column], bool, bool]] = {
        "same_file": (["name", "node_file"], [short, F.col("file")], False, True),
        "qualified": (["qualified_name"], [target], True, False),
        "module": (["qualified_name"], [whole], True, False),
        "global": (["name"], [short], False, True),
    }
    tables, small = {}, True
    for way, (key, _, decides, _) in ladder.items():
        if way != "module":
            tables[way] = scratch.stored(_answers(s, key, decides), "answers")
            small = small and tables[way].count() <= BROADCAST_ANSWERS
    tables["module"] = tables["qualified"]

    def met(rows: DataFrame) -> DataFrame:
        for way, (key, asked, _, by_use) in ladder.items():
            found = tables[way].select(*(F.col(c).alias(f"_{way}_{c}") for c in key), *(F.col(c).alias(f"_{way}_{c}") for c in ("n", "picked", "n_type", "picked_type")))
            same = functools.reduce(operator.and_, (a == F.col(f"_{way}_{c}") for a, c in zip(asked, key, strict=True)))
            part = lambda c, w=way, use=by_use: F.when(F.col("_type_use"), F.col(f"_{w}_{c}_type")).otherwise(F.col(f"_{w}_{c}")) if use else F.col(f"_{w}_{c}")
            answer = F.when(part("n") > 0, F.struct(part("n").alias("n"), part("picked").alias("picked")))
            rows = rows.join(F.broadcast(found) if small else found, same, "left").select(*rows.columns, answer.alias(way))
        return rows

    if small:
        out = met(refs)
    else:
        names = ["raw_name", "target_module", "file", "_type_use"]
        looked = met(refs.select(*names).distinct())
        out = refs.join(looked, functools.reduce(operator.and_, (refs[c].eqNullSafe(looked[c]) for c in names))).select(refs["*"], *(looked[w] for w in ladder))
    way = F.when(F.col("call_kind") == "indirect", F.lit(None).cast("string"))
    for name in ladder:
        way = way.when(F.col(name).isNotNull(), F.lit(name))
    out = out.withColumn("strategy", way)
    out = out.withColumn("_chosen", F.coalesce(*(F.when(F.col("strategy") == w, F.col(w)) for w in ladder))).drop(*ladder)
    # a reference never means its owner: one candidate less where the owner is among them
    own = s.groupBy(F.col("node").alias("owner_id")).agg(F.collect_set(F.struct("name", "qualified_name", "node_file", "kind")).alias("_own"))
    fits = lambda o: ~F.col("_type_use") | ~o["kind"].isin(*CALLABLE)
    is_met = lambda o: F.when(F.col("strategy") == "same_file", (o["name"] == short) & (o["node_file"] == F.col("file")) & fits(o)).when(F.col("strategy") == "qualified", o["qualified_name"] == target).when(F.col("strategy") == "module", o["qualified_name"] == whole).when(F.col("strategy") == "global", (o["name"] == short) & fits(o))
    out = out.join(own, "owner_id", "left")
    itself = F.coalesce(F.exists("_own", is_met), F.lit(False))
    unsafe = F.col("_receiver_unsafe") & F.col("strategy").isin("same_file", "global")
    picked = F.col("_chosen.picked")
    out = out.withColumn("n_candidates", F.coalesce(F.col("_chosen.n"), F.lit(0)) - itself.cast("long"))
    out = out.withColumn("resolved_id", F.when(~picked.eqNullSafe(F.col("owner_id")) & ~unsafe, picked))
    state = F.when(F.col("resolved_id").isNotNull(), "resolved").when((F.col("n_candidates") > 0) & (picked.isNull() | unsafe), "ambiguous").otherwise("unresolved")
    out = out.withColumn("status", state)
    sure = F.lit(0.0)
    for name, value in CONFIDENCE.items():
        sure = F.when((F.col("status") == "resolved") & (F.col("strategy") == name), F.lit(value)).otherwise(sure)
    return out.select(*references.columns, "strategy", "n_candidates", "resolved_id", "status", sure.alias("confidence"))


def resolve_named(calls: DataFrame, names: DataFrame, owners: DataFrame, symbols: DataFrame, targets: DataFrame | None = None, resolved_only: bool = False) -> DataFrame:
    """``resolve`` without imports for references in three tables: ``calls(owner_id, name_id, ...)``, ``names(name_id,
    raw_name, target_module, call_kind)`` and ``owners(owner_id, file)``; a reference is a row of their inner join.

    Gives the columns of calls, call_kind, strategy, resolved_id and status. A name is looked up once, whatever number
    of references bear it, and no reference carries a text but that of a few fixed words: calls move once to their
    names and once to their owners. Only symbols of files that owners lie in are looked up by file. ``names`` may have
    type_use and receiver_unsafe. ``resolved_only`` leaves the others out, those of the lookups without a file before
    they move to their owners; then the columns of ``targets(resolved_id, ...)`` may be added, which meet the answers
    and not the references.
    """
    if targets is not None and not resolved_only:
        raise ValueError("targets only stand beside resolved references")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in names.columns else F.lit(False)
    asked = names.withColumn("_type_use", flag("type_use")).withColumn("_unsafe", flag("receiver_unsafe"))
    target = F.regexp_replace("raw_name", r"^\.+|\.+$", "")
    asked = asked.withColumn("_target", target).withColumn("_last", F.element_at(F.split("_target", r"\."), -1))
    asked = asked.withColumn("_whole", F.when(F.col("target_module").isNotNull(), F.concat_ws(".", "target_module", "_target")))
    asked = asked.select("name_id", "call_kind", "_type_use", "_unsafe", "_target", "_last", "_whole")
    s = symbols.select(F.col("id").alias("node"), "name", "qualified_name", F.col("file").alias("node_file"), "signature", "definition", *(["kind"] if "kind" in symbols.columns else [F.lit("").alias("kind")]))

    def met(rows: DataFrame, found: DataFrame, same: Column) -> DataFrame:
        return rows.join(F.broadcast(found) if found.count() <= BROADCAST_ANSWERS else found, same, "left")

    # lookups that need no file
    qualified, anywhere = (scratch.stored(_answers(s, [key], decides), "answers") for key, decides in (("qualified_name", True), ("name", False)))
    found = []
    for way, table, key, by_use in (("qualified", qualified, "_target", False), ("module", qualified, "_whole", False), ("global", anywhere, "_last", True)):
        asked = met(asked, table.select(*(F.col(c).alias(f"_{way}_{c}") for c in table.columns)), F.col(key) == F.col(f"_{way}_{table.columns[0]}"))
        part = lambda c, w=way, use=by_use: F.when(F.col("_type_use"), F.col(f"_{w}_{c}_type")).otherwise(F.col(f"_{w}_{c}")) if use else F.col(f"_{w}_{c}")
        found.append(F.when(part("n") > 0, F.struct(F.lit(way).alias("strategy"), F.least(part("n"), F.lit(2)).alias("n"), part("picked").alias("picked"))))
    direct = ~F.col("call_kind").eqNullSafe("indirect")
    asked = asked.withColumn("_found", F.when(direct, F.coalesce(*found)))
    answer = ["strategy", "_n", "_picked"]
    asked = asked.select("name_id", "call_kind", "_type_use", "_unsafe", "_last", F.col("_found.strategy").alias("strategy"), F.col("_found.n").alias("_n"), F.col("_found.picked").alias("_picked"))

    # the lookup by file: of symbols in files of owners; their names get short keys
    owners = scratch.stored(owners.select("owner_id", "file"), "owners")
    files = owners.select(F.col("file").alias("node_file")).distinct()
    near = _answers(s, ["name", "node_file"], False).join(files, "node_file", "left_semi")
    use = [F.struct(F.lit(u).alias("use"), F.least(F.col("n" + c), F.lit(2)).alias("n"), F.col("picked" + c).alias("picked")) for u, c in ((False, ""), (True, "_type"))]
    near = near.select("name", "node_file", F.inline(F.array(*use))).where("n > 0")
    near = scratch.stored(near, "answers")
    by_file = not near.isEmpty()
    if by_file:
        keys = scratch.stored(near.select("name").distinct().withColumn("_short", F.monotonically_increasing_id()), "names")
        near = near.join(keys, "name").select(F.col("_short").alias("_near"), "node_file", "use", F.col("n").alias("_near_n"), F.col("picked").alias("_near_picked"))
        asked = met(asked, keys, F.col("_last") == F.col("name")).withColumn("_short", F.when(direct, F.col("_short"))).drop("name")
    if resolved_only:
        asked = asked.where(F.col("_picked").isNotNull() | (F.col("_short").isNotNull() if by_file else F.lit(False)))
    shown = []
    if targets is not None:
        shown = [c for c in targets.columns if c != "resolved_id"]
        asked = asked.join(targets, F.col("_picked") == F.col("resolved_id"), "left").drop("resolved_id")
        if by_file:
            near = near.join(targets.withColumnsRenamed({c: f"_near_{c}" for c in shown}), F.col("_near_picked") == F.col("resolved_id"), "left").drop("resolved_id")

    out = calls.join(asked.drop("_last"), "name_id").join(owners, "owner_id")
    if by_file:
        # a reference whose name no such file has meets nothing, and not all in one place
        key = F.coalesce("_short", -1 - F.shiftrightunsigned(F.xxhash64("owner_id"), 1))
        out = met(out, scratch.stored(near, "answers"), (key == F.col("_near")) & (F.col("file") == F.col("node_file")) & (F.col("_type_use") == F.col("use")))
        at = F.col("_near").isNotNull()
        out = out.withColumns({c: F.when(at, new).otherwise(F.col(c)) for c, new in zip([*answer, *shown], [F.lit("same_file"), *(F.col(f"_near{c}") for c in answer[1:]), *(F.col(f"_near_{c}") for c in shown)], strict=True)})
    unsafe = F.col("_unsafe") & F.col("strategy").isin("same_file", "global")
    itself = F.col("_picked").eqNullSafe(F.col("owner_id"))
    out = out.withColumn("resolved_id", F.when(~itself & ~unsafe, F.col("_picked")))
    # a sole candidate is picked; of several, one at least is not the owner
    others = (F.col("_n") > 1) | ((F.col("_n") == 1) & ~itself)
    state = F.when(F.col("resolved_id").isNotNull(), "resolved").when(others & (F.col("_picked").isNull() | unsafe), "ambiguous").otherwise("unresolved")
    if resolved_only:
        out = out.where("resolved_id is not null")
    return out.select(*calls.columns, "call_kind", "strategy", "resolved_id", state.alias("status"), *shown)
