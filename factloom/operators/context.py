"""What surrounds a symbol, a document or a shard, answered for all of them at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom import scratch
from factloom.functions import ids

#: Relations between documents and code; fixed values.
CROSS = ["DESCRIBES", "CONSTRAINS", "IMPLEMENTED_BY", "VERIFIED_BY", "BELONGS_TO", "DOCUMENTS"]
#: Sections of a symbol's context in the order in which they are kept.
_SECTIONS = {"primary": 0, "relation": 1, "candidate": 2}


def _first(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group with place; Spark cuts each partition to ``k`` a group before it shuffles."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def _same(id_: Column | str) -> Column:
    """The text of an id that is a text."""
    return F.col(id_) if isinstance(id_, str) else id_


def _numbered(rows: DataFrame, columns: list[str], text: Callable[..., Column]) -> DataFrame:
    """``columns`` of ``rows(id, qualified_name)`` and number, which grows by qualified name, then by the text of the id;
    stored, so that wide rows carry a number in place of both."""
    ranged = rows.select("id", "qualified_name").repartitionByRange("qualified_name").sortWithinPartitions("qualified_name", text("id"))
    return scratch.stored(ranged.select(*columns, F.monotonically_increasing_id().alias("number")), "numbered")


def linked(links: DataFrame, others: DataFrame, relations: list[str], incoming: bool) -> DataFrame:
    """anchor, relation, id, kind, qualified_name, each once: what resolved ``links`` of the relations join.

    Going out the anchor is a document and ``others`` is code, coming in the anchor is a symbol and ``others`` is
    documents. Links whose other end is not in ``others`` go.
    """
    here, there = ("target_id", "source_id") if incoming else ("source_id", "target_id")
    rows = links.where((F.col("status") == "resolved") & F.col("relation").isin(relations))
    rows = rows.select(F.col(here).alias("anchor"), "relation", F.col(there).alias("id")).distinct()
    return rows.join(others.select("id", "kind", "qualified_name"), "id")


def resolve_document(documents: DataFrame, text: str) -> DataFrame:
    """The document that ``text`` names, by id, qualified name, name or path without case: an equal field comes before
    one that holds it, then the least qualified name, then the least id. No row if there is none."""
    wanted = text.casefold()
    fields = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("id", "qualified_name", "name", "path")]
    equal, holds = F.lit(False), F.lit(False)
    for f in fields:
        equal, holds = equal | (f == wanted), holds | ((f != "") & f.contains(wanted))
    return documents.withColumn("rank", F.when(equal, 0).otherwise(1)).where(equal | holds).orderBy("rank", "qualified_name", "id").limit(1)


def related_code(links: DataFrame, nodes: DataFrame, max_edges: int = 12) -> DataFrame:
    """Code that documents name: document, role, relation, id, name, place, total.

    Role ``resolved`` lists links to code by qualified name, ``candidate`` the anchors that are ambiguous or lead
    nowhere. Up to ``max_edges`` of each role are shown; ``total`` counts all of them.
    """
    code = nodes.select(F.col("id").alias("target_id"), F.col("qualified_name").alias("name"))
    sure = links.where((F.col("status") == "resolved") & F.col("relation").isin(CROSS)).join(code, "target_id")
    sure = sure.select(F.col("source_id").alias("document"), F.lit("resolved").alias("role"), "relation", F.col("target_id").alias("id"), "name")
    open_ = links.where("status <> 'resolved'").select(F.col("source_id").alias("document"), F.lit("candidate").alias("role"), F.lit("CANDIDATE").alias("relation"), "id", F.col("raw_anchor").alias("name"))
    rows = sure.unionByName(open_).distinct()
    total = rows.groupBy("document", "role").agg(F.count(F.lit(1)).alias("total"))
    return _first(rows, ["document", "role"], ["name", "id", "relation"], max_edges).join(total, ["document", "role"])


def related_code_summary(links: DataFrame, documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row for each document: resolved links, shards that they reach, candidates, and whether anything is uncertain
    (a candidate is left, or no link is resolved)."""
    code = nodes.select(F.col("id").alias("target_id"), "shard")
    sure = links.where((F.col("status") == "resolved") & F.col("relation").isin(CROSS)).join(code, "target_id")
    # one row for each shard first, so that the count of shards is of few rows
    sure = sure.groupBy("source_id", "shard").agg(F.count(F.lit(1)).alias("n"))
    sure = sure.groupBy("source_id").agg(F.sum("n").alias("links"), F.count("shard").alias("shards"))
    open_ = links.where("status <> 'resolved'").groupBy("source_id").agg(F.count(F.lit(1)).alias("candidates"))
    rows = documents.select("id").join(sure, F.col("id") == sure["source_id"], "left").drop("source_id").join(open_, F.col("id") == open_["source_id"], "left").drop("source_id")
    rows = rows.fillna(0, ["links", "shards", "candidates"])
    return rows.withColumn("uncertain", (F.col("candidates") > 0) | (F.col("links") == 0))


def related_documents(links: DataFrame, documents: DataFrame, max_sections: int = 6, text: Callable[..., Column] = _same) -> DataFrame:
    """Documents that name a symbol: symbol, id, qualified_name, place, total. Symbols without any have no row."""
    rows = links.where((F.col("status") == "resolved") & F.col("relation").isin(CROSS)).select(F.col("target_id").alias("symbol"), F.col("source_id").alias("id")).distinct()
    rows = rows.join(_numbered(documents.select("id", "qualified_name").distinct(), ["id", "qualified_name"], text), "id")
    total = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("total"))
    return _first(rows, ["symbol"], ["number"], max_sections).join(total, "symbol").drop("number")


def _around(edges: DataFrame) -> DataFrame:
    """symbol, section, id, each once: callers and callees of both ends of a call, and referrers; one pass over edges."""
    calls = F.array(
        F.struct(F.col("dst_id").alias("symbol"), F.lit(0).alias("section"), F.col("src_id").alias("id")),
        F.struct(F.col("src_id").alias("symbol"), F.lit(1).alias("section"), F.col("dst_id").alias("id")),
    )
    refers = F.array(F.struct(F.col("dst_id").alias("symbol"), F.lit(2).alias("section"), F.col("src_id").alias("id")))
    rows = edges.where("type IN ('CALLS', 'REFERENCES')")
    return rows.select(F.explode(F.when(F.col("type") == "CALLS", calls).otherwise(refers)).alias("e")).select("e.*").distinct()


def _near(nodes: DataFrame, edges: DataFrame, k: int, text: Callable[..., Column]) -> DataFrame:
    """symbol, section, id, place, total: the first ``k`` of a symbol's callers, callees and referrers, in this order and
    by qualified name; both the symbol and the id are nodes."""
    met = _around(edges).join(_numbered(nodes, ["id"], text), "id")
    total = met.groupBy("symbol").agg(F.count(F.lit(1)).alias("total"))
    # a symbol that stands in nodes more than once has every row as often
    here = nodes.groupBy(F.col("id").alias("symbol")).agg(F.count(F.lit(1)).alias("copies"))
    rows = _first(met, ["symbol"], ["section", "number"], k).join(total, "symbol").join(here, "symbol")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    place = ((F.col("place") - 1) * F.col("copies") + F.col("copy")).cast("int")
    return rows.select("symbol", "section", "id", place.alias("place"), (F.col("total") * F.col("copies")).alias("total")).where(F.col("place") <= k)


def _way() -> Column:
    return F.when(F.col("section") == 0, "caller").when(F.col("section") == 1, "callee").otherwise("reference")


def explain_symbol(nodes: DataFrame, edges: DataFrame, links: DataFrame, documents: DataFrame, max_edges: int = 12, max_sections: int = 6, text: Callable[..., Column] = _same) -> DataFrame:
    """symbol, section, id, place, total of every symbol.

    Its definition and its shard; up to ``max_edges`` callers, then callees, then referrers, by qualified name (total
    counts the three together); up to ``max_sections`` documents that name it. Ids may be short keys of which ``text``
    writes the id; they are written last.
    """
    one = (F.lit(1).alias("place"), F.lit(1).cast("long").alias("total"))
    own = nodes.select(text("id").alias("symbol"), F.lit("definition").alias("section"), text("id").alias("id"), *one)
    shard = nodes.where("shard IS NOT NULL").select(text("id").alias("symbol"), F.lit("shard").alias("section"), F.col("shard").alias("id"), *one)
    written = lambda rows, section: rows.select(text("symbol").alias("symbol"), section.alias("section"), text("id").alias("id"), "place", "total")
    near = written(_near(nodes, edges, max_edges, text), _way())
    named = written(related_documents(links, documents, max_sections, text), F.lit("document"))
    return own.unionByName(shard).unionByName(near).unionByName(named)


def explain_module(nodes: DataFrame, boundary: DataFrame, links: DataFrame) -> DataFrame:
    """One row for each shard: symbols, public_symbols (met by a boundary edge), outbound and inbound shards, and the
    documents that name a symbol of it."""
    size = nodes.groupBy("shard").agg(F.count(F.lit(1)).alias("symbols"))
    public = boundary.select(F.col("dst_shard").alias("shard"), "dst_id").distinct().groupBy("shard").agg(F.count(F.lit(1)).alias("public_symbols"))
    pairs = boundary.select("src_shard", "dst_shard").distinct()
    out = pairs.groupBy(F.col("src_shard").alias("shard")).agg(F.count(F.lit(1)).alias("outbound"))
    into = pairs.groupBy(F.col("dst_shard").alias("shard")).agg(F.count(F.lit(1)).alias("inbound"))
    told = links.where((F.col("status") == "resolved") & F.col("relation").isin(CROSS)).join(nodes.select(F.col("id").alias("target_id"), "shard"), "target_id")
    told = told.select("shard", "source_id").distinct().groupBy("shard").agg(F.count(F.lit(1)).alias("documents"))
    rows = size
    for part in (public, out, into, told):
        rows = rows.join(part, "shard", "left")
    return rows.fillna(0)


def module_symbols(nodes: DataFrame, boundary: DataFrame, max_symbols: int = 8) -> DataFrame:
    """The first symbols of each shard, public ones first, then by qualified name: shard, id, public, place."""
    met = boundary.select(F.col("dst_id").alias("id")).distinct().withColumn("public", F.lit(True))
    rows = nodes.select("shard", "id", "qualified_name").join(met, "id", "left").fillna(False, ["public"])
    return _first(rows, ["shard"], [F.desc("public"), "qualified_name", "id"], max_symbols).select("shard", "id", "public", "place")


def task_context(nodes: DataFrame, edges: DataFrame, references: DataFrame, relations: int = 12, candidates: int = 6, cap: int = 6000, text: Callable[..., Column] = _same, reference_text: Callable[..., Column] = _same) -> DataFrame:
    """symbol, section, place, fact_id, id, kept: a compact context of every symbol.

    ``primary`` is the symbol and its first neighbour; ``relation`` its first callers, callees and referrers;
    ``candidate`` what its references that are not resolved may mean (``references(id, owner_id, status,
    start_line, candidates)``; one without candidates stands for itself). Facts are kept from the front as long as
    their JSON takes ``cap`` bytes at most; the symbol itself always is. Ids of nodes and of references may be short
    keys, the latter in the order of their texts; ``text`` and ``reference_text`` write them where a symbol's rows have
    met. Candidates are texts.
    """
    near = _near(nodes, edges, relations, text)
    primary = lambda place: F.struct(F.lit("primary").alias("section"), F.lit(place).alias("place"), F.lit(None).cast("int").alias("way"), "id")
    relation = F.struct(F.lit("relation").alias("section"), "place", F.col("section").alias("way"), "id")
    near = near.select("symbol", F.explode(F.when(F.col("place") == 1, F.array(primary(2), relation)).otherwise(F.array(relation))).alias("e")).select("symbol", "e.*")
    own = nodes.select(F.col("id").alias("symbol"), primary(1).alias("e")).select("symbol", "e.*")
    unsure = references.where("status <> 'resolved'").select(F.col("owner_id").alias("symbol"), F.col("id").alias("reference"), "start_line", F.explode_outer("candidates").alias("name"))
    unsure = unsure.join(nodes.select(F.col("id").alias("symbol")), "symbol")
    unsure = _first(unsure, ["symbol"], ["start_line", "reference", F.asc_nulls_first("name")], candidates).select("symbol", F.lit("candidate").alias("section"), "place", "reference", "name")
    # at most 2 + relations + candidates rows a symbol, so no window is large
    rows = own.unionByName(near).unionByName(unsure, allowMissingColumns=True).repartition("symbol")
    fact = F.when(F.col("section") == "primary", F.concat(F.lit("symbol:"), text("id")))
    fact = fact.when(F.col("section") == "relation", F.concat_ws(":", F.lit("relation"), F.when(F.col("way") == 0, "caller").when(F.col("way") == 1, "callee").otherwise("reference"), text("symbol"), text("id")))
    fact = fact.when(F.col("name").isNull(), F.concat(F.lit("unresolved:"), reference_text("reference"))).otherwise(F.concat_ws(":", F.lit("candidate"), reference_text("reference"), "name"))
    rows = rows.withColumn("fact_id", fact)
    order = F.element_at(F.create_map(*(F.lit(x) for kv in _SECTIONS.items() for x in kv)), F.col("section"))
    size = F.octet_length(F.to_json(F.struct("section", "fact_id")))
    upto = F.sum(size).over(W.partitionBy("symbol").orderBy(order, "place").rowsBetween(W.unboundedPreceding, 0))
    kept = (upto <= cap) | ((F.col("section") == "primary") & (F.col("place") == 1))
    shown = F.when(F.col("section") == "candidate", F.col("name")).otherwise(text("id"))
    return rows.withColumn("kept", kept).select(text("symbol").alias("symbol"), "section", "place", "fact_id", shown.alias("id"), "kept")


def span(text: Column, start: Column, end: Column, most: int = 20) -> Column:
    """start_line, end_line, start_byte, end_byte, content of the lines ``start`` to ``end`` (from 1, both included) of a
    text, ``most`` of them, which is the size of a shown span; null if the text is null or ends before them."""
    lines = F.split(text, "\n", -1)
    a = F.greatest(F.coalesce(start, F.lit(1)), F.lit(1)).cast("int")
    b = F.least(F.greatest(F.coalesce(end, a), a), F.size(lines), a + most - 1).cast("int")
    content = F.array_join(F.slice(lines, a, b - a + 1), "\n")
    before = F.when(a > 1, F.octet_length(F.array_join(F.slice(lines, F.lit(1), a - 1), "\n")) + 1).otherwise(F.lit(0))
    made = F.struct(a.alias("start_line"), b.alias("end_line"), before.alias("start_byte"), (before + F.octet_length(content)).alias("end_byte"), content.alias("content"))
    return F.when(text.isNotNull() & (a <= F.size(lines)), made)


def evidence_rows(nodes: DataFrame, documents: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """What each fact is written from: prefix, own (id of a node or document), edge, link (their ids), src, dst, name, and
    sure for links that are resolved."""

    def rows(df: DataFrame, prefix: str, **columns: Column | str) -> DataFrame:
        named = {"own": nodes.schema["id"].dataType, "edge": edges.schema["id"].dataType, "link": links.schema["id"].dataType, "src": edges.schema["src_id"].dataType, "dst": edges.schema["dst_id"].dataType, "name": "string", "sure": "boolean"}
        made = [(F.col(columns[c]) if isinstance(columns[c], str) else columns[c]).alias(c) if c in columns else F.lit(None).cast(kind).alias(c) for c, kind in named.items()]
        return df.select(F.lit(prefix).alias("prefix"), *made)

    # each branch has one prefix, so that Spark reduces what is written from it to the columns of the branch
    out = rows(nodes, "CODE", own="id", name="file").unionByName(rows(documents, "DOC", own="id"))
    for prefix, only in (("CALL", "type = 'CALLS'"), ("REF", "type = 'REFERENCES'"), ("DEP", "type NOT IN ('CALLS', 'REFERENCES')")):
        out = out.unionByName(rows(edges.where(only), prefix, edge="id", src="src_id", dst="dst_id", name="type"))
    # a link's name is its anchor if it has no target
    anchor = F.when(F.col("target_id").isNull(), F.coalesce("raw_anchor", F.lit("")))
    return out.unionByName(rows(links, "XLINK", link="id", src="source_id", dst="target_id", name=anchor, sure=F.coalesce(F.col("status") == "resolved", F.lit(False))))


def evidence_columns(repository: str, text: Callable[..., Column] = _same, edge_text: Callable[..., Column] = lambda src, dst, kind, key: key, link_text: Callable[..., Column] = _same) -> list[Column]:
    """evidence_id, fact, source, relation, target of an evidence row; the id hashes all that follow it, so it finds them."""
    prefix, own, name, src, dst = (F.col(c) for c in ("prefix", "own", "name", "src", "dst"))
    code, doc, edge = prefix == "CODE", prefix == "DOC", F.col("prefix").isin("CALL", "REF", "DEP")
    fact = F.when(code | doc, text("own")).when(edge, edge_text(src, dst, name, F.col("edge"))).otherwise(link_text(F.col("link")))
    source = F.when(code, F.coalesce(name, text("own"))).when(doc, text("own")).otherwise(text("src"))
    relation = F.when(code, "DEFINES").when(edge, name).when(doc | F.col("sure"), "DOCUMENTS").otherwise("CANDIDATE")
    target = F.when(code | doc, text("own")).otherwise(F.coalesce(text("dst"), F.concat(F.lit("raw:"), name)))
    kind = F.when(code, "CODE_DEFINITION").when(doc, "DOCUMENT_SECTION").when(prefix == "CALL", "CALL_RELATION").when(prefix == "REF", "REFERENCE").when(prefix == "DEP", "DEPENDENCY").otherwise("CROSS_LAYER_LINK")
    made = ids.evidence_id("", F.lit(repository), kind, source, relation, target, fact)
    id_ = F.concat(F.lit("E-"), prefix, F.substring(made, 3, 25))
    return [id_.alias("evidence_id"), fact.alias("fact"), source.alias("source"), relation.alias("relation"), target.alias("target")]


def evidence_facts(repository: str, nodes: DataFrame, documents: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """evidence_id, fact, source, relation, target of every fact."""
    return evidence_rows(nodes, documents, edges, links).select(*evidence_columns(repository))


def packed(evidence_id: Column | str) -> Column:
    """An evidence id in few bytes, each id its own: prefix and digest, or the whole text after a zero if it has another form."""
    e = F.col(evidence_id) if isinstance(evidence_id, str) else evidence_id
    prefix = F.regexp_extract(e, r"^E-([A-Z]+)-[0-9a-f]{24}\z", 1)
    return F.when(prefix != "", F.concat(F.encode(prefix, "UTF-8"), F.unhex(F.right(e, F.lit(24))))).otherwise(F.concat(F.unhex(F.lit("00")), F.encode(e, "UTF-8")))


def unpacked(packed_id: Column | str) -> Column:
    p = F.col(packed_id) if isinstance(packed_id, str) else packed_id
    prefix, digest = F.decode(F.substring(p, F.lit(1), F.octet_length(p) - 12), "UTF-8"), F.lower(F.hex(F.substring(p, -12, 12)))
    return F.when(F.substring(p, 1, 1) == F.unhex(F.lit("00")), F.decode(F.substring(p, F.lit(2), F.octet_length(p)), "UTF-8")).otherwise(F.concat(F.lit("E-"), prefix, F.lit("-"), digest))


def trace_evidence(requests: DataFrame, facts: DataFrame, columns: list[Column] | None = None) -> DataFrame:
    """The fact behind each distinct id of ``requests(evidence_id)``, with found; ids of no fact have nulls.

    ``facts(evidence_id, ...)`` are evidence facts, or with ``columns`` evidence rows beside their id, from which those
    columns are written after the requests have met them. Ids travel packed.
    """
    wanted = requests.select(packed("evidence_id").alias("evidence")).distinct()
    held = facts.select(packed("evidence_id").alias("evidence"), *(c for c in facts.columns if c != "evidence_id"), F.lit(True).alias("met"))
    rows = wanted.join(held, "evidence", "left").withColumn("found", F.col("met").isNotNull())
    if columns is None:
        return rows.select(unpacked("evidence").alias("evidence_id"), *(c for c in facts.columns if c != "evidence_id"), "found")
    names = ["evidence_id", "fact", "source", "relation", "target"]
    shown = [F.when(F.col("found"), c).alias(n) for n, c in zip(names, columns, strict=True) if n != "evidence_id"]
    return rows.select(unpacked("evidence").alias("evidence_id"), *shown, "found")
