"""Documents as sections and anchors, and anchors linked to code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LEVELS = range(1, 7)
#: Confidence of each kind of anchor; fixed values.
CONFIDENCE = {"requirement": 1.0, "file": 1.0, "module": 0.9, "qualified": 1.0, "symbol": 0.7}


def sections(docs: DataFrame) -> DataFrame:
    """Sections of ``docs(doc, text)`` by ATX headings: doc, level, title, heading_path, start_line, end_line.

    The path holds the titles of the enclosing headings and its own; the n-th section of a document with an equal path
    gets ``[n]`` from the second on. Lines count from 1. Text before the first heading is in no section.
    """
    lines = docs.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s+\S", 1))
    title = F.trim(F.regexp_extract("line", r"^#{1,6}\s+(.*?)\s*#*\s*$", 1))
    of = W.partitionBy("doc").orderBy("pos")
    total = F.max("pos").over(W.partitionBy("doc"))
    heads = lines.withColumn("last", total).withColumn("level", level).where("level > 0").withColumn("title", title)
    upto = of.rowsBetween(W.unboundedPreceding, -1)
    for k in LEVELS:
        heads = heads.withColumn(f"p{k}", F.last_value(F.when(F.col("level") == k, F.struct("pos", "title")), True).over(upto))
    parts = []
    for k in LEVELS:
        above = F.greatest(F.lit(-1), *(F.coalesce(F.col(f"p{j}.pos"), F.lit(-1)) for j in range(1, k)), F.lit(-1))
        parts.append(F.when((F.lit(k) < F.col("level")) & (F.col(f"p{k}.pos") > above), F.col(f"p{k}.title")))
    path = F.array_join(F.array_compact(F.array(*parts, F.col("title"))), " / ")
    rows = heads.withColumn("path", path).withColumn("end_line", F.coalesce(F.lead("pos").over(of), F.col("last") + 1))
    n = F.row_number().over(W.partitionBy("doc", "path").orderBy("pos"))
    named = F.when(n > 1, F.concat("path", F.lit("["), n.cast("string"), F.lit("]"))).otherwise(F.col("path"))
    return rows.select("doc", "level", "title", named.alias("heading_path"), (F.col("pos") + 1).alias("start_line"), "end_line")


def anchors(docs: DataFrame) -> DataFrame:
    """doc, kind, anchor: ``[kind:value]`` tags, names in backticks and requirement ids, each once."""
    text = F.col("text")
    tag = F.transform(F.regexp_extract_all(text, F.lit(r"\[(?:module|file|symbol):[^\]\n]+\]"), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, r"\[(\w+):", 1).alias("kind"), F.regexp_extract(x, r":([^\]]+)\]", 1).alias("anchor")))
    tick = F.transform(F.regexp_extract_all(text, F.lit(r"`([^`\n]+)`"), F.lit(1)), lambda x: F.struct(F.when(x.rlike(r"\.(py|c|h|cpp|hpp|java)$"), "file").otherwise("symbol").alias("kind"), x.alias("anchor")))
    need = F.transform(F.regexp_extract_all(text, F.lit(r"\bREQ-[0-9]+\b"), F.lit(0)), lambda x: F.struct(F.lit("requirement").alias("kind"), x.alias("anchor")))
    return docs.select("doc", F.explode(F.array_distinct(F.concat(tag, tick, need))).alias("a")).select("doc", "a.kind", "a.anchor")


def section_kind(title: Column, path: Column) -> Column:
    """Requirement, AcceptanceCriterion, Constraint, ArchitectureSection or DocumentSection."""
    t = F.lower(title)
    return F.when(t.rlike(r"\breq-[0-9]+\b|requirement"), "Requirement").when(t.contains("acceptance"), "AcceptanceCriterion").when(t.contains("constraint"), "Constraint").when(t.contains("architecture") | F.lower(path).contains("architecture"), "ArchitectureSection").otherwise("DocumentSection")


def link(found: DataFrame, nodes: DataFrame, requirements: DataFrame) -> DataFrame:
    """Anchors with status (resolved if exactly one target), target, candidates (count) and confidence.

    A symbol is looked up by qualified name first and by bare name if that finds none. Distinct anchors meet the
    lookup; documents meet the answers.
    """
    keys = found.select("kind", "anchor").distinct()
    table = (
        requirements.select(F.lit("requirement").alias("kind"), "anchor", "target", F.lit("requirement").alias("way"))
        .unionByName(nodes.select(F.lit("module").alias("kind"), F.col("shard").alias("anchor"), F.col("shard").alias("target"), F.lit("module").alias("way")).distinct())
        .unionByName(nodes.select(F.lit("file").alias("kind"), F.col("file").alias("anchor"), F.col("file").alias("target"), F.lit("file").alias("way")).distinct())
        .unionByName(nodes.select(F.lit("symbol").alias("kind"), F.col("qualified_name").alias("anchor"), F.col("id").alias("target"), F.lit("qualified").alias("way")))
        .unionByName(nodes.where("name <> qualified_name").select(F.lit("symbol").alias("kind"), F.col("name").alias("anchor"), F.col("id").alias("target"), F.lit("symbol").alias("way")))
    )
    met = table.join(keys, ["kind", "anchor"]).groupBy("kind", "anchor", "way").agg(F.countDistinct("target").alias("n"), F.min("target").alias("target"))
    first = met.groupBy("kind", "anchor").agg(F.min_by(F.struct("way", "n", "target"), F.when(F.col("way") == "symbol", 1).otherwise(0)).alias("b"))
    rows = found.join(first, ["kind", "anchor"], "left")
    n = F.coalesce("b.n", F.lit(0))
    sure = F.lit(0.0)
    for way, value in CONFIDENCE.items():
        sure = F.when((n == 1) & (F.col("b.way") == way), F.lit(value)).otherwise(sure)
    status = F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved")
    return rows.select("doc", "kind", "anchor", status.alias("status"), F.when(n == 1, F.col("b.target")).alias("target"), n.alias("candidates"), sure.alias("confidence"))
