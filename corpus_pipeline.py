"""Corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, SentencePiece encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom import scratch
from factloom.llm import decontam, jaccard_join, line_dedup, pieces, quality
from factloom.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.kept_documents(docs)


def site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source."""
    return line_dedup.line_dedup(docs).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the least doc_id."""
    return jaccard_join.one_of_each(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text that they decode to."""
    return pieces.encode(docs, tokenizer("piece_bpe_32k.model"), decode=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", site_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmarks),
    ("SentencePiece encoding", encoded),
]

#: The ids of the last stage have no form in SQL; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if k + 1 < len(STAGES):
            rows = scratch.stored(rows, f"stage-{k}")
    return rows
