"""Contract queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import decontam, html_extract, jaccard_join, licenses, line_dedup, pieces, quality, substring_dedup, token_counts, token_store


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality_cascade(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir)).drop("spans")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_dropped")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.html_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_files(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_quality_rules,
        op2_sentencepiece,
        op3_substring_dedup,
        op4_license_scan,
        op5_benchmark_decontamination,
        op6_token_counts,
        op7_jaccard_join,
        op8_line_dedup,
        op9_html_text,
        op10_token_files,
    )
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality.sql(),
        "op3_substring_dedup": substring_dedup.sql(),
        "op5_benchmark_decontamination": decontam.SQL,
        "op7_jaccard_join": jaccard_join.SQL,
        "op8_line_dedup": line_dedup.sql(),
    }
