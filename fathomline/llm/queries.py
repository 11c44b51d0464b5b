"""Thin queries over the standard tables, one per operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, idcoder, langid, lm, mixing, neardup, packing, quality, substrings, tokencount


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_documents(spark, sf_dir))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_documents(spark, sf_dir))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_documents(spark, sf_dir)).select("doc_id", "class_id", "class_size")


def op6_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_spans(_documents(spark, sf_dir)).drop("row")


def op8_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idcoder.round_trip(_documents(spark, sf_dir))


def op9_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "source", "copy_no", "shuffle_key")


QUERIES = {f.__name__: f for f in (op1_packing, op2_language_id, op3_token_counts, op4_lm_scores, op5_near_duplicates, op6_learned_partitions, op7_substring_dedup, op8_range_coded_ids, op9_quality_divergence, op10_poisson_mixing)}
ORACLE_SQL: dict[str, str] = {"op10_poisson_mixing": mixing.oracle_sql()}
