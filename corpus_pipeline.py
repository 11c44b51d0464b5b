"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs.  All but the last return
the columns of documents, further ones included.  SQL cannot express the
stages; tests compare them with brute force on small tables.  An empty table
stays empty in every stage, and texts of any length are worked on whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fathomline.llm import common, langid, mixing, neardup, packing, substrings


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay.

    Null texts and texts without a letter go; rows that repeat are told alike.
    """
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near-duplicates stays, that of the least doc_id.

    Repeated rows are copies, and so are all empty or null texts of one another.
    """
    return neardup.drop_near_duplicates(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out of the later ones.

    Null and empty texts stay as they are; a text that was all repeats stays as
    an empty one.  Of repeated rows the first keeps its text.
    """
    return substrings.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated so that sources near their target weights, and shuffled.

    A null source is a source.  Rows of equal id share their number of copies;
    rows without id draw by their text.
    """
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence of at most 2048 tokens.

    Null and empty texts are the end id alone; rows that repeat are packed as
    often as they occur.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to shared storage and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{common.scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
