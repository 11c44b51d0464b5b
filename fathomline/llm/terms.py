"""Counts of distinct terms, and their join to the terms of every document.

A dictionary of terms grows with the corpus, so it is never broadcast whole.
Its most frequent terms, at most a fixed number, go to every worker; the terms
of a document that are not among them travel as (row, term, frequency) and are
joined by shuffle.  Frequent terms thus never meet in one task, and the rest
are few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_codes, slices

#: Terms sent to every worker, at most.
HEAD_TERMS = 1 << 19
#: Bytes of all of them, and of one, at most.
HEAD_BYTES, LONG_TERM = 8 << 20, 64

#: Texts -> (terms per text, code of every term, distinct terms by code)
Extract = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, pa.Array]]


def term_counts(docs: DataFrame, text_col: str, extract: Extract) -> DataFrame:
    """(term, n) over all texts; counted per batch first, so hot terms are cheap."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                _, codes, terms = extract(batch.column(0))
                n = np.bincount(codes, minlength=len(terms))
                yield pa.RecordBatch.from_arrays([terms.cast(pa.string()), pa.array(n, pa.int64())], ["term", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias(text_col)).mapInArrow(count, "term string, n long")
    return rows.groupBy("term").agg(F.sum("n").alias("n"))


def head(counts: DataFrame, most: int = HEAD_TERMS, most_bytes: int = HEAD_BYTES) -> pa.Table:
    """The most frequent rows of a (term, n, ...) table: about ``most``, and most_bytes of terms.

    Numbers of rows and bytes by n say where the border lies; of the rows that
    are just on it a share is taken by hash, so however many are equally
    frequent, the head is neither empty nor larger.  Terms over LONG_TERM bytes
    never belong to it.
    """
    key = counts.columns[0]
    size = F.octet_length(key) if dict(counts.dtypes)[key] == "string" else F.lit(8)
    short = counts.filter(size <= LONG_TERM).withColumn("_bin", F.least(F.col("n"), F.lit(1 << 20)))
    bins = short.groupBy("_bin").agg(F.count("*").alias("rows"), F.sum(size).alias("bytes")).orderBy(F.desc("_bin")).collect()
    border, share, rows, held = 0, 0, 0, 0
    for b in bins:
        border = b["_bin"]
        share = min(1.0, (most - rows) / b["rows"], (most_bytes - held) / max(b["bytes"], 1))
        rows, held = rows + b["rows"], held + b["bytes"]
        if share < 1:
            break
    drawn = F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30))
    return short.filter((F.col("_bin") > border) | ((F.col("_bin") == border) & drawn)).drop("_bin").toArrow()


def head_lookup(terms: pa.Array, known: pa.Array) -> np.ndarray:
    """For every distinct term its place among the known ones, or -1."""
    return pc.fill_null(pc.index_in(terms, value_set=known), -1).to_numpy(zero_copy_only=False)


def tail_rows(lens: np.ndarray, codes: np.ndarray, terms: pa.Array, place: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, term, frequency) of the terms whose place is -1."""
    far = place[codes] < 0
    owner = np.repeat(np.arange(len(lens)), lens)[far]
    row, code, freq = doc_codes(np.bincount(owner, minlength=len(lens)), codes[far], len(terms))
    return row, terms.take(pa.array(code)), freq


def join_tail(rows: DataFrame, dictionary: DataFrame, sums: dict[str, Column], keep: dict[str, Column]) -> DataFrame:
    """Bring the rows of a document together again.

    rows: row, term, freq and carried columns; a document has one base row
    with a null term, and one row per term of its tail.  dictionary: term and
    values.  sums are added up per row after the join, keep are aggregates of
    carried columns.  Base rows are spread by their row number.
    """
    spread = rows.withColumn("term", F.coalesce(F.col("term"), F.concat(F.lit(" \x00"), F.col("row").cast("string"))))
    joined = spread.join(dictionary, "term", "left")
    return joined.groupBy("row").agg(*(c.alias(k) for k, c in keep.items()), *(F.sum(c).alias(k) for k, c in sums.items())).drop("row")
