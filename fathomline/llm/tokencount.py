"""Token counts: pieces counted once per distinct pre-token, joined and summed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, materialize, numbered, slices, sum_by_row
from .terms import HEAD_TERMS, head, head_lookup, join_tail, tail_rows, term_counts
from .tokens import vocabulary

_SPACED = re.compile(" *[^ ]+| +")


def pretokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Pre-tokens of a sentence-piece model whose pieces hold a space only in front.

    The model sees the text with one space before it; a pre-token is a run of
    spaces with the characters up to the next one, named without its first
    space.  No piece reaches over its border, so counts of pieces add up.
    """
    plain = pc.replace_substring(as_text(texts), "▁", " ")
    odd = pc.or_(pc.match_substring(plain, "  "), pc.or_(pc.starts_with(plain, " "), pc.ends_with(plain, " ")))
    empty = pc.equal(plain, "")
    simple = pc.invert(pc.or_(odd, empty)).to_numpy(zero_copy_only=False)
    parts = pc.split_pattern(plain, " ")
    lens = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    if not simple.all():
        at = np.concatenate([[0], np.cumsum(lens)])
        pieces, last = [], 0
        for i in np.flatnonzero(~simple):
            pieces.append(flat.slice(at[last], at[i] - at[last]))
            text = plain[int(i)].as_py()
            units = [u[1:] for u in _SPACED.findall(" " + text)] if text else []
            lens[i] = len(units)
            pieces.append(pa.array(units, pa.string()))
            last = i + 1
        pieces.append(flat.slice(at[last]))
        flat = pa.concat_arrays(pieces)
    d = flat.dictionary_encode()
    return lens, d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model",
                 limit: int = 4096, head_terms: int = HEAD_TERMS) -> DataFrame:
    """Tokens of every whole text, as the model's library counts them.

    Returns doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than limit).
    Ids are never made for documents: the library counts the pieces of each
    distinct pre-token once, in the whole corpus.  Null and empty texts count
    0; every row of the input gives one row, repeated or without id; other
    columns are ignored; an empty table gives no rows.
    """
    counts = term_counts(docs, text_col, pretokens)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=vocabulary(model))
        for batch in batches:
            terms = batch.column(0).to_pylist()
            n = [len(x) for x in sp.encode(terms, num_threads=1)]
            n = [k if t else 1 for k, t in zip(n, terms, strict=True)]  # a lone space at the end
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32())], ["term", "n", "pieces"])

    table = materialize(counts.mapInArrow(pieces, "term string, n long, pieces int"), "pieces")
    top = head(table, head_terms)
    shared = docs.sparkSession.sparkContext.broadcast((top["term"].combine_chunks(), top["pieces"].to_numpy()))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sizes = shared.value
        sizes = np.append(sizes, 0).astype(np.int64)  # place -1 counts nothing
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = as_text(batch.column(2))
                lens, codes, terms = pretokens(texts)
                place = head_lookup(terms, known)
                near = sum_by_row(sizes[place][codes], lens)
                row, term, freq = tail_rows(lens, codes, terms, place)
                ids, n = batch.column(0), len(lens)
                yield pa.RecordBatch.from_arrays(
                    [ids, batch.column(1), pa.nulls(n, pa.string()), pa.array(np.zeros(n, np.int64)), pa.array(near), pc.cast(pc.binary_length(texts), pa.int64())], names=_NAMES)
                if len(row):
                    none = pa.nulls(len(row), pa.int64())
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), none, term, pa.array(freq), pa.array(np.zeros(len(row), np.int64)), none], names=_NAMES)

    source = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "row").select("row", "doc_id", "text")
    rows = source.mapInArrow(look, "row long, doc_id long, term string, freq long, near long, n_bytes long")
    summed = join_tail(
        rows,
        table.select("term", "pieces"),
        {"n_tokens": F.col("near") + F.col("freq") * F.coalesce(F.col("pieces"), F.lit(0))},
        {"doc_id": F.max("doc_id"), "n_bytes": F.max("n_bytes")},
    )
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


_NAMES = ["row", "doc_id", "term", "freq", "near", "n_bytes"]
