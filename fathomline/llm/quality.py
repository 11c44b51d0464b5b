"""Quality rules: distribution divergence from what is usual in a language.

A document has two histograms, of character classes and of its language's
common words.  The reference of a language holds, for every bin, the median
share over its documents, so a large part of poor documents does not move it.
Both are compared by the Jensen-Shannon distance, the root of the divergence
(base 2), less what the length of the document alone would make.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_text, coded_words, mix64, slices, starts_of, sum_by_row

#: Bins of bytes; bytes inside a multi-byte character belong to none but the first.
CLASSES = ("lower", "upper", "digit", "blank", "break", "stop", "bang", "symbol", "other", "wide")
_SYMBOLS = b"#*$%&|<>"
_LEVELS = 4096


def _class_table() -> np.ndarray:
    t = np.full(256, CLASSES.index("other"), np.uint8)
    t[ord("a") : ord("z") + 1] = CLASSES.index("lower")
    t[ord("A") : ord("Z") + 1] = CLASSES.index("upper")
    t[ord("0") : ord("9") + 1] = CLASSES.index("digit")
    for chars, name in ((b" \t", "blank"), (b"\n\r\x0b\x0c", "break"), (b".,;:?'\"()-", "stop"), (b"!", "bang"), (_SYMBOLS, "symbol")):
        t[list(chars)] = CLASSES.index(name)
    t[0xC0:] = CLASSES.index("wide")
    t[0x80:0xC0] = len(CLASSES)
    return t


_CLASS = _class_table()


def class_counts(texts: pa.Array) -> np.ndarray:
    """Characters of every class in every text."""
    at = starts_of(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) + _offset(texts)
    kinds = _CLASS[np.frombuffer(texts.buffers()[2] or b"", np.uint8, int(at[-1]))]
    out = np.zeros((len(texts), len(CLASSES) + 1), np.int64)
    for k in range(1, len(CLASSES) + 1):  # the first class, by far the largest, is what is left
        out[:, k] = np.diff(np.searchsorted(np.flatnonzero(kinds == k), at))
    out[:, 0] = np.diff(at) - out.sum(axis=1)
    return out[:, : len(CLASSES)]


def _offset(texts: pa.Array) -> int:
    return int(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset]) if len(texts) else 0


def stems(words: pa.Array) -> pa.Array:
    """Words in lower case without the signs around them."""
    return pc.utf8_trim(pc.utf8_lower(words), characters=".,;:!?'\"()-#*$%&|<>")


def base_counts(texts: pa.Array, lens: np.ndarray, codes: np.ndarray, words: pa.Array) -> dict[str, np.ndarray]:
    """Counts of the base rules for every text."""
    n = len(lens)
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    lines = pc.split_pattern(texts, "\n")
    per = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lines.flatten()
    full = pc.match_substring_regex(flat, r"[^ \t-\r]").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(n, dtype=np.int64), per)[full]
    d = flat.filter(pa.array(full)).dictionary_encode()
    line = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = np.unique(owner * max(len(d.dictionary), 1) + line) // max(len(d.dictionary), 1)
    dup = np.bincount(owner, minlength=n) - np.bincount(distinct, minlength=n)
    return {"n_words": lens, "word_chars": sum_by_row(sizes[codes], lens), "n_dup_lines": dup, "n_repeat_words": repeated_words(lens, codes)}


def repeated_words(lens: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Words of every text in 3-word windows that the text holds twice or more."""
    owner = np.repeat(np.arange(len(lens), dtype=np.int64), lens)
    if len(codes) < 3:
        return np.zeros(len(lens), np.int64)
    inside = np.flatnonzero(owner[2:] == owner[:-2])
    key = mix64(mix64(mix64(owner[inside]) + codes[inside].astype(np.uint64)) + codes[inside + 1].astype(np.uint64)) + codes[inside + 2].astype(np.uint64)
    key = mix64(key)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(codes), bool)
    for k in range(3):
        cover[inside[again] + k] = True
    return sum_by_row(cover.astype(np.int64), lens)


def divergence(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of every row of counts from a distribution."""
    p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    m = (p + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        b = np.where(reference > 0, reference * np.log2(reference / m), 0).sum(axis=1)
    return np.maximum((a + b) / 2, 0)


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of every row of counts from a distribution.

    n draws from a reference of k bins have a divergence of about (k - 1) / (8 n ln 2)
    from it; that much is taken off first, so texts of all lengths compare.
    """
    chance = (counts.shape[1] - 1) / (8 * np.log(2) * np.maximum(counts.sum(axis=1), 1))
    return np.sqrt(np.maximum(divergence(counts, reference) - chance, 0))


def _word_counts(lens, codes, words: pa.Array, common: list[str]) -> np.ndarray:
    """Occurrences of every common word, then of all others, in every text."""
    place = pc.fill_null(pc.index_in(stems(words), value_set=pa.array(common, pa.string())), len(common)).to_numpy(zero_copy_only=False).astype(np.int64)
    k = len(common) + 1
    owner = np.repeat(np.arange(len(lens), dtype=np.int64), lens)
    return np.bincount(owner * k + place[codes], minlength=len(lens) * k).reshape(len(lens), k)


def references(docs: DataFrame, text_col: str, lang_col: str, common_words: int, min_words: int, most_langs: int) -> dict[str, tuple[np.ndarray, list[str], np.ndarray]]:
    """Of every language: class shares, its common words, and their shares."""
    if docs.filter(F.col(lang_col).isNotNull()).select(lang_col).distinct().limit(most_langs + 1).count() > most_langs:
        raise ValueError(f"more than {most_langs} languages in {lang_col}")
    source = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                lens, codes, words = coded_words(b.column(1))
                named = stems(words).dictionary_encode()
                codes = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes]
                langs = b.column(0).dictionary_encode()
                lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), lens)
                k = max(len(named.dictionary), 1)
                key, n = np.unique(lang * k + codes, return_counts=True)
                rows = [langs.dictionary.take(pa.array(key // k)), named.dictionary.take(pa.array(key % k)), pa.array(n)]
                keep = pc.not_equal(rows[1], "")
                yield pa.RecordBatch.from_arrays([r.filter(keep) for r in rows], names=["lang", "term", "n"])

    counts = source.mapInArrow(count, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "term")
    top: dict[str, list[str]] = {}
    for row in counts.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= common_words).orderBy("lang", "k").collect():
        top.setdefault(row["lang"], []).append(row["term"])

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                texts, langs = as_text(b.column(1)), b.column(0)
                lens, codes, words = coded_words(texts)
                classes, out = class_counts(texts), []
                for lang in langs.unique().to_pylist():
                    own = pc.equal(langs, lang).to_numpy(zero_copy_only=False) & (lens >= min_words)
                    if lang not in top or not own.any():
                        continue
                    c = np.hstack([classes / np.maximum(classes.sum(axis=1, keepdims=True), 1), (_word_counts(lens, codes, words, top[lang]) / np.maximum(lens[:, None], 1))[:, :-1]])[own]
                    level = np.minimum((c * _LEVELS).astype(np.int64), _LEVELS)
                    key, n = np.unique(np.arange(c.shape[1]) * (_LEVELS + 1) + level, return_counts=True)
                    out.append(pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(key // (_LEVELS + 1)), pa.array(key % (_LEVELS + 1)), pa.array(n)], names=["lang", "bin", "level", "n"]))
                yield from out

    bins = source.mapInArrow(shares, "lang string, bin long, level long, n long").groupBy("lang", "bin", "level").agg(F.sum("n").alias("n"))
    medians: dict[str, np.ndarray] = {}
    for row in bins.groupBy("lang", "bin").agg(F.percentile("level", 0.5, F.col("n")).alias("level")).collect():
        middle = medians.setdefault(row["lang"], np.zeros(len(CLASSES) + len(top[row["lang"]])))
        middle[row["bin"]] = (row["level"] + (0.5 if row["level"] else 0)) / _LEVELS
    out = {}
    for lang, middle in sorted(medians.items()):
        classes, words = middle[: len(CLASSES)], middle[len(CLASSES) :]
        if classes.sum():
            out[lang] = (classes / classes.sum(), top[lang], np.append(words, max(1 - words.sum(), 0)) / max(words.sum(), 1))
    return out


def assess(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", common_words: int = 24,
           min_words: int = 50, class_limit: float = 0.17, word_limit: float = 0.25, most_langs: int = 1000) -> DataFrame:
    """Counts of the base rules and the verdict of the divergence for every text.

    A document is kept unless base_failed (fewer than min_words words, or over
    half of them in repeated 3-word windows) or it is too far from the nearest
    language's reference: the distance of its character classes is over
    class_limit or that of its common words over word_limit.  The nearest is
    the one with the least sum of both distances.  Texts below min_words are
    not judged by distance at all.  References cover every document of a
    language with min_words words; where there is none, distances are null and
    only the base rules judge.  More than most_langs languages raise
    ValueError, since their references go to every worker.

    Null text has no words.  A very long text is judged whole.  Every row gives
    one row, repeated or without id.  An empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(references(docs, text_col, lang_col, common_words, min_words, most_langs))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                texts = as_text(b.column(1))
                lens, codes, words = coded_words(texts)
                c, classes = base_counts(texts, lens, codes, words), class_counts(texts)
                best = np.full((3, len(lens)), np.inf)
                for class_ref, common, word_ref in known.value.values():
                    one, two = distance(classes, class_ref), distance(_word_counts(lens, codes, words, common), word_ref)
                    total = one + two
                    best = np.where(total < best[0], [total, one, two], best)
                failed = (lens < min_words) | (100 * c["n_repeat_words"] > 50 * lens)
                far = np.isfinite(best[0]) & (lens >= min_words) & ((best[1] > class_limit) | (best[2] > word_limit))
                none = ~np.isfinite(best[0])
                columns = [b.column(0), *(pa.array(c[k]) for k in ("n_words", "word_chars")), pa.array(classes[:, CLASSES.index("symbol")]), *(pa.array(c[k]) for k in ("n_dup_lines", "n_repeat_words")),
                           pa.array(failed), pa.array(~failed & ~far), pa.array(best[1], mask=none), pa.array(best[2], mask=none)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"
    names = [k.split()[0] for k in kinds.split(", ")]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(judge, kinds)
