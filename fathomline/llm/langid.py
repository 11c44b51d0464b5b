"""Language ID: prediction by partial matching over bytes, with frozen statistics.

Each language has a tree of byte contexts up to ``ORDER`` long.  A byte costs
-log2 c / (n + d) bits in a context where it was seen c of n times among d
different bytes, or an escape of -log2 d / (n + d) bits and its cost in the
next shorter context; after the empty context all 256 bytes are equally likely.
A context that was never seen costs nothing to leave.  The language with the
shortest code for the whole text wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, crc_mod, free_names, slices, small_batches, starts_of

ORDER = 3
UNDETERMINED = "und"
_PAD = "\n" * ORDER  # stands before every text


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every byte with the ORDER bytes before it as one code; first and end place of every text."""
    low = pc.utf8_lower(as_text(texts))
    padded = pc.binary_join_element_wise(_PAD, low, "")
    lens = pc.binary_length(padded).to_numpy(zero_copy_only=False).astype(np.int64)
    at = starts_of(lens)
    raw = np.frombuffer(padded.buffers()[2], np.uint8, int(at[-1])).astype(np.uint32)
    code = raw.copy()
    for back in range(1, ORDER + 1):
        code[back:] |= raw[:-back] << np.uint32(8 * back)
    return code, at[:-1] + ORDER, at[1:]


class Trees:
    """The context trees of one language as sorted arrays, one per order."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.pairs, self.contexts = [], []
        for order in range(ORDER + 1):
            pair, at = np.unique(codes & np.uint64((1 << (8 * order + 8)) - 1), return_inverse=True)
            n = np.bincount(at, counts, len(pair))
            context, at = np.unique(pair >> np.uint64(8), return_inverse=True)
            self.pairs.append((pair, n))
            self.contexts.append((context, np.bincount(at, n, len(context)), np.bincount(at, minlength=len(context))))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Exact code length of the last byte of every code, after the others."""
        codes = codes.astype(np.uint64)
        out, open_ = np.zeros(len(codes)), np.arange(len(codes))
        for order in range(ORDER, -1, -1):
            if not len(open_):
                break
            pair = codes[open_] & np.uint64((1 << (8 * order + 8)) - 1)
            known, total, kinds = self.contexts[order]
            at, seen = _find(known, pair >> np.uint64(8))
            n, d = total[at], kinds[at]
            keys, c = self.pairs[order]
            at, hit = _find(keys, pair)
            hit &= seen
            out[open_[hit]] += np.log2((n + d) / c[at])[hit]
            escape = seen & ~hit
            out[open_[escape]] += np.log2((n + d) / d)[escape]
            open_ = open_[~hit]
        out[open_] += 8.0
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Scorer:
    """Code lengths of whole texts in every language.

    Costs of the codes seen in training are kept in an open-addressed table;
    other codes are worked out when they occur.
    """

    def __init__(self, langs: list[str], table: pa.Table):
        self.langs = langs
        lang, gram, n = (table[c].to_numpy() for c in ("lang_no", "gram", "n"))
        self.trees = [Trees(gram[lang == i].astype(np.uint64), n[lang == i].astype(float)) for i in range(len(langs))]
        self.codes = np.unique(gram).astype(np.uint32)
        self.cost = np.stack([t.bits(self.codes) for t in self.trees], axis=1).astype(np.float32)
        size = 1 << max(10, (4 * len(self.codes)).bit_length())
        self.shift, self.mask = np.uint32(32 - size.bit_length() + 1), size - 1
        self.slot = np.full(size, -1, np.int32)
        left = np.arange(len(self.codes), dtype=np.int32)
        at = self._home(self.codes)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask
        self.keys = np.where(self.slot >= 0, self.codes[self.slot], np.uint32(0))

    def _home(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint32(2654435769)) >> self.shift).astype(np.int64)

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Row of cost for every code, -1 for codes that training did not see."""
        at = self._home(codes)
        out = self.slot[at]
        todo = np.flatnonzero((self.keys[at] != codes) & (out >= 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            out[todo] = self.slot[at]
            more = (self.keys[at] != codes[todo]) & (out[todo] >= 0)
            todo, at = todo[more], at[more]
        return out

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Bits of every text in every language."""
        codes, first, end = grams(texts)
        place = self.places(codes)
        cost = self.cost
        if (new := np.flatnonzero(place < 0)).size:
            odd, at = np.unique(codes[new], return_inverse=True)
            place[new] = len(cost) + at
            cost = np.concatenate([cost, np.stack([t.bits(odd) for t in self.trees], axis=1).astype(np.float32)])
        out = np.empty((len(first), len(self.langs)))
        total = np.zeros(len(codes) + 1)
        for i in range(len(self.langs)):
            np.cumsum(np.ascontiguousarray(cost[:, i])[place], dtype=np.float64, out=total[1:])
            out[:, i] = total[end] - total[first]
        return out


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out_mod: int = 4, held_out: int = 2,
             fit_docs: int = 1500, fit_bytes: int = 8 << 20, most_langs: int = 1000, keep: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Predict the language of every whole text.

    Learns from labelled documents whose crc32 of the id, modulo held_out_mod,
    is not held_out: of each language about fit_docs documents and fit_bytes of
    text, chosen by hash; all their byte contexts count.  More than most_langs
    labels raise ValueError, since the trees go to every worker.  Returns
    doc_id, held_out, lang_pred, score (the posterior of the prediction under
    equal priors), or, with keep, every column of docs with those two; names
    gives them other names, and columns of docs that have them are replaced.

    ``und`` with score 0 is predicted for texts that are null or have no
    letter, and for all where nothing could be learned.  Ties go to the first
    language in order.  Every row gives one row, repeated or without id; an
    empty table gives no rows.
    """
    if keep:
        docs = docs.drop(*(c for c in docs.columns if c in names))
    spark = docs.sparkSession
    small_batches(spark)
    out_of = F.coalesce(crc_mod(F.col(id_col), held_out_mod) == held_out, F.lit(False))
    train = docs.filter(~out_of & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sized = train.groupBy(lang_col).agg(F.count("*"), F.sum(F.octet_length(text_col))).limit(most_langs + 1).collect()
    sizes = {r[0]: min(1.0, fit_docs / r[1], fit_bytes / max(r[2], 1)) for r in sized}
    if len(sizes) > most_langs:
        raise ValueError(f"more than {most_langs} languages in {lang_col}")
    langs = sorted(sizes)
    model = None
    if langs:
        share = F.create_map(*(F.lit(x) for k in langs for x in (k, int(sizes[k] * (1 << 30)))))
        number = F.create_map(*(F.lit(x) for i, k in enumerate(langs) for x in (k, i)))
        chosen = train.filter(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 30)) < share[F.col(lang_col)])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in slices(whole, "text", 1 << 21):
                    codes, first, end = grams(b.column(1))
                    lang = np.repeat(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), end - first)
                    inside = np.repeat(first - np.concatenate([[0], np.cumsum(end - first)[:-1]]), end - first) + np.arange(len(lang))
                    key, n = np.unique(lang << 32 | codes[inside].astype(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key >> 32), pa.array(key & 0xFFFFFFFF), pa.array(n)], names=["lang_no", "gram", "n"])

        rows = chosen.select(number[F.col(lang_col)].alias("lang_no"), F.col(text_col).alias("text")).mapInArrow(count, "lang_no long, gram long, n long")
        table = rows.groupBy("lang_no", "gram").agg(F.sum("n").alias("n")).orderBy("lang_no", "gram").toArrow()
        present = sorted(set(table["lang_no"].to_pylist()))
        if present:
            again = np.full(len(langs), -1)
            again[present] = range(len(present))
            table = table.set_column(table.schema.get_field_index("lang_no"), "lang_no", pa.array(again[table["lang_no"].to_numpy()]))
            model = spark.sparkContext.broadcast(([langs[i] for i in present], table))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value) if model is not None else None
        for whole in batches:
            place = whole.schema.get_field_index(text_col)
            for b in slices(whole, text_col, 1 << 21):
                texts = as_text(b.column(place))
                letters = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
                best_lang, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
                if scorer is not None and letters.any():
                    bits = scorer.lengths(texts)
                    best = bits.argmin(axis=1)
                    over = bits - bits.min(axis=1, keepdims=True)
                    score = np.where(letters, 1 / np.exp2(-np.minimum(over, 1000)).sum(axis=1), 0.0)
                    best_lang[letters] = np.array(scorer.langs, object)[best[letters]]
                columns = [b.column(i) for i in range(b.num_columns) if keep or i != place]
                kept = [n for n in b.schema.names if keep or n != text_col]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(best_lang, pa.string()), pa.array(score)], names=[*kept, *names])

    source = docs if keep else docs.select(F.col(id_col).cast("long").alias("doc_id"), out_of.alias("held_out"), F.col(text_col).cast("string").alias(text_col))
    kinds = [f for f in source.schema.fields if keep or f.name != text_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + f", `{names[0]}` string, `{names[1]}` double"
    return source.mapInArrow(predict, schema)


def keep_identified(docs: DataFrame, *, min_score: float = 0.0, **options) -> DataFrame:
    """The documents whose language could be told, with the columns they came with.

    Documents without a letter go, and those scored below min_score.
    """
    lang, score = free_names(docs, "lang_pred", "score")
    told = identify(docs, keep=True, names=(lang, score), **options)
    return told.filter((F.col(lang) != UNDETERMINED) & (F.col(score) >= min_score)).select(*docs.columns)
