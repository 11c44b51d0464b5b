"""LM scoring: a log-frequency Bloom filter of n-gram counts, in segments.

Counts are quantised on a logarithmic scale; an n-gram of level q is in the
filter once for each level from 1 to q, and its level is read back by probing
level after level until one is absent.  Unigrams and bigrams share the filter.
The filter grows with the corpus and is never whole in one place: n-grams are
sent to the segment that their hash names, and their levels are sent back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, coded_words, crc_mod, materialize, mix64, numbered, slices, starts_of, sum_by_row, word_hashes
from .terms import HEAD_TERMS, head, head_lookup, join_tail, tail_rows, term_counts

_U = np.uint64
_BIGRAM = _U(0x9E3779B97F4A7C15)  # fixed: odd multiplier that sets a history apart from a word
_BEGIN = _U(0x42D6C5A1B3F7E981)  # fixed: the history of the first token
_END = _U(0x1D3B5F79A2C4E687)  # fixed: the end token
MAX_LEVEL = 64


class Scale:
    """Levels of counts: level q stands for counts from low[q] to high[q]."""

    def __init__(self, base: float = 1.4):
        low, top = [0, 1], 1
        while len(low) <= MAX_LEVEL:
            top = max(top + 1, int(top * base))
            low.append(top)
        self.low = np.array(low, np.float64)
        self.high = np.append(self.low[1:] - 1, self.low[-1])

    def level(self, counts: np.ndarray) -> np.ndarray:
        return (np.searchsorted(self.low, counts, side="right") - 1).clip(0, MAX_LEVEL)


def lower_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of every text with A-Z lower-cased."""
    return coded_words(pc.ascii_lower(as_text(texts)))


def with_ends(values: np.ndarray, lens: np.ndarray, end) -> np.ndarray:
    """A value for every word, and one for the end of every text."""
    return np.insert(values, np.cumsum(lens), end)


def grams(lens: np.ndarray, codes: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens per text (its end included), word and pair of every token, both words of every pair, and the keys.

    Keys are those of the words, of the end and of the begin, then of the pairs.
    """
    hashes = np.append(word_hashes(words), [_END, _BEGIN])
    own = with_ends(codes, lens, len(words))
    lens = lens + 1
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[starts_of(lens)[:-1]] = len(words) + 1
    pairs, pair = np.unique(before * len(hashes) + own, return_inverse=True)
    history, last = pairs // len(hashes), pairs % len(hashes)
    return lens, own, pair, history, last, np.append(mix64(hashes), mix64(hashes[history] * _BIGRAM + hashes[last]))


class Filter:
    """Bits in segments; an n-gram's bits all lie in the segment its hash names.

    Keys count by their first 48 bits, which is what travels between workers.
    """

    PROBES = 3

    def __init__(self, bits: bytes, segments: int, segment_bits: int):
        self.bits = np.frombuffer(bits, np.uint8)
        self.shift = _U(64 - (segments - 1).bit_length()) if segments > 1 else None
        self.segment_bits = segment_bits

    @staticmethod
    def places(keys: np.ndarray, level: int, segment_bits: int):
        """The PROBES bit places of every key at a level within its segment, one array at a time."""
        h = mix64((keys & ~_U(0xFFFF)) + _U(level * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
        one, two = h & _U(0xFFFFFFFF), (h >> _U(32)) | _U(1)
        for i in range(Filter.PROBES):
            yield (((one + two * _U(i)) & _U(0xFFFFFFFF)) * _U(segment_bits) >> _U(32)).view(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray, level: np.ndarray, bits_per_entry: int) -> Filter:
        """One segment that holds every key once for each of its levels."""
        segment_bits = max(1024, int(int(level.sum()) * bits_per_entry * 1.02) + 7) // 8 * 8
        bits = np.zeros(segment_bits, bool)
        for now in range(1, int(level.max(initial=0)) + 1):
            keys, level = keys[level >= now], level[level >= now]
            for place in cls.places(keys, now, segment_bits):
                bits[place] = True
        return cls(np.packbits(bits, bitorder="little").tobytes(), 1, segment_bits)

    def has(self, keys: np.ndarray, level: int) -> np.ndarray:
        """Indexes of the keys whose bits of the level are all set."""
        base = (keys >> self.shift).view(np.int64) * self.segment_bits if self.shift is not None else np.zeros(len(keys), np.int64)
        live = None
        for place in self.places(keys, level, self.segment_bits):
            at = base + place if live is None else base[live] + place[live]
            hit = np.flatnonzero((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            live = hit if live is None else live[hit]
            if not len(live):
                break
        return live

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of every key: the last one of an unbroken run of present levels."""
        out = np.zeros(len(keys), np.int64)
        live = np.arange(len(keys))
        for level in range(1, MAX_LEVEL + 1):
            if not len(live):
                break
            live = live[self.has(keys[live], level)]
            out[live] = level
        return out


def _pieces(keys: np.ndarray, counts: np.ndarray, segments: int) -> pa.RecordBatch:
    """Sorted keys with their counts as one row per segment, 48 bits a key and 8 or more a count."""
    bits = (segments - 1).bit_length()
    segment = (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = np.searchsorted(segment, np.arange(segments + 1))
    rows = [(s, a, b) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
    rest = (keys >> _U(16)).astype("<u8")
    data, many = [], []
    for _, a, b in rows:
        low = rest[a:b].view("<u2").reshape(-1, 4)[:, :3]
        small = np.minimum(counts[a:b], 255).astype(np.uint8)
        data.append(low.tobytes() + small.tobytes())
        many.append(counts[a:b][small == 255].astype("<i8").tobytes())
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array(data, pa.binary()), pa.array(many, pa.binary())], names=["segment", "keys", "many"])


def _unpack(keys: bytes, many: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(keys) // 7
    wide = np.zeros((n, 4), "<u2")
    wide[:, :3] = np.frombuffer(keys, "<u2", 3 * n).reshape(-1, 3)
    counts = np.frombuffer(keys, np.uint8, offset=6 * n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(many, "<i8")
    return wide.view("<u8").ravel() << _U(16), counts


class Model:
    """What turns levels into probabilities: the scale, N, V and the weights."""

    def __init__(self, scale: Scale, total: int, distinct: int, weights: np.ndarray):
        self.scale, self.total, self.distinct, self.weights = scale, total, distinct, weights

    def p1(self, own: np.ndarray) -> np.ndarray:
        return (self.scale.low[own] + 1) / (self.total + self.distinct + 1)

    def logs(self) -> np.ndarray:
        """log10 probability by packed levels of history, word and pair.

        P(w | h) = (1 - a) P1(w) + a c(h, w) / c(h), with a by the level of h;
        c(h, w) is the least and c(h) the largest count of its level, so that
        the probabilities of one history do not exceed 1 in sum.
        """
        history, own, follows = unpacked(np.arange(_RADIX**3))
        p2 = self.scale.low[follows] / np.maximum(self.scale.high[history], 1)
        a = self.weights[history]
        return np.log10((1 - a) * self.p1(own) + a * p2)

    def ratios(self, packed: np.ndarray, n: np.ndarray) -> list:
        """(history level, log2 ratio of pair and word probability, n), each token's own occurrence left out."""
        history, own, follows = unpacked(packed)
        pair, past = self.scale.low[follows] - 1, np.maximum(self.scale.high[history] - 1, 1)
        left1 = np.maximum(self.p1(own) - 1 / max(self.total + self.distinct + 1, 1), 1e-300)
        seen = (pair > 0) & (own > 0)
        bins = np.round(2 * np.log2(np.where(seen, pair, 1) / past / left1))
        return [(h, b if s else None, k) for h, b, s, k in zip(history.tolist(), bins.tolist(), seen.tolist(), n.tolist(), strict=True)]


_RADIX = MAX_LEVEL + 1


def unpacked(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levels of history, word and pair."""
    return packed // _RADIX**2, packed // _RADIX % _RADIX, packed % _RADIX


def _packed(levels: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per text and packed levels of every token, from three bytes a token."""
    raw = np.frombuffer(b"".join(levels.to_pylist()), np.uint8).reshape(-1, 3).astype(np.int64)
    return pc.binary_length(levels).to_numpy(zero_copy_only=False).astype(np.int64) // 3, (raw[:, 0] * _RADIX + raw[:, 1]) * _RADIX + raw[:, 2]


def _fit_weights(ratio_counts: list, rounds: int = 20) -> np.ndarray:
    """Deleted interpolation: weights by level of the history, from (level, log2 ratio, n)."""
    out = np.zeros(MAX_LEVEL + 1)
    by: dict[int, list] = {}
    for level, bin_, n in ratio_counts:
        by.setdefault(level, []).append((-np.inf if bin_ is None else bin_ / 2, n))
    for level, rows in by.items():
        ratio, n = 2.0 ** np.array([r for r, _ in rows], float), np.array([x for _, x in rows], float)
        a = 0.5
        for _ in range(rounds):
            a = float((n * (a * ratio / (a * ratio + 1 - a))).sum() / n.sum())
        out[level] = min(a, 0.999)
    return out


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out_mod: int = 7, held_out: int = 2, base: float = 1.4,
                    bits_per_entry: int = 8, segment_bytes: int = 1 << 21, slice_bytes: int = 4 << 20, head_terms: int = HEAD_TERMS) -> DataFrame:
    """Score every whole text under unigram counts and under a bigram model.

    Learns from documents whose crc32 of the id, modulo held_out_mod, is not
    held_out (documents without id learn too).  Returns doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score, score.  Counts cover every
    training document.  base_score uses exact counts; score uses the filter,
    which holds every n-gram and whose size is bits_per_entry for each level
    of each n-gram.  It has a segment for about every segment_bytes of text, so
    a segment is bounded; n-grams are sent to it and levels back by slices of
    slice_bytes of text.
    The interpolation weights are fitted with each token's own occurrence left
    out, on all training documents.

    Null or empty text is the end token alone.  Every row gives one row, also
    repeated ones; without any training document the counts are 0 and N = 0.
    A very long text is a slice of its own.  An empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    scale = Scale(base)
    rows_in = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.coalesce(crc_mod(F.col(id_col), held_out_mod) == held_out, F.lit(False)).alias("held_out"),
    )
    # read three times: for words, for n-grams by slices, and for the slices themselves; rows and slices are the same each time
    source = numbered(rows_in, "row").select("row", "doc_id", "text", "held_out")

    sizes = source.agg(F.count_if(~F.col("held_out")).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n_train, n_bytes = sizes["n"] or 0, sizes["bytes"] or 0

    words = materialize(term_counts(source.filter(~F.col("held_out")), "text", lower_words), "words")
    facts = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, distinct = (facts["n"] or 0) + n_train, facts["v"] + (n_train > 0)

    # a segment for so many bytes of text, and beyond 2^14 segments for up to 32 times as many
    bits = (n_bytes // segment_bytes).bit_length()
    segments = 1 << max(4, min(bits, max(14, bits - 5)))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", slice_bytes):
                lens, own, pair, history, _, keys = grams(*lower_words(b.column(2)))
                learns = ~b.column(3).to_numpy(zero_copy_only=False)
                here, n_words = np.repeat(learns, lens), len(keys) - len(history)
                n = np.append(np.bincount(own[here], minlength=n_words), np.bincount(pair[here], minlength=len(history)))
                n[n_words - 1] = learns.sum()  # texts that begin
                order = np.argsort(keys)
                rows = _pieces(keys[order], n[order], segments)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[0].as_py()] * rows.num_rows, pa.int64()), *rows.columns], names=["batch", "segment", "keys", "many"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", slice_bytes):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(b)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(0, 1), pa.array([sink.getvalue().to_pybytes()])], names=["batch", "docs"])

    def probe(group: pa.Table) -> pa.Table:
        parts = [_unpack(k.as_py(), m.as_py()) for k, m in zip(group["keys"], group["many"], strict=True)]
        cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
        keys = np.concatenate([p[0] for p in parts])
        n = np.concatenate([p[1] for p in parts])
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        first = np.flatnonzero(new)
        keys, n = keys[first], np.add.reduceat(n, first)
        levels = np.empty(len(order), np.uint8)
        levels[order] = Filter.of(keys, scale.level(n), bits_per_entry).levels(keys)[np.cumsum(new) - 1]
        return pa.table([group["batch"], group["segment"], pa.array([x.tobytes() for x in np.split(levels, cuts)], pa.binary())], names=["batch", "segment", "levels"])

    top = head(words, head_terms)
    known = spark.sparkContext.broadcast((top["term"].combine_chunks(), top["n"].to_numpy()))
    scale_n = np.log10(total + distinct + 1)

    def combine(slice_: pa.Table, answers: pa.Table) -> pa.Table:
        group = pa.ipc.open_stream(slice_["docs"][0].as_buffer()).read_all().combine_chunks()
        names, counts = known.value
        logs = np.append(np.log10(counts + 1.0), 0.0)
        end = (np.log10(n_train + 1.0), int(n_train > 0))
        lens, codes, words_ = lower_words(group["text"])
        more, _, pair, history, last, keys = grams(lens, codes, words_)
        level = np.empty(len(keys), np.uint8)
        level[np.argsort(keys)] = np.frombuffer(b"".join(answers.sort_by("segment")["levels"].to_pylist()), np.uint8)
        one, two, both = level[history], level[last], level[-len(history) :]
        both = np.where((one > 0) & (two > 0), np.minimum(both, np.minimum(one, two)), 0)  # a pair is no more frequent than its parts
        data = np.stack([one, two, both], axis=1).astype(np.uint8)[pair].tobytes()
        levels = pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer((3 * starts_of(more)).astype(np.int32)), pa.py_buffer(data)])
        place = head_lookup(words_, names)
        near = sum_by_row(logs[place][codes], lens) + end[0]
        n_known = sum_by_row((place >= 0).astype(np.int64)[codes], lens) + end[1]
        row, term, freq = tail_rows(lens, codes, words_, place)
        n, k = len(lens), len(row)
        base_rows = pa.table([group["row"], group["doc_id"], group["held_out"], pa.nulls(n, pa.string()), pa.array(np.zeros(n, np.int64)), pa.array(near), pa.array(n_known), pa.array(more), levels], names=_NAMES)
        none = pa.nulls(k, pa.int64())
        tail = pa.table([group["row"].take(pa.array(row)), none, pa.nulls(k, pa.bool_()), term.cast(pa.string()), pa.array(freq), pa.array(np.zeros(k)), pa.array(np.zeros(k, np.int64)), none, pa.nulls(k, pa.binary())], names=_NAMES)
        return pa.concat_tables([base_rows, tail])

    sent = source.mapInArrow(pack, "batch long, docs binary")
    answers = source.mapInArrow(pieces, "batch long, segment int, keys binary, many binary").groupBy("segment").applyInArrow(probe, "batch long, segment int, levels binary")
    kind = "row long, doc_id long, held_out boolean, term string, freq long, near double, near_known long, n_tokens long"
    rows = materialize(sent.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(combine, kind + ", levels binary"), "levels", "zstd")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "levels"):
                packed, n = np.unique(_packed(b.column(0))[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(packed), pa.array(n)], names=["packed", "n"])

    learnt = rows.filter(F.col("levels").isNotNull() & ~F.col("held_out"))
    fitted = learnt.select("levels").mapInArrow(tally, "packed long, n long").groupBy("packed").agg(F.sum("n").alias("n")).orderBy("packed").toArrow()
    unfitted = Model(scale, total, distinct, np.zeros(_RADIX))
    weights = _fit_weights(unfitted.ratios(fitted["packed"].to_numpy(), fitted["n"].to_numpy()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = Model(scale, total, distinct, weights).logs()
        for whole in batches:
            for b in slices(whole, "levels"):
                held = b.column(8).is_valid().to_numpy(zero_copy_only=False)
                lens, packed = _packed(b.column(8).drop_null())
                out = np.zeros(len(held))
                out[held] = sum_by_row(logs[packed], lens)
                yield pa.RecordBatch.from_arrays([*b.columns[:8], pa.array(out, mask=~held)], names=[*_NAMES[:8], "score"])

    summed = join_tail(
        rows.mapInArrow(score, kind + ", score double"),
        words,
        {"logs": F.col("near") + F.col("freq") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + 1.0), "n_known": F.col("near_known") + F.when(F.col("n") > 0, F.col("freq")).otherwise(0)},
        {"doc_id": F.max("doc_id"), "held_out": F.max("held_out"), "n_tokens": F.max("n_tokens"), "score": F.max("score")},
    )
    return summed.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(float(scale_n))).alias("base_score"), "score",
    )


_NAMES = ["row", "doc_id", "held_out", "term", "freq", "near", "near_known", "n_tokens", "levels"]
