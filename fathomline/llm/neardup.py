"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles.

Equal texts are one node.  Every node has a signature of consistent weighted
samples, cut into bands; nodes that share a band are candidates, and a link is
made where the weighted Jaccard similarity of the TF-IDF shingles is high
enough.  Classes are the connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, coded_words, free_names, input_bytes, materialize, mix64, numbered, scratch_of, slices, small_batches, starts_of, word_hashes

_U = np.uint64
SHINGLE = 5
#: Rows of a table sent to every worker, at most; a larger one is joined by shuffle.
MOST_BROADCAST = 300_000
#: Nodes of a band in one task, and leaders that they all meet in one round, about.
CHUNK = 256
#: Bytes of text of a slice, whose shingles travel together.
SLICE = 4 << 20

# fixed odd multipliers, one for every place in a shingle
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingles per text and their hashes: windows of five words in small letters.

    A text of one to four words is one shingle; a text without words has none.
    """
    lens, codes, words = coded_words(pc.utf8_lower(as_text(texts)))
    h = (word_hashes(words) if len(words) else np.zeros(0, _U))[codes]
    n = np.maximum(lens - (SHINGLE - 1), (lens > 0).astype(np.int64))
    first = np.repeat(starts_of(lens)[:-1], n)
    at = first + np.arange(len(first)) - np.repeat(starts_of(n)[:-1], n)
    end = np.repeat(starts_of(lens)[1:], n)
    out = np.zeros(len(at), _U)
    for k in range(SHINGLE):
        inside = at + k < end
        out[inside] += h[(at + k)[inside]] * _PLACE[k]
    return n, mix64(out)


class Weights:
    """TF-IDF weights from the document frequencies of all shingles.

    Frequencies come as levels, one byte a shingle: level q stands for
    2^(q / 2) documents.  The inverse frequency is scaled to go from 1 to
    1 + SPAN: with more, the many copies of a document would make its own
    shingles worth little, and copies with a few changes unlike.
    """

    SPAN = 0.25

    def __init__(self, documents: int):
        idf = np.log((documents + 1) / (np.exp2(np.arange(256) / 2) + 1)) / np.log(documents + 2)
        self.factor = 1 + self.SPAN * np.clip(idf, 0, 1)

    @staticmethod
    def level(df: np.ndarray) -> np.ndarray:
        """The level of every document frequency, the nearest on the scale."""
        return np.round(2 * np.log2(df)).astype(np.uint8)

    def of(self, hashes: np.ndarray, levels: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of one text, in order, and their weights; levels has one byte for each."""
        distinct, tf = np.unique(hashes, return_counts=True)
        return distinct, tf * self.factor[np.frombuffer(levels, np.uint8)]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller weights over the sum of the larger; 0 if both are empty."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = float(np.minimum(a[1][i], b[1][j]).sum())
    whole = float(a[1].sum() + b[1].sum()) - low
    return low / whole if whole > 0 else 0.0


class Sampler:
    """Improved consistent weighted sampling (Ioffe, 2010).

    For sample k and shingle s: r, c ~ Gamma(2, 1) and b ~ U(0, 1), fixed by
    (s, k); t = floor(ln w / r + b), ln a = ln c - r (t - b) - r; the sample is
    the (s, t) of least a.  The variates come from tables of 4096 draws each,
    read at three places of a multiplied hash.
    """

    def __init__(self, bands: int, rows: int, seed: int = 41):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.mult = (rng.integers(1 << 62, 1 << 63, bands * rows, dtype=np.int64).astype(_U) | _U(1))[:, None]
        self.r = rng.gamma(2.0, 1.0, 4096).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, 4096)).astype(np.float32)
        self.b = rng.random(4096).astype(np.float32)

    def signature(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One 64-bit hash per sample."""
        log_w = np.log(weights).astype(np.float32)[None, :]
        k, best = np.arange(len(self.mult)), None
        for at in range(0, len(keys), 512):
            some = keys[at : at + 512]
            place = (some[None, :] * self.mult).view("<u2").reshape(len(k), len(some), 4) >> 4
            r, b, a = np.take(self.r, place[:, :, 3]), np.take(self.b, place[:, :, 2]), np.take(self.log_c, place[:, :, 1])
            t = log_w[:, at : at + 512] / r
            t += b
            np.floor(t, out=t)
            b -= t
            b -= 1
            b *= r
            a += b
            i = a.argmin(axis=1)
            now = (a[k, i], some[i], t[k, i])
            if best is None:
                best = now
            else:
                better = now[0] < best[0]
                best = tuple(np.where(better, x, y) for x, y in zip(now, best, strict=True))
        return mix64(best[1] ^ mix64(best[2].astype(np.int64).astype(_U)))

    def band_keys(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        s = self.signature(keys, weights).reshape(self.bands, self.rows)
        out = np.arange(self.bands).astype(_U)
        for k in range(self.rows):
            out = mix64(out * _PLACE[0] + s[:, k])
        return out.view(np.int64)


def _thin(keys: np.ndarray) -> bytes:
    """The low 48 bits of every hash; the bucket names at least 5 of the 16 others."""
    return keys.astype("<u8").view("<u2").reshape(-1, 4)[:, :3].tobytes()


def _wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 4), "<u2")
    out[:, :3] = np.frombuffer(data, "<u2").reshape(-1, 3)
    return out.view("<u8").ravel()


def _distinct(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Distinct shingles of a slice; then, text by text and in order, the shingles of every text: how many, which, how often."""
    n, h = shingles(texts)
    keys, code = np.unique(h, return_inverse=True)
    owner = np.repeat(np.arange(len(n), dtype=np.int64), n)
    pair, tf = np.unique(owner * max(len(keys), 1) + code, return_counts=True)
    owner, code = np.divmod(pair, max(len(keys), 1))
    return keys, np.bincount(owner, minlength=len(n)), code, tf


def frequency_levels(source: DataFrame, buckets: int) -> DataFrame:
    """(batch, bucket, levels): of every slice of source (row, .., text) the levels of its distinct shingles, in order.

    Hashes travel by slices and their first bits to a bucket, each once a slice
    with the number of its documents, so no shingle is hot; levels travel back.
    """
    shift = _U(64 - (buckets - 1).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                keys, _, code, _ = _distinct(b.column(b.schema.get_field_index("text")))
                df = np.bincount(code, minlength=len(keys))
                cuts = np.searchsorted(keys >> shift, np.arange(buckets + 1).astype(_U))
                rows = [(k, x, y) for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
                small = np.minimum(df, 255).astype(np.uint8)
                many = [df[x:y][small[x:y] == 255].astype("<i8").tobytes() for _, x, y in rows]
                columns = [[b.column(0)[0].as_py()] * len(rows), [r[0] for r in rows], [_thin(keys[x:y]) for _, x, y in rows], [small[x:y].tobytes() for _, x, y in rows], many]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["batch", "bucket", "keys", "df", "many"])

    def merge(group: pa.Table) -> pa.Table:
        counts = [np.frombuffer(x.as_py(), np.uint8).astype(np.int64) for x in group["df"]]
        for n, more in zip(counts, group["many"], strict=True):
            n[n == 255] = np.frombuffer(more.as_py(), "<i8")
        keys, place = np.unique(np.concatenate([_wide(x.as_py()) for x in group["keys"]]), return_inverse=True)
        level = Weights.level(np.bincount(place, np.concatenate(counts)))[place]
        parts = np.split(level, np.cumsum([len(n) for n in counts])[:-1])
        return pa.table([group["batch"], group["bucket"], pa.array([x.tobytes() for x in parts], pa.binary())], names=["batch", "bucket", "levels"])

    chunks = source.mapInArrow(count, "batch long, bucket int, keys binary, df binary, many binary")
    return chunks.groupBy("bucket").applyInArrow(merge, "batch long, bucket int, levels binary")


def packed_slices(source: DataFrame) -> DataFrame:
    """(batch, docs): the slices themselves, compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(b)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(0, 1), pa.array([sink.getvalue().to_pybytes()])], names=["batch", "docs"])

    return source.mapInArrow(pack, "batch long, docs binary")


def _small_side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node of every component of undirected edges (a, b).

    Every node hooks on to its least neighbour and the edges are contracted to
    what they hook on to, until none is left; each round is written out and
    smaller than the one before.
    """
    left, hooks = materialize(edges.select("a", "b").distinct(), "edges"), []
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "hooks")
        hooks.append(hook)
        at = {k: hook.select(F.col("node").alias(k), F.col("comp").alias(f"to_{k}")) for k in "ab"}
        moved = left.join(at["a"], "a").join(at["b"], "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        left = materialize(moved.filter(F.col("a") != F.col("b")).distinct(), "edges")
    if not hooks:
        return materialize(edges.limit(0).select(F.col("a").alias("node"), F.col("a").alias("comp")), "labels")
    labels = hooks[0]
    for hook in hooks[1:]:
        labels = relabel(labels, hook)
    return materialize(labels, "labels")


def relabel(labels: DataFrame, hook: DataFrame) -> DataFrame:
    """labels with each component replaced by what it hooks on to, if it does."""
    return labels.join(hook.select(F.col("node").alias("comp"), F.col("comp").alias("root")), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, bands: int = 14, rows: int = 4) -> DataFrame:
    """The class of every document: one row per row of docs.

    Returns doc_id, node (md5 of the text), class_id (the least doc_id of the
    class; null if none has one), first_node (the node that holds it) and
    class_size.  Two different texts are linked if they share a band and their
    weighted Jaccard similarity is at least ``similarity``; a pair of that
    similarity shares one of 14 bands of 4 with probability over 0.999, and
    within a band no pair of different components is left uncompared.

    Null texts count as empty, and all empty texts are one class; so are texts
    without words that are equal.  Rows that repeat fall into one class.  An
    empty table gives no rows; other columns are ignored.
    """
    with scratch_of(docs.sparkSession) as kept:
        members, labels = _linked(docs, id_col, text_col, similarity, bands, rows)
        kept += [members, labels]
    named = members.join(labels, "node", "left").select("doc_id", "node", "n", F.coalesce("comp", "node").alias("comp"))
    # no id ranks last
    rank = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("doc_id"), F.col("node").alias("node"))
    sizes = named.groupBy("comp").agg(F.min(rank).alias("first"), F.sum("n").alias("class_size"))
    out = named.join(sizes, "comp").select("doc_id", "node", F.col("first.doc_id").alias("class_id"), F.col("first.node").alias("first_node"), "class_size", "n")
    return out.select("doc_id", "node", "class_id", "first_node", "class_size", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_n")).drop("_n")


def _linked(docs: DataFrame, id_col: str, text_col: str, similarity: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, n) of all documents and (node, comp) of the nodes that have links, both stored."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # read several times; rows and slices are the same each time
    source = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")), "row").select("row", "doc_id", "text")
    weights = Weights(docs.count())
    buckets = 1 << max(5, min(20, (input_bytes(docs) >> 21).bit_length()))

    def sign(slice_: pa.Table, answers: pa.Table) -> pa.Table:
        sampler = Sampler(bands, rows)
        part = pa.ipc.open_stream(slice_["docs"][0].as_buffer()).read_all().combine_chunks()
        keys, n, code, tf = _distinct(part["text"].combine_chunks())
        level = np.frombuffer(b"".join(answers.sort_by("bucket")["levels"].to_pylist()), np.uint8)[code]
        hashes, weight, at = keys[code], tf * weights.factor[level], starts_of(n)
        found = [(x, y) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        signed = [sampler.band_keys(hashes[x:y], weight[x:y]).tolist() if y > x else None for x, y in found]
        node = [md5(t.encode()).digest() for t in part["text"].to_pylist()]
        return pa.table([part["doc_id"], pa.array(node), pa.array(signed, pa.list_(pa.int64())), pa.array([level[x:y].tobytes() for x, y in found])], names=["doc_id", "node", "bands", "levels"])

    both = packed_slices(source).groupBy("batch").cogroup(frequency_levels(source, buckets).groupBy("batch"))
    signed = materialize(both.applyInArrow(sign, "doc_id long, node binary, bands array<long>, levels binary"), "signed")
    # every member once; copies of one text are combined before the shuffle
    members = materialize(signed.groupBy("node", "doc_id").agg(F.count("*").alias("n")), "members")
    nodes = signed.groupBy("node").agg(F.first("bands").alias("bands"))
    placed = materialize(nodes.select("node", F.explode("bands").alias("band")), "bands")
    shared = placed.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("size")).filter(F.col("size") > 1)
    placed = materialize(placed.join(shared, "band"), "shared")

    involved = placed.select("node").distinct()
    wanted = materialize(involved, "involved")
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    texts, levels = (
        rows.join(_small_side(wanted), "node", "left_semi").groupBy("node").agg(F.first(c).alias(c))
        for rows, c in ((source.select(digest.alias("node"), "text"), "text"), (signed.select("node", "levels"), "levels"))
    )
    texts = materialize(texts.join(levels, "node"), "texts")

    def verify(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar enough."""

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = lru_cache(512)(lambda t, levels: weights.of(shingles(pa.array([t]))[1], levels))
            for whole in batches:
                for b in slices(whole, "text_b"):
                    keep = [weighted_jaccard(seen(t, p), seen(u, q)) >= similarity for t, u, p, q in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        one, two = (texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}"), F.col("levels").alias(f"levels_{k}")) for k in "ab")
        full = pairs.select("a", "b").distinct().join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b", "levels_a", "levels_b")
        return materialize(full.mapInArrow(compare, "a binary, b binary"), "links")

    def meet(rows: DataFrame) -> DataFrame:
        """Links found in groups of rows (band, chunk, node, comp, leads): each leader meets all."""

        def compare(group: pa.Table) -> pa.Table:
            nodes, comp, leads = (group[c].to_pylist() for c in ("node", "comp", "leads"))
            n, h = shingles(group["text"].combine_chunks())
            at = starts_of(n)
            sets = [weights.of(h[x:y], levels.as_py()) for x, y, levels in zip(at[:-1], at[1:], group["levels"], strict=True)]
            owner = np.repeat(np.arange(len(sets)), [len(k) for k, _ in sets])
            keys, w = (np.concatenate(x) for x in zip(*sets, strict=True))
            total = np.array([x.sum() for _, x in sets])
            number = {c: i for i, c in enumerate(dict.fromkeys(comp))}
            label = np.array([number[c] for c in comp])
            found = []
            for i in np.flatnonzero(leads):
                mine, mine_w = sets[i]
                fits = (label != label[i]) & (np.minimum(total, total[i]) >= similarity * np.maximum(total, total[i]))
                if not fits.any() or not len(mine):
                    continue
                place = np.minimum(np.searchsorted(mine, keys), len(mine) - 1)
                hit = mine[place] == keys
                low = np.bincount(owner[hit], np.minimum(w[hit], mine_w[place[hit]]), len(sets))
                near = np.flatnonzero(fits & (low >= similarity * (total + total[i] - low)))
                for j in near:
                    found.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
                    label[label == label[j]] = label[i]
            return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

        full = rows.join(texts, "node")
        return full.groupBy("band", "chunk").applyInArrow(compare, "a binary, b binary")

    # first every node meets one leader of each of its bands
    first = verify(placed.filter(F.col("node") != F.col("leader")).select(F.col("leader").alias("a"), F.col("node").alias("b")))
    done = placed.select("band", F.col("leader").alias("node")).distinct()
    labels, turn = components(first), 0
    while True:
        # nodes that have not met all others of their band, in bands where these are of several components
        comp = placed.select("band", "node").join(labels, "node", "left").select("band", "node", F.coalesce("comp", "node").alias("comp"))
        left = comp.join(done, ["band", "node"], "left_anti")
        parts = left.groupBy("band", "comp").agg(F.count("*").alias("m"))
        mixed = parts.groupBy("band").agg(F.max(F.struct("m", "comp")).alias("most"), F.sum("m").alias("n")).filter(F.col("most.m") < F.col("n"))
        open_ = materialize(left.join(mixed.select("band", "n", F.col("most.m").alias("m"), F.col("most.comp").alias("main")), "band"), "open")
        if open_.isEmpty():
            break
        # those outside a band's largest component lead, about CHUNK at a time; when they have met all, the band is done
        few = F.col("n") - F.col("m") <= CHUNK
        drawn = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 30)) < F.lit(CHUNK << 30) / (F.col("n") - F.col("m"))
        chunks = F.ceil(F.col("n") / CHUNK).cast("int")
        own = F.pmod(F.xxhash64("node", F.lit(turn + 1)), chunks).cast("int")
        seated = open_.select("band", "node", "comp", ((F.col("comp") != F.col("main")) & (few | drawn)).alias("leads"), chunks.alias("chunks"), own.alias("own"))
        rows = seated.select("band", "node", "comp", "leads", F.explode(F.when(F.col("leads"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("own"))).alias("chunk"))
        new = materialize(meet(rows).distinct(), "links")
        done = materialize(done.union(seated.filter("leads").select("band", "node")), "done")
        turn += 1
        if not new.isEmpty():  # components grow by links between them
            of = {k: comp.select(F.col("node").alias(k), F.col("comp").alias(f"comp_{k}")).distinct() for k in "ab"}
            between = new.join(of["a"], "a").join(of["b"], "b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))
            roots = components(between.filter(F.col("a") != F.col("b")))
            every = comp.select("node", "comp").distinct()
            labels = materialize(relabel(every, roots), "labels")

    return members, labels


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of every class, the one with the least id, in the columns it came with."""
    name, node = free_names(docs, "_id", "_node")
    with scratch_of(docs.sparkSession) as kept:
        found = classes(docs, id_col=id_col, text_col=text_col, **options)
        first = found.filter((F.col("node") == F.col("first_node")) & F.col("doc_id").eqNullSafe(F.col("class_id")))
        first = materialize(first.select(F.col("doc_id").alias("kept_id"), F.col("node").alias("kept_node")).distinct(), "kept")
        kept.append(first)
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))
    numbered = docs.withColumn(name, F.col(id_col).cast("long")).withColumn(node, digest)
    side = _small_side(first)
    keep = numbered.join(side, (numbered[node] == side["kept_node"]) & numbered[name].eqNullSafe(side["kept_id"]), "left_semi")
    return keep.dropDuplicates([name, node]).select(*docs.columns)
