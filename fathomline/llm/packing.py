"""Packing: first-fit decreasing with a tournament tree, in randomised groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, slices, small_batches, starts_of
from .tokens import WordEncoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Bins:
    """Open bins under a tournament tree of their free room.

    Every inner node holds the larger room of its two children, so the first
    bin that takes a piece is found by one walk from the root.
    """

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(most - 1, 0).bit_length()
        self.capacity = capacity
        self.tree = [capacity] * (2 * self.leaves)
        self.opened = 0

    def put(self, size: int) -> int:
        """Place a piece in the first bin with room; the bin's number."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        tree[node] -= size
        found = node - self.leaves
        node //= 2
        while node:
            most = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == most:
                break
            tree[node] = most
            node //= 2
        self.opened = max(self.opened, found + 1)
        return found


def plan(sizes: list[int], capacity: int, min_cut: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every token once.

    Full windows of a document become sequences of their own.  The rests go by
    first-fit decreasing.  Then the emptiest bins are taken apart to fill the
    room left in others, cutting a piece where the room is at least min_cut,
    and the one bin that stays part-full is dealt out into powers of two,
    which need no padding.
    """
    full, rests = [], []
    for doc, n in enumerate(sizes):
        whole = n - n % capacity
        full += [[(doc, at, capacity)] for at in range(0, whole, capacity)]
        if n > whole:
            rests.append((n - whole, doc, whole))
    rests.sort(key=lambda x: (-x[0], x[1]))
    tree = Bins(len(rests), capacity)
    bins: list[list[tuple[int, int, int]]] = [[] for _ in rests]
    for n, doc, at in rests:
        bins[tree.put(n)].append((doc, at, n))
    del bins[tree.opened :]

    fill = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda i: (-fill[i], i))
    i, j = 0, len(order) - 1
    while i < j:
        to, source = order[i], order[j]
        room = capacity - fill[to]
        if room < max(min_cut, 1):
            i += 1
            continue
        doc, at, n = bins[source].pop()
        take = min(n, room)
        bins[to].append((doc, at, take))
        if take < n:
            bins[source].append((doc, at + take, n - take))
        fill[to] += take
        fill[source] -= take
        if not fill[source]:
            j -= 1
    if i == j and (left := fill[order[j]]) and capacity - left >= min_cut:
        bins[order[j]], more = _powers(bins[order[j]], left)
        bins += more
    return full + [b for b in bins if b]


def _powers(pieces: list[tuple[int, int, int]], total: int) -> tuple[list, list]:
    """Deal pieces into sequences whose lengths are the powers of two in total."""
    out, todo = [], list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        if not (room := total & (1 << bit)):
            continue
        one = []
        while room:
            doc, at, n = todo.pop()
            take = min(n, room)
            one.append((doc, at, take))
            if take < n:
                todo.append((doc, at + take, n - take))
            room -= take
        out.append(one)
    return out[0], out[1:]


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json",
         end_id: int = 1, capacity: int = 2048, group_docs: int = 1024, min_cut: int = 16, seed: int = 17,
         with_ids: bool = False) -> DataFrame:
    """Pack the ids of every document, each followed by end_id, into sequences.

    One row per piece: doc_id, start and length within the document's ids,
    ids_crc32 of the piece (unsigned, over little-endian unsigned 32-bit ids),
    doc_tokens, sequence_id and offset in the sequence; with_ids adds ``ids``,
    the piece itself as such bytes.  Groups of about group_docs documents are
    drawn by a seeded hash of the row's place and packed independently, so
    memory is bounded by a group and a lost task repacks one group only.  Only
    ids travel between executors, once.

    A null or empty text is the end id alone.  Rows that repeat, or that have
    an id in common or none, are spread like others and packed as often as they
    occur; within a group documents go by id, then by place.  A very long text
    fills windows of its own.  An empty table gives no rows.  Further columns
    are ignored.
    """
    small_batches(docs.sparkSession)
    groups = max(1, -(-docs.count() // group_docs))
    rows_in = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "row")
    part = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(groups)).cast("long")
    source = rows_in.select("doc_id", "text", part.alias("part"), "row")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(vocabulary)
        kind = np.dtype("<u2") if max(encoder.vocab_size, end_id + 1) <= 1 << 16 else np.dtype("<u4")
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                n, ids = encoder.encode(batch.column(1))
                ids = np.insert(ids.astype(kind), np.cumsum(n), kind.type(end_id))
                at = starts_of((n + 1) * kind.itemsize)
                data = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(ids)])
                width = pa.array(np.full(len(n), kind.itemsize, np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), width, data.cast(pa.binary())], ["doc_id", "part", "row", "width", "ids"])

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("row", "ascending")])
        part, width = group["part"][0].as_py(), group["width"][0].as_py()
        doc_ids = group["doc_id"].to_pylist()
        ids = [np.frombuffer(x.as_buffer(), f"<u{width}") for x in group["ids"]]
        rows = []
        for k, sequence in enumerate(plan([len(x) for x in ids], capacity, min_cut)):
            offset = 0
            for doc, at, n in sequence:
                data = ids[doc][at : at + n].astype("<u4").tobytes()
                rows.append((doc_ids[doc], at, n, zlib.crc32(data), len(ids[doc]), (part << 32) + k, offset) + ((data,) if with_ids else ()))
                offset += n
        kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
        names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids
        columns = list(zip(*rows, strict=True))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    coded = source.mapInArrow(encode, "doc_id long, part long, row long, width int, ids binary")
    return coded.groupBy("part").applyInArrow(place, PIECES + ", ids binary" * with_ids)
