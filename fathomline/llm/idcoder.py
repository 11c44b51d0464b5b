"""Token-id files: an adaptive context-mixing range coder in independent blocks.

A block holds the ids of whole documents.  Its ids are laid out as ``lanes``
contiguous runs that are coded side by side, one id of every lane per step, by
a range coder of its own per lane; the statistics are shared by the lanes and
learned from the ids already coded in this block alone.  An id is coded once,
under a mixture of three predictions:

* order 2: the id that last followed these two ids,
* order 1: the id that last followed this id,
* order 0: counts of all ids so far, renewed on a fixed schedule.

How far each is trusted is learned per state (how often the two contexts were
right lately, and whether they agree).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import input_bytes, numbered, slices, starts_of
from .tokens import kept_encoder

MAGIC = b"FTID"
VERSION = 2
#: magic, version, vocabulary size, documents, ids, lanes, crc32 of the ids; then crc32 of all these and the body
HEADER, CHECK = struct.Struct("<4sIIIQII"), struct.Struct("<I")

#: the scales of the flags and of order 0; a range is divided by both at once
_FLAG_BITS, _TOTAL_BITS = 11, 21
_FLAGS, _TOTAL = 1 << _FLAG_BITS, 1 << _TOTAL_BITS
#: frequent ids have whole cells of the scale of order 0, so one look finds them
_CELL_BITS = 4
_U = np.uint64
_SCALE_BITS = _U(_FLAG_BITS + _TOTAL_BITS)
_TOP, _BOTTOM = _U(1 << 48), _U(1 << 32)
_LOW32 = _U((1 << 32) - 1)
_HASH1, _HASH2 = np.uint32(2654435761), np.uint32(40503 * 2654435761 & 0xFFFFFFFF)
_SLOTS2_BITS = 18
#: steps between renewals of the trust in the contexts
_TRUST_STEPS = 8


class _Model:
    """Order-0 to order-2 statistics of one block; coder and decoder run it alike.

    A context's slot holds four times the id that it foretells, plus how sure
    it is of it (0 to 3).  A flag tells which context is right; where none is,
    the id follows on the scale of order 0.  The two are one step of the coder.
    On that scale frequent ids have cells by their counts; behind the cells
    every id has a place of width 1, for those that have no cell.
    """

    def __init__(self, vocab: int):
        if vocab > _TOTAL // 2:
            raise ValueError(f"more ids than the scale holds: {vocab}")
        self.vocab = vocab
        self.counts = np.zeros(vocab, np.int64)
        self.seen, self.next_renewal, self.waiting = 0, 0, []
        bits = max(10, min(18, (vocab - 1).bit_length()))
        self.slots2 = 1 << bits  # those of order 2 follow those of order 1
        self.slots = np.zeros(self.slots2 + (1 << _SLOTS2_BITS), np.uint32)
        # four places for each of 32 states: order 2 is right, order 1 alone, neither; the last is not used
        self.hits = np.tile([1.0, 1.0, 8.0, 0.0], 32)
        self.outcomes: list[np.ndarray] = []
        self.n_cells = (_TOTAL - vocab) >> _CELL_BITS
        self.behind = self.n_cells << _CELL_BITS
        self.alone = np.arange(vocab) + self.behind
        # start and width of every id on the scale of order 0; at 0 the whole scale, for ids that a context foretells
        self.start0, self.width0 = np.zeros(vocab + 1, np.int64), np.full(vocab + 1, _TOTAL)
        self._share()
        self._renew()

    def _renew(self) -> None:
        if self.waiting:
            self.counts += np.bincount(np.concatenate(self.waiting), minlength=self.vocab)
            self.waiting = []
        grown = np.cumsum(self.counts if self.seen else np.ones(self.vocab))
        # one product by a constant, rounded down: the same on every machine, and never falling
        ends = (grown * (self.n_cells / float(grown[-1]))).astype(np.int64)
        ends[-1] = self.n_cells
        cells = np.diff(ends, prepend=0)
        start, width = self.start0[1:], self.width0[1:]
        np.left_shift(cells, _CELL_BITS, out=width)
        np.left_shift(ends, _CELL_BITS, out=start)
        start -= width
        none = cells == 0
        np.copyto(start, self.alone, where=none)
        width += none
        self.cells, self.id_of_cell = cells, None  # the second is made when something is looked up
        self.next_renewal = self.seen + max(4096, self.seen // 2)

    def _share(self) -> None:
        hits = self.hits.reshape(-1, 4)
        part = (hits / hits.sum(axis=1, keepdims=True) * (_FLAGS - 3)).astype(np.int64) + 1
        part[:, 2] = _FLAGS - part[:, 0] - part[:, 1]
        part[:, 3] = 0
        self.flag_start, self.flag_width = ((np.cumsum(part, axis=1) - part) << _TOTAL_BITS).reshape(-1), part.reshape(-1)

    def predict(self, one: np.ndarray, two: np.ndarray) -> None:
        """Look up both contexts of every lane: one id back, and two."""
        key = two * _HASH2
        key += one * _HASH1
        key >>= np.uint32(32 - _SLOTS2_BITS)
        self.at = np.empty((2, len(one)), np.int64)
        self.at[0], self.at[1] = one, key
        if self.vocab > self.slots2:
            self.at[0] &= self.slots2 - 1
        self.at[1] += self.slots2
        self.said = self.slots.take(self.at)
        self.sure = self.said.astype(np.uint8)
        self.sure &= np.uint8(3)
        self.state = self.sure[1] << np.uint8(4)
        self.state |= self.sure[0] << np.uint8(2)
        self.state |= ((self.said[0] ^ self.said[1]) < np.uint32(4)).view(np.uint8) << np.uint8(6)

    def span(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of every lane's id on both scales."""
        self.fresh = ids << np.uint32(2)
        self.miss = (self.said ^ self.fresh) > np.uint32(3)
        neither = self.miss[0] & self.miss[1]
        outcome = self.state + self.miss[1].view(np.uint8)
        outcome += neither.view(np.uint8)
        self.outcome = outcome.astype(np.int64)
        at = ids.astype(np.int64)
        at += 1
        at *= neither
        width = self.flag_width.take(self.outcome)
        start = self.start0.take(at)
        start *= width
        start += self.flag_start.take(self.outcome)
        width *= self.width0.take(at)
        return start.view(_U), width.view(_U)

    def find(self, value: np.ndarray) -> np.ndarray:
        """The id of every lane from a value on both scales."""
        if self.id_of_cell is None:
            self.id_of_cell = np.zeros(-(-_TOTAL >> _CELL_BITS), np.uint32)
            self.id_of_cell[: self.n_cells] = np.repeat(np.arange(self.vocab, dtype=np.uint32), self.cells)
        value = value.view(np.int64)
        flag = self.state.astype(np.int64)
        flag += 1
        foretold = np.where(value < self.flag_start.take(flag), self.said[1], self.said[0])
        foretold >>= np.uint32(2)
        flag += 1
        value -= self.flag_start.take(flag)
        neither = value >= 0
        value *= neither
        # exact: a quotient of whole numbers below 2^53 is never rounded up to a whole one
        goal = (value / self.flag_width.take(flag)).astype(np.int32)
        ids = self.id_of_cell.take(goal >> np.int32(_CELL_BITS))
        far = np.flatnonzero(goal >= self.behind)
        if len(far):
            ids[far] = goal.take(far) - self.behind
        return np.where(neither, ids, foretold)

    def learn(self, ids: np.ndarray) -> None:
        self.outcomes.append(self.outcome)
        if len(self.outcomes) == _TRUST_STEPS:
            self.hits += np.bincount(np.concatenate(self.outcomes), minlength=len(self.hits))
            if self.hits.max() > 1 << 16:
                self.hits *= 0.5
            self.outcomes = []
            self._share()
        # of booleans, a > b is: a and not b
        some = self.sure > 0
        self.said += (self.sure < 3) > self.miss
        self.said -= some & self.miss
        self.slots[self.at] = np.where(self.miss > some, self.fresh, self.said)
        self.waiting.append(ids)
        self.seen += len(ids)
        if self.seen >= self.next_renewal:
            self._renew()


def _runs(flat: np.ndarray, lanes: int) -> list[tuple[int, np.ndarray]]:
    """The lanes' runs of ids as tables, with the number of their first lane: those that are one id longer, then the others."""
    each, more = divmod(len(flat), lanes)
    cut = more * (each + 1)
    runs = [(0, flat[:cut].reshape(more, each + 1)), (more, flat[cut:].reshape(lanes - more, each))]
    return [(lane, run) for lane, run in runs if run.size]


def _turn(of: np.ndarray, into: np.ndarray) -> None:
    """Copy a table into one that lies the other way in memory, a few columns at a time, as these stay in the cache."""
    for k in range(0, of.shape[1], 16):
        into[:, k : k + 16] = of[:, k : k + 16]


def encode_ids(ids: np.ndarray, vocab: int, lanes: int) -> bytes:
    """The body of a block: words of 16 bits, four of every lane, then in the order in which a decoder needs them."""
    n = len(ids)
    lanes = max(1, min(lanes, n))
    steps, last = -(-n // lanes), n % lanes or lanes
    model = _Model(vocab)
    low, rng = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    # words as they come out, and the lanes that they belong to
    words, owners = [], []
    kind = np.uint16 if lanes <= 1 << 16 else np.uint32
    grid = np.zeros((steps, lanes), np.uint32)
    for lane, run in _runs(ids, lanes):
        _turn(run, grid[: run.shape[1], lane : lane + len(run)].T)
    before = np.zeros(lanes, np.uint32)
    for step in range(steps):
        live = lanes if step < steps - 1 else last
        now, one, two = grid[step, :live], grid[step - 1, :live] if step else before[:live], grid[step - 2, :live] if step > 1 else before[:live]
        model.predict(one, two)
        start, width = model.span(now)
        lo, r = low[:live], rng[:live]
        r >>= _SCALE_BITS
        start *= r
        lo += start
        r *= width
        who = np.flatnonzero(_settle(lo, r))
        while len(who):
            out, rest = lo.take(who), r.take(who)
            words.append((out >> _U(48)).astype("<u2"))
            owners.append(who.astype(kind))
            out <<= _U(16)
            rest <<= _U(16)
            again = _settle(out, rest)
            lo[who], r[who] = out, rest
            who = who[again]
        model.learn(now)
    puts = sum(map(len, words))
    end = (low + _LOW32) >> _U(32)
    for part in (end >> _U(16), end & _U(0xFFFF), *np.zeros((2, lanes), _U)):
        words.append(part.astype("<u2"))
        owners.append(np.arange(lanes, dtype=kind))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    by_lane = np.concatenate(words).take(order)
    # a decoder is four words ahead: where a lane puts a word out, it reads the fourth after that
    first = starts_of(np.bincount(owner, minlength=lanes))[:-1]
    stream = np.zeros(len(order), "<u2")
    stream[order[:-4]] = by_lane[4:]
    return b"".join(by_lane.take(first + k).tobytes() for k in range(4)) + stream[:puts].tobytes()


def _settle(low: np.ndarray, rng: np.ndarray) -> np.ndarray:
    """Whether each lane must put out a word; a range too small is cut to the next border."""
    out = low + rng
    out ^= low
    out = out < _TOP
    if rng.min() < _BOTTOM:
        small = rng < _BOTTOM
        small &= ~out
        rng[small] = (~low[small] + _U(1)) & _LOW32
        out |= small
    return out


def decode_ids(body: bytes, n: int, vocab: int, lanes: int) -> np.ndarray:
    lanes = max(1, min(lanes, n))
    steps, last = -(-n // lanes), n % lanes or lanes
    words, at = np.frombuffer(body, "<u2").astype(np.uint16), 4 * lanes
    code = np.zeros(lanes, _U)
    for k in range(4):
        code <<= _U(16)
        code |= words[k * lanes : (k + 1) * lanes]
    model = _Model(vocab)
    low, rng = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    grid = np.zeros((steps, lanes), np.uint32)
    before = np.zeros(lanes, np.uint32)
    for step in range(steps):
        live = lanes if step < steps - 1 else last
        now, one, two = grid[step, :live], grid[step - 1, :live] if step else before[:live], grid[step - 2, :live] if step > 1 else before[:live]
        model.predict(one, two)
        lo, r = low[:live], rng[:live]
        r >>= _SCALE_BITS
        value = code[:live] - lo
        value //= r
        np.minimum(value, _LOW32, out=value)
        now[:] = model.find(value)
        start, width = model.span(now)
        start *= r
        lo += start
        r *= width
        who = np.flatnonzero(_settle(lo, r))
        while len(who):
            value = code.take(who)
            value <<= _U(16)
            value |= words[at : at + len(who)]
            code[who] = value
            at += len(who)
            left, rest = lo.take(who), r.take(who)
            left <<= _U(16)
            rest <<= _U(16)
            again = _settle(left, rest)
            lo[who], r[who] = left, rest
            who = who[again]
        model.learn(now)
    out = np.zeros(n, np.uint32)
    for lane, run in _runs(out, lanes):
        _turn(grid[: run.shape[1], lane : lane + len(run)].T, run)
    return out


def write_block(doc_lens: np.ndarray, ids: np.ndarray, vocab: int, lanes: int = 4096) -> bytes:
    """A whole block: header, ids per document, and the coded ids."""
    body = np.asarray(doc_lens, "<u4").tobytes() + encode_ids(ids, vocab, lanes)
    check = zlib.crc32(np.ascontiguousarray(ids, "<u4"))
    head = HEADER.pack(MAGIC, VERSION, vocab, len(doc_lens), len(ids), lanes, check)
    return head + CHECK.pack(zlib.crc32(body, zlib.crc32(head))) + body


def read_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids per document and all ids; a damaged block raises ValueError."""
    if len(data) < HEADER.size + CHECK.size or data[:4] != MAGIC:
        raise ValueError("not a token block")
    magic, version, vocab, docs, n, lanes, check = HEADER.unpack_from(data)
    body = data[HEADER.size + CHECK.size :]
    if CHECK.unpack_from(data, HEADER.size)[0] != zlib.crc32(body, zlib.crc32(data[: HEADER.size])):
        raise ValueError("token block is damaged")
    if version != VERSION:
        raise ValueError(f"token block of version {version}")
    lens = np.frombuffer(body, "<u4", docs).astype(np.int64)
    ids = decode_ids(body[4 * docs :], n, vocab, lanes).astype("<u4", copy=False) if n else np.zeros(0, "<u4")
    if zlib.crc32(ids) != check or lens.sum() != n:
        raise ValueError("token block does not decode to its ids")
    return lens, ids


def write(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json",
          end_id: int = 1, block_ids: int = 1 << 20, lanes: int = 4096, part_bytes: int = 12 << 20) -> None:
    """Write the ids of all documents, each followed by end_id, in ascending id order.

    ``path`` becomes a folder of Parquet containers, one row per block: part,
    block, n_docs, n_ids, doc_ids and ``data`` (see write_block).  Parts are
    ranges of the id; a block takes whole documents up to about block_ids ids.
    Null or empty texts are the end id alone; rows of equal id follow each
    other in a fixed order; null ids come first; a very long text is a block of
    its own; further columns are ignored.  An empty table writes an empty folder.
    """
    # ties are dealt by content and place, so that no key is too large for a part
    rows = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "place")
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("tie"), "place")
    parts = max(1, min(1 << 20, -(-input_bytes(docs) // part_bytes)))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("place")]
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_encoder(vocabulary)
        vocab = max(encoder.vocab_size, end_id + 1)
        block, part, keys, lens, kept = 0, 0, [], [], []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(kept)
            n = np.concatenate(lens)
            names = pa.concat_arrays(keys)
            row = [[part], [block], [len(n)], [len(ids)], [names.to_pylist()], [write_block(n, ids, vocab, lanes)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, _KINDS, strict=True)], names=_NAMES)

        for whole in batches:
            part = whole.column(4)[0].as_py() if whole.num_rows else part
            for batch in slices(whole, "text", 1 << 20):
                n, ids = encoder.encode(batch.column(1))
                ids = np.insert(ids, np.cumsum(n), np.uint32(end_id))
                ends, at = np.cumsum(n + 1), 0
                while at < len(n):  # whole documents up to the block's size, one at least
                    held = sum(map(len, kept))
                    base = ends[at - 1] if at else 0
                    upto = max(int(np.searchsorted(ends - base, block_ids - held, side="right")), at + (not held))
                    upto = min(upto, len(n))
                    if upto > at:
                        keys.append(batch.column(0).slice(at, upto - at))
                        lens.append(n[at:upto] + 1)
                        kept.append(ids[base : ends[upto - 1]])
                        at = upto
                    if at < len(n):
                        yield flush()
                        block, keys, lens, kept = block + 1, [], [], []
        if kept:
            yield flush()

    blocks = ranged.mapInArrow(encode, ", ".join(f"{n} {t}" for n, t in zip(_NAMES, _SQL, strict=True)))
    blocks.write.option("compression", "none").parquet(path)


_NAMES = ["part", "block", "n_docs", "n_ids", "doc_ids", "data"]
_SQL = ["int", "int", "long", "long", "array<long>", "binary"]
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]


def read(spark, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a folder that ``write`` made, decoded block by block.

    One row per document: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 over its little-endian unsigned 32-bit ids; with_ids
    adds ``ids`` (array).  Checksums are verified; damage fails the job.
    """
    table = spark.read.parquet(path)
    sizes = table.select("part", "block", "n_ids")
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    starts = sizes.join(parts, "part").select("part", "block", (F.col("part_start") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("block_start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lens, ids = read_block(batch.column(3)[k].as_py())
                at = starts_of(lens)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                same = [np.repeat(batch.column(i)[k].as_py(), len(lens)) for i in (0, 1)]
                columns = [pa.array(same[0], pa.int32()), pa.array(same[1], pa.int32()), batch.column(2)[k].values, pa.array(at[:-1]), pa.array(lens), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = "part int, block int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    names = [x.split()[0] for x in kinds.split(", ")]
    rows = table.select("part", "block", "doc_ids", "data").mapInArrow(decode, kinds)
    joined = rows.join(starts, ["part", "block"])
    return joined.select("doc_id", (F.col("block_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] * with_ids))


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write to the session's scratch folder and read the files back."""
    import uuid

    from .common import scratch

    spark = docs.sparkSession
    path = f"{scratch(spark)}/ids-{uuid.uuid4().hex[:12]}"
    write(docs, path, **options)
    return read(spark, path)
