"""Pieces shared by the operators: shared scratch tables and vectorised words."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Bytes of a batch that goes to a Python worker, about.
BATCH = 8 << 20

_roots: dict[str, str] = {}
_made: list[str] = []  # paths of the scratch tables that are there


def scratch(spark: SparkSession) -> str:
    """The session's folder for intermediate tables, under spark.checkpoint.dir."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = f"{shared_folder(spark)}/fathomline-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _remove(spark: SparkSession, root: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may have gone before this process
        pass


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of the queries run inside go when each query ends, not when the driver's memory happens to be swept."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df once to shared storage and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    with shuffles_dropped(spark):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    _made.append(path)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that materialize made, once nothing reads them any more."""
    for t in tables:
        _made.remove(t._scratch_path)
        _remove(t.sparkSession, t._scratch_path)


@contextmanager
def scratch_of(spark: SparkSession):
    """Removes the scratch tables made inside, but those that are put in the list it gives."""
    before, kept = len(_made), []
    yield kept
    paths = {t._scratch_path for t in kept}
    for path in _made[before:]:
        if path not in paths:
            _remove(spark, path)
    _made[before:] = [p for p in _made[before:] if p in paths]


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number for every row that stays the same however often the result is read.

    A plain scan of files numbers its rows alike each time; anything else is written out once.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project" and plan.deterministic():
        plan = plan.child()
    rows = df.withColumn(name, F.monotonically_increasing_id())
    return rows if plan.nodeName().startswith("Relation ") or plan.nodeName() == "LogicalRelation" else materialize(rows, "numbered")


def small_batches(spark: SparkSession) -> None:
    """From now on batches for Python workers hold about BATCH bytes, unless the session sets a bound itself.

    Spark's own bound is 64 MB, so all of a task's texts would be one batch: in
    the JVM twice outside its heap, as vectors and as the stream to the worker,
    and once more in the worker.  The bound is read when a table is computed,
    which may be after its operator has returned, so it is not taken back.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until df has no column of it."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def input_bytes(df: DataFrame) -> int:
    """The planner's estimate of the size of df; it sets numbers of groups only."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(n, 1 << 55)


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the decimal text of key, modulo n; null keys give null."""
    return F.crc32(key.cast("string").cast("binary")) % n


def as_text(array: pa.Array) -> pa.Array:
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return pc.fill_null(array.cast(pa.string()), "")


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text: counts per text, flat words."""
    parts = pc.ascii_split_whitespace(as_text(texts))
    lens = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if full.all():
        return lens, flat
    owner = np.repeat(np.arange(len(lens)), lens)
    return np.bincount(owner[full], minlength=len(lens)).astype(np.int64), flat.filter(pa.array(full))


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Counts per text, a code for every word, and the distinct words by code."""
    lens, flat = split_words(texts)
    d = flat.dictionary_encode()
    return lens, d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def starts_of(lens: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=out[1:])
    return out


def sum_by_row(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths, with 0 for empty runs."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    at = starts_of(lens)
    return total[at[1:]] - total[at[:-1]]


def doc_codes(lens: np.ndarray, codes: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, code) pairs with their frequencies."""
    owner = np.repeat(np.arange(len(lens), dtype=np.int64), lens)
    key, freq = np.unique(owner * max(n_codes, 1) + codes, return_counts=True)
    return key // max(n_codes, 1), key % max(n_codes, 1), freq


_M1 = np.uint64(0xBF58476D1CE4E5B9)  # fixed values of the splitmix64 finaliser
_M2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64 values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of every (distinct) word, the same in every process.

    Eight bytes of all words at a time are mixed in, so the work is done in
    whole arrays.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    words = pa.concat_arrays([words.cast(pa.string())])  # offsets from 0
    at = np.frombuffer(words.buffers()[1], np.int32, n + 1).astype(np.int64)
    raw = np.zeros(int(at[-1] - at[0]) + 8, np.uint8)
    raw[:-8] = np.frombuffer(words.buffers()[2] or b"", np.uint8, int(at[-1]))[at[0] :]
    at -= at[0]
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))  # eight bytes from every place on, read where they lie
    left = np.diff(at)
    out = mix64(left.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live, place = np.flatnonzero(left > 0), at[:-1]
    place, left = place[live], left[live]
    while len(live):
        keep = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        part = np.where(left >= 8, eight[place], eight[place] & ((np.uint64(1) << (keep & np.uint64(63))) - np.uint64(1)))
        out[live] = mix64(out[live] * np.uint64(0xD6E8FEB86659FD93) + part)
        more = left > 8
        live, place, left = live[more], place[more] + 8, left[more] - 8
    return out


def release() -> None:
    """Give memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """The batch in runs of rows of about ``most`` bytes of the text column."""
    texts = batch.column(batch.schema.get_field_index(column))
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    at = 0
    for end in [*cuts.tolist(), batch.num_rows]:
        if end > at:
            yield batch.slice(at, end - at)
        at = end
    release()
