import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomline.llm import common, langid, neardup, packing, substrings

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"
KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_scratch_tables_go_but_for_those_kept(spark):
    there = lambda t: os.path.isdir(t._scratch_path.removeprefix("file://"))
    before = common.materialize(spark.range(3), "before")
    with common.scratch_of(spark) as kept:
        one, two = (common.materialize(spark.range(5).groupBy((F.col("id") % 2).alias("k")).count(), "t") for _ in range(2))
        kept.append(two)
    assert there(before) and not there(one) and there(two) and two.count() == 2
    common.discard(two)
    assert not there(two) and spark.conf.get(KEY, None) is None


def test_rows_keep_their_numbers(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).repartition(5).write.parquet(path)
    stored = spark.read.parquet(path)
    for table in (stored, stored.select((F.col("id") + 1).alias("id")), stored.repartition(3, F.rand()), stored.withColumn("x", F.rand())):
        rows = common.numbered(table, "n")
        one, two = sorted(rows.collect()), sorted(rows.collect())
        assert one == two and len({r["n"] for r in one}) == 100


def test_slices_hold_every_row_once():
    batch = pa.record_batch([pa.array(["a" * n for n in (1, 50, 0, 200, 3)] + [None]), pa.array(range(6))], names=["text", "k"])
    parts = list(common.slices(batch, "text", 60))
    assert [k for p in parts for k in p.column(1).to_pylist()] == list(range(6)) and len(parts) > 1


@pytest.mark.parametrize("operator", [langid.keep_identified, neardup.drop_near_duplicates, substrings.remove_repeats, packing.pack])
def test_workers_get_small_batches(spark, docs, operator):
    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    spark.conf.unset(BOUND)
    operator(docs([(1, "a b c", "en")]))
    wide = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("abcd "), 2000).alias("text"))
    got = wide.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in got) == 3000 and max(r.bytes for r in got) < 9 << 20


def test_a_bound_of_the_session_stays(spark, docs):
    spark.conf.set(BOUND, "1000")
    assert {r.doc_id for r in packing.pack(docs([(1, "a b"), (2, "c")])).collect()} == {1, 2} and spark.conf.get(BOUND) == "1000"
    spark.conf.unset(BOUND)


def test_hashes_of_words_are_those_of_their_bytes():
    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    def plain(word):
        raw = word.encode()
        out = mix((len(raw) + 0x9E3779B97F4A7C15) % 2**64)
        for k in range(0, len(raw), 8):
            out = mix((out * 0xD6E8FEB86659FD93 + int.from_bytes(raw[k : k + 8], "little")) % 2**64)
        return out

    words = ["", *("abcdéfg漢ijklmnopqrstuvw"[:n] for n in range(1, 24)), "", "\0", "\0\0"]
    for array in (pa.array(words), pa.array(words).slice(5, 9), pa.array(words).slice(24), pa.array([""]), pa.array([], pa.string())):
        assert common.word_hashes(array).tolist() == [plain(w) for w in array.to_pylist()]
