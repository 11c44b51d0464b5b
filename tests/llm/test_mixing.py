import collections
import glob

import duckdb
import pytest

from fathomline.llm import mixing

from .conftest import ODD


def rows(n=900):
    return [(i, f"text {i}", None, ("big", "mid", "small")[0 if i % 9 < 6 else 1 if i % 9 < 8 else 2]) for i in range(n)]


def test_rates_reach_the_target(docs):
    got = collections.Counter(r.source for r in mixing.mix(docs(rows()), temperature=0.0).collect())
    assert all(abs(got[s] - 300) < 75 for s in ("big", "mid", "small"))
    given = collections.Counter(r.source for r in mixing.mix(docs(rows()), weights={"big": 1.0, "small": 3.0}, epochs=2.0).collect())
    assert set(given) == {"big", "small"} and abs(given["small"] - 1350) < 200 and abs(given["big"] - 450) < 100


def test_same_draw_again_and_shuffled(docs):
    a = [tuple(r) for r in mixing.mix(docs(rows())).collect()]
    b = [tuple(r) for r in mixing.mix(docs(rows()).repartition(7)).collect()]
    assert a == b
    keys = [r[-1] for r in a]
    assert keys == sorted(keys) and [r[0] for r in a] != sorted(r[0] for r in a)


def test_copies_equal_sql(docs, tmp_path):
    path = str(tmp_path / "d")
    docs(rows() + ODD).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet({glob.glob(path + '/*.parquet')})")
    want = sorted(con.execute(mixing.oracle_sql()).fetchall(), key=str)
    got = mixing.mix(docs(rows() + ODD)).select("doc_id", "source", "copy_no", "shuffle_key").collect()
    assert sorted(map(tuple, got), key=str) == want


@pytest.mark.parametrize("epochs", [1.0, 900.0])
def test_large_rates_keep_their_mean(docs, epochs):
    n = mixing.mix(docs([(i, "x", None, "s") for i in range(20)]), epochs=epochs).count()
    assert abs(n - 20 * epochs) < 6 * (20 * epochs) ** 0.5


def test_odd_tables(docs, spark):
    assert mixing.mix(docs([])).count() == 0
    clash = spark.createDataFrame([(1, "t", "s", 9, "mine", "own")], "doc_id long, text string, source string, copy_no int, _source string, _copies string")
    got = mixing.mix(clash, epochs=5.0)
    assert got.columns == ["doc_id", "text", "source", "_source", "_copies", "copy_no", "shuffle_key"]
    assert {(r._source, r._copies) for r in got.collect()} == {("mine", "own")}
    assert mixing.mix(docs(rows()), weights={}).count() == 0
