import glob
import os

import duckdb
import pytest

from fathomline.plans.oracle import ORACLE_SQL
from fathomline.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the standard tables are not here")


def rows(values):
    return sorted(str(tuple(v)) for v in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = rows(df.select(*columns).collect())
    assert found or name.startswith("near_dup")
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for f in glob.glob(f"{DATA}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
        con.execute(f"CREATE VIEW answer AS {ORACLE_SQL[name]}" if not ORACLE_SQL[name].startswith("WITH RECURSIVE") else f"CREATE TABLE answer AS {ORACLE_SQL[name]}")
        assert found == rows(con.execute(f"SELECT {', '.join(columns)} FROM answer").fetchall())


def test_entry_works_without_the_llm_folder(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLE_SQL) <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 1
