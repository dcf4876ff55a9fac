import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from lodestone.plans import catalogue, index_queries, source_queries  # noqa: F401 - they register queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def frame(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), key=lambda c: c.astype(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in catalogue.ORACLE_SQL:
        want = duck.sql(catalogue.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        pd.testing.assert_frame_equal(frame(got), frame(want), check_dtype=False)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_work_of_small_files_is_dealt_out(spark):
    # 200 short rows of one file: one task would read them, and make and cut all files
    files = source_queries._files_of_parts(spark, DATA, ".c", [("int a;", [])])
    trees = source_queries._files_of_trees(spark, DATA, [("KEY/a.py", "", "true")])
    assert files.rdd.getNumPartitions() >= 8 and trees.rdd.getNumPartitions() >= 8
