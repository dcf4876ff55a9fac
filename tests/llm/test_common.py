import pytest
from pyspark.sql import functions as F

from lodestone.llm import common


def test_written_tables_keep_rows_and_schema_until_released(spark):
    df = spark.createDataFrame([(1, None, [1, 2]), (2, "x", None)], "a long, b string, c array<int>")
    kept = common.materialize(df, "t")
    assert kept.schema == df.schema and sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    assert common.materialize(df.limit(0), "t").count() == 0
    common.release(spark)
    with pytest.raises(Exception, match="FILE_NOT_EXIST"):
        kept.collect()


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "words int, _WORDS int")
    assert common.fresh(df, "words", "words", "x") == ["__words", "___words", "x"]


def test_let(spark):
    assert spark.range(1).select(common.let(F.lit(3), lambda x: x * x)).first()[0] == 9
