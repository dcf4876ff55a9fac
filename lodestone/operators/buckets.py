"""Tables in buckets of a key, of which an update rewrites only those it touches.

A table lies in Parquet, one folder for each bucket of its key's hash.  An update
reads and overwrites the buckets that hold a key it removes or brings, by Spark's
dynamic partition overwrite; the others are neither read nor written.  A bucket
that loses its last row would be left as it was by such an overwrite, so a row
without a key is written with each touched bucket; readers pass over it.

An update is one job for each table: if it fails, nothing has changed.  Run again
it gives the same table.

Keys must not be null.  A key may have many rows: an update replaces all of them.
An update without keys writes nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The column, and the folders' name.
BUCKET = "bucket"
#: Rows of the driving table that a bucket holds on average, and how many buckets there are at most.
BUCKET_ROWS, MAX_BUCKETS = 256, 4096


@dataclass
class Touched:
    """What an update rewrote."""

    buckets: list[int]
    of: int


def bucket_count(rows: int) -> int:
    return max(1, min(MAX_BUCKETS, math.ceil(rows / BUCKET_ROWS)))


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def write_table(df: DataFrame, path: str, key: str, buckets: int, order: tuple[str, ...] = ()) -> None:
    """``df`` as a new table at ``path``, one file for each bucket, sorted by ``order``."""
    marked = df.withColumn(BUCKET, bucket_of(F.col(key), buckets))
    marked.repartition(BUCKET).sortWithinPartitions(BUCKET, *order).write.partitionBy(BUCKET).parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, key: str, only: list[int] | None = None) -> DataFrame:
    """The rows of a table, or those of some buckets: the filter prunes folders."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    rows = spark.read.schema(T.StructType([*kind.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(path)
    rows = rows if only is None else rows.where(F.col(BUCKET).isin(only))
    return rows.where(F.col(key).isNotNull()).drop(BUCKET)


def touched_buckets(keys: DataFrame, key: str, buckets: int) -> list[int]:
    """The buckets of some keys; their number is bounded by the table's."""
    return sorted(r[0] for r in keys.select(bucket_of(F.col(key), buckets)).distinct().collect())


def replace_rows(spark: SparkSession, path: str, schema: T.StructType | str, key: str, buckets: int, gone: DataFrame, new: DataFrame, touched: list[int] | None = None, order: tuple[str, ...] = ()) -> Touched:
    """The table at ``path`` without the rows of the keys in ``gone`` and with the rows of ``new``.

    ``touched``, if given, names the buckets that both lie in, and ``gone`` has all keys of ``new``; else they are looked up, for which ``new`` is computed once more.
    """
    keys = gone.select(key)
    if touched is None:
        # each row of ``new`` replaces what its key had
        keys = keys.union(new.select(key)).distinct()
        touched = touched_buckets(keys, key, buckets)
    if touched:
        kept = read_table(spark, path, schema, key, touched).join(keys, key, "left_anti").select(*new.columns)
        rows = kept.unionByName(new).withColumn(BUCKET, bucket_of(F.col(key), buckets))
        marks = spark.createDataFrame([(b,) for b in touched], f"{BUCKET} int").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in new.schema.fields], F.col(BUCKET))
        made = rows.unionByName(marks).repartition(BUCKET).sortWithinPartitions(BUCKET, *order)
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return Touched(touched, buckets)


def sizes(spark: SparkSession, path: str) -> dict[int, int]:
    """Bytes of each bucket."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(folder) if s.isDirectory() and s.getPath().getName().startswith(f"{BUCKET}=")]
    return {int(p.getName().split("=")[1]): fs.getContentSummary(p).getLength() for p in found}
