"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a text column that a worker handles at once; a longer row is handled alone.
SLICE_BYTES = 4 << 20
#: Bytes of the batches that rows go to workers in while a table is written; a longer row is a batch alone.
BATCH_BYTES = 8 << 20
#: ``salted_join``: rows of a key from which it may be hot, and how many keys are hot at most.
HOT_ROWS, HOT_KEYS = 1024, 100_000


def tokenizer_path(name: str) -> str:
    """Full path of a public vocabulary file on the machine that asks: workers look it up themselves."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only where the session names none and runs in this process alone (tests) a
    folder of this machine is made and put into the session's settings.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: The group that tables are written in, see ``tables_of``.
_group = ["tables"]


@contextmanager
def tables_of(group: str) -> Iterator[None]:
    """What ``materialize`` writes within belongs to ``group``, which ``release`` deletes as one."""
    _group.append(group)
    try:
        yield
    finally:
        _group.pop()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}"


def release(spark: SparkSession, group: str | None = None) -> None:
    """Deletes what ``materialize`` wrote for this application, all of it or one group: call it when no result that reads it is needed any more."""
    _delete(spark, _own_dir(spark) + (f"/{group}" if group else ""))


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` returned and nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._written_to)


def materialize(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """Write ``df`` into the shared folder and read it back.

    Cuts lineage, so that a lost executor costs a reread instead of a
    recomputation, and makes what follows see one fixed version of the rows.
    Results that are not yet computed read these tables: ``release`` or ``drop``
    deletes them.  Rows of megabytes are put into files of ``file_rows`` at most:
    neither the writer nor the reader then holds more of them at once.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{_group[-1]}/{name}-{uuid.uuid4().hex}"
    # rows go to the workers in batches that the JVM and the worker both hold
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(bound)
    spark.conf.set(bound, str(BATCH_BYTES))
    try:
        df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
    finally:
        spark.conf.set(bound, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def give_back(spark: SparkSession) -> None:
    """Lets the executors' JVMs return heap that what ran before has left unused, to the Python workers beside them.

    A JVM keeps the memory it has once taken; a collection on demand is what makes
    it shrink.  The tasks are so many that every executor gets some.
    """
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.expr("reflect('java.lang.System', 'gc')").alias("gc")).write.format("noop").mode("overwrite").save()


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that clash with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: binds it as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sliced(batches: Iterator[pa.RecordBatch], at: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose column ``at`` (texts, bytes or lists) holds about ``limit`` bytes, one row at least.

    Spark bounds a batch by ``spark.sql.execution.arrow.maxBytesPerBatch``; what a
    worker makes of its rows may be many times as large, and this bounds that.
    """
    for batch in batches:
        column = batch.column(at)
        nested = pa.types.is_list(column.type) or pa.types.is_large_list(column.type)
        sizes = pc.multiply(pc.list_value_length(column), 8) if nested else pc.binary_length(column)
        sizes = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], spread: str, rows: str | None = None, how: str = "inner") -> DataFrame:
    """``many``, a table with any number of rows for each of ``keys``, joined with ``one``, which has at most one.

    Keys with more rows than a bound are hot: their rows are dealt by the hash of
    column ``spread`` over several tasks, and the row of ``one`` is copied to each.
    The bound is HOT_ROWS, or as many as leave at most HOT_KEYS hot keys whatever
    the input, so the broadcast table of hot keys has a bounded size.  ``rows`` is a
    column of ``one``, left out of the result, with the rows of ``many`` for the key
    (or more); without it they are counted.  Tables that are not written are
    computed anew for each look.
    """
    counts = one.select(*keys, F.col(rows).alias("_n")) if rows else many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    one = one.drop(rows) if rows else one
    total, most = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    bound = max(HOT_ROWS, total // HOT_KEYS)
    if most <= bound:
        return many.join(one, keys, how)
    hot = F.broadcast(counts.where(F.col("_n") > bound).select(*keys, F.ceil(F.col("_n") / bound).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    left = many.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("_salts")
    right = one.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
