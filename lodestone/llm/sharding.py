"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass 1 scatters the records by a seeded hash into buckets of about
``bucket_bytes``; the number of tasks follows from the size of the input.  Each
bucket is sorted by that hash, so that its order doesn't depend on the order in
which blocks arrive, permuted in memory by Fisher-Yates (Spark's ``shuffle`` is
one) and written to the shared folder.  Pass 2 reads
the buckets back in order of number and deals the resulting sequence of rows
round robin into shards, which makes shard counts differ by one row at most
(law ``rows``).

The scatter hash covers the record's key and a row number that Spark hands out
while scanning, so copies of one text, rows of one source and even repeated
rows spread over all buckets: no bucket grows with a hot key.

Cases: null text counts no bytes; an empty table gives an empty result;
repeated rows are separate records; other columns travel along untouched,
whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import fresh, materialize, table

#: Bytes of records that one bucket holds on average.
BUCKET_BYTES = 8 << 20
#: Bytes of records that one task permutes, in as many buckets as that makes.
TASK_BYTES = 128 << 20
#: Bucket counts are summed in groups of this many, so that no task sees all.
GROUP = 1024
#: The offsets are one row of 16 bytes for each bucket; up to this many they are broadcast, beyond it they are joined by a shuffle.
BROADCAST_BUCKETS = 200_000


def external_shuffle(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of ``df`` with their place in a random order.

    Returns struct column ``rec`` (the row as it came) and long ``position``,
    gapless from 0.  The order depends on the seed, on the number of shuffle
    partitions and on how Spark splits the input; another run gives it again.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(8)
    total = df.agg(F.sum(size.cast("long")).alias("b")).first().b or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    tasks = max(math.ceil(total / TASK_BYTES), min(buckets, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    drawn = df.select(
        F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.monotonically_increasing_id()).alias("draw"),
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("rec"),
    )
    scattered = drawn.withColumn("bucket", F.pmod("draw", F.lit(buckets))).repartition(tasks, "bucket").sortWithinPartitions("bucket", "draw")
    shuffled = scattered.groupBy("bucket").agg(F.shuffle(F.collect_list("rec"), seed).alias("recs"))
    written = materialize(shuffled.select("bucket", F.posexplode("recs").alias("place", "rec")), "shard-buckets")

    counts = written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.expr(f"bucket div {GROUP}"))
    within = F.sum("n").over(W.partitionBy("block").orderBy("bucket")) - F.col("n")
    blocks = counts.groupBy("block").agg(F.sum("n").alias("m"))
    blocks = blocks.select("block", (F.sum("m").over(W.orderBy("block")) - F.col("m")).alias("before"))
    offsets = counts.select("bucket", "block", within.alias("inside")).join(blocks, "block").select("bucket", (F.col("inside") + F.col("before")).alias("offset"))
    if buckets <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    return written.join(offsets, "bucket").select("rec", (F.col("offset") + F.col("place")).alias("position"))


def shard_rows(df: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` in random order, dealt into ``shards`` (law ``rows``).

    Adds int ``shard`` and long ``slot`` (gapless from 0 in each shard); a
    column of ``df`` with such a name stays and the new one gets underscores.
    """
    shard, slot = fresh(df, "shard", "slot")
    placed = external_shuffle(df, key, text, seed, bucket_bytes)
    return placed.select("rec.*", F.pmod("position", F.lit(shards)).cast("int").alias(shard), F.expr(f"position div {int(shards)}").alias(slot))


def write_shards(df: DataFrame, path: str, shards: int = 24, **options) -> None:
    """Write ``shard_rows(df)`` as one Parquet folder per shard, in slot order."""
    shard, slot = fresh(df, "shard", "slot")
    shard_rows(df, shards, **options).repartition(shards, shard).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def op7_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in 24 shards of equal row counts."""
    dealt = shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return dealt.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
