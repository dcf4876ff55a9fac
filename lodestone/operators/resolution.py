"""Resolving names to files by joins: first existing candidate, unique name, longest prefix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Bits of the filter of existing paths, and of one row of it: 8 MB in rows of 4 kB, whatever the number of paths.
FILTER_BITS, ROW_BITS = 1 << 26, 1 << 15


def path_filter(files: DataFrame) -> DataFrame:
    """(row, bits): one bit for each path's hash among FILTER_BITS; rows without a path are left out."""
    place = F.pmod(F.xxhash64("path"), F.lit(FILTER_BITS))
    return files.select((F.floor(place / ROW_BITS)).cast("int").alias("row"), (place % ROW_BITS).alias("bit")).groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits"))


def perhaps_existing(each: DataFrame, bits: DataFrame) -> DataFrame:
    """The rows of ``each`` (path) whose bit is set: all whose path exists, and the share of the others that the filter is full to."""
    place = F.pmod(F.xxhash64("path"), F.lit(FILTER_BITS))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("_bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = each.withColumn("row", F.floor(place / ROW_BITS).cast("int")).withColumn("_bit", (place % ROW_BITS).cast("int")).join(F.broadcast(bits), "row")
    return marked.where(F.getbit(byte, F.col("_bit") % 8) == 1).select(*each.columns)


def first_existing(specs: DataFrame, files: DataFrame, candidates: str = "candidates", keys: Sequence[str] = ("source", "module"), filtered: bool = False) -> DataFrame:
    """(keys, target): for each row of ``specs`` the first of its ``candidates`` that is a path of ``files``; rows without one are left out.

    With ``filtered``, candidates that a filter of all paths excludes don't reach the
    join's shuffle: most candidates don't exist.  It costs one more look at the paths,
    and is worth it where they are too many to be broadcast.
    """
    each = specs.select(*keys, F.posexplode(candidates).alias("_at", "path"))
    known = files.select("path").distinct()
    found = (perhaps_existing(each, path_filter(files)) if filtered else each).join(known, "path")
    return found.groupBy(*keys).agg(F.min_by("path", "_at").alias("target"))


def unique_by(files: DataFrame, name: Column, column: str = "name") -> DataFrame:
    """The files whose name no other has, with that name in ``column``.

    Counts with partial sums, so that a name which very many share is no task of its own.
    """
    named = files.withColumn(column, name)
    return named.groupBy(column).agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("path")).where("_n = 1").drop("_n")


def prefix_hashes(segments: Column) -> Column:
    """array<struct<depth,h1,h2>>: for each prefix of an array of segments, from the empty one on, two 64-bit hashes, each made of that of the prefix before it and one segment."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(11).cast("long").alias("h1"), F.lit(13).cast("long").alias("h2"))

    def step(done: Column, segment: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct((last["depth"] + 1).alias("depth"), F.xxhash64(last["h1"], segment).alias("h1"), F.xxhash64(segment, last["h2"]).alias("h2"))
        return F.concat(done, F.array(longer))

    return F.aggregate(segments, F.array(start), step)


def longest_prefix(paths: DataFrame, known: DataFrame, path: str = "segments", key: str = "id") -> DataFrame:
    """(key, prefix, value, depth): for each array of segments the deepest prefix that ``known`` (prefix array, value) has; the empty one counts.

    What is shuffled of a path are its prefixes' depths and hashes, 20 bytes each;
    prefixes are equal if both hashes are.  Segments aren't null.
    """
    hashes = ["depth", "h1", "h2"]
    prefixes = paths.select(key, F.inline(prefix_hashes(F.col(path))))
    ends = known.select("prefix", "value", F.element_at(prefix_hashes(F.col("prefix")), -1).alias("_h")).select("prefix", "value", "_h.*")
    found = prefixes.join(ends, hashes)
    best = F.max(F.struct("depth", "prefix", "value")).alias("b")
    return found.groupBy(key).agg(best).select(key, "b.prefix", "b.value", "b.depth")


def line_gap_blocks(rows: DataFrame, group: str, start: str, end: str, gap: int = 2) -> DataFrame:
    """``rows`` with int ``block``: numbered from 0 in each group, anew where ``start`` lies ``gap`` or more behind the last ``end``."""
    w = W.partitionBy(group).orderBy(start)
    new = F.when(F.col(start) - F.lag(end).over(w) >= gap, 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("block", F.sum("_new").over(w).cast("int")).drop("_new")
