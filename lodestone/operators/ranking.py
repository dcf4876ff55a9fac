"""Running sums and ranks over rows in order, without one task that sees all.

Rows are cut into blocks of neighbours in the order, by splitters drawn from a
sample.  The blocks' totals, at most MAX_BLOCKS for each group, are summed up
first; a row's running sum is that of its own block plus what lies before.  Rows
that tie in a hot value are parted by the order's further columns.

Nulls come first in the order, as in an ascending sort, and count 0 as values;
rows that tie in the whole order follow each other in any order; empty tables
give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that a block holds on average, how many blocks there are at most, and the sampled rows for each splitter.
BLOCK_ROWS, MAX_BLOCKS, SAMPLED = 200_000, 256, 32


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = "_" + name
    return name


def _below(key: Column, splitters: list[Column], first: int = 0) -> Column:
    """How many of the sorted splitters are not above ``key``: a balanced tree of comparisons."""
    if not splitters:
        return F.lit(first)
    mid = len(splitters) // 2
    return F.when(key < splitters[mid], _below(key, splitters[:mid], first)).otherwise(_below(key, splitters[mid + 1 :], first + mid + 1))


def order_blocks(df: DataFrame, order: list[str], name: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with int column ``name``: the number of the row's block, ascending in ``order``.

    Reads ``df`` twice, to count it and to draw the splitters.
    """
    rows = df.count()
    blocks = min(MAX_BLOCKS, math.ceil(rows / block_rows))
    if blocks < 2:
        return df.withColumn(name, F.lit(0))
    key = F.struct(*order)
    drawn = df.select(key.alias("k")).sample(min(1.0, blocks * SAMPLED / rows), seed=11).agg(F.array_sort(F.collect_list("k")).alias("k"))
    step = F.greatest(F.size("k") / blocks, F.lit(1))
    chosen = drawn.select(F.transform(F.sequence(F.lit(1), F.lit(blocks - 1)), lambda i: F.get("k", F.floor(i * step).cast("int"))).alias("k")).first().k
    kinds = [df.schema[c].dataType for c in order]
    splitters = [F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(s, kinds, order, strict=True)]) for s in dict.fromkeys(x for x in chosen if x is not None)]
    return df.withColumn(name, _below(key, splitters))


def running_sums(df: DataFrame, value: str | Column, order: list[str], within: list[str], block: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of the same ``within`` up to and with this one, in the order of ``block``, then ``order``.

    One shuffle of the rows, by block and group, and one of the blocks' totals.
    """
    value = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0))
    total, before, own = (_free(df, n) for n in ("total", "before", "own"))
    # groups may be null, which a plain equi-join would drop
    groups = [F.col(c).alias(f"{before}{i}") for i, c in enumerate(within)]
    totals = df.groupBy(block, *within).agg(F.sum(value).alias(total))
    earlier = W.partitionBy(*(within or [F.lit(0)])).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(F.col(block).alias(f"{before}block"), *groups, F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(before))
    summed = df.withColumn(own, F.sum(value).over(W.partitionBy(block, *within).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    met = F.col(block) == F.col(f"{before}block")
    for i, c in enumerate(within):
        met = met & F.col(c).eqNullSafe(F.col(f"{before}{i}"))
    return summed.join(carried, met).select(*[F.col(f"`{c}`") for c in df.columns if c != out], (F.col(own) + F.col(before)).alias(out))


def ranked(df: DataFrame, order: list[str], within: list[str] | None = None, out: str = "rank", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``out``: the row's number from 1 on within its group, in ascending ``order``."""
    block, within = _free(df, "block"), within or []
    blocked = order_blocks(df, [*within, *order], block, block_rows)
    return running_sums(blocked, F.lit(1), order, within, block, out).drop(block)
