"""Exact nearest neighbours that read only what can be near.

Vectors lie in folders by their nearest pivot, sorted by their distance to it.
With r = |x - p| and the query's own distance to the pivot, the triangle
inequality gives |q - x| >= ||q - p| - r|, and so a bound on the inner product
from below the distance 1 - q.x that the search sorts by; vectors need not have
length one.  A first look at the most promising folders gives a distance that k
rows reach; then only folders, and in them only ranges of r, whose bound is within
it are read.  Nothing near is lost: results equal those of a scan, ties by key
included.

Pivots are rows with the smallest hashes of their keys; their number is a
parameter.  Rows without a vector are left out; k beyond the table gives all
rows; an empty table gives none.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.retrieval import POOL, nearest

#: Pivots at most, and rows for each on average.
MAX_PIVOTS, PIVOT_ROWS = 256, 64
#: What rounding may take from a bound.
SLACK = 1e-9


@dataclass
class Read:
    """What a search has read: folders and rows, of how many; folders of the first look count once more."""

    folders: int
    of_folders: int
    rows: int
    of_rows: int


def _placed(df: DataFrame, embedding: str, centers: np.ndarray) -> DataFrame:
    """``df`` with the number of the nearest pivot, the distance to it and the squared length."""
    at = df.columns.index(embedding)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, centers.shape[1])
            # one pivot at a time: the differences themselves, as products would cancel for near ones
            distance = np.stack([np.sqrt(((x - c) ** 2).sum(1)) for c in centers], 1)
            best = distance.argmin(1)
            added = [pa.array(best.astype(np.int32)), pa.array(distance[np.arange(len(x)), best]), pa.array((x**2).sum(1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "pivot", "radius", "square"])

    fields = [T.StructField("pivot", T.IntegerType()), T.StructField("radius", T.DoubleType()), T.StructField("square", T.DoubleType())]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def write_vectors(vectors: DataFrame, path: str, key: str = "chunk_id", embedding: str = "embedding", pivots: int | None = None) -> None:
    """``vectors`` (no columns pivot, radius or square) as a table for ``nearest_pruned``, with one small row for each folder beside it."""
    spark, rows = vectors.sparkSession, vectors.where(F.col(embedding).isNotNull())
    count = pivots or max(1, min(MAX_PIVOTS, math.ceil(rows.count() / PIVOT_ROWS)))
    centers = [r[0] for r in rows.orderBy(F.xxhash64(F.col(key)), key).select(embedding).limit(count).collect()] or [[0.0]]
    placed = _placed(rows, embedding, np.array(centers, np.float64))
    # a pivot that very many rows are near is dealt over several tasks and files
    placed.repartition("pivot", F.pmod(F.xxhash64(key), F.lit(4))).sortWithinPartitions("pivot", "radius").write.partitionBy("pivot").parquet(f"{path}/rows")
    written = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    folders = written.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("least"), F.max("radius").alias("most"), F.max("square").alias("square"))
    listed = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "pivot int, center array<double>")
    folders.join(F.broadcast(listed), "pivot").coalesce(1).write.parquet(f"{path}/folders")
    spark.createDataFrame([(json.dumps(placed.schema.jsonValue()),)], "kind string").coalesce(1).write.parquet(f"{path}/schema")


def nearest_pruned(spark: SparkSession, path: str, query: Sequence[float], k: int = POOL, key: str = "chunk_id", embedding: str = "embedding") -> tuple[DataFrame, Read]:
    """The ``k`` rows nearest to one query vector, as ``nearest`` has them, and what was read for it."""
    kind = T.StructType.fromJson(json.loads(spark.read.parquet(f"{path}/schema").first().kind))
    rows, folders = spark.read.schema(kind).parquet(f"{path}/rows"), spark.read.parquet(f"{path}/folders").collect()
    plain = [c for c in rows.columns if c not in ("pivot", "radius", "square")]
    q = np.array(query, np.float64)
    if not folders:
        return nearest(rows.select(*plain), query, k, key, embedding), Read(0, 0, 0, 0)
    own = float(q @ q)
    away = {f.pivot: float(np.sqrt(((q - np.array(f.center)) ** 2).sum())) for f in folders}

    def bound(f) -> float:
        gap = max(0.0, away[f.pivot] - f.most, f.least - away[f.pivot])
        return 1 - (own + f.square - gap * gap) / 2

    # the folders that must be read first, until they hold k rows
    first, held = [], 0
    for f in sorted(folders, key=lambda f: (bound(f), away[f.pivot])):
        first.append(f)
        held += f.n
        if held >= k:
            break
    reach = math.inf
    if held >= k:
        near = nearest(rows.where(F.col("pivot").isin([f.pivot for f in first])), query, k, key, embedding)
        reach = near.agg(F.max("distance")).first()[0] + SLACK
    left = [f for f in folders if bound(f) <= reach]

    def reachable(f):
        width = math.sqrt(max(0.0, own + f.square - 2 * (1 - reach))) + SLACK if reach < math.inf else math.inf
        if away[f.pivot] - width <= f.least and f.most <= away[f.pivot] + width:
            return F.col("pivot") == f.pivot
        return (F.col("pivot") == f.pivot) & F.col("radius").between(away[f.pivot] - width, away[f.pivot] + width)

    ranges = [reachable(f) for f in left]
    while len(ranges) > 1:  # a balanced tree of conditions
        ranges = [a | b for a, b in zip(ranges[::2], ranges[1::2], strict=False)] + ranges[len(ranges) & ~1 :]
    some = rows.where(F.col("pivot").isin([f.pivot for f in left]) & ranges[0])
    total = Read(len(left), len(folders), held + some.count(), sum(f.n for f in folders))
    return nearest(some.select(*plain), query, k, key, embedding), total
