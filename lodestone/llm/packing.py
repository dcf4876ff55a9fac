"""Packing documents into training sequences by a grouping genetic algorithm.

Documents are cut into pieces of at most ``capacity`` tokens.  What is packed is
the histogram of piece lengths, which has ``capacity`` entries at most however
many pieces there are: a packing is a set of bin patterns (lengths and how many
of each) with multiplicities.  On islands, one Spark task each, packings evolve:
a child gets whole well-filled bins of one parent, keeps the bins of the other
that still have their pieces, drops those with pieces used twice, and best-fits
the displaced pieces, longest first.  After each epoch every island gets its
neighbour's elite.

A piece's place follows from its rank among the pieces of its length, found by
windows over hash-salted groups of bounded size, so no length, however common,
meets in one task.  Pieces never come to the driver; the histogram, the elites
and the final patterns do, which the capacity bounds.

Cases: null and empty texts are one piece, the end id alone; repeated rows are
packed once each; an empty table gives an empty result; further columns are not
read.
"""

from __future__ import annotations

import base64
import os
import pickle
import random
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import fresh, materialize, sliced, table, tokenizer_path

CAPACITY = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: Islands, epochs between migrations, generations in an epoch, packings on an island.
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4, 3, 5, 4
#: Shares of the emptiest patterns that a mutation dissolves.
DISSOLVED = (0.05, 0.2, 0.5)
#: Pieces of one length that are ranked in one group, on average, unless that makes more groups of a length than the second number.
RANK_ROWS, RANK_GROUPS = 256, 100_000
#: The byte-level pre-tokenization pattern, a fixed value of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
RANKS = "byte_bpe_50k.tiktoken"

Pattern = tuple[tuple[int, int], ...]
Packing = dict[Pattern, int]

# ---- tokens --------------------------------------------------------------------------------

#: Runs of white space so long are left to the tokenizers library: the other one's pattern engine gives up on them.
_LONG_SPACE = re.compile(r"\s{300}")
_SPECIAL = "<|endoftext|>"
_loaded: dict[tuple[str, str], tuple] = {}


class Tokens:
    """Ids of texts as bytes of little-endian uint32, as the tokenizers library gives them.

    The same vocabulary as ranks, where there is a file of it, gives equal ids
    several times as fast.
    """

    def __init__(self, path: str, ranks: str) -> None:
        if (path, ranks) not in _loaded:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            import tiktoken
            from tokenizers import Tokenizer

            exact, fast = Tokenizer.from_file(path), None
            if os.path.exists(ranks):
                pairs = map(bytes.split, open(ranks, "rb"))
                fast = tiktoken.Encoding(ranks, pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
            _loaded[path, ranks] = exact, fast, exact.token_to_id(_SPECIAL)
        self.exact, self.fast, self.special = _loaded[path, ranks]

    def __call__(self, text: str) -> bytes:
        if self.fast is None or _LONG_SPACE.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.special is not None and _SPECIAL in text:
            parts = [self.fast.encode_to_numpy(t, disallowed_special=()).astype("<u4").tobytes() for t in text.split(_SPECIAL)]
            return np.array([self.special], "<u4").tobytes().join(parts)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def cut_documents(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, model: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: key, int ``piece``, long ``start``, long ``length``, long ``ids_crc32`` and, if asked for, array ``ids``.

    Only the first piece of a longer document may be shorter than ``capacity``.
    If the key has one of these names, the new column gets an underscore before it.
    """
    tail = np.array([end_id], "<u4").tobytes()
    names = [key, *fresh(df.select(key), "piece", "start", "length", "ids_crc32", *["ids"] * with_ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(model or tokenizer_path(TOKENIZER), "" if model else tokenizer_path(RANKS))
        for batch in sliced(batches, 1):
            rows, at, number, starts, crcs, ids = batch.column(0), [], [], [], [], []
            lengths = []
            for i, text_ in enumerate(batch.column(1).to_pylist()):
                raw = (tokens(text_) if text_ else b"") + tail
                n = len(raw) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = raw[4 * a : 4 * b]
                    at.append(i)
                    number.append(k)
                    starts.append(a)
                    lengths.append(b - a)
                    crcs.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype("<i4"))
            made = [rows.take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(made + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=names)

    kinds = [df.schema[key].dataType, T.IntegerType(), T.LongType(), T.LongType(), T.LongType()] + [T.ArrayType(T.IntegerType())] * with_ids
    return df.select(key, text).mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


# ---- the genetic algorithm on the histogram ------------------------------------------------


def _fill(pattern: Pattern) -> int:
    return sum(s * c for s, c in pattern)


def best_fit(packing: Packing, demand: dict[int, int], capacity: int, order: list[int] | None = None) -> Packing:
    """``packing`` with all of ``demand`` added: in the given order of lengths (longest first by default), each piece into the fullest bin that takes it."""
    rooms: dict[int, list[list]] = defaultdict(list)
    for pattern, m in packing.items():
        if m:
            rooms[capacity - _fill(pattern)].append([pattern, m])
    keys = sorted(rooms)

    def put(room: int, pattern: Pattern, m: int) -> None:
        if not rooms[room]:
            insort(keys, room)
        rooms[room].append([pattern, m])

    for size in order or sorted(demand, reverse=True):
        n = demand.get(size, 0)
        while n:
            i = bisect_left(keys, size)
            if i == len(keys):
                each = min(capacity // size, n)
                bins = n // each
                put(capacity - each * size, ((size, each),), bins)
            else:
                room = keys[i]
                pattern, m = rooms[room].pop()
                if not rooms[room]:
                    del keys[i]
                each = min(room // size, n)
                bins = min(m, n // each)
                if m > bins:
                    put(room, pattern, m - bins)
                merged = dict(pattern)
                merged[size] = merged.get(size, 0) + each
                put(room - each * size, tuple(sorted(merged.items(), reverse=True)), bins)
            n -= each * bins
    out: Packing = defaultdict(int)
    for groups in rooms.values():
        for pattern, m in groups:
            out[pattern] += m
    return dict(out)


def _used(packing: Packing) -> dict[int, int]:
    out: dict[int, int] = defaultdict(int)
    for pattern, m in packing.items():
        for s, c in pattern:
            out[s] += c * m
    return out


def score(packing: Packing, capacity: int) -> tuple[int, float]:
    """Bins, then minus the mean squared fill: less is better."""
    bins = sum(packing.values())
    return bins, -sum(m * (_fill(p) / capacity) ** 2 for p, m in packing.items()) / max(1, bins)


def _keep(packing: Packing, left: dict[int, int], rng: random.Random) -> Packing:
    """The bins of ``packing`` whose pieces are all still in ``left``, which they are taken from; the fullest come first."""
    kept: Packing = {}
    for pattern, m in sorted(packing.items(), key=lambda x: (-_fill(x[0]), rng.random())):
        m = min(m, *(left.get(s, 0) // c for s, c in pattern))
        if m:
            kept[pattern] = m
            for s, c in pattern:
                left[s] -= c * m
    return kept


def crossover(a: Packing, b: Packing, counts: dict[int, int], capacity: int, rng: random.Random) -> Packing:
    """A child of ``a`` with well-filled bins of ``b``."""
    fills = sorted((_fill(p) for p in b), reverse=True)
    bar = fills[len(fills) // 2]
    injected = {p: rng.randint(1, m) for p, m in b.items() if _fill(p) >= bar and rng.random() < 0.5}
    left = dict(counts)
    for s, n in _used(injected).items():
        left[s] -= n
    child = _keep(a, left, rng)
    for p, m in injected.items():
        child[p] = child.get(p, 0) + m
    return best_fit(child, {s: n for s, n in left.items() if n}, capacity)


def mutate(packing: Packing, capacity: int, rng: random.Random) -> Packing:
    """Dissolves the emptiest bins, few or many, and some others, and best-fits their pieces."""
    ranked = sorted(packing.items(), key=lambda x: _fill(x[0]))
    gone = {p: m for p, m in ranked[: max(1, int(len(ranked) * rng.choice(DISSOLVED)))]}
    gone.update({p: rng.randint(1, m) for p, m in ranked if rng.random() < 0.05 and p not in gone})
    rest = {p: m - gone.get(p, 0) for p, m in packing.items() if m > gone.get(p, 0)}
    freed = _used(gone)
    order = sorted(freed, key=lambda s: -s * rng.uniform(0.9, 1.0))
    return best_fit(rest, freed, capacity, order)


def evolve(counts: dict[int, int], population: list[Packing], capacity: int, rng: random.Random, generations: int = GENERATIONS, size: int = POPULATION) -> list[Packing]:
    """The population after some generations, best first."""
    while len(population) < size:
        # not longest first: that is one packing, which all islands would start from
        order = sorted(counts, key=lambda s: -s * rng.uniform(0.5, 1.0))
        population.append(best_fit({}, counts, capacity, order))
    least = -(-sum(s * n for s, n in counts.items()) // capacity)
    for _ in range(generations):
        population.sort(key=lambda p: score(p, capacity))
        if sum(population[0].values()) <= least:
            break
        children = [mutate(crossover(*rng.sample(population, 2), counts, capacity, rng), capacity, rng) for _ in range(size // 2)]
        population = sorted([*population, *children], key=lambda p: score(p, capacity))[:size]
    return sorted(population, key=lambda p: score(p, capacity))


def pack_histogram(spark: SparkSession, counts: dict[int, int], capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, seed: int = 5) -> Packing:
    """A packing of ``counts`` pieces by length, evolved on islands from best fits in random orders.

    Best fit of the longest first takes part in the last choice only.
    """
    elites: list[Packing] = []
    least = -(-sum(s * n for s, n in counts.items()) // capacity)
    for epoch in range(epochs if counts else 0):

        def island(frames: Iterator[pd.DataFrame], epoch: int = epoch, elites: list[Packing] = elites) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for i in frame["id"]:
                    # its own elite and that of the island before it
                    start = [elites[i], elites[i - 1]] if elites else []
                    best = evolve(counts, start, capacity, random.Random(seed * 10_007 + epoch * 101 + int(i)), generations)[0]
                    yield pd.DataFrame({"island": [i], "elite": [pickle.dumps(best)]})

        found = spark.range(0, islands, 1, islands).mapInPandas(island, "island long, elite binary").collect()
        elites = [pickle.loads(bytes(r.elite)) for r in sorted(found, key=lambda r: r.island)]
        if min(sum(p.values()) for p in elites) <= least:
            break
    return min([*elites, best_fit({}, counts, capacity)], key=lambda p: score(p, capacity))


# ---- places --------------------------------------------------------------------------------


def slots(packing: Packing) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first rank, end rank, pieces of it in a bin, first sequence, offset of its first piece)."""
    out, next_rank, sequence = [], defaultdict(int), 0
    for pattern, m in sorted(packing.items(), reverse=True):
        offset = 0
        for size, count in pattern:
            lo = next_rank[size]
            next_rank[size] = lo + count * m
            out.append((size, lo, lo + count * m, count, sequence, offset))
            offset += size * count
        sequence += m
    return out


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", **ga) -> DataFrame:
    """``pieces``, whose long column ``length`` has each one's tokens, with long ``sequence_id`` and long ``offset`` (with underscores before them if their names are taken)."""
    spark = pieces.sparkSession
    columns = [f"c{i}" for i in range(len(pieces.columns))]  # no name of the input can clash
    plain = pieces.toDF(*columns).withColumn("size", F.col(columns[pieces.columns.index(length)]))
    salted = materialize(plain.withColumn("draw", F.xxhash64(F.monotonically_increasing_id(), F.col("size"))), "pieces")
    counts = {r["size"]: r.n for r in salted.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    packing = pack_histogram(spark, counts, capacity, **ga)
    # both have a row for each length and pattern: the capacity bounds them
    lengths = spark.createDataFrame([(s, max(1, min(n // RANK_ROWS, RANK_GROUPS))) for s, n in counts.items()], "size long, groups long")
    places = spark.createDataFrame(slots(packing), "size long, lo long, hi long, each long, first long, base long")

    grouped = salted.join(F.broadcast(lengths), "size").withColumn("g", F.pmod("draw", F.col("groups"))).drop("groups")
    sizes = grouped.groupBy("size", "g").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("size", "g", (F.sum("n").over(W.partitionBy("size").orderBy("g")) - F.col("n")).alias("before"))
    ranked = grouped.withColumn("rank", F.row_number().over(W.partitionBy("size", "g").orderBy("draw")))
    ranked = ranked.join(before, ["size", "g"]).withColumn("rank", F.col("rank") - 1 + F.col("before"))
    found = ranked.join(F.broadcast(places), "size").where("rank >= lo AND rank < hi").withColumn("at", F.expr("rank - lo"))
    sequence = F.col("first") + F.expr("at div each")
    offset = F.col("base") + F.pmod("at", F.col("each")) * F.col("size")
    return found.select(*columns, sequence.alias("sequence"), offset.alias("offset")).toDF(*pieces.columns, *fresh(pieces, "sequence_id", "offset"))


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, model: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of ``df``'s documents with their places in sequences."""
    pieces = cut_documents(df, key, text, capacity, end_id, model, with_ids)
    return place_pieces(pieces, capacity, pieces.columns[3])


def op6_grouping_genetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
