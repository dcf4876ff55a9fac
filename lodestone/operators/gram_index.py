"""Substring search by a stored table of postings: which rows hold which run of three characters.

A literal of three characters or more can only stand in rows that hold all of its
runs, so it is enough to read the rows of its rarest one and to test those.
Postings are sorted by run within their files: a filter on runs skips all row
groups that can't hold one.  Folding is that of the search: ASCII letters.

Results equal those of a scan of all texts.  Literals shorter than a run are
looked for in a scan.  Null columns hold nothing; rows without any run have no
postings and are found by short literals only; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import ascii_lower
from lodestone.operators.retrieval import grams, substring_join

#: Characters of a run; folders that the runs are dealt over, and files in each.
GRAM, PARTS, SPREAD = 3, 64, 4


def _part(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


def postings(rows: DataFrame, columns: Sequence[str], *keys: str) -> DataFrame:
    """(gram, keys): each run of the folded ``columns`` of each row once; runs don't reach from one column into the next."""
    found = F.array_distinct(F.flatten(F.array(*[F.coalesce(grams(ascii_lower(F.col(c)), GRAM), F.array().cast("array<string>")) for c in columns])))
    return rows.select(F.explode(found).alias("gram"), *keys)


def write_postings(found: DataFrame, path: str) -> None:
    """Postings in folders by the run's hash.  A run that most rows hold is dealt over several files."""
    key = [c for c in found.columns if c != "gram"][0]
    placed = found.withColumn("part", _part(F.col("gram")))
    placed.repartition("part", F.pmod(F.xxhash64(key), F.lit(SPREAD))).sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(path)


def read_postings(spark: SparkSession, path: str, wanted: Sequence[str] | None = None) -> DataFrame:
    """All postings, or those of some runs: only their folders are listed, and only their row groups read."""
    found = spark.read.parquet(path)
    if wanted is None:
        return found
    parts = [r[0] for r in spark.createDataFrame([(g,) for g in wanted], "gram string").select(_part(F.col("gram"))).distinct().collect()]
    return found.where(F.col("part").isin(parts) & F.col("gram").isin(list(wanted)))


def runs_of(literal: str) -> list[str]:
    """The runs of a literal as the index folds them."""
    folded = "".join(c.lower() if c.isascii() else c for c in literal)
    return sorted({folded[i : i + GRAM] for i in range(len(folded) - GRAM + 1)})


def candidates(find, literals: Sequence[str], key: str) -> DataFrame | None:
    """(key) of the rows that may hold one of some literals; None if one is too short for the index.

    ``find`` gives the postings of a list of runs.  What comes to the driver is a
    number for each run of the literals.
    """
    if any(len(x) < GRAM for x in literals):
        return None
    asked = {x: runs_of(x) for x in literals}
    every = sorted({g for runs in asked.values() for g in runs})
    counts = {r.gram: r.n for r in find(every).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}
    rarest = {min(runs, key=lambda g: (counts[g], g)) for runs in asked.values() if all(g in counts for g in runs)}
    return find(sorted(rarest)).select(key).distinct() if rarest else find(every[:1]).select(key).limit(0)


def indexed_join(found: DataFrame, texts: DataFrame, literals: DataFrame, key: str, text: str = "text", literal: str = "literal") -> DataFrame:
    """Pairs of rows whose ``text`` contains ``literal``, as ``substring_join`` has them, by the postings (gram, key) of ``texts``.

    Each literal goes by the rarest of its runs.  Texts meet only the literals that
    they share that run with; those too short for a run are looked for in a scan.
    """
    folded = ascii_lower(F.col(literal))
    # columns of a row may have been joined by a null character: what holds one may reach over it
    indexed = (F.length(literal) >= GRAM) & ~F.contains(literal, F.lit("\x00"))
    long = literals.where(indexed)
    runs = long.select(literal, F.explode(grams(folded, GRAM)).alias("gram"))
    counts = found.join(runs.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = runs.join(counts, "gram", "left").groupBy(literal).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    rarest = rarest.where("r.n > 0").select(literal, "r.gram")
    pairs = rarest.join(found.select("gram", key), "gram").select(literal, key).join(literals, literal)
    # folded before the join, once for each text and not for each of its literals
    lowered = texts.withColumn("_folded", ascii_lower(F.col(text)))
    hits = lowered.join(pairs, key).where(F.contains("_folded", folded)).select(*texts.columns, *literals.columns)
    return hits.unionByName(substring_join(texts, literals.where(~indexed), text, literal).select(*hits.columns))
