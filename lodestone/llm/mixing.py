"""Mixing sources to target weights, in whole words, by distributed prefix sums.

Every document draws a random key from its id and text.  The documents of a
source are sorted by that key: the keys are spread evenly, so equal ranges of
them hold about equally many documents and cut a source into buckets without a
sample.  Running sums of sizes within buckets and over the buckets' totals say
how many words of the source lie before a document.  A source takes its budget as
full epochs over all its documents and a last one that is cut exactly where the
budget ends, inside a document if need be.

Documents that are equal in id, source, size and key are one row with a number
until the end, so no group of copies meets in a bucket.

Targets share the words of all sources by weight.  No target exceeds ``most``
times its source; what a source can't take goes to the others by weight until
none is above.  Sources sorted by what they can take for each unit of weight are
full up to one place, which prefix sums over them find.

Cases: null and empty texts have size 0 and are never taken; a null source is a
source, the last; null ids are ids; a table without words has targets 0; an empty
table gives an empty result; other columns stay, new ones take free names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import fresh, materialize, salted_join, table
from lodestone.operators.ranking import order_blocks, running_sums

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in their order, over and over.
WEIGHTS = (1, 2, 3)
#: How often a document is taken at most.
MOST = 3
#: Documents that a bucket of one source holds on average.
BUCKET_ROWS = 8192
#: Hex digits of a key's digest, and how many keys that makes.
DIGITS, KEYS = 12, float(16**12)


def counted(df: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 5) -> DataFrame:
    """``df`` without ``text``, with ``size`` in words and ``draw``, a random key of id and text."""
    size, draw = fresh(df, "size", "draw")
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    mixed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    key = F.conv(F.substring(mixed, 1, DIGITS), 16, 10).cast("long")
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != text], words.alias(size), key.alias(draw))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with ``target``.

    Weights go round by the order of ``source``, null last.
    """
    last = sources.withColumn("last", F.col("source").isNull())
    placed = running_sums(order_blocks(last, ["last", "source"], "block"), F.lit(1), ["last", "source"], [], "block", "place").drop("block", "last")
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = placed.withColumn("weight", F.get(cycle, F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int")).cast("long"))
    capped = weighed.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    by_level = order_blocks(capped, ["level", "place"], "block")
    filled = running_sums(by_level, "cap", ["level", "place"], [], "block", "caps")
    filled = running_sums(filled, "weight", ["level", "place"], [], "block", "weights").drop("block")
    whole = capped.agg(F.sum("source_size").alias("all_words"), F.sum("weight").alias("all_weight"))
    rest = F.col("all_words") - F.col("caps") + F.col("cap")
    heavy = (F.col("all_weight") - F.col("weights") + F.col("weight")).cast("double")
    full = F.col("cap").cast("double") * heavy <= F.col("weight").cast("double") * rest.cast("double")
    marked = filled.join(F.broadcast(whole)).withColumn("full", full)
    taken = marked.agg(F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))), F.lit(0)).alias("gone"), F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))), F.lit(0)).alias("gone_weight"))
    level = (F.col("all_words") - F.col("gone")).cast("double") / F.nullif(F.col("all_weight") - F.col("gone_weight"), F.lit(0)).cast("double")
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight").cast("double") * level)
    return marked.join(F.broadcast(taken)).select("source", "source_size", target.alias("target"))


def mix_sources(df: DataFrame, source: str = "source", size: str = "size", draw: str = "draw", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` without ``draw`` and with what the mix takes of each row.

    ``df`` has for each row its source, its size and a key from 0 to KEYS that
    orders the source's rows at random, see ``counted``.  Adds ``source_size``,
    ``target`` (double) and ``taken`` (long), in the unit of sizes.
    """
    source_size, target, taken = fresh(df, "source_size", "target", "taken")
    others = [c for c in df.columns if c not in (source, size, draw)]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(0)
    plain = df.select(row.alias("row"), F.col(source).alias("source"), F.col(size).cast("long").alias("size"), F.col(draw).alias("draw"))
    rows = materialize(plain.groupBy("row", "source", "size", "draw").agg(F.count(F.lit(1)).alias("copies")), "mixed-rows")
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sizes = materialize(sizes, "mixed-sources")
    # an equi-join drops null keys, so the null source gets a name that no other has
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    known = targets(sizes.select("source", "source_size"), weights, most).withColumn("name", name).drop("source")
    known = materialize(known.join(sizes.select(name.alias("name"), "rows"), "name").withColumn("all_rows", F.col("rows")), "mixed-targets")
    placed = salted_join(rows.withColumn("name", name), known, ["name"], "draw", "rows")
    bucket = F.floor(F.col("draw") / F.lit(KEYS) * F.ceil(F.col("all_rows") / F.lit(bucket_rows))).cast("long")
    placed = placed.withColumn("bucket", bucket).withColumn("words", F.col("size") * F.col("copies"))
    summed = running_sums(placed, "words", ["draw", "row", "size"], ["name"], "bucket", "upto")
    each = summed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    before = F.col("upto") - F.col("words") + (F.col("copy") - 1) * F.col("size")
    budget = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.coalesce(F.expr("cast(floor(target + 0.5) as long) div nullif(source_size, 0)"), F.lit(0))
    rest = F.greatest(F.lit(0), F.least(F.col("size"), budget - whole * F.col("source_size") - before))
    kept = [F.col("row")[c].alias(c) for c in others]
    named = {c: e for c, e in zip(others, kept, strict=True)} | {source: F.col("source").alias(source), size: F.col("size").alias(size)}
    return each.select(
        *[named[c] for c in df.columns if c != draw],
        F.col("source_size").alias(source_size),
        F.col("target").alias(target),
        (whole * F.col("size") + rest).cast("long").alias(taken),
    )


def op12_prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all sources takes of every document."""
    docs = counted(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP12_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    substr(md5('5:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 12) AS draw
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM docs GROUP BY source
), weighed AS (
  SELECT *, (place - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM sources
), levels AS (
  SELECT *, sum(source_size) OVER () AS all_words,
    sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, place) - cap AS caps_before,
    sum(weight) OVER () - sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, place) + weight AS weight_left
  FROM weighed
), marked AS (
  SELECT *, CAST(cap AS DOUBLE) * CAST(weight_left AS DOUBLE) <= CAST(weight AS DOUBLE) * CAST(all_words - caps_before AS DOUBLE) AS is_full FROM levels
), leveled AS (
  SELECT *, (CAST(all_words AS DOUBLE) - coalesce(sum(cap) FILTER (is_full) OVER (), 0)) / nullif(coalesce(sum(weight) FILTER (NOT is_full) OVER (), 0), 0) AS level FROM marked
), goals AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE CAST(weight AS DOUBLE) * level END AS target FROM leveled
), budgets AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM goals
), ordered AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
  CAST(coalesce(budget // nullif(source_size, 0), 0) * size
    + greatest(0, least(size, budget - coalesce(budget // nullif(source_size, 0), 0) * source_size - before)) AS BIGINT) AS taken
FROM ordered
"""
