"""Distributions that noise thresholds are chosen by."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ranking import order_blocks, running_sums

#: Fixed percentiles of a report.
PERCENTILES = (50, 75, 90, 95, 99, 100)
#: Counts that a report lists.
TOP = 15


def _cumulative(values: DataFrame, column: str) -> DataFrame:
    """(value, upto, total): distinct values with how many are not greater.

    The histogram is what is sorted, not the rows, and in blocks, so that no task sees all of it.
    """
    histogram = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    upto = running_sums(order_blocks(histogram, ["value"], "block"), "n", ["value"], [], "block", "upto")
    return upto.select("value", "upto").join(F.broadcast(histogram.agg(F.sum("n").alias("total"))))


def percentiles(values: DataFrame, column: str = "n", wanted: Sequence[int] = PERCENTILES) -> DataFrame:
    """(p, value) by nearest rank: the value at place min(n - 1, floor(n * p / 100)) from 0; 0 if there is none."""
    spark = values.sparkSession
    listed = F.array(*[F.lit(p) for p in wanted])
    places = _cumulative(values, column).withColumn("p", F.explode(listed))
    place = F.least(F.col("total") - 1, F.expr("total * p div 100"))
    found = places.where(F.col("upto") > place).groupBy("p").agg(F.min("value").alias("value"))
    return spark.createDataFrame([(p,) for p in wanted], "p int").join(found, "p", "left").select("p", F.coalesce(F.col("value"), F.lit(0)).alias("value"))


def fraction_at_or_below(values: DataFrame, thresholds: Sequence[float], column: str = "n") -> DataFrame:
    """(threshold, fraction) of values that the threshold keeps; 0 if there is none."""
    kept = [F.coalesce(F.avg(F.when(F.col(column) <= t, 1.0).otherwise(0.0)), F.lit(0.0)).alias(f"f{i}") for i, t in enumerate(thresholds)]
    pairs = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"f{i}").alias("fraction")) for i, t in enumerate(thresholds)])
    return values.where(F.col(column).isNotNull()).agg(*kept).select(F.explode(pairs).alias("x")).select("x.*")


def import_target_counts(imports: DataFrame) -> DataFrame:
    """(target_file, n): distinct importers of each file."""
    return imports.groupBy("target_file").agg(F.countDistinct("source_file").alias("n"))


@dataclass(frozen=True)
class Summary:
    """What a report shows of counts: how many there are, the largest, percentiles, the share a threshold keeps."""

    total: int
    head: list[tuple[object, int]]
    ranks: dict[int, int]
    kept: float


def summarized(counts: DataFrame, name: str, threshold: int, top: int = TOP) -> Summary:
    """The summary of a table (name, n) of any size; a bounded number of rows comes to the driver."""
    total = counts.count()
    if not total:
        return Summary(0, [], {}, 0.0)
    head = [(x[name], x.n) for x in counts.orderBy(F.desc("n"), name).limit(top).collect()]
    ranks = {x.p: x.value for x in percentiles(counts).orderBy("p").collect()}
    return Summary(total, head, ranks, fraction_at_or_below(counts, [threshold]).first().fraction)


def _summary(counts: list[tuple[object, int]], threshold: int, top: int) -> Summary:
    """The same of a list, largest first."""
    values = sorted(n for _, n in counts)
    ranks = {p: values[min(len(values) - 1, len(values) * p // 100)] for p in PERCENTILES} if values else {}
    return Summary(len(counts), counts[:top], ranks, sum(n <= threshold for n in values) / max(len(values), 1))


def _lines(s: Summary, what: str) -> list[str]:
    if not s.total:
        return ["(nothing to calibrate)"]
    head = [f"{s.total} {what}, top {len(s.head)} by count:"] + [f"  {n:6d}  {x}" for x, n in s.head]
    return [*head, "percentiles: " + ", ".join(f"p{p}={v}" for p, v in s.ranks.items()), f"the current threshold keeps {s.kept:.1%}"]


def format_report(literals: Summary | list[tuple[str, int]], imports: Summary | list[tuple[str, int]], literal_threshold: int, import_threshold: int, top: int = TOP) -> str:
    """A text report of both distributions; lists come largest first."""
    literals, imports = (x if isinstance(x, Summary) else _summary(x, t, top) for x, t in ((literals, literal_threshold), (imports, import_threshold)))
    return "\n".join(
        ["=== literal_noise_threshold ===", f"currently configured: {literal_threshold}", *_lines(literals, "sampled literals"), ""]
        + ["=== import_noise_threshold ===", f"currently configured: {import_threshold}", *_lines(imports, "import targets")]
        + ["", "A threshold that keeps 80 to 95 % of the values is a reasonable start; review before changing the configuration."]
    )
