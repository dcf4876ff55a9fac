"""Change detection, latest-row upserts and wipes on stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.paths import Rule, classify_layer, classify_module, suffix


def diff(known: DataFrame, scanned: DataFrame, force: bool = False, scope: Column | None = None) -> DataFrame:
    """(path, content_hash, status) of both tables of (path, content_hash): new, changed, unchanged or deleted.

    With ``force`` what is known counts as changed.  ``scope``, a condition on
    ``path``, says which known files this scan answers for; others are left out.
    """
    old = known if scope is None else known.where(scope)
    both = old.select("path", F.col("content_hash").alias("_old")).join(scanned.select("path", F.col("content_hash").alias("_new")), "path", "full")
    status = F.when(F.col("_new").isNull(), "deleted").when(F.col("_old").isNull(), "new").when((F.col("_old") == F.col("_new")) & F.lit(not force), "unchanged").otherwise("changed")
    return both.select("path", F.coalesce("_new", "_old").alias("content_hash"), status.alias("status"))


def diff_stats(changes: DataFrame) -> DataFrame:
    """One row of counts: changed (with new), unchanged and deleted files."""
    n = lambda *s: F.count_if(F.col("status").isin(list(s)))
    return changes.agg(n("new", "changed").alias("changed_files"), n("unchanged").alias("unchanged_files"), n("deleted").alias("deleted_files"))


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``: what an upsert leaves.

    Aggregates with partial maxima, so a hot key doesn't meet in one task.
    """
    rest = [c for c in rows.columns if c not in keys]
    last = F.max(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("_row"))).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, "_last._row.*").select(*rows.columns)


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those with their keys."""
    return table.join(changes.select(*keys), list(keys), "left_anti").unionByName(changes)


def without_paths(table: DataFrame, gone: DataFrame, column: str = "file_path") -> DataFrame:
    """``table`` without the rows of the files in ``gone`` (path)."""
    return table.join(gone.select(F.col("path").alias(column)), column, "left_anti")


def without_suffixes(table: DataFrame, suffixes: Sequence[str], column: str = "path") -> DataFrame:
    """``table`` without files of some extensions: what a changed language version wipes."""
    return table.where(~suffix(F.col(column)).isin(list(suffixes)))


def reclassified(chunks: DataFrame, rules: Sequence[Rule], default_layer: str, depth: int = 1, module_rules: Sequence[Rule] = (), column: str = "file_path") -> DataFrame:
    """``chunks`` with ``layer`` and ``module`` by these rules, whatever they were when stored: an expression on the path, nothing is rewritten."""
    path = F.col(column)
    made = {"layer": classify_layer(path, rules, default_layer), "module": classify_module(path, depth, module_rules)}
    return chunks.withColumns(made).select(*chunks.columns)


def warnings(chunks: DataFrame, rules: int, default_layer: str) -> list[str]:
    """What looks wrong with how chunks (layer, module) are classified."""
    row = chunks.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("module").alias("modules"), F.count_if(F.col("layer") != default_layer).alias("layered")).first()
    out = []
    if row.n and row.modules == 1:
        out.append("all chunks are of one module: module_depth or module rules may not fit the tree")
    if row.n and rules and not row.layered:
        out.append("no chunk matches a layer rule")
    return out
