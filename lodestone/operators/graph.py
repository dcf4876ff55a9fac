"""Roles of modules in the import graph, and modules that one entry point unites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import Rule, classify_module


def module_stats(edges: DataFrame) -> DataFrame:
    """(module, role, imported_by, imports_from) of edges (source, target) between modules; lists are sorted.

    Foundation: only imported; extension: only imports; application: both.
    """
    between = edges.where("source <> target AND source <> '' AND target <> ''").select("source", "target").distinct()
    into = between.groupBy(F.col("target").alias("module")).agg(F.array_sort(F.collect_set("source")).alias("imported_by"))
    out = between.groupBy(F.col("source").alias("module")).agg(F.array_sort(F.collect_set("target")).alias("imports_from"))
    role = F.when(F.col("imports_from").isNull(), "foundation").when(F.col("imported_by").isNull(), "extension").otherwise("application")
    return into.join(out, "module", "full").select("module", role.alias("role"), F.coalesce("imported_by", F.array().cast(into.schema["imported_by"].dataType)).alias("imported_by"), F.coalesce("imports_from", F.array().cast(out.schema["imports_from"].dataType)).alias("imports_from"))


def entry_unification(edges: DataFrame) -> DataFrame:
    """(entry, modules) of edges (entry, module): entry points that reach more than one module."""
    reached = edges.where("module <> ''").groupBy("entry").agg(F.array_sort(F.collect_set("module")).alias("modules"))
    return reached.where(F.size("modules") > 1)


def module_graph(imports: DataFrame, depth: int = 1, rules: Sequence[Rule] = ()) -> DataFrame:
    """``module_stats`` of import edges (source_file, target_file), files being classified to modules."""
    module = lambda c: classify_module(F.col(c), depth, rules)
    return module_stats(imports.select(module("source_file").alias("source"), module("target_file").alias("target")))


def entry_points(imports: DataFrame, depth: int = 1, rules: Sequence[Rule] = ()) -> DataFrame:
    """``entry_unification`` of the Python files at the project's root."""
    at_root = imports.where(~F.contains("source_file", F.lit("/")) & F.endswith("source_file", F.lit(".py")))
    return entry_unification(at_root.select(F.col("source_file").alias("entry"), classify_module(F.col("target_file"), depth, rules).alias("module")))
