"""A draft configuration from nothing but names and manifests, to be reviewed before use."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import CONFIG_NAME
from lodestone.functions import paths
from lodestone.operators.ranking import ranked
from lodestone.shared import written
from lodestone.sources.manifests import cargo_targets, cmake_modules
from lodestone.sources.scan import list_files, with_content

MAX_DEPTH = 5
#: Usual directories and files of each layer.
LAYERS = {
    "frontend": (["frontend", "client", "web", "ui", "react", "vue", "angular"], []),
    "backend/api": (["api", "routes", "handlers", "views", "endpoints", "controllers"], ["views.py", "urls.py", "serializers.py", "routes.py", "endpoints.py", "controllers.py"]),
    "models": (["models", "schemas", "entities"], ["models.py", "schemas.py", "entities.py"]),
    "config": (["config", "configs", "settings"], ["settings.py", "config.py"]),
    "constants": (["constants", "consts"], ["constants.py", "consts.py"]),
    "daemons": (["daemons", "workers", "jobs", "cron", "tasks"], ["tasks.py", "jobs.py", "cron.py", "worker.py", "workers.py"]),
}
#: The same for trees with Rust, and for trees with C or C++.
RUST_LAYERS = {"tests": (["tests"], []), "examples": (["examples"], []), "benches": (["benches"], []), "commands": (["commands", "handlers"], ["commands.rs", "handlers.rs"])}
C_LAYERS = {
    "include": (["include", "inc", "public"], []),
    "tests": (["tests", "test"], []),
    "platform": (["windows", "unix", "macosx", "mac", "linux", "gtk", "android", "ios", "win32"], []),
    "vendor": (["third_party", "third-party", "vendor", "external", "deps"], []),
}
TRANSLATION_DIRS = ["langs", "locales", "i18n", "translations"]
LANGUAGES = {"Python": (".py",), "JavaScript": (".js", ".jsx"), "TypeScript": (".ts", ".tsx"), "Rust": (".rs",), "C": (".c", ".h"), "C++": (".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx")}


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all files outside excluded directories; contents only of manifests."""
    rows = list_files(spark, root, pruned=paths.EXCLUDED_DIRS)
    read = with_content(spark, root, rows.where(paths.basename(F.col("path")).isin("Cargo.toml", "CMakeLists.txt")))
    contents = read.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    return rows.select("path").join(contents, "path", "left")


#: Groups of layers in the order of a draft, and the languages a tree must have for a group, if any.
GROUPS = ((LAYERS, ()), (RUST_LAYERS, ("Rust",)), ({}, ("Rust",)), (C_LAYERS, ("C", "C++")))
#: The group that the binaries of crates stand for.
BINARIES = 2
PLACEHOLDER = "there are .jsx or .tsx files, but no directory with a usual name: fill in its name"


def _usual(spark: SparkSession) -> DataFrame:
    """(kind, low, grp, place, layer, nth): every usual name with the layer it speaks for."""
    rows = [
        (kind, name, grp, place, layer, nth)
        for grp, (table, _) in enumerate(GROUPS)
        for place, (layer, both) in enumerate(table.items())
        for kind, names in zip(("dirs", "files"), both, strict=True)
        for nth, name in enumerate(names)
    ]
    rows += [("dirs", name, None, None, None, nth) for nth, name in enumerate(TRANSLATION_DIRS)]
    return spark.createDataFrame(rows, "kind string, low string, grp int, place int, layer string, nth int")


def _named(tree: DataFrame) -> DataFrame:
    """(kind, low, name): directories and files near the root, as they are spelled at their first place."""
    parts = paths.parts(F.col("path"))
    folders = F.slice(parts, F.lit(1), F.least(F.size(parts) - 1, F.lit(MAX_DEPTH)))
    file = F.when(F.size(parts) <= MAX_DEPTH, F.array(F.element_at(parts, -1))).otherwise(F.array())
    each = F.concat(F.transform(folders, lambda n: F.struct(F.lit("dirs").alias("kind"), n.alias("name"))), F.transform(file, lambda n: F.struct(F.lit("files").alias("kind"), n.alias("name"))))
    return tree.select("path", F.inline(each)).groupBy("kind", F.lower("name").alias("low")).agg(F.min_by("name", "path").alias("name"))


def _allowed(languages: list[str]) -> list[int]:
    return [grp for grp, (_, needed) in enumerate(GROUPS) if not needed or set(needed) & set(languages)]


@dataclass
class Draft:
    """What a draft says, as tables that grow with the tree, and as facts that don't."""

    languages: list[str]
    #: (nth, layer, dirs, files): layers are read in the order of nth, from 0.
    layers: DataFrame
    #: (target, sources)
    modules: DataFrame
    #: (path)
    catalogs: DataFrame
    #: Whether directories without a usual name hold a frontend.
    placeholder: bool
    default_layer: str
    nested: bool


def draft_tables(tree: DataFrame) -> Draft:
    """The draft for a tree of (path, content).

    All usual names meet the names of the tree in one join; a layer's directories
    and files are gathered from it, and the binaries of crates are further rows in
    the order that the groups give.
    """
    spark = tree.sparkSession
    known = sorted({end for ends in LANGUAGES.values() for end in ends})
    suffixes = {r.end for r in tree.select(paths.suffix(F.col("path")).alias("end")).where(F.col("end").isin(known)).distinct().collect()}
    languages = sorted(name for name, ends in LANGUAGES.items() if suffixes & set(ends))
    # at most as many rows as there are usual names
    met = _named(tree).join(F.broadcast(_usual(spark)), ["kind", "low"])
    met = spark.createDataFrame(met.collect(), met.schema)
    pick = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("nth", "name")))), lambda x: x["name"]).alias(kind)
    usual = met.where(F.col("grp").isNotNull()).groupBy("grp", "place", "layer").agg(pick("dirs"), pick("files")).withColumn("path", F.lit(""))
    crates = cargo_targets(tree.where(paths.basename(F.col("path")) == "Cargo.toml"))
    binaries = crates.where("bin IS NOT NULL").select(F.lit(BINARIES).alias("grp"), F.lit(0).alias("place"), F.col("bin").alias("layer"), F.array().cast("array<string>").alias("dirs"), F.array("file").alias("files"), "path")
    found = written(usual.unionByName(binaries).where(F.col("grp").isin(_allowed(languages))), "layers")
    placeholder = bool(suffixes & {".jsx", ".tsx"}) and found.where("layer = 'frontend'").isEmpty()
    layers = ranked(found, ["grp", "place", "path", "layer"], out="nth").select((F.col("nth") - (0 if placeholder else 1)).alias("nth"), "layer", "dirs", "files")
    if placeholder:
        layers = spark.createDataFrame([(0, "frontend", [], [])], layers.schema).unionByName(layers)
    makefiles = tree.where(paths.basename(F.col("path")) == "CMakeLists.txt") if "C" in languages else tree.limit(0)
    # catalogs lie in a directory that is spelled as its name's first place is
    places = met.where(F.col("grp").isNull()).select("name")
    catalogs = tree.where(F.endswith("path", F.lit(".json"))).select("path", F.get(paths.parts(F.col("path")), F.size(paths.parts(F.col("path"))) - 2).alias("name")).join(F.broadcast(places), "name", "left_semi")
    return Draft(
        languages,
        layers,
        cmake_modules(makefiles, tree),
        catalogs.select("path"),
        placeholder,
        "other" if not placeholder and found.isEmpty() else paths.DEFAULT_LAYER,
        "Rust" in languages and not crates.where(F.col("crate").isNotNull() & F.contains("path", F.lit("/"))).isEmpty(),
    )


def suggest_config(tree: DataFrame) -> dict:
    """The draft for a tree of (path, content) as one document."""
    tree = tree.persist()
    try:
        draft = draft_tables(tree)
        layers = [{"name": r.layer, "dirs": r.dirs, "files": r.files} for r in draft.layers.orderBy("nth").collect()]
        if draft.placeholder:
            layers[0]["_comment"] = PLACEHOLDER
        return {
            "_comment": "a draft from names and manifests: review it before use",
            "_detected_languages": draft.languages,
            "layers": layers,
            "default_layer": draft.default_layer,
            "modules": [{"name": r.target, "dirs": [], "files": r.sources} for r in draft.modules.orderBy("target").collect()],
            "translations": {"files": [r.path for r in draft.catalogs.orderBy("path").collect()]},
            "extra_excluded_dirs": [],
        } | ({"module_depth": 2} if draft.nested else {})
    finally:
        tree.unpersist()


def write_draft(root: str, draft: dict) -> str | None:
    """Writes the draft into ``root`` unless there is a configuration; the path if it was written."""
    path = os.path.join(root, CONFIG_NAME)
    try:
        with open(path, "x", encoding="utf-8") as f:
            f.write(json.dumps(draft, indent=2, ensure_ascii=False) + "\n")
    except FileExistsError:
        return None
    return path
