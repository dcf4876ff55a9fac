"""The index: tables of one project and model, in buckets of the file's path.

A version is a folder of Parquet tables and a small JSON of facts.  The first run,
and one that is forced or follows another version of the program, writes a new one
beside the old and then moves the pointer.  Other runs rewrite the buckets of the
files that changed, and leave all others as they are.  The table of files, whose
hashes say what is indexed, is written last: a run that ends before finds its
files changed again the next time, and what it had written is replaced.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import ProjectConfig
from lodestone.functions import paths
from lodestone.functions.vectors import HASH_MODEL, embed, load_embedder
from lodestone.operators import buckets, gram_index, graph, maintenance
from lodestone.sources.chunking import with_source_chunks
from lodestone.sources.import_specs import C_FAMILY, JS_ENDINGS, import_edges
from lodestone.sources.json_tree import with_chunks, with_leaves
from lodestone.sources.scan import scan_tree

SCHEMAS = {
    "files": "path string, content_hash string",
    "chunks": "chunk_id long, file_path string, start_line int, end_line int, node_type string, name string, text string, chunk_source_kind string, module string, embedding array<float>, layer string",
    "imports": "source_file string, target_file string, module string",
    "json_entries": "file_path string, ord int, key_path string, value string",
    "grams": "gram string, chunk_id long, file_path string",
}
#: The column that names the file a row belongs to, in the order in which tables are updated.
KEYS = {"chunks": "file_path", "grams": "file_path", "imports": "source_file", "json_entries": "file_path", "files": "path"}
#: Columns that buckets are sorted by, for readers who ask for some values.
ORDER = {"grams": ("gram",)}
#: Versions of what the tables hold; a row written under another version is made anew.
CHUNKS, JSON = 1, 1
IMPORTS = {"python": 1, "js_ts": 1, "rust": 1, "c_cpp": 1}
IMPORT_SUFFIXES = {"python": (".py",), "js_ts": JS_ENDINGS, "rust": (".rs",), "c_cpp": C_FAMILY}
#: Errors of a run that are handed over; all of them stay out of the index and are tried again.
SHOWN_ERRORS = 1000
NOTICE = "the index is older than this program; index again to refresh it"


class WrongModelError(RuntimeError):
    """The index was built with another embedding model."""


def _columns(name: str) -> list[str]:
    return [f.split()[0] for f in SCHEMAS[name].split(", ")]


def _postings(chunks: DataFrame) -> DataFrame:
    return gram_index.postings(chunks, ("name", "text", "file_path"), "chunk_id", "file_path")


@dataclass
class Run:
    """What an indexing run did."""

    changed_files: int
    unchanged_files: int
    deleted_files: int
    new_chunks: int
    parse_errors: list[str]
    rewritten_buckets: int = 0
    buckets: int = 0


class Index:
    def __init__(self, spark: SparkSession, root: str, model: str = HASH_MODEL) -> None:
        self.spark, self.root, self.model = spark, root.rstrip("/"), model
        self.home = f"{self.root}/.lodestone/{model.rsplit('/', 1)[-1]}"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.home).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- versions ----------------------------------------------------------------------------

    def _read(self, name: str) -> str | None:
        path = self._path(f"{self.home}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        """Through a file beside it: the rename is what readers see."""
        path, beside = self._path(f"{self.home}/{name}"), self._path(f"{self.home}/.{name.replace('/', '-')}.{uuid.uuid4().hex}")
        stream = self._fs.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        # one rename over what is there: a reader, or a crash, never finds neither
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        over = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        over[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(beside), self._fs.makeQualified(path), over)

    @property
    def version(self) -> str | None:
        return self._read("CURRENT")

    def exists(self) -> bool:
        return self.version is not None

    def facts(self) -> dict:
        at = self.version
        return json.loads(self._read(f"{at}/facts.json") or "{}") if at else {}

    def table(self, name: str) -> DataFrame:
        at = self.version
        if at is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return buckets.read_table(self.spark, f"{self.home}/{at}/{name}", SCHEMAS[name], KEYS[name])

    def open(self, config: ProjectConfig | None = None) -> dict[str, DataFrame]:
        """All tables, without rows that another version of the program wrote.

        With ``config`` layers and modules follow its rules, which may have changed since the rows were written.
        """
        tables = self._usable()
        if config is not None:
            tables["chunks"] = maintenance.reclassified(tables["chunks"], config.layer_rules, config.default_layer, config.module_depth, config.module_rules)
        return tables

    def module_graph(self, config: ProjectConfig) -> DataFrame:
        """Roles of the project's modules in its imports."""
        return graph.module_graph(self.open()["imports"], config.module_depth, config.module_rules)

    def entry_points(self, config: ProjectConfig) -> DataFrame:
        """Files at the root that import more than one module."""
        return graph.entry_points(self.open()["imports"], config.module_depth, config.module_rules)

    def warnings(self, config: ProjectConfig) -> list[str]:
        """What looks wrong with the configuration, given the chunks there are."""
        return maintenance.warnings(self.open(config)["chunks"], len(config.layer_rules), config.default_layer)

    def _usable(self) -> dict[str, DataFrame]:
        facts = self.facts()
        if facts and facts["model"] != self.model:
            raise WrongModelError(f"index of {facts['model']}, asked for {self.model}")
        tables = {n: self.table(n) for n in SCHEMAS if n != "grams" or not facts or facts.get("buckets")}
        if not facts:
            return tables
        if facts["chunks"] != CHUNKS:
            tables["chunks"], tables["files"] = tables["chunks"].limit(0), tables["files"].limit(0)
        if facts["json"] != JSON:
            stale = tables["json_entries"].select(F.col("file_path").alias("path")).union(tables["chunks"].where("node_type = 'json_group'").select("file_path")).distinct()
            tables["files"] = maintenance.without_paths(tables["files"], stale, "path")
            tables["chunks"], tables["json_entries"] = tables["chunks"].where("node_type <> 'json_group'"), tables["json_entries"].limit(0)
        for language, suffixes in IMPORT_SUFFIXES.items():
            if facts["imports"].get(language) != IMPORTS[language]:
                tables["imports"] = maintenance.without_suffixes(tables["imports"], suffixes, "source_file")
                tables["files"] = maintenance.without_suffixes(tables["files"], suffixes)
        return tables

    def postings(self, wanted: Sequence[str] | None = None) -> DataFrame | None:
        """(gram, chunk_id): all postings of the chunks, or those of some runs; None where what is stored is older than this program."""
        if not self._current():
            return None
        found = self.table("grams").select("gram", "chunk_id")
        return found if wanted is None else found.where(F.col("gram").isin(list(wanted)))

    def notice(self) -> str | None:
        """What to tell a reader if rows are missing until the next run; nothing if there were none to leave out."""
        facts = self.facts()
        if not facts or (facts["chunks"], facts["json"], facts["imports"]) == (CHUNKS, JSON, IMPORTS):
            return None
        usable = self._usable()
        return NOTICE if any(self.table(n).count() > usable[n].count() for n in ("chunks", "json_entries", "imports", "files")) else None

    def _commit(self, tables: dict[str, DataFrame]) -> int:
        """Writes a whole version and returns its number of buckets."""
        at, count = f"v{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}", buckets.bucket_count(tables["files"].count())
        for name, df in tables.items():
            buckets.write_table(df.select(*_columns(name)), f"{self.home}/{at}/{name}", KEYS[name], count, ORDER.get(name, ()))
        self._write(f"{at}/facts.json", json.dumps({"model": self.model, "chunks": CHUNKS, "json": JSON, "imports": IMPORTS, "buckets": count}))
        before = self.version
        self._write("CURRENT", at)
        # the version before stays for those who are reading it
        for status in self._fs.listStatus(self._path(self.home)):
            if status.isDirectory() and status.getPath().getName() not in (at, before):
                self._fs.delete(status.getPath(), True)
        return count

    def _replace(self, gone: DataFrame, new: dict[str, DataFrame]) -> list[int]:
        """Updates the buckets of the files in ``gone`` (path) and returns them."""
        count = self.facts()["buckets"]
        touched = buckets.touched_buckets(gone, "path", count)
        for name, key in KEYS.items():
            buckets.replace_rows(self.spark, f"{self.home}/{self.version}/{name}", SCHEMAS[name], key, count, gone.withColumnRenamed("path", key), new[name].select(*_columns(name)), touched, ORDER.get(name, ()))
        return touched

    def _current(self) -> bool:
        """Whether all that is stored was written by this version of the program, in buckets."""
        facts = self.facts()
        return bool(facts.get("buckets")) and (facts["chunks"], facts["json"], facts["imports"]) == (CHUNKS, JSON, IMPORTS)

    # -- indexing ----------------------------------------------------------------------------

    def _finished(self, chunks: DataFrame, config: ProjectConfig, load: Callable) -> DataFrame:
        """Chunks with their id, layer, module and embedding."""
        path = F.col("file_path")
        named = chunks.withColumns(
            {
                "chunk_id": F.xxhash64("file_path", "start_line", "node_type", "name", "text"),
                "layer": paths.classify_layer(path, config.layer_rules, config.default_layer),
                "module": paths.classify_module(path, config.module_depth, config.module_rules),
            }
        )
        return embed(named, "text", self.model, "embedding", load)

    def update(self, config: ProjectConfig, subdir: str = "", force: bool = False, load: Callable = load_embedder) -> Run:
        """Brings the index up to date with the tree, or with a part of it.

        The tree is walked once; only new and changed files are parsed, and only their buckets rewritten.
        """
        load(self.model)
        tables = self.open(config)
        named, manifest = F.col("path").isin(list(config.translations)), paths.basename(F.col("path")) == "Cargo.toml"
        code_file = paths.suffix(F.col("path")).isin(list(paths.EXTENSIONS))
        tree = scan_tree(self.spark, self.root, sorted(config.extra_excluded_dirs), sorted(config.forced_add), also=named | manifest).persist()
        every, texts = tree.where(code_file & ~named), tree.where(named)
        inside = F.startswith("path", F.lit(subdir.strip("/") + "/")) if subdir else F.lit(True)
        code = maintenance.diff(tables["files"], every.where(inside), force, code_file & inside)
        other = maintenance.diff(tables["files"], texts, force, ~code_file)
        # written, as it says what is stored before that is overwritten
        work = f"{self.home}/work-{uuid.uuid4().hex}"
        code.withColumn("code", F.lit(True)).unionByName(other.withColumn("code", F.lit(False))).write.parquet(work)
        changes = self.spark.read.parquet(work)
        stats = maintenance.diff_stats(changes.where("code")).first()
        todo = changes.where("status IN ('new', 'changed')").select("path")
        gone = changes.where("status <> 'unchanged'").select("path")

        parsed = with_source_chunks(every.join(todo, "path", "left_semi")).persist()
        errors = [f"{r.path}: {r.error}" for r in parsed.where("error IS NOT NULL").select("path", "error").orderBy("path").limit(SHOWN_ERRORS).collect()]
        failed = parsed.where("error IS NOT NULL").select("path")
        new_json = texts.join(todo, "path", "left_semi").withColumn("stem", paths.stem(F.col("path")))
        json_chunks = with_chunks(new_json, "content", "stem").select(F.col("path").alias("file_path"), "start_line", F.col("start_line").alias("end_line"), F.lit("json_group").alias("node_type"), "name", "text", F.lit("json_key").alias("chunk_source_kind"))
        chunks = parsed.where("error IS NULL").withColumnRenamed("path", "file_path").drop("error").unionByName(json_chunks)
        chunks = self._finished(chunks, config, load).persist()
        new = {
            "chunks": chunks,
            "grams": _postings(chunks),
            "imports": import_edges(every.select("path", "content"), tree.where(manifest).select("path", "content"), self.root.rsplit("/", 1)[-1], todo.join(failed, "path", "left_anti")),
            "json_entries": with_leaves(new_json, "content").select(F.col("path").alias("file_path"), "ord", "key_path", "value"),
            "files": changes.where("status IN ('new', 'changed')").join(failed, "path", "left_anti").select("path", "content_hash"),
        }
        if self._current() and not force:
            count, touched = self.facts()["buckets"], len(self._replace(gone, new))
        else:
            kept = {n: maintenance.without_paths(tables[n], gone, key) for n, key in KEYS.items() if n != "grams"}
            whole = {n: kept[n].select(*_columns(n)).unionByName(new[n].select(*_columns(n))) for n in kept}
            whole["grams"] = _postings(whole["chunks"])
            count = touched = self._commit(whole)
        run = Run(stats.changed_files, stats.unchanged_files, stats.deleted_files, chunks.count(), errors, touched, count)
        for df in (tree, parsed, chunks):
            df.unpersist()
        self._fs.delete(self._path(work), True)
        return run
