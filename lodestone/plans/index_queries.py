"""Queries over whole indexes and drafts, of source trees that are made of the tables.

Each nation is a module that its suppliers import; regions are a catalog.  What an
index must hold then is a matter of joins, which the SQL says.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import ProjectConfig, parse_config
from lodestone.plans import wizard
from lodestone.plans.catalogue import read, register
from lodestone.shared import new_path, spread
from lodestone.sources.scan import write_files
from lodestone.store import Index, WrongModelError
from lodestone.streaming import listing

CATALOG = "i18n/regions.json"
CONFIG = {"layers": [{"name": "world", "dirs": ["nations"]}], "default_layer": "rest", "translations": {"files": [CATALOG]}}


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of what all suppliers import, and of the catalog."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    one = nation.select(F.format_string("nations/n_%d.py", "n_nationkey").alias("path"), F.format_string("NAME = '%s'\n\n\nclass Nation%d:\n    pass\n", "n_name", "n_nationkey").alias("content"))
    package = spark.range(1).select(F.lit("nations/__init__.py").alias("path"), F.lit("").alias("content"))
    entries = region.join(nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).count(), "r_regionkey").select("r_name", F.format_string('"%s": {"key": %d, "nations": %d}', "r_name", "r_regionkey", "count").alias("x"))
    catalog = entries.agg(F.concat(F.lit("{\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_name", "x"))), lambda e: e["x"]), ",\n"), F.lit("\n}")).alias("content"))
    return one.unionByName(package).unionByName(catalog.select(F.lit(CATALOG).alias("path"), "content"))


def _suppliers(spark: SparkSession, sf_dir: str, then: bool) -> DataFrame:
    """(path, content) of the suppliers' modules; ``then``: those in debt are gone, and the rich ones have another function."""
    name = F.concat(F.lit("supply_"), F.col("s_suppkey"), F.when(F.lit(then) & (F.col("s_acctbal") > 5000), "_more").otherwise(""))
    content = F.concat(F.lit("from nations import n_"), F.col("s_nationkey"), F.lit("\n\n\ndef "), name, F.lit("():\n    return '"), F.col("s_name"), F.lit("'\n"))
    gone = F.lit(then) & (F.col("s_acctbal") < 0)
    return spread(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name", "s_acctbal")).select(F.format_string("src/s_%d.py", "s_suppkey").alias("path"), F.when(~gone, content).alias("content"))


def _built(spark: SparkSession, sf_dir: str) -> tuple[Index, ProjectConfig]:
    root, config = new_path(spark, "tree"), parse_config(CONFIG)
    write_files(_nations(spark, sf_dir).unionByName(_suppliers(spark, sf_dir, False)), root)
    index = Index(spark, root)
    index.update(config)
    return index, config


_TREE = """s AS (SELECT 'src/s_' || s_suppkey || '.py' AS path, s_nationkey AS nk, 'supply_' || s_suppkey || CASE WHEN s_acctbal > 5000 THEN '_more' ELSE '' END AS name, s_name FROM supplier WHERE NOT s_acctbal < 0),
n AS (SELECT 'nations/n_' || n_nationkey || '.py' AS path, n_nationkey AS nk, n_name FROM nation),
r AS (SELECT r_name, r_regionkey AS k, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL),
j AS (SELECT 'i18n/regions.json' AS path, '{' || chr(10) || string_agg('"' || r_name || '": {"key": ' || k || ', "nations": ' || n || '}', ',' || chr(10) ORDER BY r_name) || chr(10) || '}' AS content FROM r)"""


@register(f"""WITH {_TREE},
f AS (SELECT path, 'from nations import n_' || nk || repeat(chr(10), 3) || 'def ' || name || '():' || chr(10) || '    return ''' || s_name || '''' || chr(10) AS content FROM s
  UNION ALL SELECT path, 'NAME = ''' || n_name || '''' || repeat(chr(10), 3) || 'class Nation' || nk || ':' || chr(10) || '    pass' || chr(10) FROM n
  UNION ALL SELECT 'nations/__init__.py', '' UNION ALL SELECT path, content FROM j)
SELECT 'file' AS section, path, '' AS item, sha256(content) AS value FROM f
UNION ALL SELECT 'chunk', path, name, 'function rest src' FROM s
UNION ALL SELECT 'chunk', path, 'NAME', 'block world nations' FROM n
UNION ALL SELECT 'chunk', path, 'Nation' || nk, 'class world nations' FROM n
UNION ALL SELECT 'chunk', path, 'regions', 'json_group rest i18n' FROM j
UNION ALL SELECT 'import', s.path, n.path, 'nations' FROM s JOIN n USING (nk)
UNION ALL SELECT 'json', 'i18n/regions.json', r_name || '.key', k::VARCHAR FROM r
UNION ALL SELECT 'json', 'i18n/regions.json', r_name || '.nations', n::VARCHAR FROM r""")
def index_after_update(spark, sf_dir):
    """All an index holds after a second run, in which files changed and went."""
    index, config = _built(spark, sf_dir)
    write_files(_suppliers(spark, sf_dir, True), index.root)
    index.update(config)
    tables = index.open(config)
    row = lambda df, section, *columns: df.select(F.lit(section).alias("section"), *[c.alias(n) for c, n in zip(columns, ("path", "item", "value"), strict=True)])
    col = F.col
    parts = [
        row(tables["files"], "file", col("path"), F.lit(""), col("content_hash")),
        row(tables["chunks"], "chunk", col("file_path"), col("name"), F.concat_ws(" ", "node_type", "layer", "module")),
        row(tables["imports"], "import", col("source_file"), col("target_file"), col("module")),
        row(tables["json_entries"], "json", col("file_path"), col("key_path"), col("value")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@register(f"""WITH {_TREE}, s1 AS (SELECT count(*) AS s FROM supplier), n1 AS (SELECT count(*) AS n FROM n), r1 AS (SELECT 2 * count(*) AS r FROM r),
c AS (SELECT s, n, r, s + 2 * n + 1 AS chunks, s + n + 2 AS files FROM s1, n1, r1),
t AS (SELECT unnest(['current', 'chunks', 'json', 'python', 'rust', 'model']) AS outdated, c.* FROM c)
SELECT outdated, CASE outdated WHEN 'model' THEN -1 WHEN 'chunks' THEN 0 WHEN 'json' THEN chunks - 1 ELSE chunks END AS chunks,
  CASE outdated WHEN 'model' THEN -1 WHEN 'chunks' THEN 0 WHEN 'json' THEN files - 1 WHEN 'python' THEN 1 ELSE files END AS files,
  CASE outdated WHEN 'model' THEN -1 WHEN 'python' THEN 0 ELSE s END AS imports,
  CASE outdated WHEN 'model' THEN -1 WHEN 'json' THEN 0 ELSE r END AS json_entries, outdated IN ('chunks', 'json', 'python') AS notice FROM t""")
def index_versions(spark, sf_dir):
    """What is left to read of an index, and whether it says so, where a part of it was written by another version or for another model."""
    index, _ = _built(spark, sf_dir)
    facts, rows = index.facts(), []
    changes = {"current": {}, "chunks": {"chunks": 0}, "json": {"json": 0}, "python": {"imports": facts["imports"] | {"python": 0}}, "rust": {"imports": facts["imports"] | {"rust": 0}}, "model": {"model": "another"}}
    for name, change in changes.items():
        index._write(f"{index.version}/facts.json", json.dumps(facts | change))
        try:
            tables = index.open()
            rows.append((name, *[tables[t].count() for t in ("chunks", "files", "imports", "json_entries")], index.notice() is not None))
        except WrongModelError:
            rows.append((name, -1, -1, -1, -1, False))
    index._write(f"{index.version}/facts.json", json.dumps(facts))
    return spark.createDataFrame(rows, "outdated string, chunks long, files long, imports long, json_entries long, notice boolean")


@register("""WITH s AS (SELECT s_suppkey AS k FROM supplier), b AS (SELECT *, row_number() OVER (ORDER BY 'libs/c' || k || '/Cargo.toml') AS i FROM s)
SELECT 'layer' AS section, 'frontend' AS name, 'Web' AS dirs, '' AS files UNION ALL SELECT 'layer', 'backend/api', 'api', 'views.py' UNION ALL SELECT 'layer', 'models', 'models', ''
UNION ALL SELECT 'layer', 'tests', 'tests', '' UNION ALL SELECT 'layer', 'tests', 'tests', '' UNION ALL SELECT 'layer', 'tool' || k, '', 'tool' || k || '.rs' FROM b
UNION ALL SELECT 'module', 'lib' || k, '', CASE WHEN k % 2 = 0 THEN 'main.c,util.c' ELSE 'main.c' END FROM s
UNION ALL SELECT 'catalog', 'app' || k || '/i18n/en.json', '', '' FROM s
UNION ALL SELECT 'language', unnest(['C', 'Python', 'Rust', 'TypeScript']), '', ''
UNION ALL SELECT 'order', 'tool' || k, (i + 3)::VARCHAR, '' FROM b
UNION ALL SELECT 'default', 'backend/other', '2', ''""")
def draft_config(spark, sf_dir):
    """The draft for a tree of a program, a crate and a library of each supplier."""
    key = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    made = [
        ("appKEY/api/views.py", None), ("appKEY/models/x.py", None), ("appKEY/Web/a.tsx", None), ("appKEY/i18n/en.json", None), ("appKEY/i18n/deep/no.json", None), ("appKEY/tests/t.py", None),
        ("libs/cKEY/Cargo.toml", '[package]\nname = "cKEY"\n[[bin]]\nname = "toolKEY"\n'), ("libs/cKEY/src/lib.rs", None),
        ("nativeKEY/CMakeLists.txt", "add_library(libKEY STATIC main.c util.c $<X:y>) # )\nadd_executable(noneKEY ${SOURCES} main.c)\n"), ("nativeKEY/main.c", None),
    ]
    filled = lambda text: F.regexp_replace(F.lit(text), F.lit("KEY"), F.col("k").cast("string")) if text else F.lit(None).cast("string")
    files = key.select(F.inline(F.array(*[F.struct(filled(p).alias("path"), filled(t).alias("content")) for p, t in made])))
    some = key.where("k % 2 = 0").select(F.concat(F.lit("native"), F.col("k"), F.lit("/util.c")).alias("path"), F.lit(None).cast("string").alias("content"))
    draft = wizard.draft_tables(files.unionByName(some))
    row = lambda df, section, name, dirs, files: df.select(F.lit(section).alias("section"), name.alias("name"), dirs.alias("dirs"), files.alias("files"))
    col, none = F.col, F.lit("")
    facts = [("language", x, "", "") for x in draft.languages] + [("default", draft.default_layer, str(2 if draft.nested else None), "")]
    parts = [
        row(draft.layers, "layer", col("layer"), F.array_join("dirs", ","), F.array_join("files", ",")),
        row(draft.layers.where(F.startswith("layer", F.lit("tool"))), "order", col("layer"), col("nth").cast("string"), none),
        row(draft.modules, "module", col("target"), none, F.array_join("sources", ",")),
        row(draft.catalogs, "catalog", col("path"), none, none),
        spark.createDataFrame(facts, "section string, name string, dirs string, files string"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])


@register("""SELECT 'nations/__init__.py' AS path, 'new' AS status, 100 AS seconds UNION ALL SELECT 'nations/n_' || n_nationkey || '.py', 'new', 100 FROM nation
UNION ALL SELECT 'src/s_' || s_suppkey || '.py', 'new', 100 FROM supplier UNION ALL SELECT 'src/s_' || s_suppkey || '.py', 'changed', 200 FROM supplier WHERE s_acctbal > 5000
UNION ALL SELECT 'src/s_' || s_suppkey || '.py', 'deleted', 101 FROM supplier WHERE s_acctbal < 0""")
def tree_changes(spark, sf_dir):
    """What a stream of listings says of a tree before and after files changed and went: a row for each change, none for what stayed."""
    root, listings, out, checkpoint = (new_path(spark, n) for n in ("tree", "listings", "changes", "state"))
    write_files(_nations(spark, sf_dir).unionByName(_suppliers(spark, sf_dir, False)), root)
    for seconds, then in ((100, None), (200, _suppliers(spark, sf_dir, True))):
        if then is not None:
            write_files(then, root)
        listing.write_listing(spark, root, listings, seconds)
        listing.follow_listings(spark, listings, out, checkpoint, once=True).awaitTermination()
    return spark.read.parquet(f"{out}/batch_*/changes").select("path", "status", F.col("seconds").cast("int").alias("seconds"))
