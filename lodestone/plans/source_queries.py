"""Registered queries over source files, manifests and JSON that are made of the driver's tables.

The files of a row are templates: ``KEY`` stands for its key, and which parts a
file or a tree has depends on the key.  What must come out of each part was
written down by hand; the SQL puts it together, with lines and numbers of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import escape_like
from lodestone.functions.vectors import embed
from lodestone.operators import graph, maintenance
from lodestone.plans.catalogue import ORACLE_SQL, QUERIES, read, register
from lodestone.shared import spread
from lodestone.sources.chunking import with_source_chunks
from lodestone.sources.import_specs import import_edges
from lodestone.sources.json_tree import with_chunks
from lodestone.sources.manifests import cargo_targets, cmake_modules

#: A chunk that a part of a file must give: type, name, first and last line in it from 0, text.
Want = tuple[str, str, int, int, str]
#: A part of a file: its text and its chunks.
Part = tuple[str, Sequence[Want]]


def _quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _filled(text: str, key: Column) -> Column:
    return F.replace(F.lit(text), F.lit("KEY"), key.cast("string"))


# ---- chunks --------------------------------------------------------------------------------


def _files_of_parts(spark: SparkSession, sf_dir: str, ending: str, parts: Sequence[Part]) -> DataFrame:
    """A file for each row of ``part``: the parts that its key has, two empty lines between each two."""
    key = F.col("p_partkey")
    there = [F.when(F.shiftright(key * 37 + 11, j).bitwiseAND(3) != 0, _filled(text, key)) for j, (text, _) in enumerate(parts)]
    return spread(read(spark, sf_dir, "part").select("p_partkey")).select(F.concat(F.lit("d/f"), key, F.lit(ending)).alias("path"), F.concat_ws("\n\n\n", *there).alias("content"))


def _chunks_sql(ending: str, parts: Sequence[Part]) -> str:
    sizes = ", ".join(f"({j}, {text.count(chr(10)) + 1})" for j, (text, _) in enumerate(parts))
    wants = ", ".join(f"({j}, {i}, {_quoted(kind)}, {_quoted(name)}, {first}, {last}, {_quoted(body)})" for j, (_, found) in enumerate(parts) for i, (kind, name, first, last, body) in enumerate(found))
    return f"""WITH f AS (SELECT p_partkey AS k, j, n FROM part, (VALUES {sizes}) v(j, n) WHERE (((p_partkey * 37 + 11) >> j) & 3) <> 0),
o AS (SELECT k, j, 1 + coalesce(sum(n + 2) OVER (PARTITION BY k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM f),
w(j, i, node_type, name, s, e, text) AS (VALUES {wants}),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY j, i) AS num FROM o JOIN w USING (j))
SELECT 'd/f' || k || '{ending}' AS path, (top + s)::INT AS start_line, (top + e)::INT AS end_line, node_type, replace(replace(name, 'KEY', k::VARCHAR), 'NUM', num::VARCHAR) AS name, replace(text, 'KEY', k::VARCHAR) AS text FROM r"""


def _chunk_query(name: str, ending: str, parts: Sequence[Part]) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = with_source_chunks(_files_of_parts(spark, sf_dir, ending, parts))
        return found.select("path", "start_line", "end_line", "node_type", "name", "text")

    query.__name__ = name
    register(_chunks_sql(ending, parts))(query)


_chunk_query(
    "chunks_python",
    ".py",
    [
        ("import functools\nfrom a import KEY_b", []),
        ("# about it\ndef fKEY(x):\n    return x", [("function", "fKEY", 0, 2, "# about it\ndef fKEY(x):\n    return x")]),
        ("@functools.cache\nasync def gKEY():\n    return 'def no(): KEY'", [("function", "gKEY", 0, 2, "@functools.cache\nasync def gKEY():\n    return 'def no(): KEY'")]),
        (
            "class KKEY(Base):\n    '''doc'''\n    a = KEY\n\n    # about m\n    def m(self):\n        return self.a\n\n    class Inner:\n        b = 1",
            [("class", "KKEY", 0, 9, "class KKEY(Base):\n'''doc'''\na = KEY\n"), ("method", "KKEY.m", 4, 6, "# about m\ndef m(self):\n        return self.a"), ("class", "KKEY.Inner", 8, 9, "class Inner:\nb = 1\n")],
        ),
        ("LIMIT_KEY = KEY  # seconds\nOTHER = 2", [("block", "LIMIT_KEY", 0, 1, "LIMIT_KEY = KEY  # seconds\nOTHER = 2")]),
        ("with router('/KEY'):\n    router('GET')", [("block", "fKEY#NUM", 0, 1, "with router('/KEY'):\n    router('GET')")]),
        ("if KEY:\n    x = 1", []),
        ("x_KEY = 1\n\ny_KEY = [\n    2,\n]", [("block", "x_KEY", 0, 0, "x_KEY = 1"), ("block", "y_KEY", 2, 4, "y_KEY = [\n    2,\n]")]),
    ],
)

_chunk_query(
    "chunks_js",
    ".tsx",
    [
        ("import a from 'a';\nimport { KEY_b } from \"./b\";", []),
        ("// about it\nconst fKEY = (a) => {\n  return `${a} }`;\n};", [("function", "fKEY", 0, 3, "// about it\nconst fKEY = (a) => {\n  return `${a} }`;\n};")]),
        ("export async function gKEY(): Promise<void> {\n  await go(/[}]/);\n}", [("function", "gKEY", 0, 2, "export async function gKEY(): Promise<void> {\n  await go(/[}]/);\n}")]),
        ("class WKEY extends B {\n  run() {\n    return KEY;\n  }\n}", [("class", "WKEY", 0, 4, "class WKEY extends B\n"), ("method", "WKEY.run", 1, 3, "run() {\n    return KEY;\n  }")]),
        ("class VKEY {\n  on = (e) => {\n    go(e);\n  }\n}", [("class", "VKEY", 0, 4, "class VKEY\n"), ("method", "VKEY.on", 1, 3, "on = (e) => {\n    go(e);\n  }")]),
        ("let pKEY = 1, q = () => 2;", [("block", "pKEY", 0, 0, "let pKEY = 1, q = () => 2;")]),
        ("wKEY({a: '}'});", [("block", "fKEY#NUM", 0, 0, "wKEY({a: '}'});")]),
        ("if (a) { b(KEY) } else { c() }", []),
    ],
)

_chunk_query(
    "chunks_rust",
    ".rs",
    [
        ("use a::b;\npub mod mKEY;", []),
        ("/* a /* b */ } */\n#[inline]\npub fn fKEY() -> u32 { KEY }", [("function", "fKEY", 0, 2, "/* a /* b */ } */\n#[inline]\npub fn fKEY() -> u32 { KEY }")]),
        ("impl<T> Default for GKEY<T> {\n    fn default() -> Self { GKEY }\n}", [("class", "Default for GKEY<T>", 0, 2, "impl<T> Default for GKEY<T>\n"), ("method", "Default for GKEY<T>.default", 1, 1, "fn default() -> Self { GKEY }")]),
        ("trait TKEY {\n    fn m(&self) -> u32 { '}' as u32 }\n}", [("class", "TKEY", 0, 2, "trait TKEY\n"), ("method", "TKEY.m", 1, 1, "fn m(&self) -> u32 { '}' as u32 }")]),
        ("const CKEY: usize = KEY;\nstatic SKEY: usize = 1;", [("block", "CKEY", 0, 1, "const CKEY: usize = KEY;\nstatic SKEY: usize = 1;")]),
        ("struct UKEY;", []),
        ("#[cfg(test)]\nmod tests_KEY {\n    #[test]\n    fn t() { assert!(r#\"}\"# != \"\"); }\n}", [("class", "tests_KEY", 0, 4, "#[cfg(test)]\nmod tests_KEY\n"), ("method", "tests_KEY.t", 2, 3, "#[test]\nfn t() { assert!(r#\"}\"# != \"\"); }")]),
    ],
)

_chunk_query(
    "chunks_c",
    ".c",
    [
        ("#include <a.h>", []),
        ("/* about it */\nstatic int *fKEY(char *s, int n) {\n    return s[n] == '}' ? 0 : KEY;\n}", [("function", "fKEY", 0, 3, "/* about it */\nstatic int *fKEY(char *s, int n) {\n    return s[n] == '}' ? 0 : KEY;\n}")]),
        ("#ifdef A_KEY\nint gKEY(void) {\n    return KEY;\n}\n#endif", [("function", "gKEY", 1, 3, "int gKEY(void) {\n    return KEY;\n}")]),
        ("int oldKEY(a, b)\n  int a;\n  char *b;\n{\n  return a;\n}", [("function", "oldKEY", 0, 5, "int oldKEY(a, b)\n  int a;\n  char *b;\n{\n  return a;\n}")]),
        ("int protoKEY(int a);\nstatic int cKEY = 0;", [("block", "protoKEY", 0, 1, "int protoKEY(int a);\nstatic int cKEY = 0;")]),
    ],
)

_chunk_query(
    "chunks_cpp",
    ".hpp",
    [
        ("#include <a>\nusing namespace std;", []),
        ("namespace nKEY {\nint free(int a) { return a; }\n}", [("class", "nKEY", 0, 2, "namespace nKEY\n"), ("method", "nKEY.free", 1, 1, "int free(int a) { return a; }")]),
        ("template <typename T>\nT maxKEY(T a, T b) {\n    return a < b ? b : a;\n}", [("function", "maxKEY", 0, 3, "template <typename T>\nT maxKEY(T a, T b) {\n    return a < b ? b : a;\n}")]),
        ("void WKEY::run()\n{\n    x = R\"(})\";\n}", [("function", "WKEY::run", 0, 3, "void WKEY::run()\n{\n    x = R\"(})\";\n}")]),
        ("extern \"C\" {\nint cKEY(void) {\n  return KEY;\n}\n}", [("function", "cKEY", 1, 3, "int cKEY(void) {\n  return KEY;\n}")]),
        ("struct DKEY {\n    ~DKEY() {}\n};", [("class", "DKEY", 0, 2, "struct DKEY\n"), ("method", "DKEY.~DKEY", 1, 1, "~DKEY() {}")]),
    ],
)


# ---- imports -------------------------------------------------------------------------------

#: A file of a tree: path, text, the condition on the key ``k`` under which it is there.
File = tuple[str, str, str]
#: An edge: the file that imports, the file found, the label, the condition.
Edge = tuple[str, str, str, str]


def _files_of_trees(spark: SparkSession, sf_dir: str, files: Sequence[File]) -> DataFrame:
    """(path, content): a tree for each row of ``supplier``."""
    keys = spread(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")))
    each = F.array(*[F.struct(_filled(path, F.col("k")).alias("path"), _filled(text, F.col("k")).alias("content"), F.expr(when).alias("there")) for path, text, when in files])
    return keys.select(F.inline(each)).where("there").drop("there")


def _edges_sql(edges: Sequence[Edge]) -> str:
    filled = lambda text: f"replace({_quoted(text)}, 'KEY', k::VARCHAR)"
    rows = [f"SELECT {filled(source)} AS source_file, {filled(target)} AS target_file, {filled(label)} AS module FROM s WHERE {when}" for source, target, label, when in edges]
    return "WITH s AS (SELECT s_suppkey AS k FROM supplier)\n" + "\nUNION ALL ".join(rows)


def _import_query(name: str, files: Sequence[File], edges: Sequence[Edge]) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tree = _files_of_trees(spark, sf_dir, files)
        manifests = tree.where(F.endswith("path", F.lit("Cargo.toml")))
        return import_edges(tree, manifests if name == "imports_rust" else None, "proj")

    query.__name__ = name
    register(_edges_sql(edges))(query)


_import_query(
    "imports_python",
    [
        ("sKEY/__init__.py", "", "true"),
        ("sKEY/a.py", "import sKEY.b.c as x, os\nfrom . import b, nothing\nfrom .b import c\nfrom .sub.deep import (\n    y,\n)\nif TYPE_CHECKING:\n    import sKEY.no\nelse:\n    from sKEY.d import e\ndef f():\n    import proj.sKEY.d\n", "true"),
        ("sKEY/b/__init__.py", "", "k % 2 = 0"),
        ("sKEY/b/c.py", "from ..d import thing\n", "k % 3 <> 0"),
        ("sKEY/d.py", "from .ns import z\nfrom . import a\n", "true"),
        ("sKEY/no.py", "", "true"),
        ("sKEY/sub/deep.py", "from . import deep\ndef broken(:\nimport sKEY.d\n", "true"),
    ],
    [
        ("sKEY/a.py", "sKEY/b/c.py", "sKEY.b.c", "k % 3 <> 0"),
        ("sKEY/a.py", "sKEY/b/__init__.py", ".", "k % 2 = 0"),
        ("sKEY/a.py", "sKEY/__init__.py", ".", "k % 2 = 1"),
        ("sKEY/a.py", "sKEY/b/c.py", ".b", "k % 2 = 0 AND k % 3 <> 0"),
        ("sKEY/a.py", "sKEY/b/__init__.py", ".b", "k % 2 = 0 AND k % 3 = 0"),
        ("sKEY/a.py", "sKEY/sub/deep.py", ".sub.deep", "true"),
        ("sKEY/a.py", "sKEY/d.py", "sKEY.d", "true"),
        ("sKEY/a.py", "sKEY/d.py", "proj.sKEY.d", "true"),
        ("sKEY/b/c.py", "sKEY/d.py", "..d", "k % 3 <> 0"),
        ("sKEY/d.py", "sKEY/a.py", ".", "true"),
        # the folder of deep.py is no package: its bare relative import finds nothing
        ("sKEY/sub/deep.py", "sKEY/d.py", "sKEY.d", "true"),
    ],
)

_import_query(
    "imports_js",
    [
        ("wKEY/app.js", "import A from './lib/a';\nexport * from \"./lib\";\nconst z = require('../wKEY/util');\nimport './style.ts';\nimport 'react';\n// import './no';\nconst s = \"import './lib/a'\";\n", "true"),
        ("wKEY/lib/a.ts", "import type { B } from '../util';\n", "k % 2 = 0"),
        ("wKEY/lib/a.jsx", "", "true"),
        ("wKEY/lib/index.js", "export { a } from './a';\n", "k % 3 <> 0"),
        ("wKEY/lib/index.tsx", "", "k % 4 = 0"),
        ("wKEY/util/index.ts", "", "k % 2 = 1"),
        ("wKEY/util.tsx", "", "k % 5 = 0"),
        ("wKEY/style.ts", "", "true"),
        ("wKEY/no.js", "", "true"),
    ],
    [
        ("wKEY/app.js", "wKEY/lib/a.ts", "./lib/a", "k % 2 = 0"),
        ("wKEY/app.js", "wKEY/lib/a.jsx", "./lib/a", "k % 2 = 1"),
        ("wKEY/app.js", "wKEY/lib/index.tsx", "./lib", "k % 4 = 0"),
        ("wKEY/app.js", "wKEY/lib/index.js", "./lib", "k % 4 <> 0 AND k % 3 <> 0"),
        ("wKEY/app.js", "wKEY/util.tsx", "../wKEY/util", "k % 5 = 0"),
        ("wKEY/app.js", "wKEY/util/index.ts", "../wKEY/util", "k % 5 <> 0 AND k % 2 = 1"),
        ("wKEY/app.js", "wKEY/style.ts", "./style.ts", "true"),
        ("wKEY/lib/a.ts", "wKEY/util.tsx", "../util", "k % 2 = 0 AND k % 5 = 0"),
        ("wKEY/lib/index.js", "wKEY/lib/a.ts", "./a", "k % 3 <> 0 AND k % 2 = 0"),
        ("wKEY/lib/index.js", "wKEY/lib/a.jsx", "./a", "k % 3 <> 0 AND k % 2 = 1"),
    ],
)

_import_query(
    "imports_c",
    [
        ("cKEY/src/m.c", '#include "m.h"\n#include <stdio.h>\n  #  include "deepKEY.h"\n#include "../inc/twice.h"\n#include "gone.h"\n// #include "no.h"\n/*\n#include "no.h"\n*/\n', "true"),
        ("cKEY/src/m.h", "", "k % 2 = 0"),
        ("cKEY/other/m.h", "", "true"),
        ("cKEY/inc/deepKEY.h", '#include "partKEY.hpp"\n', "true"),
        ("cKEY/a/partKEY.hpp", "", "true"),
        ("cKEY/b/partKEY.hpp", "", "k % 3 = 0"),
        ("cKEY/inc/twice.h", "", "k % 5 <> 0"),
        ("cKEY/src/no.h", "", "true"),
    ],
    [
        ("cKEY/src/m.c", "cKEY/src/m.h", "m.h", "k % 2 = 0"),
        ("cKEY/src/m.c", "cKEY/inc/deepKEY.h", "deepKEY.h", "true"),
        ("cKEY/src/m.c", "cKEY/inc/twice.h", "../inc/twice.h", "k % 5 <> 0"),
        ("cKEY/inc/deepKEY.h", "cKEY/a/partKEY.hpp", "partKEY.hpp", "k % 3 <> 0"),
    ],
)

_import_query(
    "imports_rust",
    [
        ("rKEY/Cargo.toml", '[package]\nname = "my-rKEY"\n', "true"),
        ("rKEY/src/lib.rs", "pub mod net;\nmod util;\nmod inner { pub mod deep; }\n", "true"),
        ("rKEY/src/net.rs", "mod tcp;\nuse super::util::{self, helper as h};\n", "k % 2 = 0"),
        ("rKEY/src/net/mod.rs", "mod tcp;\nuse super::util::{self, helper as h};\n", "k % 2 = 1"),
        ("rKEY/src/net/tcp.rs", "use crate::util::Conn;\nuse super::*;\nuse std::io;\n", "true"),
        ("rKEY/src/util.rs", "use my_rKEY::inner::deep::X as Y;\nuse self::a::b;\n", "true"),
        ("rKEY/src/inner/deep.rs", "", "k % 3 <> 0"),
        ("rKEY/src/main.rs", "use my_rKEY::net::tcp::T;\n", "true"),
        ("rKEY/src/orphan.rs", "use crate::net::A;\n", "true"),
    ],
    [
        ("rKEY/src/net.rs", "rKEY/src/util.rs", "super::util", "k % 2 = 0"),
        ("rKEY/src/net.rs", "rKEY/src/util.rs", "super::util::helper", "k % 2 = 0"),
        ("rKEY/src/net/mod.rs", "rKEY/src/util.rs", "super::util", "k % 2 = 1"),
        ("rKEY/src/net/mod.rs", "rKEY/src/util.rs", "super::util::helper", "k % 2 = 1"),
        ("rKEY/src/net/tcp.rs", "rKEY/src/util.rs", "crate::util::Conn", "true"),
        ("rKEY/src/net/tcp.rs", "rKEY/src/net.rs", "super", "k % 2 = 0"),
        ("rKEY/src/net/tcp.rs", "rKEY/src/net/mod.rs", "super", "k % 2 = 1"),
        ("rKEY/src/util.rs", "rKEY/src/inner/deep.rs", "my_rKEY::inner::deep::X", "k % 3 <> 0"),
        # the module inside lib.rs is known, its file isn't there
        ("rKEY/src/util.rs", "rKEY/src/lib.rs", "my_rKEY::inner::deep::X", "k % 3 = 0"),
        ("rKEY/src/util.rs", "rKEY/src/util.rs", "self::a::b", "true"),
        ("rKEY/src/main.rs", "rKEY/src/net/tcp.rs", "my_rKEY::net::tcp::T", "true"),
    ],
)


# ---- manifests -----------------------------------------------------------------------------


@register("""WITH s AS (SELECT s_suppkey AS k FROM supplier)
SELECT 'r' || k || '/Cargo.toml' AS path, 'my-r' || k AS crate, NULL AS bin, NULL AS file FROM s
UNION ALL SELECT 'r' || k || '/Cargo.toml', 'my-r' || k, 'one', 'first.rs' FROM s WHERE k % 2 = 0
UNION ALL SELECT 'r' || k || '/Cargo.toml', 'my-r' || k, 'two' || k, 'two' || k || '.rs' FROM s WHERE k % 2 = 0""")
def manifests_cargo(spark, sf_dir):
    head = '[package]\nname = "my-rKEY"\n'
    bins = '[[bin]]\nname = "one"\npath = "src/cmd/first.rs"\n[[bin]]\nname = "twoKEY"\n[[bin]]\npath = "src/unnamed.rs"\n'
    return cargo_targets(_files_of_trees(spark, sf_dir, [("rKEY/Cargo.toml", head + bins, "k % 2 = 0"), ("rKEY/Cargo.toml", head, "k % 2 = 1"), ("rKEY/bad/Cargo.toml", "[", "true")]))


@register("""SELECT 'app' || s_suppkey AS target, CASE WHEN s_suppkey % 3 = 0 THEN 'main.c' ELSE 'main.c,util.c' END AS sources FROM supplier
UNION ALL SELECT 'lib' || s_suppkey, 'util.c' FROM supplier WHERE s_suppkey % 3 <> 0
UNION ALL SELECT 'no', 'main.c' FROM (SELECT count(*) AS n FROM supplier) WHERE n > 0""")
def manifests_cmake(spark, sf_dir):
    """Targets of build files; a call is found wherever it stands, behind a comment sign too, and one name in many files is one target."""
    text = 'project(x)\n# add_library(no main.c)\nadd_executable(appKEY "main.c" # and\n  src/util.c missing.c $<TARGET_OBJECTS:z>)\nADD_LIBRARY(libKEY STATIC src/util.c)\nadd_library(varKEY ${SOURCES})\n'
    files = _files_of_trees(spark, sf_dir, [("kKEY/CMakeLists.txt", text, "true"), ("kKEY/main.c", "", "true"), ("kKEY/src/util.c", "", "k % 3 <> 0")])
    found = cmake_modules(files.where(F.endswith("path", F.lit("CMakeLists.txt"))), files)
    return found.select("target", F.array_join("sources", ",").alias("sources"))


# ---- JSON budgets --------------------------------------------------------------------------

ORACLE_SQL["json_budget_batch"] = """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
l AS (SELECT conv_id, i, unnest([1, 2, 3]) AS j, unnest(['turn', 'role', 'text']) AS key, unnest([turn::VARCHAR, role, text]) AS value FROM t),
x AS (SELECT *, length(key) + length(value) AS own, length('[' || i || '].') AS path FROM l WHERE value IS NOT NULL),
d AS (SELECT conv_id, i, count(*) AS n, sum(own) AS own, sum(own + path) AS whole, sum(own + path + 2) + count(*) - 1 AS chars FROM x GROUP BY ALL),
c AS (SELECT conv_id, sum(n) <= 25 AND sum(whole) <= 1200 AS fits, sum(chars + 1) - 1 AS chars FROM d GROUP BY conv_id),
p AS (SELECT conv_id, 0 AS i, 1 AS part, 'conv' || conv_id AS name, chars FROM c WHERE fits
  UNION ALL SELECT conv_id, i, 1, '[' || i || ']', d.chars FROM d JOIN c USING (conv_id) WHERE NOT fits AND own <= 1200
  UNION ALL SELECT conv_id, i, part, '[' || i || ']#' || part, chars FROM (
    SELECT conv_id, i, CASE WHEN key = 'text' THEN 2 ELSE 1 END AS part, sum(x.own + path + 2) + count(*) - 1 AS chars
    FROM x JOIN c USING (conv_id) JOIN (SELECT conv_id, i FROM d WHERE own > 1200) USING (conv_id, i) WHERE NOT fits GROUP BY ALL))
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY i, part) - 1)::INT AS ord, name, 1::INT AS start_line, chars::INT AS n_chars FROM p"""


@register("""WITH RECURSIVE e AS (SELECT user_id, 'e' || event_id AS key, repeat(event_type || ' ', (event_id % 9 * 6)::INT) AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
n AS (SELECT user_id, count(*) AS n, sum(length(key) + length(value)) AS chars FROM e GROUP BY user_id),
r AS (SELECT user_id, i, 1 AS part, 1 AS held, length(key) + length(value) AS chars FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, CASE WHEN held = 25 OR r.chars + length(key) + length(value) > 1200 THEN part + 1 ELSE part END, CASE WHEN held = 25 OR r.chars + length(key) + length(value) > 1200 THEN 1 ELSE held + 1 END,
    CASE WHEN held = 25 OR r.chars + length(key) + length(value) > 1200 THEN 0 ELSE r.chars END + length(key) + length(value) FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1),
g AS (SELECT user_id, part, min(i) AS first, string_agg(key || ': ' || value, chr(10) ORDER BY i) AS text FROM r JOIN e USING (user_id, i) JOIN n USING (user_id) WHERE n.n > 25 OR n.chars > 1200 GROUP BY ALL)
SELECT user_id, 'u' || user_id || '#' || part AS name, (first + 1)::INT AS start_line, text FROM g
UNION ALL SELECT user_id, 'u' || user_id, 2, string_agg(key || ': ' || value, chr(10) ORDER BY i) FROM e JOIN n USING (user_id) WHERE n.n <= 25 AND n.chars <= 1200 GROUP BY user_id""")
def json_budget_flat(spark, sf_dir):
    """Chunks of each user's events as one flat JSON object, a line for each key."""
    value = F.expr("repeat(event_type || ' ', cast(event_id % 9 * 6 AS int))")
    line = F.concat(F.lit('"e'), F.col("event_id"), F.lit('": "'), value, F.lit('"'))
    rows = read(spark, sf_dir, "events").select("user_id", F.struct("event_id", line.alias("line")).alias("x"))
    lines = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"])
    files = rows.groupBy("user_id").agg(F.concat(F.lit("{\n"), F.array_join(lines, ",\n"), F.lit("\n}")).alias("content"))
    return with_chunks(files.withColumn("stem", F.concat(F.lit("u"), F.col("user_id"))), "content", "stem").select("user_id", "name", "start_line", "text")


# ---- graph, upserts, patterns, vectors -----------------------------------------------------


def _tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import edges between files: those of an order's customer's nation import those of its supplier."""
    lines, orders = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("o_custkey % 7 < l_suppkey % 10 OR o_custkey % 11 = 0")
    customer, supplier = F.col("o_custkey"), F.col("l_suppkey")
    source = F.when(customer % 11 == 0, F.concat(F.lit("run"), customer, F.when(customer % 2 == 0, ".py").otherwise(".rs"))).otherwise(F.concat(F.lit("m"), customer % 7, F.lit("/src/c"), customer, F.lit(".py")))
    return rows.select(source.alias("source_file"), F.concat(F.lit("m"), supplier % 10, F.lit("/src/s"), supplier, F.lit(".py")).alias("target_file"))


_TREE = """e AS (SELECT DISTINCT CASE WHEN o_custkey % 11 = 0 THEN 'run' || o_custkey || CASE WHEN o_custkey % 2 = 0 THEN '.py' ELSE '.rs' END ELSE 'm' || o_custkey % 7 || '/src' END AS s, 'm' || l_suppkey % 10 || '/src' AS t
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 7 < l_suppkey % 10 OR o_custkey % 11 = 0)"""


@register(f"""WITH {_TREE}, b AS (SELECT * FROM e WHERE s <> t), i AS (SELECT t AS module, string_agg(s, ',' ORDER BY s) AS l FROM b GROUP BY 1), o AS (SELECT s AS module, string_agg(t, ',' ORDER BY t) AS l FROM b GROUP BY 1)
SELECT coalesce(i.module, o.module) AS module, CASE WHEN o.l IS NULL THEN 'foundation' WHEN i.l IS NULL THEN 'extension' ELSE 'application' END AS role, coalesce(i.l, '') AS imported_by, coalesce(o.l, '') AS imports_from FROM i FULL JOIN o USING (module)""")
def module_graph(spark, sf_dir):
    """Roles of modules from edges between files, two directories being a module."""
    found = graph.module_graph(_tree_edges(spark, sf_dir), 2)
    return found.select("module", "role", F.array_join("imported_by", ",").alias("imported_by"), F.array_join("imports_from", ",").alias("imports_from"))


@register(f"WITH {_TREE} SELECT s AS entry, string_agg(t, ',' ORDER BY t) AS modules FROM e WHERE s LIKE 'run%.py' GROUP BY s HAVING count(*) > 1")
def entry_points(spark, sf_dir):
    """Python files at the root that import more than one module."""
    return graph.entry_points(_tree_edges(spark, sf_dir), 2).select("entry", F.array_join("modules", ",").alias("modules"))


@register("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, 'X', o_totalprice + 1 FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT -1 - o_orderkey, 'N', 0 FROM orders WHERE o_orderkey % 7 = 0""")
def upsert_rows(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changed = rows.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    new = rows.where("o_orderkey % 7 = 0").select((-1 - F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.lit(0.0).alias("o_totalprice"))
    return maintenance.upsert(rows, changed.unionByName(new), ["o_orderkey"])


@register(r"""WITH n AS (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN '_' WHEN 1 THEN '%' WHEN 2 THEN chr(92) ELSE 'x' END || p_partkey % 3 AS name FROM part)
SELECT p_partkey, replace(replace(replace(name, chr(92), chr(92) || chr(92)), '%', chr(92) || '%'), '_', chr(92) || '_') AS pattern, true AS itself, p_partkey % 4 = 3 AS other FROM n""")
def like_escaped(spark, sf_dir):
    """LIKE patterns that match their own name, and none with another character in a wildcard's place."""
    mark = F.expr(r"CASE p_partkey % 4 WHEN 0 THEN '_' WHEN 1 THEN '%' WHEN 2 THEN '\\' ELSE 'x' END")
    name = lambda c: F.concat(F.col("p_name"), c, (F.col("p_partkey") % 3).cast("string"))
    rows = read(spark, sf_dir, "part").select("p_partkey", name(mark).alias("name"), name(F.lit("x")).alias("plain"))
    rows = rows.withColumn("pattern", escape_like(F.col("name")))
    return rows.select("p_partkey", "pattern", F.expr("name LIKE pattern").alias("itself"), F.expr("plain LIKE pattern").alias("other"))


@register("""WITH w AS (SELECT p_partkey, md5(unnest(string_split(lower(p_name || ' ' || p_type || ' ' || p_partkey), ' '))) AS h FROM part),
d AS (SELECT p_partkey, ('0x' || substr(h, 15, 2))::INT % 64 AS i, CASE WHEN substr(h, 1, 1) >= '8' THEN 1 ELSE -1 END AS s FROM w),
v AS (SELECT p_partkey, i, sum(s) AS s FROM d GROUP BY ALL)
SELECT p_partkey, i::INT AS dim, (CASE WHEN s > 0 THEN 1 ELSE -1 END)::INT AS sign, round(100 * s * s / sum(s * s) OVER (PARTITION BY p_partkey), 2) AS share FROM v WHERE s <> 0""")
def hashed_embeddings(spark, sf_dir):
    """The built-in embedder's vectors: the sign and the share of the squared length of each part that isn't 0."""
    text = F.concat_ws(" ", "p_name", "p_type", F.col("p_partkey").cast("string"))
    rows = embed(spread(read(spark, sf_dir, "part").select("p_partkey", text.alias("text"))))
    each = rows.select("p_partkey", F.posexplode("embedding").alias("dim", "x")).where("x <> 0")
    x = F.col("x").cast("double")
    return each.select("p_partkey", "dim", F.signum("x").cast("int").alias("sign"), F.round(100 * x * x, 2).alias("share"))


__all__ = ["ORACLE_SQL", "QUERIES"]
