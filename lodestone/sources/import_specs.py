"""What files import: specifiers parsed in a UDTF, then resolved to files by joins.

A specifier comes with candidate paths in order of preference; which of them
exist is asked of the whole table of files at once.  What can't be resolved
gives no edge.
"""

from __future__ import annotations

import ast
import posixpath
import re
import tomllib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.operators.resolution import first_existing, longest_prefix, unique_by
from lodestone.shared import written
from lodestone.sources.scan_braces import C, CPP, JS, RUST, Scanner

JS_ENDINGS = (".ts", ".tsx", ".js", ".jsx")
C_FAMILY = (".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx")

#: A specifier: label as written, candidate paths, names that may be modules of the package found, basename looked up at last, segments of a Rust path.
Spec = tuple[str, list[str], list[str], str | None, list[str] | None]


def _joined(*parts: str) -> str:
    return posixpath.normpath(posixpath.join(*parts))


def _dotted(parts: list[str], base: str) -> list[str]:
    """Where a dotted name may lie: the shortest prefix that is a file, then the package."""
    files = [_joined(base, *parts[: i + 1]) + ".py" for i in range(len(parts))]
    return [*files, _joined(base, *parts, "__init__.py")]


def _runtime(node: ast.AST) -> Iterator[ast.AST]:
    """Imports that can run: those under ``if TYPE_CHECKING`` can't."""
    if isinstance(node, (ast.Import, ast.ImportFrom)):
        yield node
    children = ast.iter_child_nodes(node)
    if isinstance(node, ast.If):
        said = ast.unparse(node.test)
        if said == "TYPE_CHECKING" or said.endswith(".TYPE_CHECKING"):
            children = iter(node.orelse)
    for child in children:
        yield from _runtime(child)


_IMPORT_LINE = re.compile(r"^([ \t]*)((?:import|from)\b(?:[^\n(#\\]|\\\n|\([^()]*\))*)", re.M)
_TYPING_LINE = re.compile(r"^([ \t]*)(?:if\s+(?:\w+\.)*TYPE_CHECKING\s*:|\S)", re.M)


def _imports_of_broken(text: str) -> Iterator[ast.AST]:
    """Imports of a file that doesn't parse: statements that do by themselves, but for those under ``if TYPE_CHECKING``."""
    for m in _IMPORT_LINE.finditer(text):
        # the nearest line before it that is less indented holds it
        depth = len(m[1])
        if depth:
            around = [x for x in _TYPING_LINE.finditer(text, 0, m.start()) if len(x[1]) < depth]
            if around and around[-1][0].rstrip().endswith(":"):
                continue
        try:
            yield ast.parse(m[2].strip()).body[0]
        except (SyntaxError, IndexError):
            continue


def python_specs(path: str, text: str, root_name: str = "") -> Iterator[Spec]:
    """``root_name``: the name of the project's directory, which may be the package's own."""
    try:
        nodes = _runtime(ast.parse(text))
    except (SyntaxError, ValueError):
        nodes = _imports_of_broken(text)
    for node in nodes:
        if isinstance(node, ast.Import):
            for alias in node.names:
                parts = alias.name.split(".")
                yield alias.name, _absolute(parts, root_name), [], None, None
            continue
        names = [a.name for a in node.names if a.name != "*"]
        parts = node.module.split(".") if node.module else []
        label = "." * node.level + ".".join(parts)
        if not node.level:
            yield label, _absolute(parts, root_name), names, None, None
            continue
        base = posixpath.dirname(path)
        for _ in range(node.level - 1):
            base = posixpath.dirname(base)
        yield label, _dotted(parts, base), names, None, None


def _absolute(parts: list[str], root_name: str) -> list[str]:
    own = _dotted(parts[1:], "") if root_name and parts[0] == root_name else []
    return _dotted(parts, "") + own



def js_specs(path: str, text: str) -> Iterator[Spec]:
    scanner = Scanner(text, JS)
    for m in re.finditer(r"\b(?:import|export)\b[^;()\"]*?\"|\brequire\s*\(\s*\"", scanner.mask):
        head = m[0]
        if head.startswith("export") and not re.search(r"\bfrom\s*\"$", head) or head.startswith("import") and not re.search(r"(?:\bfrom\s*|^import\s*)\"$", head):
            continue
        at = m.end() - 1
        end = scanner.mask.find('"', at + 1)
        name = text[at + 1 : end]
        if name.startswith("."):
            base = _joined(posixpath.dirname(path), name)
            yield name, [base, *(base + e for e in JS_ENDINGS), *(f"{base}/index{e}" for e in JS_ENDINGS)], [], None, None


def c_specs(path: str, text: str) -> Iterator[Spec]:
    scanner = Scanner(text, CPP if not path.endswith(".c") else C)
    for m in re.finditer(r"^[ \t]*#[ \t]*include[ \t]*\"", scanner.mask, re.M):
        name = text[m.end() : text.find('"', m.end())]
        yield name, [_joined(posixpath.dirname(path), name)], [], posixpath.basename(name), None


def use_paths(tree: str) -> list[list[str]]:
    """All paths of a Rust use tree: groups are spread out, aliases dropped, ``*`` and ``self`` stand for what they are in."""
    tree = re.sub(r"\s+as\s+\w+", "", tree.strip())
    tokens = re.findall(r"[\w#]+|::|[{},*]", tree)
    at = 0

    def one() -> list[list[str]]:
        nonlocal at
        found: list[str] = []
        while at < len(tokens) and tokens[at] not in (",", "}"):
            token = tokens[at]
            at += 1
            if token == "{":
                tails = []
                while at < len(tokens) and tokens[at] != "}":
                    tails += one()
                    if at < len(tokens) and tokens[at] == ",":
                        at += 1
                at += 1
                return [found if t == ["self"] and found else found + t for t in tails]
            if token not in ("::", "*"):
                found.append(token)
        return [found] if found else []

    return one()


def rust_specs(path: str, text: str) -> Iterator[Spec]:
    for m in re.finditer(r"\buse\s+([^;]+);", Scanner(text, RUST).mask):
        for segments in use_paths(m[1]):
            yield "::".join(segments), [], [], None, segments


def rust_mods(text: str) -> Iterator[tuple[list[str], bool]]:
    """Modules a file declares: their path in the file, and whether their text is elsewhere."""
    stack: list[str | None] = []
    for m in re.finditer(r"\bmod\s+(\w+)\s*([;{])|[{}]", Scanner(text, RUST).mask):
        if m[1]:
            if all(stack):
                yield [*stack, m[1]], m[2] == ";"
            if m[2] == "{":
                stack.append(m[1])
        elif m[0] == "{":
            stack.append(None)
        elif stack:
            stack.pop()


def specs_of(path: str, text: str, root_name: str = "") -> Iterator[Spec]:
    suffix, text = posixpath.splitext(path)[1].lower(), text.removeprefix("\ufeff")
    if suffix == ".py":
        yield from python_specs(path, text, root_name)
    elif suffix in JS_ENDINGS:
        yield from js_specs(path, text)
    elif suffix == ".rs":
        yield from rust_specs(path, text)
    elif suffix in C_FAMILY:
        yield from c_specs(path, text)


@F.udtf(returnType="ord int, label string, candidates array<string>, names array<string>, basename string, segments array<string>")
class ImportSpecs:
    """The specifiers of one file; a file that can't be parsed has none."""

    def eval(self, path: str, content: str, root_name: str):
        try:
            found = list(specs_of(path, content or "", root_name or ""))
        except (SyntaxError, ValueError, RecursionError):
            return
        yield from ((i, *s) for i, s in enumerate(found))


@F.udtf(returnType="inner array<string>, elsewhere boolean")
class RustMods:
    def eval(self, content: str):
        yield from rust_mods(content or "")


@F.udtf(returnType="crate string, root string, lib boolean")
class CrateRoots:
    """Where the crates of one manifest begin: its library and its binaries, src/main.rs if none are listed."""

    def eval(self, path: str, content: str):
        try:
            data = tomllib.loads(content or "")
        except tomllib.TOMLDecodeError:
            return
        name, base = data.get("package", {}).get("name"), posixpath.dirname(path)
        if not name:
            return
        crate = name.replace("-", "_")
        yield crate, _joined(base, data.get("lib", {}).get("path", "src/lib.rs")), True
        bins = [b.get("path") or f"src/bin/{b['name']}.rs" for b in data.get("bin", []) if b.get("name")] if data.get("bin") else ["src/main.rs"]
        for b in bins:
            yield crate, _joined(base, b), False


def _declarations(files: DataFrame) -> DataFrame:
    """(file, is_root, inner, target): the modules each Rust file declares and the files they lie in, as the root of a tree or not; those in the file itself have it as target, those that lie nowhere none."""
    rust = files.where(F.endswith("path", F.lit(".rs")))
    mods = rust.select(F.col("path").alias("file"), "content").lateralJoin(RustMods(F.col("content").outer())).drop("content")
    mods = mods.withColumn("is_root", F.explode(F.array(F.lit(True), F.lit(False))))
    host = F.regexp_replace("file", r"/?[^/]*$", "")
    stem = F.regexp_replace("file", r"\.rs$", "")
    flat = F.col("is_root") | F.endswith("file", F.lit("mod.rs"))
    folder = F.concat_ws("/", F.when(flat, F.when(host != "", host)).otherwise(stem), F.when(F.size("inner") > 1, F.array_join(F.slice("inner", F.lit(1), F.size("inner") - 1), "/")), F.element_at("inner", -1))
    away = mods.where("elsewhere").withColumn("candidates", F.array(F.concat(folder, F.lit(".rs")), F.concat(folder, F.lit("/mod.rs"))))
    found = first_existing(away, rust, keys=("file", "is_root", "inner"))
    return mods.where("NOT elsewhere").select("file", "is_root", "inner", F.col("file").alias("target")).unionByName(found)


#: Each module file of a crate by the declarations that lead to it; a file that lies on its own way isn't entered again.
_MODULE_TREES = """
WITH RECURSIVE reached (tree, crate, lib, module, file, is_root, way) MAX RECURSION LEVEL {levels} AS (
  SELECT tree, crate, lib, CAST(array() AS array<string>), tree, true, array(tree) FROM {roots}
  UNION ALL
  SELECT tree, crate, lib, concat(module, inner), target, false, concat(way, array(target))
  FROM reached JOIN {declared} d ON d.file = reached.file AND d.is_root = reached.is_root
  WHERE NOT array_contains(way, target))
SELECT DISTINCT tree, crate, lib, module, file, is_root FROM reached
"""
#: How deep modules may be nested in files.
MODULE_LEVELS = 1000


def rust_modules(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """(tree, crate, lib, module, file): the modules of all crates.

    Where a declaration leads is looked up once, for all files; a recursive query
    follows the declarations from the crates' roots.  A file that several
    declarations of a tree lead to is the module that is nested least.
    """
    spark = files.sparkSession
    # the query ends by itself; the bound on its rows is meant for those that don't
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    roots = manifests.lateralJoin(CrateRoots(F.col("path").outer(), F.col("content").outer())).join(files.select(F.col("path").alias("root")), "root")
    roots = roots.select(F.col("root").alias("tree"), "crate", "lib").distinct()
    declared = _declarations(files)
    # read several times, and the query runs a job for each level
    reached = written(spark.sql(_MODULE_TREES, roots=roots, declared=declared.where("target <> file"), levels=MODULE_LEVELS), "rust-modules")
    depth = F.size("module")
    first = reached.withColumn("_least", F.min(depth).over(W.partitionBy("tree", "file"))).where(depth == F.col("_least")).drop("_least")
    here = first.join(declared.where("target = file"), ["file", "is_root"]).select("tree", "crate", "lib", F.concat("module", "inner").alias("module"), "file")
    return first.select("tree", "crate", "lib", "module", "file").unionByName(here)


def _rust_edges(specs: DataFrame, files: DataFrame, manifests: DataFrame) -> DataFrame:
    modules = rust_modules(files, manifests)
    w = W.partitionBy("file").orderBy(F.desc("lib"), "tree", F.size("module"))
    own = modules.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(F.col("file").alias("source"), F.col("tree").alias("own_tree"), F.col("module").alias("own_module"))
    libs = modules.where("lib").select("crate", F.col("tree").alias("lib_tree")).groupBy("crate").agg(F.max("lib_tree").alias("lib_tree"))
    head, rest = F.col("segments")[0], F.slice("segments", F.lit(2), F.size("segments"))
    joined = specs.withColumn("head", head).join(own, "source", "left").join(libs, F.col("head") == F.col("crate"), "left")
    base = F.slice("own_module", F.lit(1), F.greatest(F.size("own_module") - 1, F.lit(0)))
    path = F.when(head == "crate", rest).when(head == "self", F.concat("own_module", rest)).when(head == "super", F.when(F.size("own_module") > 0, F.concat(base, rest))).when(F.col("lib_tree").isNotNull(), rest)
    tree = F.when(head.isin("crate", "self", "super"), F.col("own_tree")).otherwise(F.col("lib_tree"))
    asked = joined.select("source", "ord", "label", F.concat(F.array(tree), path).alias("segments")).where(F.col("segments").isNotNull() & F.col("segments")[0].isNotNull())
    known = modules.select(F.concat(F.array("tree"), "module").alias("prefix"), F.col("file").alias("value"))
    keyed = asked.withColumn("id", F.struct("source", "ord", "label"))
    return longest_prefix(keyed, known, "segments", "id").select("id.source", "id.ord", F.col("value").alias("target_file"), F.col("id.label").alias("module"))


def import_edges(files: DataFrame, manifests: DataFrame | None = None, root_name: str = "", only: DataFrame | None = None) -> DataFrame:
    """(source_file, target_file, module) of all files (path, content), or of those in ``only`` (path); ``manifests``: the Cargo.toml files, if there are any.

    Several imports of one file are several edges.
    """
    sources = files if only is None else files.join(only.select("path"), "path", "left_semi")
    specs = sources.select(F.col("path").alias("source"), "content").lateralJoin(ImportSpecs(F.col("source").outer(), F.col("content").outer(), F.lit(root_name))).drop("content")
    key = ("source", "ord", "label", "names", "basename")
    plain = specs.where(F.size("candidates") > 0)
    direct = first_existing(plain, files, keys=key)
    # a package stands for the first of the imported names that is a module of it
    base = F.regexp_replace("target", r"__init__\.py$", "")
    packages = direct.where(F.endswith("target", F.lit("__init__.py")) & (F.size("names") > 0))
    inner = F.flatten(F.transform("names", lambda n: F.array(F.concat(base, n, F.lit(".py")), F.concat(base, n, F.lit("/__init__.py")))))
    refined = first_existing(packages.withColumn("candidates", inner), files, keys=("source", "ord")).withColumnRenamed("target", "refined")
    direct = direct.join(refined, ["source", "ord"], "left").select("source", "ord", F.coalesce("refined", "target").alias("target_file"), F.col("label").alias("module"))
    # an include that isn't found where it points to may be the only file of that name
    missing = plain.where(F.col("basename").isNotNull()).join(direct.select("source", "ord"), ["source", "ord"], "left_anti")
    c_files = files.where(paths.suffix(F.col("path")).isin(list(C_FAMILY))).select("path")
    alone = unique_by(c_files, paths.basename(F.col("path")), "basename").withColumnRenamed("path", "target_file")
    edges = direct.unionByName(missing.join(alone, "basename").select("source", "ord", "target_file", F.col("label").alias("module")))
    if manifests is not None and not manifests.isEmpty():
        edges = edges.unionByName(_rust_edges(specs.where("segments IS NOT NULL"), files, manifests))
    return edges.select(F.col("source").alias("source_file"), "target_file", "module")
