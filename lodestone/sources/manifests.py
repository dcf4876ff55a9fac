"""Build manifests as sources: crates and binaries of Cargo.toml, targets of CMakeLists.txt."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import basename

#: A word and the bracket that makes a call of it; what a call is made of; what parts its arguments.
_OPENED = re.compile(r"(\w+)\s*\(")
_PIECE = re.compile(r"#[^\n]*|[()]|[^#()]+")
_SPLIT = re.compile(r'"[^"]*"|\S+')
#: Fixed values of the build language: the calls that define a target, the words in
#: them that name no source, and the characters of what only running it would resolve.
CALLS = frozenset({"add_library", "add_executable"})
KEYWORDS = frozenset({"STATIC", "SHARED", "MODULE", "OBJECT", "UNKNOWN", "ALIAS", "IMPORTED", "GLOBAL", "EXCLUDE_FROM_ALL", "INTERFACE", "WIN32", "MACOSX_BUNDLE"})
UNRESOLVED, GENERATED = frozenset("${}<>"), "$<"


def _arguments(text: str, at: int) -> list[str]:
    """The arguments of the call whose bracket stands before ``at``, without comments and quotes; none if it never closes."""
    inside, depth = "", 1
    for piece in _PIECE.finditer(text, at):
        if piece[0].startswith("#"):
            continue
        depth += {"(": 1, ")": -1}.get(piece[0], 0)
        if depth == 0:
            words = _SPLIT.findall(inside)
            return [w[1:-1] if w[0] == w[-1] == '"' and len(w) > 1 else w for w in words]
        inside += piece[0]
    return []


def _role(argument: str) -> str:
    """What an argument says of the target: a keyword, one source more that isn't known, an unknown number of them, or a file."""
    if argument in KEYWORDS:
        return "keyword"
    if GENERATED in argument:
        return "one more"
    return "unknown" if UNRESOLVED & set(argument) else "file"


def cmake_targets(text: str) -> Iterator[tuple[str, list[str]]]:
    """(target, sources as written) of calls that can be read without running CMake; a call with an unknown number of sources says nothing reliable."""
    for call in _OPENED.finditer(text):
        name, *rest = (_arguments(text, call.end()) if call[1].lower() in CALLS else []) or [""]
        roles = {a: _role(a) for a in rest}
        if name and not UNRESOLVED & set(name) and "unknown" not in roles.values():
            yield name, [a for a in rest if roles[a] == "file"]


@F.udtf(returnType="target string, source string")
class CMakeSources:
    def eval(self, content: str):
        for target, sources in cmake_targets(content or ""):
            for source in sources:
                yield target, source


@F.udtf(returnType="crate string, bin string, file string")
class CargoTargets:
    """A row for the package, and one for each binary with the name of its file."""

    def eval(self, content: str):
        try:
            data = tomllib.loads(content or "")
        except tomllib.TOMLDecodeError:
            return
        yield data.get("package", {}).get("name"), None, None
        for b in data.get("bin", []):
            if b.get("name"):
                yield data.get("package", {}).get("name"), b["name"], (b.get("path") or f"{b['name']}.rs").rsplit("/", 1)[-1]


def cargo_targets(manifests: DataFrame) -> DataFrame:
    """(path, crate, bin, file) of manifests (path, content)."""
    return manifests.lateralJoin(CargoTargets(F.col("content").outer())).drop("content")


def cmake_modules(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """(target, sources): names of the existing sources of each target, of all manifests together, sorted."""
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    named = manifests.withColumn("folder", folder).lateralJoin(CMakeSources(F.col("content").outer()))
    there = named.select("target", F.concat_ws("/", F.when(F.col("folder") != "", F.col("folder")), "source").alias("path")).join(files.select("path"), "path", "left_semi")
    return there.groupBy("target").agg(F.array_sort(F.collect_set(basename(F.col("path")))).alias("sources"))
