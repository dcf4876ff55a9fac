"""Path expressions: parts, layers, modules, exclusion.

Rules are lists of (name, directories, files); the first that matches wins.
Paths are relative to the project's root: directories above it have no say.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, Sequence[str], Sequence[str]]

#: What is source code, and directories that hold none of the project's own.
EXTENSIONS = (".py", ".js", ".jsx", ".ts", ".tsx", ".rs", ".c", ".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx", ".h")
EXCLUDED_DIRS = frozenset({".git", "__pycache__", "node_modules", "dist", "build", ".idea", ".venv", "venv", "site-packages", "target"})
MAX_FILE_BYTES = 200_000
DEFAULT_LAYER = "backend/other"


def parts(path: Column) -> Column:
    return F.split(path, "/")


def relative_to(root: str, path: str = "path") -> Column:
    """The path of a listed file relative to the folder that was listed."""
    base = root.rstrip("/").split(":", 1)[-1]
    behind = F.col(path).substr(F.instr(path, base) + len(base), F.length(path))
    return F.regexp_replace(behind, "^/+", "")


def basename(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def suffix(path: Column) -> Column:
    """Extension in lower case with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]+$", "")


def _matches(path: Column, rule: Rule) -> Column:
    _, dirs, files = rule
    lowered = F.lower(path)
    by_dir = F.arrays_overlap(parts(lowered), F.array(*[F.lit(d.lower()) for d in dirs])) if dirs else F.lit(False)
    return by_dir | basename(lowered).isin([f.lower() for f in files]) if files else by_dir


def _first_rule(path: Column, rules: Sequence[Rule]) -> Column | None:
    chain = None
    for rule in rules:
        chain = (F if chain is None else chain).when(_matches(path, rule), F.lit(rule[0]))
    return chain


def classify_layer(path: Column, rules: Sequence[Rule], default: str = DEFAULT_LAYER) -> Column:
    chain = _first_rule(path, rules)
    return F.lit(default) if chain is None else chain.otherwise(F.lit(default))


def classify_module(path: Column, depth: int = 1, rules: Sequence[Rule] = ()) -> Column:
    """The first rule's name, or else the leading ``depth`` directories; a lone file is its own module."""
    p = parts(path)
    leading = F.when(F.size(p) == 1, path).otherwise(F.array_join(F.slice(p, F.lit(1), F.least(F.lit(depth), F.size(p) - 1)), "/"))
    chain = _first_rule(path, rules)
    return leading if chain is None else chain.otherwise(leading)


def is_source(path: Column, size: Column, extra_excluded: Sequence[str] = (), forced: Sequence[str] = (), extensions: Sequence[str] = EXTENSIONS, max_bytes: int = MAX_FILE_BYTES) -> Column:
    """Whether a scan takes a file: its extension, size and directories.

    Names in ``extra_excluded`` apply anywhere, those with a slash from the root;
    ``forced`` takes names off the list.
    """
    names = sorted((EXCLUDED_DIRS | {e for e in extra_excluded if "/" not in e}) - set(forced))
    kept = suffix(path).isin(list(extensions)) & (size <= max_bytes) & ~F.endswith(path, F.lit(".min.js"))
    kept &= ~F.arrays_overlap(parts(path), F.array(*[F.lit(n) for n in names]))
    for prefix in (e.strip("/") for e in extra_excluded if "/" in e):
        kept &= ~((path == prefix) | F.startswith(path, F.lit(prefix + "/")))
    return kept


def normalize_path(path: Column) -> Column:
    """``path`` without empty parts, ``.`` and ``..`` where it has something to go up from; ``.`` for nothing, null for null."""
    absolute = F.startswith(path, F.lit("/"))

    def step(kept: Column, part: Column) -> Column:
        up = (F.size(kept) > 0) & (F.try_element_at(kept, F.lit(-1)) != "..")
        above = F.when(up, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when(absolute, kept).otherwise(F.concat(kept, F.array(part)))
        return F.when(part.isin("", "."), kept).when(part == "..", above).otherwise(F.concat(kept, F.array(part)))

    kept = F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step)
    joined = F.concat(F.when(absolute, "/").otherwise(""), F.array_join(kept, "/"))
    return F.when(joined == "", ".").otherwise(joined)
