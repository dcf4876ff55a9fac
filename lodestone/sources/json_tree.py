"""JSON as a source: flat leaves for literal search, and chunks of bounded size for embedding.

Key order matters, so the text is parsed in a Python UDTF; each row is parsed
by itself, so any number of files streams through.

A tree is flattened once, into its leaves in order and its containers with the
range of leaves each holds.  Running sums over the leaves give every container's
size by a subtraction; what becomes a chunk is then decided for each leaf by
itself: all leaves of the outermost container that fits the budgets go together,
and the others are runs under one container, cut where a budget is full.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed budgets of a chunk.
LEAF_BUDGET, CHAR_BUDGET = 25, 1200

Leaf = tuple[str, str]


@dataclass
class Container:
    """``path``: of the container; ``joint``: characters between its path and those of its members; ``first``, ``end``: the leaves in it; ``parent``: its number, -1 for none."""

    path: str
    joint: int
    parent: int
    first: int
    end: int = 0


def flatten(tree: object) -> tuple[list[Leaf], list[int], list[Container]]:
    """All scalars in order as (path, value): ``a.b``, ``a[0]``, null being empty and others as Python prints them; the container of each; all containers, outer ones first."""
    found: list[Leaf] = []
    homes: list[int] = []
    boxes: list[Container] = []
    todo: list[tuple[str, object, int]] = [("", tree, -1)]
    while todo:
        path, node, home = todo.pop()
        if home >= 0 and node is boxes[home]:  # all in it is done
            node.end = len(found)
        elif isinstance(node, (dict, list)):
            named = isinstance(node, dict)
            dot = "." if path and named else ""
            box = Container(path, len(dot), home, len(found))
            boxes.append(box)
            me = len(boxes) - 1
            todo.append((path, box, me))
            members = [(f"{path}{dot}{k}", v, me) for k, v in node.items()] if named else [(f"{path}[{i}]", v, me) for i, v in enumerate(node)]
            todo.extend(members[::-1])
        else:
            found.append((path, "" if node is None else str(node)))
            homes.append(home)
    return found, homes, boxes


def leaves(tree: object) -> Iterator[Leaf]:
    yield from flatten(tree)[0]


def _filled(run: list[Leaf], leaf_budget: int, char_budget: int) -> Iterator[list[Leaf]]:
    """A run of leaves in parts within both budgets, one leaf at least."""
    part: list[Leaf] = []
    room = char_budget
    for leaf in run:
        size = len(leaf[0]) + len(leaf[1])
        if part and (len(part) == leaf_budget or size > room):
            yield part
            part, room = [], char_budget
        part.append(leaf)
        room -= size
    yield part


def cut_tree(tree: object, stem: str, leaf_budget: int = LEAF_BUDGET, char_budget: int = CHAR_BUDGET) -> list[tuple[str, list[Leaf]]]:
    """Chunks (name, leaves) within the budgets.

    A container is measured without the path that leads to it, a run of scalars
    with its whole paths.
    """
    found, homes, boxes = flatten(tree)
    upto = [0, *accumulate(len(p) + len(v) for p, v in found)]
    whole: list[int] = []  # for each container the outermost one around it that fits, itself included; -1 for none
    for number, box in enumerate(boxes):
        outer = whole[box.parent] if box.parent >= 0 else -1
        count = box.end - box.first
        chars = upto[box.end] - upto[box.first] - count * (len(box.path) + box.joint)
        fits = count <= leaf_budget and chars <= char_budget
        whole.append(outer if outer >= 0 else number if fits else -1)
    out: list[tuple[str, list[Leaf]]] = []
    parts: Counter[int] = Counter()
    for (home, outer), run in groupby(range(len(found)), lambda i: (-1, whole[homes[i]]) if homes[i] >= 0 and whole[homes[i]] >= 0 else (homes[i], -1)):
        rows = [found[i] for i in run]
        if outer >= 0 or home < 0:
            out.append(((boxes[outer].path if outer >= 0 else "") or stem, rows))
            continue
        for part in _filled(rows, leaf_budget, char_budget):
            parts[home] += 1
            out.append((f"{boxes[home].path or stem}#{parts[home]}", part))
    return out


_QUOTED = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)


def chunk_rows(text: str, stem: str, leaf_budget: int = LEAF_BUDGET, char_budget: int = CHAR_BUDGET) -> Iterator[tuple[str, int, str]]:
    """(name, line, text) of each chunk.

    The line is where the last key of the chunk's first leaf is quoted next;
    places only go forward, and line 1 stands for a key that isn't there.
    """
    places: dict[str, list[int]] = defaultdict(list)
    for m in _QUOTED.finditer(text):
        places[m[1]].append(m.start())
    breaks = [m.start() for m in re.finditer("\n", text)]
    reached = 0
    for name, found in cut_tree(json.loads(text), stem, leaf_budget, char_budget):
        key = found[0][0].rpartition(".")[2].partition("[")[0]
        i = bisect_left(places[key], reached)
        line = 1
        if i < len(places[key]):
            at = places[key][i]
            reached, line = at + 1, bisect_left(breaks, at) + 1
        yield name, line, "\n".join(f"{p}: {v}" for p, v in found)


@F.udtf(returnType="ord int, key_path string, value string")
class JsonLeaves:
    """Leaves of one JSON text; a text that is no JSON has none."""

    def eval(self, text: str):
        try:
            tree = json.loads(text) if text is not None else {}
        except ValueError:
            return
        for i, (path, value) in enumerate(leaves(tree)):
            yield i, path, value


@F.udtf(returnType="ord int, name string, start_line int, text string")
class JsonChunks:
    """Chunks of one JSON text; a text that is no JSON has none."""

    def eval(self, text: str, stem: str):
        try:
            rows = list(chunk_rows(text, stem)) if text is not None else []
        except ValueError:
            return
        for i, (name, line, body) in enumerate(rows):
            yield i, name, line, body


def with_leaves(df: DataFrame, column: str) -> DataFrame:
    """A row for each leaf of ``column``: ``df``'s columns, ``ord``, ``key_path`` and ``value``."""
    return df.lateralJoin(JsonLeaves(F.col(column).outer()))


def with_chunks(df: DataFrame, column: str, stem: str) -> DataFrame:
    """A row for each chunk of ``column``: ``df``'s columns, ``ord``, ``name``, ``start_line``, ``text``; ``stem`` names whole files."""
    return df.lateralJoin(JsonChunks(F.col(column).outer(), F.col(stem).outer()))
