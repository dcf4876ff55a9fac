"""Items of Python files, from the standard library's parser; broken files by their indentation."""

from __future__ import annotations

import ast
import io
import re
import tokenize

from lodestone.sources.items import CLASS, COMMENT, DATA, FUNCTION, OTHER, SKIPPED, Item

_HEAD = re.compile(r"(?:async\s+)?(def|class)\s+(\w+)")
_BOUND = re.compile(r"(\w+)\s*(?::[^=\n]*)?(?:[-+*/%&|^@]|//|\*\*|<<|>>)?=(?!=)")


class _Offsets:
    """Offsets of (line, column in bytes) places."""

    def __init__(self, text: str) -> None:
        self.lines = text.splitlines(keepends=True) or [""]
        self.starts, at = [], 0
        for line in self.lines:
            self.starts.append(at)
            at += len(line)

    def at(self, line: int, column: int) -> int:
        text = self.lines[line - 1]
        return self.starts[line - 1] + (column if text.isascii() else len(text.encode()[:column].decode(errors="ignore")))


def _name(node: ast.stmt) -> str | None:
    if isinstance(node, ast.Assign) and isinstance(node.targets[0], ast.Name):
        return node.targets[0].id
    if isinstance(node, (ast.AnnAssign, ast.AugAssign)) and isinstance(node.target, ast.Name):
        return node.target.id
    return None


def _item(node: ast.stmt, offsets: _Offsets) -> Item:
    first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
    column = node.col_offset if first == node.lineno else 0
    start = offsets.at(first, column)
    if first != node.lineno:
        line = offsets.lines[first - 1]
        start += len(line) - len(line.lstrip())
    end = offsets.at(node.end_lineno, node.end_col_offset)
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
        return Item(FUNCTION, start, end, node.name)
    if isinstance(node, ast.ClassDef):
        children = [_item(x, offsets) for x in node.body]
        return Item(CLASS, start, end, node.name, children[0].start, children)
    if isinstance(node, (ast.Import, ast.ImportFrom)):
        return Item(SKIPPED, start, end)
    if isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign, ast.Expr, ast.With, ast.AsyncWith)):
        return Item(DATA, start, end, _name(node))
    return Item(OTHER, start, end)


def _with_comments(items: list[Item], comments: list[Item], start: int, end: int) -> list[Item]:
    """Items and the comments between them, in order; comments inside an item go to it if it is a class."""
    own = [c for c in comments if start <= c.start < end and not any(i.start <= c.start < i.end for i in items)]
    for item in items:
        if item.kind == CLASS:
            item.children = _with_comments(item.children, comments, item.start, item.end)
            item.body = min([item.body, *(c.start for c in item.children if c.kind == COMMENT and c.start > item.start)])
    return sorted([*items, *own], key=lambda x: x.start)


def items_of(text: str) -> list[Item]:
    text_lf = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
    if text_lf != text:
        text = text_lf
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return _by_indentation(text)
    offsets = _Offsets(text)
    comments = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                a = offsets.starts[t.start[0] - 1] + t.start[1]
                comments.append(Item(COMMENT, a, a + len(t.string)))
    except (tokenize.TokenError, IndentationError):
        pass
    return _with_comments([_item(n, offsets) for n in tree.body], comments, 0, len(text) + 1)


def _by_indentation(text: str, base: int = 0, indent: int = 0) -> list[Item]:
    """Statements of a file that doesn't parse: each line at ``indent``, with the deeper lines under it."""
    starts, at = [], 0
    for line in text.splitlines(keepends=True):
        body = line.lstrip()
        if body.strip() and len(line) - len(body) <= indent and not body.startswith((")", "]", "}")):
            starts.append(at + len(line) - len(body))
        at += len(line)
    out: list[Item] = []
    pending: int | None = None
    for a, b in zip(starts, [*starts[1:], len(text)], strict=True):
        whole = text[a:b].rstrip()
        start = a if pending is None else pending
        end = a + len(whole)
        if whole.startswith("@"):
            pending = start
            continue
        pending = None
        head = _HEAD.match(whole)
        if whole.startswith("#"):
            out.append(Item(COMMENT, base + a, base + a + len(whole.split("\n")[0])))
        elif head and head[1] == "def":
            out.append(Item(FUNCTION, base + start, base + end, head[2]))
        elif head:
            line_end = text.find("\n", a)
            rest = text[line_end + 1 : end] if 0 <= line_end < end else ""
            inner = len(rest) - len(rest.lstrip(" \t")) if rest else 0
            children = _by_indentation(rest, base + line_end + 1, inner) if rest else []
            out.append(Item(CLASS, base + start, base + end, head[2], children[0].start if children else base + end, children))
        elif re.match(r"(?:import|from)\b", whole):
            out.append(Item(SKIPPED, base + start, base + end))
        else:
            bound = _BOUND.match(whole)
            out.append(Item(DATA if bound or whole.startswith("with ") else OTHER, base + start, base + end, bound[1] if bound else None))
    return out
