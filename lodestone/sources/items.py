"""Cutting source files into chunks, given their statements.

Language scanners turn a file into a tree of items with text offsets.  From
there three steps lead to chunks: ``parts_of`` gives every comment to a statement
or leaves it by itself, ``gathered`` puts data that lies close together into
groups, and each group is rendered by itself.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise

#: Kinds of items.  A field function is a member that holds a function; data is gathered into blocks; others are passed over.
FUNCTION, CLASS, FIELD_FUNCTION, DATA, COMMENT, SKIPPED, OTHER = "function", "class", "field function", "data", "comment", "skipped", "other"

ANONYMOUS = "<anonymous>"


@dataclass
class Item:
    """``start``, ``end``: offsets of the text; ``body``: where a class's body starts; ``children``: what it holds."""

    kind: str
    start: int
    end: int
    name: str | None = None
    body: int | None = None
    children: list[Item] = field(default_factory=list)


@dataclass(frozen=True)
class Chunk:
    start_line: int
    end_line: int
    node_type: str
    name: str
    text: str
    chunk_source_kind: str


class Source:
    """A file's text and its lines."""

    def __init__(self, text: str) -> None:
        self.text = text
        self._breaks = [m.end() for m in re.finditer("\n", text)]

    def line(self, offset: int) -> int:
        return bisect_right(self._breaks, offset) + 1

    def lines(self, item: Item) -> tuple[int, int]:
        """First and last line."""
        return self.line(item.start), self.line(max(item.start, item.end - 1))

    def joined(self, items: Iterable[Item]) -> str:
        return "\n".join(self.text[x.start : x.end] for x in items)


@dataclass
class Part:
    """A statement with the comments right above it and, if it is data, the one that ends its line; or a comment that is nobody's."""

    item: Item
    above: list[Item]
    beside: Item | None = None

    @property
    def items(self) -> list[Item]:
        return [*self.above, self.item, *([self.beside] if self.beside else [])]


def parts_of(source: Source, items: list[Item]) -> list[Part]:
    """All items of one level, each in one part, in their order.

    A comment that starts on the line where the item before it ends is not about
    what follows, and neither are those before it.
    """
    out: list[Part] = []
    open_: list[Item] = []  # comments that may be about the next statement

    def loose() -> None:
        out.extend(Part(c, []) for c in open_)
        open_.clear()

    for before, item in pairwise([None, *items]):
        if item.kind != COMMENT:
            out.append(Part(item, list(open_)))
            open_.clear()
        elif before is None or source.lines(before)[1] != source.lines(item)[0]:
            open_.append(item)
        else:
            loose()
            if before.kind == DATA:
                out[-1].beside = item
            else:
                out.append(Part(item, []))
    loose()
    return out


def gathered(source: Source, parts: Iterable[Part]) -> list[list[Part]]:
    """Statements in groups: data with fewer than two lines from one to the next, every other one alone; what makes no chunk is left out and parts nothing."""
    out: list[list[Part]] = []
    for part in parts:
        if part.item.kind in (COMMENT, SKIPPED, OTHER):
            continue
        last = out[-1][-1] if out else None
        close = last is not None and last.item.kind == part.item.kind == DATA and source.lines(part.items[0])[0] - source.lines(last.items[-1])[1] < 2
        if close:
            out[-1].append(part)
        else:
            out.append([part])
    return out


def _block(source: Source, group: list[Part], unnamed: str) -> Chunk:
    texts = [source.joined(p.items[: len(p.above) + 1]) + (f"  {source.joined([p.beside])}" if p.beside else "") for p in group]
    first, last = source.lines(group[0].items[0])[0], source.lines(group[-1].items[-1])[1]
    return Chunk(first, last, "block", group[0].item.name or unnamed, "\n".join(texts), "top_level_assignment_group")


def _function(source: Source, part: Part, kind: str, name: str) -> Chunk:
    return Chunk(source.lines(part.items[0])[0], source.lines(part.item)[1], kind, name, source.joined(part.items), "function")


def _class(source: Source, part: Part, name: str) -> Iterator[Chunk]:
    """The class's head with its plain members, then its methods, then the classes in it; nothing for a class without a body."""
    item = part.item
    if item.body is None:
        return
    members = parts_of(source, item.children)
    plain = [x for p in members if p.item.kind not in (FUNCTION, FIELD_FUNCTION, CLASS) for x in p.items]
    head = [source.joined([c]) for c in part.above] + [source.text[item.start : item.body].rstrip()] + [source.joined([x]) for x in plain]
    yield Chunk(source.lines(part.items[0])[0], source.lines(item)[1], "class", name, "\n".join(head).rstrip() + "\n", "class")
    inner = lambda p: f"{name}.{p.item.name or ANONYMOUS}"
    yield from (_function(source, p, "method", inner(p)) for p in members if p.item.kind in (FUNCTION, FIELD_FUNCTION))
    for p in members:
        if p.item.kind == CLASS:
            yield from _class(source, p, inner(p))


def chunks(text: str, items: list[Item], stem: str) -> list[Chunk]:
    """The chunks of a file in the order of their items."""
    source, out = Source(text), []
    for group in gathered(source, parts_of(source, items)):
        part = group[0]
        if part.item.kind == DATA:
            out.append(_block(source, group, f"{stem}#{len(out) + 1}"))
        elif part.item.kind == CLASS:
            out.extend(_class(source, part, part.item.name or ANONYMOUS))
        else:
            out.append(_function(source, part, "function", part.item.name or ANONYMOUS))
    return out
