"""Main text of web pages by minimum-cut labelling.

A page falls into text blocks.  A linear classifier over markup, class names,
link density and length gives each block a bounded score, and so a cost of being
called content and one of being called boilerplate: the capacities of its edges
to the two terminals.  Neighbouring blocks, and blocks of the same container, are
tied by edges that weaken with their distance in the DOM and between blocks of
different kinds.  The minimum cut, found by max-flow, labels all blocks at once:
names and elements that say what they are decide by themselves, while short
lines, half-linked ones and others without a name go with their neighbours.

A class, id or role counts by its whole name or its head word (comment-list:
comment; post-footer: footer); inline elements with the name of boilerplate are
blocks of their own.

A name or a form around the whole page, or around its main part, says nothing
about the text in it: what they say counts only where enough text lies outside.

Blocks whose own costs outweigh all their ties keep their label in some minimum
cut; they are settled first and their ties handed on to their neighbours as
costs, so that max-flow runs on what is left only.

Cases: null, empty and markup-free pages (the latter are one block) have
defined texts; unclosed tags, comments and quotes are taken as browsers mostly
do; very long pages are read whole; an empty table gives an empty result;
repeated rows and further columns stay as they are, and a new column whose name
is taken gets underscores; blocks whose costs tie are boilerplate.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import fresh, sliced, table

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>""", re.S)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z][a-z])")
#: Names of a state or a topic, not of what an element is: has-sidebar, comments-open, tag-ads.
_STATE = re.compile(r"(?:has|no|with|without|is|not|tag|category)[-_].*|.*[-_](?:open|opened|closed|enabled|disabled|active|inactive|visible)")

#: Elements whose content is no text of the page.
RAW = frozenset("script style title noscript template svg math iframe object canvas textarea select option video audio".split())
#: Elements that open a block of their own.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("hr br".split())
#: What an element says about all text in it.
ELEMENTS = {"nav": -12.0, "footer": -12.0, "aside": -12.0, "form": -12.0, "menu": -12.0, "dialog": -12.0, "header": -8.0, "search": -12.0, "article": 5.0, "main": 3.0, "h1": 2.0, "fieldset": -8.0}
#: What a word in a class, id or role says.
NAMES = {
    **dict.fromkeys("ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted recommend recommended related reply replies search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget alert discussion discussions discuss guestbook respond responses feedback complementary contentinfo"
                  " kommentar kommentare commentaire commentaires comentario comentarios werbung anzeige anzeigen publicidad publicite anuncio anuncios seitenleiste".split(), -11.0),
    **dict.fromkeys("article content entry main post story body text".split(), 1.5),
}
#: Elements that may lie around a whole page: what they say is taken back there, as names are.
FORMS = frozenset(("form", "fieldset"))
#: Characters outside a container in blocks of so many that keep what the container's names say, or this share of those inside.
OUTSIDE, PROSE, OUTSIDE_SHARE = 200, 40, 0.5
#: Words of a name that say nothing about what an element is.
GENERIC = frozenset("area block box bar body button buttons col column container content inner item items layout line link links list outer page panel row section slot unit wrap wrapper zone".split())
#: What one word may join to the name it starts with: commentlist, adslot.
JOINED = GENERIC | frozenset("form thread holder region widget".split())
#: Inline elements that are taken for blocks if they have the name of boilerplate.
INLINE = frozenset("span small em strong b i u font ins del mark sup sub cite q abbr time data bdi bdo".split())
#: Scores end at this; what a block without a name must be worth on a page that has prose: PROSE_CHARS characters in one block.
LIMIT, BIAS, PROSE_CHARS = 4.0, 0.8, 140
#: Ties: of blocks next to each other, of blocks in one container; their share between blocks of different kinds.
ADJACENT, SIBLING, UNLIKE = 1.5, 1.2, 0.25
#: Containers that say this or less are boilerplate by name.
NAMED = -2.0


@dataclass
class Block:
    """``node``: the innermost container around the text, by number; ``said``: what the names of all of them say; ``tag``: the innermost."""

    text: str
    node: int
    said: float
    tag: str
    inside: bool
    linked: int
    cost_content: float = field(default=0.0)
    cost_boilerplate: float = field(default=0.0)


def _known(word: str) -> str:
    """The name of boilerplate that a word of two joined ones starts with, or the word itself."""
    if word in NAMES or word in GENERIC:
        return word
    return next((word[:i] for i in range(len(word) - 3, 1, -1) if word[i:] in JOINED and NAMES.get(word[:i], 0.0) < 0), word)


def _said_by(name: str) -> float:
    """What one class, id or role says: as a whole, or by its last word that means something; a content word behind one of boilerplate says nothing."""
    if name in NAMES:
        return NAMES[name]
    if _STATE.fullmatch(name):
        return 0.0
    words = [_known(w) for w in _WORD.findall(name)]
    telling = [w for w in words if w not in GENERIC] or words
    head, first = (NAMES.get(telling[-1], 0.0), NAMES.get(telling[0], 0.0)) if telling else (0.0, 0.0)
    return 0.0 if head >= 0 > first and len(telling) > 1 and head else head or min(first, 0.0)


def _evidence(tag: str, attributes: str, inside: bool) -> tuple[float, float]:
    """What an element says about the text in it, and the part of it that is taken back if it holds the page's main part."""
    said = ELEMENTS.get(tag, 0.0)
    if tag == "header" and inside:
        said = 0.0
    back = said if tag in FORMS else 0.0
    if attributes and ("=" in attributes or "hidden" in attributes):
        names = [x for m in _NAMES.finditer(attributes) for x in _HUMP.sub("-", m[1] or m[2] or m[3] or "").lower().split()]
        found = [x for x in map(_said_by, names) if x]
        if tag in ("body", "main"):
            found = [x for x in found if x > 0]
        if found:
            said += min(found) if min(found) < 0 else max(found)
            back += min(0.0, *found)
        if _HIDDEN.search(attributes):
            said -= 12.0
    return said, back


def _take_back(blocks: list[Block], own: list[tuple[str, float, float]], parent: list[int]) -> None:
    """Takes back what names and forms say that lie around the page's main part.

    ``own``: tag and evidence of each container, ``parent``: the one around it; a container's number is above its parent's.
    """
    held = [0] * len(own)
    size = [len(b.text) - b.linked if len(b.text) >= PROSE else 0 for b in blocks]
    for b, n in zip(blocks, size, strict=True):
        held[b.node] += n
    for x in range(len(own) - 1, 0, -1):
        held[parent[x]] += held[x]
    largest = [0] * len(own)  # the child that holds most
    for x in range(len(own) - 1, 0, -1):
        if not largest[parent[x]] or held[x] > held[largest[parent[x]]]:
            largest[parent[x]] = x
    changed = False
    for tag in ("article", "main", ""):
        top = max((x for x in range(len(own)) if own[x][0] == tag and held[x]), key=held.__getitem__, default=None)
        if top is None:
            continue
        # from the page down to the main part, and on to what holds most of it
        chain = [top]
        while chain[-1]:
            chain.append(parent[chain[-1]])
        chain.reverse()
        while (below := largest[chain[-1]]) and 2 * held[below] > held[chain[-1]]:
            chain.append(below)
        if not any(own[x][2] < 0 for x in chain):
            continue
        # where the way to each container leaves the chain, and whether nothing on it then is boilerplate
        level, plain = [0] * len(own), [True] * len(own)
        on = {x: i for i, x in enumerate(chain)}
        for x in range(1, len(own)):
            if x in on:
                level[x] = on[x]
            else:
                level[x], plain[x] = level[parent[x]], plain[parent[x]] and own[x][1] >= 0
        beside = [0] * len(chain)  # text that leaves the chain at each of its containers
        for b, n in zip(blocks, size, strict=True):
            if n and plain[b.node]:
                beside[level[b.node]] += n
        outside, within = 0, sum(beside)
        for x, n in zip(chain, beside, strict=True):
            kind, said, back = own[x]
            if back < 0 and outside < min(OUTSIDE, OUTSIDE_SHARE * within):
                own[x] = kind, said - back, 0.0
                changed = True
            outside, within = outside + n, within - n
    if changed:
        said = [own[0][1]]
        for x in range(1, len(own)):
            said.append(said[parent[x]] + own[x][1])
        for b in blocks:
            b.said = max(-60.0, said[b.node])


def blocks_of(html: str) -> tuple[list[Block], list[int]]:
    """The text blocks of a page, white space and character references resolved, empty ones left out; and the parent of each container."""
    out: list[Block] = []
    own: list[tuple[str, float, float]] = [("", 0.0, 0.0)]
    parent: list[int] = [0]
    # containers around the place reached: tag, number, evidence of all so far, whether in an article or main
    stack: list[tuple[str, int, float, bool]] = [("", 0, 0.0, False)]
    parts: list[str] = []
    linked, link_from, at, size = 0, -1, 0, 0
    open_tags: Counter[str] = Counter()  # of the stack: what isn't open needn't be looked for
    nested: dict[int, int] = {}  # inline elements of the same kind open in one that is a block

    def flush() -> None:
        nonlocal linked, link_from, size
        if parts:
            text = "".join(parts)
            if link_from >= 0:
                linked += len(text) - link_from
                link_from = 0
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                tag, node, said, inside = stack[-1]
                out.append(Block(text, node, said, tag, inside, linked))
            parts.clear()
            linked = size = 0

    def opened(tag: str, evidence: tuple[float, float], inside: bool) -> int:
        _, node, said, _ = stack[-1]
        own.append((tag, *evidence))
        parent.append(node)
        stack.append((tag, len(own) - 1, max(-60.0, said + evidence[0]), inside))
        open_tags[tag] += 1
        return len(own) - 1

    def closed(k: int) -> None:
        for x in stack[k:]:
            open_tags[x[0]] -= 1
        del stack[k:]

    def innermost(tag: str) -> int:
        return next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag) if open_tags[tag] else 0

    for m in _TAG.finditer(html):
        if m.start() < at:
            continue
        if m.start() > at:
            parts.append(html[at : m.start()])
            size += m.start() - at
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                at = _end_of(html, tag, at)
            continue
        if tag in BLOCKS:
            flush()
            if closing:
                if k := innermost(tag):
                    closed(k)
            elif tag not in VOID:
                if tag in ("p", "li", "td", "tr", "dt", "dd"):
                    while stack[-1][0] in ("p", tag):
                        closed(len(stack) - 1)
                inside = stack[-1][3]
                opened(tag, _evidence(tag, attributes, inside), inside or tag in ("article", "main"))
        elif tag == "br":
            parts.append(" ")
            size += 1
        elif tag == "a":
            if closing:
                if link_from >= 0:
                    linked += size - link_from
                link_from = -1
            elif link_from < 0:
                link_from = size
        elif tag in ("button", "label", "input"):
            # controls are blocks of their own
            flush()
            if closing:
                if stack[-1][0] == tag:
                    closed(len(stack) - 1)
            elif tag != "input":
                opened(tag, (-12.0, 0.0), stack[-1][3])
        elif tag in INLINE:
            k = innermost(tag) if nested else 0
            if closing:
                if k and nested[stack[k][1]]:
                    nested[stack[k][1]] -= 1
                elif k:
                    flush()
                    closed(k)
            elif attributes and (found := _evidence(tag, attributes, stack[-1][3]))[0] < 0:
                flush()
                nested[opened(tag, found, stack[-1][3])] = 0
            elif k:
                nested[stack[k][1]] += 1
    if at < len(html):
        parts.append(html[at:])
    flush()
    if any(back < 0 for _, _, back in own):
        _take_back(out, own, parent)
    return out, parent


_ENDS = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}


def _end_of(html: str, tag: str, at: int) -> int:
    m = _ENDS[tag].search(html, at)
    return m.start() if m else len(html)


def classify(blocks: list[Block]) -> None:
    """Sets both costs of every block: the negative log likelihoods of a logistic model."""
    framed = any(b.inside and b.said > 0 for b in blocks)
    bias = BIAS if any(b.said > NAMED and len(b.text) - b.linked >= PROSE_CHARS for b in blocks) else 0.0
    for b in blocks:
        n = len(b.text)
        score = b.said - bias + min(n, 240) / 80 - 4.0 * min(1.0, b.linked / n) + (0.5 if b.text[-1] in ".!?…:" else 0.0)
        if framed and not b.inside:
            score -= 6.0
        # no evidence outweighs all neighbours together however much there is of it
        score = LIMIT * math.tanh(score / LIMIT)
        b.cost_content = math.log1p(math.exp(-score))
        b.cost_boilerplate = math.log1p(math.exp(score))


def ties_of(blocks: list[Block], parent: list[int]) -> dict[tuple[int, int], float]:
    """Edges between blocks: (earlier, later) to weight."""
    ties: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    like = lambda a, b: UNLIKE if a.inside != b.inside or (a.said <= NAMED) != (b.said <= NAMED) else 1.0
    for i, b in enumerate(blocks):
        if i:
            # up from both to where they meet: over a page as many steps as it has containers, as blocks come in its order
            x, y, steps = blocks[i - 1].node, b.node, 0
            while x != y:
                x, y, steps = max(x, y), min(x, y), steps + 1
                x = parent[x]
            ties[i - 1, i] = ADJACENT / (1 + steps) * like(blocks[i - 1], b)
        around = parent[b.node]
        if around in last:
            pair = last[around], i
            ties[pair] = ties.get(pair, 0.0) + SIBLING / (1 + i - pair[0]) * like(blocks[pair[0]], b)
        last[around] = i
    return ties


def min_cut(to_source: list[float], to_sink: list[float], ties: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut.

    ``to_source[i]`` is paid if i leaves the source, ``to_sink[i]`` if it stays;
    a tie is paid if its ends part.
    """
    n = len(to_source)
    balance = [a - b for a, b in zip(to_source, to_sink, strict=True)]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in ties.items():
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(balance[i]) >= sum(near[i].values()):
            label[i] = balance[i] > 0
            for j, w in near[i].items():
                balance[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i in _max_flow(rest, balance, near):
            label[i] = True
    return [bool(x) for x in label]


def _max_flow(nodes: list[int], balance: list[float], near: list[dict[int, float]]) -> set[int]:
    """The source's side of a minimum cut among ``nodes``: Dinic's algorithm on residual capacities."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes}
    room[source], room[sink] = {}, {}
    for i in nodes:
        if balance[i] > 0:
            room[source][i] = balance[i]
            room[i][source] = 0.0
        elif balance[i] < 0:
            room[i][sink] = -balance[i]
            room[sink][i] = 0.0
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            i = queue.popleft()
            for j, c in room[i].items():
                if c > 1e-12 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            return {i for i in level if i >= 0}
        edges = {i: list(room[i]) for i in level}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                flow = min(room[a][b] for a, b in zip(path, path[1:], strict=False))
                cut = 0
                for k, (a, b) in reversed(list(enumerate(zip(path, path[1:], strict=False)))):
                    room[a][b] -= flow
                    room[b][a] = room[b].get(a, 0.0) + flow
                    if room[a][b] <= 1e-12:
                        cut = k
                del path[cut + 1 :]
                continue
            while edges[i] and not (room[i][edges[i][-1]] > 1e-12 and level.get(edges[i][-1]) == level[i] + 1):
                edges[i].pop()
            if edges[i]:
                path.append(edges[i][-1])
            else:
                path.pop()
                if path:
                    edges[path[-1]].pop()


def main_text(html: str | None) -> str:
    """The content blocks of a page, joined by spaces."""
    blocks, parent = blocks_of(html) if html else ([], [])
    if not blocks:
        return ""
    classify(blocks)
    content = min_cut([b.cost_boilerplate for b in blocks], [b.cost_content for b in blocks], ties_of(blocks, parent))
    return " ".join(b.text for b, yes in zip(blocks, content, strict=True) if yes)


def extract_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``df`` with ``out``: the main text of the page in ``html``, empty if there is none."""
    at = df.columns.index(html)
    (out,) = fresh(df, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            made = pa.array([main_text(x) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def op8_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
