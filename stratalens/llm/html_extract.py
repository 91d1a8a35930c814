"""Main-text extraction by minimum-cut labelling of a page's text blocks.

The page is read tag by tag into blocks of text (a block ends at any block-level tag). The
graph has a node for each block and one for each element whose name, role, class or id says
something. Terminal capacities are classifier costs: a linear classifier scores a block by its
own text and links, another scores an element by its names; a positive score ties the node to
the source (content), a negative one to the sink (boilerplate). Smoothness capacities join
neighbours in page order, blocks close together in the element tree, and each block with the
nearest element node around it, by how much that element says. Maximum flow (Dinic's) cuts the
graph; blocks still reachable from the source are the main text. So a short heading, which
looks like boilerplate by itself, is content in an article, a long advert is not, and a long
paragraph with a weak mark (a class "side", say) goes with its neighbours.

Scripts, styles and other elements whose text is never shown are not read at all; formulas,
drawings' labels and fallback content are text like any other.

Defined cases: null and empty pages have empty text; unclosed, crossed and unknown tags are
tolerated; a page without markup is one block of content; character references are decoded,
white space inside a block becomes one space, blocks come in page order with one line feed
between; nothing is capped. Repeated rows stay; columns pass through, new ones take the
place of equal names.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# Element names, fixed by the HTML standard.
HIDDEN = frozenset("script style template head title iframe select option datalist textarea noframes noembed".split())
RAW = frozenset("script style textarea title noframes noembed iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr input button object svg math canvas audio video".split()) | frozenset("mi mn mo mtext ms mrow mfrac msup msub msubsup msqrt mroot mstyle mover munder munderover mtable mtr mtd mspace semantics annotation g text tspan desc path use".split())
# Elements and words of class, id and role that mark content or boilerplate, with the classifier's weights.
ELEMENT = {"article": 6.0, "main": 5.0, "nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "menu": -9.0, "dialog": -9.0, "header": -5.0, "button": -9.0, "fieldset": -9.0, "address": -2.0, "figcaption": -0.5}
WORD_WEIGHT = [
    (re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|respond|replies|reply|disqus|discussion|reviews?|feedback)(?:$|[\s_-])"), -20.0),
    (re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|adunit|adslot|sponsor\w*|promo\w*|banner|dfp|outbrain|taboola)(?:$|[\s_-])"), -10.0),
    (re.compile(r"(?:^|[\s_-])(?:nav\w*|menu\w*|breadcrumbs?|pagination|pager|toolbar|tabs|topbar|skip)(?:$|[\s_-])"), -9.0),
    (re.compile(r"(?:^|[\s_-])(?:footer|foot|copyright|legal|colophon|masthead|site[_-]header|page[_-]header)(?:$|[\s_-])"), -9.0),
    (re.compile(r"(?:^|[\s_-])(?:header)(?:$|[\s_-])"), -5.0),
    (re.compile(r"(?:^|[\s_-])(?:sidebar|rail|widgets?|related|recommend\w*|popular|trending|share|sharing|social|subscribe|newsletter|signup|login|tagcloud|author[_-]bio)(?:$|[\s_-])"), -8.0),
    (re.compile(r"(?:^|[\s_-])(?:side|follow|search\w*|tags?|categories|bio)(?:$|[\s_-])"), -2.0),
    (re.compile(r"(?:^|[\s_-])(?:cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|disclaimer|warning|announcement|paywall|hidden)(?:$|[\s_-])"), -9.0),
    (re.compile(r"(?:^|[\s_-])(?:article|post|entry|content|story|body|text|main|prose|hentry)(?:$|[\s_-])"), 4.0),
]
ROLE = {"navigation": -9.0, "banner": -9.0, "contentinfo": -9.0, "complementary": -9.0, "search": -9.0, "form": -9.0, "dialog": -9.0, "alert": -9.0, "alertdialog": -9.0, "main": 5.0, "article": 6.0}
LANDMARK = frozenset("article main".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>)|[^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_SPACE = re.compile(r"\s+")
_weights: dict[tuple, float] = {}


def _element_weight(tag: str, attributes: str) -> tuple[float, bool]:
    """The weight of one element, and whether it is hidden."""
    key = (tag, attributes)
    got = _weights.get(key)
    if got is None:
        found = {a.lower(): html.unescape(x or y or z or "") for a, x, y, z in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        style = _SPACE.sub("", found.get("style", "").lower())
        hidden = "display:none" in style or found.get("aria-hidden", "").lower() == "true" or bool(re.search(r"(?:^|\s)hidden(?:\s|$|=)", _ATTRIBUTE.sub("", attributes)))
        weight = ELEMENT.get(tag, 0.0)
        role = ROLE.get(found.get("role", "").lower())
        if role is not None:
            weight = role
        names = f"{found.get('class', '')} {found.get('id', '')}".lower()
        if tag not in ("body", "html") and names.strip():
            hits = [w for r, w in WORD_WEIGHT if r.search(names)]
            if hits and tag not in LANDMARK:
                worst = min(hits)
                weight = worst if worst < 0 and weight <= 0 and max(hits) <= 0 else (weight + worst if worst < 0 else max(weight, worst))
        got = (weight, hidden)
        if len(_weights) > 50_000:
            _weights.clear()
        _weights[key] = got
    return got


class Block:
    __slots__ = ("text", "path", "tag", "context", "links", "words", "mark")

    def __init__(self, text, path, tag, context, links, mark=0):
        self.text, self.path, self.tag, self.context, self.links, self.mark = text, path, tag, context, links, mark
        self.words = text.count(" ") + 1


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in page order."""
    out: list[Block] = []
    # element: (tag, number, weight of its context, hidden, number of the nearest one that has a weight)
    stack: list[tuple[str, int, float, bool, int]] = [("", 0, 0.0, False, 0)]
    buffer: list[str] = []
    number, link, linked, at = 0, 0, 0, 0

    def flush():
        nonlocal linked
        if buffer:
            text = _SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            if text:
                blocks = [s for s in stack if s[0] not in INLINE]
                out.append(Block(text, tuple(s[1] for s in blocks), blocks[-1][0], stack[-1][2], min(1.0, linked / max(1, len(text))), stack[-1][4]))
            buffer.clear()
        linked = 0

    n, last = len(page), max(page.rfind(">"), page.rfind("<!")) + 1  # no tag begins and ends after that
    while at < n:
        m = _TOKEN.search(page, at) if at < last else None
        piece = page[at : m.start()] if m else page[at:]
        if piece and not stack[-1][3]:
            buffer.append(piece)
            if link:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            if m[0].startswith("<![CDATA[") and not stack[-1][3]:
                buffer.append(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        elif tag == "br":
            buffer.append(" ")
        if m[1]:
            if tag == "a":
                link = max(0, link - 1)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                # a stray end tag of an inline or small element does not close a landmark
                if stack[k][0] in ELEMENT and tag in INLINE | {"p", "li", "div", "span"} and tag not in [s[0] for s in stack[:k]]:
                    break
            continue
        if tag in VOID or m[3].endswith("/") and tag not in HIDDEN:
            continue
        if tag == "a":
            link += 1
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        _close_implied(stack, tag)
        weight, hidden = _element_weight(tag, m[3])
        outer = stack[-1][2]
        if tag in LANDMARK:
            # an unclosed element before it does not hold the main text; comments do
            context = weight if outer > -15.0 else outer + weight
        elif weight < 0 and tag == "header" and outer > 0:
            context = outer - 1.0  # the heading of an article stands in it
        elif weight < 0:
            context = min(outer, 0.0) / 2 + weight
        else:
            context = max(outer, weight) if outer >= 0 else outer + weight / 2
        number += 1
        stack.append((tag, number, context, hidden or stack[-1][3] or tag in HIDDEN, number if weight else stack[-1][4]))
    flush()
    return out


# An opening tag closes these open ones (optional end tags of the HTML standard).
_IMPLIED = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",), "body": ("head",)}
_SCOPE = frozenset("ul ol dl table article main section nav aside div body html blockquote".split())


def _close_implied(stack, tag: str) -> None:
    closes = _IMPLIED.get(tag, ("p",) if tag not in INLINE else ())
    if not closes:
        return
    for k in range(len(stack) - 1, 0, -1):
        if stack[k][0] in closes:
            del stack[k:]
            return
        if stack[k][0] in _SCOPE:
            return


def score(block: Block, has_landmark: bool, paragraphs: int = 0) -> float:
    """The classifier of a block by its own text: over 0 for content, at most 3 either way.

    paragraphs: how many p blocks the page has; loose text beside them is hardly main text."""
    s = 2.0 if len(block.path) <= 1 else 0.0  # text outside of all elements: hardly a page
    s += min(2.5, 0.12 * block.words) - 1.6
    s -= (3.0 if block.tag == "p" else 4.0) * block.links if block.links > 0.5 or block.context <= 0 else 0.0
    s += 0.6 * (block.text[-1] in ".!?…。\"”»")
    if block.tag in ("h1",):
        s += 2.0
    elif block.tag in ("p", "pre", "blockquote", "h2", "h3", "h4", "td"):
        s += 0.8
    elif block.tag in ("li", "dd", "dt"):
        s -= 0.2
    elif paragraphs > 2:
        s -= 1.0
    if re.match(r"(?:©|\(c\)\s|copyright\b|all rights reserved)", block.text, re.I) and block.words < 30:
        s -= 5.0
    if has_landmark and block.context <= 0:
        s -= 1.0  # outside of the marked main text
    return max(-3.0, min(3.0, s))


def max_flow_side(terminal: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Minimum cut: whether each node is on the source's side.

    terminal: positive ties the node to the source, negative to the sink. edges: undirected.
    """
    n = len(terminal)
    source, sink = n, n + 1
    to, room, out = [], [], [[] for _ in range(n + 2)]

    def link(a, b, forth, back):
        out[a].append(len(to))
        to.append(b), room.append(forth)
        out[b].append(len(to))
        to.append(a), room.append(back)

    for i, t in enumerate(terminal):
        if t > 0:
            link(source, i, t, 0)
        elif t < 0:
            link(i, sink, -t, 0)
    for a, b, c in edges:
        link(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        start = [0] * (n + 2)
        path: list[int] = []
        node = source
        while True:  # a blocking flow, without recursion: pages may have any number of blocks
            if node == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(k for k, e in enumerate(path) if not room[e])
                node = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while start[node] < len(out[node]):
                e = out[node][start[node]]
                if room[e] and level[to[e]] == level[node] + 1:
                    break
                start[node] += 1
            else:
                if node == source:
                    break
                level[node] = -2
                e = path.pop()
                node = to[e ^ 1]
                start[node] += 1
                continue
            path.append(e)
            node = to[e]


SCALE = 100
# How strongly a block is held by the element node around it, at most: over all that its own
# score (3) and its other edges (at most 3) can weigh. Weaker marks hold less.
HOLD = 7.0


def graph(blocks: list[Block], smooth: float = 1.0) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Terminal capacities of blocks, then of element nodes, and smoothness edges."""
    has_landmark = any(b.context >= 5.0 for b in blocks)
    paragraphs = sum(b.tag == "p" for b in blocks)
    terminal = [round(SCALE * score(b, has_landmark, paragraphs)) for b in blocks]
    edges, last_child, marks = [], {}, {}
    for i, b in enumerate(blocks):
        if b.mark and b.context:
            marks.setdefault(b.mark, []).append(i)
        if i:
            a = blocks[i - 1]
            common = 0
            for x, y in zip(a.path, b.path):
                if x != y:
                    break
                common += 1
            apart = len(a.path) + len(b.path) - 2 * common
            beside = len(a.path) == len(b.path) and apart == 2
            edges.append((i - 1, i, round(SCALE * smooth / (1 if beside else 1 + apart))))
        parent = b.path[-2] if len(b.path) > 1 else 0
        j = last_child.get(parent)
        if j is not None and j < i - 1:
            edges.append((j, i, round(SCALE * smooth / 2)))
        last_child[parent] = i
    for held in marks.values():
        context = blocks[held[0]].context
        # what an element says counts for every block that it holds
        terminal.append(round(SCALE * context * max(1.0, len(held) / 2)))
        edges += [(len(terminal) - 1, i, round(SCALE * min(HOLD, abs(context)))) for i in held]
    return terminal, edges


def label(blocks: list[Block], smooth: float = 1.0) -> list[bool]:
    """Which blocks are main text."""
    terminal, edges = graph(blocks, smooth)
    if all(t > 0 for t in terminal):
        return [True] * len(blocks)
    return max_flow_side(terminal, edges)[: len(blocks)]


def extract(page: str | None) -> str:
    """The main text of one page."""
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, keep in zip(blocks, label(blocks)) if keep)


def main_text(pages: DataFrame, *, html_column: str = "html") -> DataFrame:
    """``pages`` without the html, with text and n_chars."""
    new = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    taken = {"text", "n_chars", html_column}
    kept = [f for f in pages.schema.fields if f.name not in taken]
    source = pages.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{html_column}`")).toDF(*map(str, range(len(kept) + 1)))

    def run(batches):
        for b in batches:
            texts = [extract(x.as_py()) for x in b.column(b.num_columns - 1)]
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            columns += [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept + new])

    return source.mapInArrow(run, T.StructType(kept + new))
