"""Main text of web pages by minimum-cut labelling.

A page is read once into blocks of text, each with its chain of open elements. A classifier gives
every block the cost of calling it boilerplate and the cost of calling it content: text length, stop
marks and the share of linked text first, then, at half their weight, element kinds and words in class
or id attributes on the chain. Those costs are capacities from the source and to the sink. Smoothness
edges tie neighbours in page order, stronger the more of their chains they share, and, by proximity in the
document tree, each block to the last one of its kind before it under the same parent and under the
same grandparent, whatever stands between them. So a short line in the middle of an article stays, a long
sentence inside a menu goes, and an article goes on after an advert. The minimum cut (Dinic's algorithm
over the page's own small graph, three edges a block at most) labels the page.

Never content, whatever the cut says: scripts, styles, templates, the head, and form controls.

Defined cases: null or empty html has the empty text; unclosed and stray tags are tolerated as
browsers do (a new paragraph closes the last one); very long pages cost time in proportion to their
length; repeated rows and further columns don't matter.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.runtime import only

# HTML's element kinds.
RAW = {"script", "style", "template", "noscript", "textarea", "title", "iframe", "svg", "select", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
PAGE = {"html", "body"}  # everything is in them: they bring no blocks together
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
BREAKS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul", "figure"}

# The classifier: evidence in nats for content (positive) and for boilerplate.
ELEMENTS = {"article": 3.0, "main": 2.0, "p": 1.0, "h1": 0.6, "h2": 0.4, "h3": 0.4, "blockquote": 0.5, "pre": 0.6, "nav": -6.0, "header": -2.5, "footer": -6.0, "aside": -5.0, "form": -6.0, "button": -4.0, "menu": -5.0, "dialog": -5.0, "figcaption": 0.2, "fieldset": -3.0, "label": -1.0, "li": -0.3}
NAMES = [
    (re.compile(r"(?:^|[-_ ])(?:nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|footer|foot|masthead|topbar|toolbar|pagination|pager)(?:$|[-_ ])"), -5.0),
    (re.compile(r"(?:^|[-_ ])(?:ads?|adv|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|teaser|newsletter|subscribe|signup|popup|modal|cookies?|consent|gdpr|notice|alert|disclaimer|legal|paywall)(?:$|[-_ ])"), -6.0),
    (re.compile(r"(?:^|[-_ ])(?:comments?|replies|respond|discussion|disqus|reactions?)(?:$|[-_ ])"), -6.0),
    (re.compile(r"(?:^|[-_ ])(?:related|recommended|recirc|popular|trending|share|sharing|social|follow|tags?|meta|byline|widget|login|search)(?:$|[-_ ])"), -4.0),
    (re.compile(r"(?:^|[-_ ])(?:article|content|post|entry|story|main|body|text)(?:$|[-_ ])"), 2.0),
]
ROLES = {"navigation": -6.0, "banner": -4.0, "contentinfo": -6.0, "complementary": -5.0, "search": -6.0, "form": -6.0, "dialog": -5.0, "alert": -5.0, "main": 2.5, "article": 2.5, "menu": -5.0}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_UNCLOSED = re.compile("<[!?]")
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_STOPS = re.compile(r"[.!?;:,](?:\s|$)")
_WHITE = re.compile(r"[\s\x00]+")


def evidence(name: str, attrs: str) -> float:
    """An element's evidence from its kind, role, class and id."""
    found = ELEMENTS.get(name, 0.0)
    if attrs:
        for key, a, b, c in _ATTR.findall(attrs):
            value = (a or b or c).lower()
            key = key.lower()
            if key == "role":
                found += ROLES.get(value, 0.0)
            elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                found -= 4.0
            else:
                found += min(0.0, *(w for p, w in NAMES if p.search(value)), 0.0) or max([0.0, *(w for p, w in NAMES if w > 0 and p.search(value))])
    return found


def blocks(html: str) -> list[tuple[str, float, tuple[int, ...], float, str]]:
    """(text, evidence, chain of open elements' numbers, share of linked text, own element's kind) in page order."""
    out: list = []
    stack: list[tuple[str, int, float]] = []
    parts: list[str] = []
    linked = total = count = links = 0
    known: dict[tuple[str, str], float] = {}

    def flush():
        nonlocal linked, total
        text = _WHITE.sub(" ", unescape("".join(parts))).strip() if parts else ""
        parts.clear()
        if text:
            solid = [s for s in stack if s[0] not in INLINE]
            strong = [e for _, _, e in solid]
            out.append((text, min([0.0, *strong]) + min(3.5, sum(e for e in strong if e > 0)), tuple(i for kind, i, _ in solid if kind not in PAGE), linked / max(total, 1), solid[-1][0] if solid else ""))
        linked = total = 0

    def close_to(at: int):
        nonlocal links
        links -= sum(1 for s in stack[at:] if s[0] == "a")
        del stack[at:]

    edge = html.rfind(">") + 1  # no tag ends beyond it, so none is looked for there
    cut = _UNCLOSED.search(html, edge)
    at, size = 0, cut.start() if cut else len(html)
    for_tag = _TAG.search
    while at < size:
        m = for_tag(html, at, edge)
        stop = m.start() if m else size
        if stop > at:
            piece = html[at:stop]
            parts.append(piece)
            total += len(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            if at == edge and m[0].startswith("<!--") and not m[0][4:].endswith("-->"):
                at = size
            continue
        name = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if name not in INLINE:
                        flush()
                    close_to(i)
                    break
            else:
                if name == "p":
                    flush()
            continue
        if name in RAW:
            flush()
            if not m[3].rstrip().endswith("/") or name in ("script", "style", "textarea", "title"):
                end = _ENDS[name].search(html, at)
                at = end.end() if end else size
            continue
        if name not in INLINE:
            flush()
        if name in VOID:
            continue
        shut = CLOSES.get(name, set()) | ({"p"} if name in BREAKS_P else set())
        if shut:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in shut:
                    close_to(i)
                    break
                if stack[i][0] not in INLINE and stack[i][0] not in ("p", "b", "i"):
                    break
        key = (name, m[3])
        if key not in known:
            known[key] = evidence(name, m[3])
        count += 1
        stack.append((name, count, known[key]))
        links += name == "a"
    flush()
    return out


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side of a minimum cut (Dinic's algorithm)."""
    n = len(source)
    s, t = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def add(a, b, forth, back):
        graph[a].append(len(to))
        to.append(b)
        cap.append(forth)
        graph[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        direct = min(source[i], sink[i])  # what flows straight through needs no search
        if source[i] > direct:
            add(s, i, source[i] - direct, 0.0)
        elif sink[i] > direct:
            add(i, t, sink[i] - direct, 0.0)
    for a, b, w in edges:
        add(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        at = [0] * (n + 2)
        path: list[int] = []
        node = s
        while True:
            if node == t:
                least = min(cap[e] for e in path)
                for k, e in enumerate(path):
                    cap[e] -= least
                    cap[e ^ 1] += least
                first = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                node = to[path[first] ^ 1]
                del path[first:]
                continue
            while at[node] < len(graph[node]):
                e = graph[node][at[node]]
                if cap[e] > tiny and level[to[e]] == level[node] + 1:
                    path.append(e)
                    node = to[e]
                    break
                at[node] += 1
            else:
                if node == s:
                    break
                level[node] = -1
                node = to[path.pop() ^ 1]


def score(text: str, shown: float, linked: float) -> float:
    """A block's evidence for content (positive) or boilerplate, on its own."""
    own = min(1.6, len(text) / 100) + min(1.0, 0.35 * len(_STOPS.findall(text))) - 4.0 * linked - 1.2
    return own + max(-3.2, min(1.6, 0.5 * shown))


def ties(chains: list[tuple[int, ...]], kinds: list[str]) -> list[tuple[int, int, float]]:
    """Smoothness edges between blocks: neighbours in the page, and in the tree."""
    out = []
    for i in range(len(chains) - 1):
        a, b = chains[i], chains[i + 1]
        shared = 0
        for x, y in zip(a, b, strict=False):
            if x != y:
                break
            shared += 1
        apart = max(len(a), len(b)) - shared
        out.append((i, i + 1, 0.8 * 0.5 ** max(0, apart - 1) if apart else 1.2))
    for above, weight in ((1, 0.8), (2, 0.3)):  # a block's own element stands last in its chain
        last: dict[tuple, int] = {}
        for i, (chain, kind) in enumerate(zip(chains, kinds, strict=True)):
            if len(chain) > above:
                key = (chain[-1 - above], kind)
                if last.get(key, i - 1) != i - 1:  # neighbours are tied already
                    out.append((last[key], i, weight))
                last[key] = i
    return out


def labels(found: list[tuple[str, float, tuple[int, ...], float, str]]) -> list[bool]:
    """Which blocks are content."""
    scores = [score(text, shown, linked) for text, shown, _, linked, _ in found]
    return min_cut([max(x, 0.0) for x in scores], [max(-x, 0.0) for x in scores], ties([b[2] for b in found], [b[4] for b in found]))


def main_text(html: str) -> str:
    """The page's article: its content blocks in page order, joined by one space."""
    found = blocks(html)
    return " ".join(b[0] for b, kept in zip(found, labels(found), strict=True) if kept) if found else ""


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) for every page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["__key", "__url", "text", "n_chars"])

    src = only(pages, key, url, html).select(F.col(key).alias("__key"), F.col(url).alias("__url"), F.coalesce(html, F.lit("")))
    return src.mapInArrow(run, f"__key {dict(src.dtypes)['__key']}, __url string, text string, n_chars long").withColumnsRenamed({"__key": key, "__url": url})
