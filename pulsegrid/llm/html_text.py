"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text, each with the path of tags from the root to it. Text length, blocks, punctuation and linked text are
summed per path; a path's text ratio (characters a block) and its punctuation ratio are given to its blocks, smoothed over
the page order, and fused. Blocks over the threshold speak for the elements around them, others against; the element with the most in its favour is the main one, whatever its name. Names decide where it can't be, as in
a menu or among comments, and widen it to the article around it. The text is all of its blocks but those of menus, forms and other parts
that are never content, and those of parts named otherwise whose own score is too low.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.support import small_batches

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_OPEN_COMMENT = re.compile(r"<!--.*", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？…]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Never content, whatever they hold.
OUTSIDE = frozenset("head nav header footer aside form menu dialog button select datalist fieldset object canvas audio video map".split())
#: Words of class and id names, and roles, that mark other parts than the article.
HINTS = frozenset("ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies copyright disclaimer discussion disqus dialog footer form gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notification notices overlay pager pagination popup promo promoted promotion recommended related reply replies responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget".split())
#: Names of the article itself: in the same attribute they outweigh the others.
OWN = frozenset("article body content entry main page post story text".split())
#: Before a hint they tell of the layout, as in with-sidebar.
_LAYOUT = frozenset("has is no not with without".split())
#: Weights of scores inside an article or main element, and inside a part that is named otherwise.
MAIN_WEIGHT, HINT_WEIGHT = 2.0, 0.05
#: What a block speaks for the elements around it at most.
MOST = 3.0
_CONTAINERS = frozenset(["", "html", "body", "article", "main", "section", "div", "center"])
_CLOSES_P = BLOCKS - {"caption", "li", "optgroup", "option", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: A start tag closes an open element of these names, unless one of the others is nearer.
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
_KERNEL = np.exp(-0.5 * np.arange(-2, 3) ** 2)


@dataclass(slots=True, eq=False)
class Node:
    """An element. Elements are numbered in page order, so those inside one follow it up to `last`."""

    tag: str
    parent: Node | None
    depth: int
    number: int
    path: int
    outside: bool
    hinted: bool
    hidden: bool
    in_article: bool
    in_main: bool = False
    holds_main: bool = False
    last: int = 0
    #: depth of the nearest element around or at it that names another part; -1 if none
    other: int = -1

    def holds(self, node: Node) -> bool:
        return self.number <= node.number <= self.last


@dataclass(slots=True, eq=False)
class TextBlock:
    node: Node
    text: str
    linked: int


_TELLING = re.compile(r"class|id|role|hidden|style", re.I)


def _names_other(value: str) -> bool:
    """Whether a class, id or role names another part than the article."""
    other = False
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if words and OWN.issuperset(words):
            return False
        other |= any(w in HINTS and (k == 0 or words[k - 1] not in _LAYOUT) for k, w in enumerate(words))
    return other


@lru_cache(4096)
def _told(attributes: str) -> tuple[bool, bool]:
    """Whether the attributes name another part, and whether they hide the element."""
    hinted = hidden = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        hinted |= name in ("class", "id", "role") and _names_other(value)
        hidden |= name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None)
    return hinted, hidden


def read_page(page: str) -> tuple[list[Node], list[TextBlock]]:
    """The page's elements and its blocks of text, in order. Paths of tags are numbered: each is its parent's path and a tag."""
    root = Node("", None, 0, 0, 0, False, False, False, False)
    nodes, paths, open_, raw_ends = [root], {}, Counter(), {}
    at, found, parts, linked, links, end = root, [], [], 0, 0, 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text)

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            if text := " ".join("".join(parts).split()):
                found.append(TextBlock(at, text, linked))
            parts, linked = [], 0

    def leave(x: Node) -> None:
        """Goes on in the element around x."""
        nonlocal at, links
        while at is not x.parent:
            links -= at.tag == "a"
            open_[at.tag] -= 1
            at = at.parent

    def close(names: set[str] | frozenset[str], walls: set[str] | frozenset[str]) -> None:
        x = at
        if not any(open_[name] for name in names):
            return
        while x.parent and x.tag not in names:
            if x.tag in walls:
                return
            x = x.parent
        if x.parent:
            flush()
            leave(x)

    size, last_end = len(page), page.rfind(">")
    while end < size:
        # what follows the last > is text, and perhaps an open comment
        m = _TOKEN.search(page, end) if end <= last_end else _OPEN_COMMENT.search(page, end)
        if not m:
            add(page[end:])
            break
        add(page[end : m.start()])
        end = m.end()
        if m.re is _OPEN_COMMENT:
            continue
        slash, tag, attributes = m[1] if m[2] else m[4], (m[2] or m[5] or "").lower(), m[3] if m[2] else m[6] or ""
        if not tag:
            continue
        if slash:
            if tag == "br":
                parts.append(" ")
            elif tag in BLOCKS:
                flush()
                close({tag}, {"table", "body"} - {tag} if tag == "p" else frozenset())
            elif tag not in VOID and open_[tag]:
                x = at
                while x.parent and x.tag != tag and x.tag not in BLOCKS:
                    x = x.parent
                if x.parent and x.tag == tag:
                    leave(x)
            continue
        if tag in RAW:
            if raw_ends.get(tag, end) is not None:  # None: there is none on the rest of the page
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, end)
                raw_ends[tag] = stop and stop.end()
            end = raw_ends[tag] or (size if tag in ("script", "style") else end)
            continue
        if tag in BLOCKS:
            flush()
            if tag in _CLOSES_P:
                close({"p"}, BLOCKS - {"p"})
            if tag in _SIBLINGS:
                close(*_SIBLINGS[tag])
        if tag in VOID:
            parts.append(" ")
            continue
        if attributes.endswith("/") and tag not in BLOCKS and tag != "a":
            continue
        hinted, hidden = _told(attributes) if tag not in ("html", "body") and _TELLING.search(attributes) else (False, False)
        if tag in ("article", "main"):  # reader comments are articles inside the article
            hinted = hinted and tag == "article" and at.in_article
        main = tag in ("article", "main") and not hinted and not hidden
        path = paths.setdefault((at.path, tag), len(paths) + 1)
        at = Node(tag, at, at.depth + 1, len(nodes), path, at.outside or tag in OUTSIDE, hinted, hidden, at.in_article or hinted or tag == "article", at.in_main or main)
        nodes.append(at)
        open_[tag] += 1
        links += tag == "a"
        x = at if main else None
        while x is not None and not x.holds_main:
            x.holds_main, x = True, x.parent
    flush()
    for x in reversed(nodes):
        x.last = max(x.last, x.number)
        if x.parent:
            x.parent.last = max(x.parent.last, x.last)
    for x in nodes[1:]:
        x.outside |= x.parent.outside or (x.hidden and not x.holds_main)
        x.other = x.depth if x.hinted and not x.holds_main else x.parent.other
    return nodes, found


def _up(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def scores(blocks: list[TextBlock], weights: np.ndarray | None = None) -> np.ndarray:
    """Each block's fused score: the smoothed text ratio of its path times its smoothed punctuation ratio, lowered by its path's share of linked text, times its
    weight. Blocks are smoothed with neighbours of their own weight only."""
    weights = np.ones(len(blocks)) if weights is None else weights
    where = np.unique(np.array([b.node.path for b in blocks], np.int64), return_inverse=True)[1]
    size = np.array([len(b.text) for b in blocks], float)
    marks = np.array([len(_PUNCTUATION.findall(b.text)) for b in blocks], float)
    linked = np.array([min(b.linked, len(b.text)) for b in blocks], float)
    n, chars, signs, links = (np.bincount(where, w) for w in (None, size, marks, linked))
    texts, points, open_ = (chars / n)[where], ((signs + 0.5) / n)[where], (1 - links / np.maximum(chars, 1))[where]

    near = np.arange(len(blocks))[:, None] + np.arange(-2, 3)
    held = near.clip(0, len(blocks) - 1)
    kernel = _KERNEL * ((near == held) & (weights[held] == weights[:, None]))

    def smooth(x: np.ndarray) -> np.ndarray:
        return (kernel * x[held]).sum(1) / kernel.sum(1)

    return smooth(texts) * smooth(points) * open_ * weights


def content_node(nodes: list[Node], blocks: list[TextBlock], fused: np.ndarray) -> Node:
    """The element with the most gain: blocks over the threshold, the mean score, add what they exceed it by, up to MOST times it, and blocks under it take away what they lack. Of equal ones the innermost."""
    bar = fused.mean()
    gain = np.minimum(fused / bar - 1.0, MOST) if bar > 0 else np.ones(len(fused))
    held = np.zeros(len(nodes))
    np.add.at(held, [b.node.number for b in blocks], gain)
    held = held.tolist()
    for x in reversed(nodes[1:]):
        held[x.parent.number] += held[x.number]
    return max((x for x in nodes if x.tag in _CONTAINERS), key=lambda x: (held[x.number], x.depth))


def heaviest_node(nodes: list[Node], blocks: list[TextBlock]) -> Node:
    """The smallest element around nine tenths of the text over the threshold, text in parts named otherwise counting little: of a page whose best part is named so."""
    weights = np.array([HINT_WEIGHT if b.node.other >= 0 else MAIN_WEIGHT if b.node.in_main else 1.0 for b in blocks])
    fused = scores(blocks, weights)
    bar = min(fused.std(), fused.max())
    held = np.zeros(len(nodes))
    np.add.at(held, [b.node.number for b in blocks], np.where(fused >= bar, weights, 0.0) * [len(b.text) for b in blocks])
    held = held.tolist()
    for x in reversed(nodes[1:]):
        held[x.parent.number] += held[x.number]
    whole = max(held)
    inner = max((x for x in nodes if held[x.number] * 10 >= whole * 9), key=lambda x: x.depth)
    return next(x for x in _up(inner) if x.tag in _CONTAINERS)


def chosen(nodes: list[Node], blocks: list[TextBlock]) -> tuple[Node, bool]:
    """The page's main element, and whether the scores alone tell it.

    The scores of all visible blocks choose it, whatever the names of their tags. A choice inside of a part that is never content or is named otherwise is made again without the former and with little weight of the latter.
    An article or main element around the choice, or the only one in it that has all of the blocks over the threshold, stands for it.
    """
    seen = [b for b in blocks if not any(x.hidden and not x.holds_main for x in _up(b.node))] if any(x.hidden for x in nodes) else blocks
    inner = content_node(nodes, seen, scores(seen)) if seen else nodes[0]
    alone = not inner.outside and inner.other < 0
    if not alone:
        seen = [b for b in blocks if not b.node.outside]
        inner = heaviest_node(nodes, seen)
    around = next((x for x in _up(inner) if x.tag in ("article", "main") and not x.hinted), None)
    if around is None:
        fused = scores(seen)
        own = [x for x in nodes[inner.number : inner.last + 1] if x.tag in ("article", "main") and not x.hinted and not x.outside and x.other < 0]
        high = [b.node for b, s in zip(seen, fused.tolist(), strict=True) if s >= fused.mean() and inner.holds(b.node)]
        around = own[0] if own and all(own[0].holds(x) for x in high) else inner
    return around, alone


def weighted(blocks: list[TextBlock]) -> np.ndarray:
    return np.array([HINT_WEIGHT if b.node.other >= 0 else MAIN_WEIGHT if b.node.in_main else 1.0 for b in blocks])


def main_text(page: str | None) -> str:
    """Blocks of the main part, each with single spaces, joined by two \n; empty if there is none. In it, parts that are never content go; so do parts named otherwise whose scores are low,
    and, where there is no article, paths of several blocks that are links for the most part."""
    nodes, blocks = read_page(page) if page else ([], [])
    free = [b for b in blocks if not b.node.outside]
    if not free:
        return ""
    inner, _ = chosen(nodes, blocks)
    fused = scores(free, weighted(free))
    bar = min(fused.std(), fused.max())
    paths = [b.node.path for b in free]
    times, sizes, links = Counter(paths), Counter(), Counter()
    for b in free:
        sizes[b.node.path] += len(b.text)
        links[b.node.path] += b.linked
    listed = {p for p, n in times.items() if n > 1 and 2 * links[p] > sizes[p]}
    kept = [b for b, s in zip(free, fused.tolist(), strict=True) if inner.holds(b.node) and (s >= bar if b.node.other > inner.depth else b.node.in_main or b.node.path not in listed)]
    return "\n\n".join(b.text for b in kept)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 200):
            part = batch.slice(k, 200)
            texts = [main_text(page) for page in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html; other columns are ignored), in one narrow pass.

    A null or empty page has an empty text. Broken markup is read as far as it goes: unclosed elements end with their parents, a truncated tag is text. Repeated rows are extracted each;
    null ids and urls stay null. A page of any length or depth is read whole, in time in proportion to it. An empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
