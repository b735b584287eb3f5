"""Main-text extraction by tag-path ratios.

Every run of text is a block with a root-to-leaf path of block-level tags. Over a page, text length
and punctuation are summed per path and divided by the path's blocks; both ratios are smoothed over
the blocks in page order, fused, and compared with a threshold. Paths that reach it are content. The
innermost element that holds most of their text is the article; it is decided before any class name
is looked at, so no name can empty a page. Inside it, elements that are named as adverts, notices,
menus or comments go, unless they hold most of the content or its title.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm import textops as tx

#: A tag ends at ">", or where the next "<" stands; a quote that is not closed before that is a character.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^<>\"']++|\"[^<\"]*+\"|'[^<']*+'|[\"'])*+)(?:>|(?=<)|\Z)", re.S)
#: Words that name what is no part of an article, and words that may stand beside them in a name.
HINTS = set("ad ads advert adverts advertisement advertisements advertising banner banners sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice notices alert alerts newsletter subscribe subscription sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus reply replies respond share sharing social related recommended recommendations popup modal overlay widget widgets login signup toolbar pagination pager skip".split())
BESIDE = set("site page main top bottom left right inner outer user users post posts article articles blog global primary secondary list lists item items area section wrapper wrap container box block blocks bar link links button buttons form content text title icon icons group panel row col column unit slot message messages count body more read in on of the to and for google sub small big sticky fixed side thread node".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "xmp", "noframes", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {"head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "object", "canvas", "audio", "video", "map", "datalist", "fieldset"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ARTICLE = {"article", "main"}
#: Tags that end an open <p>, and tags that end an open one of their own kind.
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
ENDS_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINS = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "main", "blockquote"}
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")
SPACE = re.compile(r"\s+")
#: Weights of a block and its neighbours in smoothing; share of the mean that a path must reach.
KERNEL, SHARE = np.array([1.0, 2.0, 3.0, 2.0, 1.0]) / 9, 0.5
#: Share of linked characters above which a block is a menu entry; the share of content text that the article's element must hold.
MOST_LINKED, HELD = 0.6, 0.8
#: Share of a page's text above which an element is no advert or menu, whatever its name; that share where the
#: title or an article element stands elsewhere.
MOST, NEARLY_ALL = 0.5, 0.9
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Open elements that are looked through for one that a tag without an end closes.
LOOK_BACK = 64
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


class Block:
    __slots__ = ("path", "node", "text", "linked", "heading")

    def __init__(self, path: int, node: int, text: str, linked: float, heading: bool):
        self.path, self.node, self.text, self.linked, self.heading = path, node, text, linked, heading


class Node:
    """An element: its parent, whether it or one above is dropped whatever it holds, and whether its name hints at it."""

    __slots__ = ("parent", "tag", "path", "dropped", "hinted", "article")

    def __init__(self, parent: int, tag: str, path: int, dropped: bool, hinted: bool, article: bool):
        self.parent, self.tag, self.path, self.dropped, self.hinted, self.article = parent, tag, path, dropped, hinted, article


def hints(name: str) -> bool:
    """Whether one class or id names something beside an article: only words of both lists, and one of HINTS."""
    words = [w.lower() for w in WORD.findall(name)]
    return any(w in HINTS for w in words) and all(w in HINTS or w in BESIDE or w.isdigit() for w in words)


def _marks(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """(dropped whatever it holds, named like something beside an article)."""
    if tag in DROPPED or (tag == "header" and not in_article):
        return True, False
    if not attributes.strip() or tag in ("html", "body"):
        return False, False
    hinted = False
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True, False
        if name == "role" and value.lower() in ROLES:
            return True, False
        if name in ("class", "id") and tag not in ARTICLE:
            hinted = hinted or any(map(hints, value.split()))
    return False, hinted


class Page:
    """The blocks of a page in order, white space collapsed, character references decoded; and its elements.

    Paths are numbered by parent path and tag, and elements name their parent, so the cost does not
    grow with the depth of a page.
    """

    def __init__(self, page: str):
        self.nodes = [Node(-1, "", 0, False, False, False)]
        self.blocks: list[Block] = []
        self.paths: dict[tuple[int, str], int] = {}
        self._read(page)

    def _enter(self, parent: int, tag: str, dropped: bool, hinted: bool) -> int:
        above = self.nodes[parent]
        path = self.paths.setdefault((above.path, tag), len(self.paths) + 1)
        self.nodes.append(Node(parent, tag, path, above.dropped or dropped, hinted, above.article or tag in ARTICLE))
        return len(self.nodes) - 1

    def _read(self, page: str) -> None:
        stack = [0]
        there: Counter[str] = Counter()  # open elements by tag
        parts: list[str] = []
        # Open spans and labels: tag, depth of the stack before, and what its block held before a marked one.
        spans: list[tuple[str, int, list[str] | None, int]] = []
        linked = links = at = 0
        nodes = self.nodes

        def flush() -> None:
            nonlocal linked
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                top = nodes[stack[-1]]
                self.blocks.append(Block(top.path, stack[-1], text, min(1.0, linked / len(text)), top.tag in HEADINGS))
            linked = 0

        def cut(depth: int) -> None:
            for n in stack[depth:]:
                there[nodes[n].tag] -= 1
            del stack[depth:]

        def leave() -> None:
            """End the last span; the block that a marked one has interrupted goes on."""
            nonlocal linked
            _, depth, held, before = spans.pop()
            if held is not None:
                flush()
                cut(depth)
                parts.extend(held)
                linked = before

        def close(upto: int) -> None:
            while spans and (spans[-1][1] > upto or (spans[-1][1] == upto and spans[-1][2] is not None)):
                leave()
            flush()
            cut(upto)

        def enter(tag: str, dropped: bool, hinted: bool) -> None:
            there[tag] += 1
            stack.append(self._enter(stack[-1], tag, dropped, hinted))

        while at < len(page):
            m = TOKEN.search(page, at)
            piece = page[at : m.start() if m else len(page)]
            if piece:
                parts.append(piece)
                linked += len(piece) if links else 0
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            end, tag, attributes = bool(m[1]), m[2].lower(), m[3]
            if tag in RAW:
                if not end and not attributes.rstrip().endswith("/"):
                    stop = RAW_END[tag].search(page, at)
                    at = stop.end() if stop else len(page)
            elif tag == "br":
                parts.append(" ")
            elif tag in VOID and tag != "hr":
                continue
            elif tag in ("span", "label"):
                if end:
                    for i in range(len(spans) - 1, max(-1, len(spans) - 1 - LOOK_BACK), -1):
                        if spans[i][0] == tag:
                            while len(spans) > i:
                                leave()
                            break
                elif any(marks := _marks("span", attributes, True)):
                    spans.append((tag, len(stack), parts.copy(), linked))
                    parts.clear()
                    linked = 0
                    enter(tag, *marks)
                else:
                    spans.append((tag, len(stack), None, 0))
            elif tag in INLINE:
                if tag == "a":
                    links = max(0, links + (-1 if end else 1))
            elif end:
                if there[tag]:
                    i = len(stack) - 1
                    while nodes[stack[i]].tag != tag:
                        i -= 1
                    close(i)
                    links = 0
            else:
                flush()
                last = len(stack) - 1
                while tag == "p" and last > 0 and nodes[stack[last]].tag in ("span", "label"):  # marked, without an end
                    last -= 1
                if tag in ENDS_P and last > 0 and nodes[stack[last]].tag == "p":
                    close(last)
                if tag in ENDS_OWN:
                    for i in range(len(stack) - 1, max(0, len(stack) - 1 - LOOK_BACK), -1):
                        if nodes[stack[i]].tag in ENDS_OWN[tag]:
                            close(i)
                            break
                        if nodes[stack[i]].tag in CONTAINS:
                            break
                if tag != "hr":
                    links = 0
                    enter(tag, *_marks(tag, attributes, nodes[stack[-1]].article))
        close(1)
        flush()

    def sums(self, weights: dict[int, float]) -> np.ndarray:
        """For every element the sum of the weights of the elements in it, itself included."""
        out = np.zeros(len(self.nodes))
        for n, w in weights.items():
            out[n] += w
        for n in range(len(self.nodes) - 1, 0, -1):
            out[self.nodes[n].parent] += out[n]
        return out

    def inside(self, root: int) -> np.ndarray:
        """Which elements lie in ``root``, itself included."""
        out = np.zeros(len(self.nodes), bool)
        for n, node in enumerate(self.nodes):
            out[n] = n == root or (node.parent >= 0 and out[node.parent])
        return out


def content_paths(blocks: list[Block]) -> set[int]:
    """The tag paths whose smoothed, fused ratio of text and punctuation reaches the threshold."""
    paths = {p: i for i, p in enumerate(dict.fromkeys(b.path for b in blocks))}
    which = np.array([paths[b.path] for b in blocks])
    own = np.array([len(b.text) * (1 - b.linked) for b in blocks])
    marks = np.array([len(PUNCTUATION.findall(b.text)) for b in blocks], float)
    count = np.bincount(which)
    text, punctuation = np.bincount(which, own) / count, np.bincount(which, marks) / count
    smooth = lambda x: np.convolve(np.pad(x[which], 2, mode="edge"), KERNEL, "valid")
    fused = np.sqrt(smooth(text) * (1 + smooth(punctuation))) * np.log1p(text[which])
    per_path = np.bincount(which, fused) / count
    limit = SHARE * float((fused * own).sum() / max(1.0, own.sum()))
    return {p for p, i in paths.items() if per_path[i] >= limit}


def extract(page: str) -> str:
    """The main text of one page: its blocks in order, joined by newlines; empty without any.

    In an article or main element every block stays that no mark removes. Where the article is another
    element, menus of links go too, and so does what stands before the first and after the last block
    of a content path, but for headings before and text without links after it.
    """
    found = Page(page)
    nodes = found.nodes
    blocks = [b for b in found.blocks if not nodes[b.node].dropped]
    if not blocks:
        return ""
    own = Counter()
    for b in blocks:
        own[b.node] += len(b.text)
    whole = found.sums(own)
    titled = found.sums(Counter(b.node for b in blocks if nodes[b.node].tag == "h1"))
    articles = found.sums({n: 1 for n, node in enumerate(nodes) if node.tag in ARTICLE and whole[n]})

    def vetoed(size: np.ndarray, total: float) -> np.ndarray:
        """Elements in a hinted one, but for hinted ones that hold most of the content, its title or an article."""
        out = np.zeros(len(nodes), bool)
        for n, node in enumerate(nodes):
            most = MOST if titled[0] == titled[n] and articles[0] == articles[n] else NEARLY_ALL
            kept = size[n] > most * total or titled[n] or articles[n]
            out[n] = (node.parent >= 0 and out[node.parent]) or (node.hinted and not kept)
        return out

    gone = vetoed(whole, whole[0])
    blocks = [b for b in blocks if not gone[b.node]]
    chosen = content_paths(blocks)
    held = Counter()
    for b in blocks:
        if b.path in chosen and b.linked <= MOST_LINKED:
            held[b.node] += len(b.text)
    size = found.sums(held)
    total = size[0]
    leaves = {b.node for b in blocks}
    holders = [n for n in range(1, len(nodes)) if total and size[n] >= HELD * total]  # one below the other
    tagged = [n for n in holders if nodes[n].tag in ARTICLE]
    if tagged:
        inside = found.inside(tagged[-1])
        return "\n".join(b.text for b in blocks if inside[b.node])
    parts = [b for b in blocks if nodes[b.node].article]
    if sum(len(b.text) for b in parts) >= MOST * total and parts:  # several articles share the content
        return "\n".join(b.text for b in parts)
    root = next((n for n in reversed(holders) if n not in leaves), 0)
    inside = found.inside(root)
    blocks = [b for b in blocks if inside[b.node]]
    places = [i for i, b in enumerate(blocks) if b.path in chosen and b.linked <= MOST_LINKED]
    if not places:
        return "\n".join(b.text for b in blocks)
    first = places[0]
    while first and blocks[first - 1].heading:
        first -= 1
    kept = []
    for i, b in enumerate(blocks):
        menu = b.linked > MOST_LINKED and b.path not in chosen
        if (first <= i and not menu) or (i < first and b.heading and nodes[b.node].tag == "h1"):
            kept.append(b.text)
    return "\n".join(kept)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per page, from the whole html.

    Null and empty pages have an empty text, n_chars 0. Unclosed and stray tags, cut-off pages and
    text without any tag are handled. Other columns are ignored; repeated ids give repeated rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            text = [extract(x) if x else "" for x in f.html]
            yield pd.DataFrame({"page_id": f.page_id, "url": f.url, "text": text, "n_chars": [len(t) for t in text]})
        tx.give_back()

    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return p.mapInPandas(run, "page_id long, url string, text string, n_chars long")
