"""Main text of web pages by composite text density.

A page is parsed into a tree that forgives what pages get wrong (unclosed and stray tags, stray signs). For
every node, with C characters and T tags below it, LC of the characters and LT of the tags in links, and the
whole body's C_b and LC_b, the composite density is

    C / T * log(C / LC * T / LT) / log(ln(C / (C - LC) * LC + LC_b / C_b * C + e))

(zero divisors count as one, and so does a last divisor below one): characters per tag, less where text is in links. A node's density sum adds the
densities of its children. The node with the largest sum is the core. The threshold is the least density
on the path from the core up to the body: the core widens to the highest node on that path where a child beside the path
reaches it, or where all that is beside it are headings, whatever lies between. Where the core then lies in an article or main element, that
innermost one is taken: density chooses which.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are left out by
their elements and by the words in their class, id and role, before densities are computed; so are lists outside
articles that are mostly links. A header inside the article leaves its headings. Within an article or main element,
and in the core of a page without one once it is found, words drop only containers (no headings, paragraphs, inline
elements or code) whose class, id or role says nothing else, or that are mostly links.

Text: character references decoded; white space inside a block (line break elements too) becomes one space; blocks that
aren't empty are joined by newlines. Null and empty pages, and pages without a body's text, give an empty text. Depth is not
limited. Repeated rows get equal results; an empty table works; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices

# Elements by their kind in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template svg math".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
DROP = frozenset("aside audio button canvas dialog embed footer form head iframe input link math menu meta nav noscript object script select style svg template textarea title video xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
HOLDERS = frozenset("html body main article".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
# Words in a class, id or role that name what isn't the article.
NAMES = frozenset("ad ads adsense advert advertisement advertising adverts aside banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright disqus footer form gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related reply respond search share sharing sidebar skip social sponsor sponsored subscribe toolbar widget widgets".split())

# Within an article, elements that a name may drop as a whole, and words that say nothing beside a name.
CONTAINERS = frozenset("details div dl fieldset figure ol section table ul".split())
FILLERS = frozenset("area article bar block blog body bottom box buttons column container content entry group inner item items left links list main outer page panel post right section site slot top unit wrap wrapper".split())
TITLES = frozenset("banner header masthead".split())  # names of what an article's own head may be

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/><]*+)((?>[^<>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+)>|<[!?/][^<>]*+>|<[a-zA-Z/!?][^<>]*+\Z""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _kind(tag: str, attributes: str, in_article: bool) -> int:
    """1: to be dropped; 2 and 3: named as boilerplate, 3 by a whole name; else 0."""
    if tag in DROP or tag == "header" and not in_article:
        return 1
    if not attributes or tag in HOLDERS:
        return 0
    kind = 0
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return 1
        if name in ("class", "id", "role"):
            for word in value.split():
                parts = set(_SPLIT.split(_CAMEL.sub(" ", word).lower())) - {""}
                if parts & NAMES:
                    kind = 3 if kind == 3 or parts & NAMES - TITLES and parts <= NAMES | FILLERS else 2
    return kind


class Stack:
    """The open elements, outermost first; where[tag] has the places of those with a tag, blocks those of block elements.

    So whether an element is open, and where, is known without a walk, however deep a page is.
    """

    def __init__(self) -> None:
        self.nodes, self.tags = [0], ["body"]
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: int, tag: str) -> None:
        self.where.setdefault(tag, []).append(len(self.nodes))
        if tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def last(self, tag: str) -> int:
        """The innermost place of a tag; 0 if it isn't open."""
        found = self.where.get(tag)
        return found[-1] if found else 0

    def cut(self, place: int) -> None:
        """Ends the element at a place and all within it."""
        while len(self.nodes) > place:
            self.nodes.pop()
            tag = self.tags.pop()
            self.where[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def end_within(self, names: tuple[str, ...], stops: tuple[str, ...]) -> None:
        """Ends the outermost open element of these names above the innermost stop."""
        floor = max(map(self.last, stops))
        above = [found[i] for found in (self.where.get(n, []) for n in names) if (i := bisect_right(found, floor)) < len(found)]
        if above:
            self.cut(min(above))


class Page:
    """Nodes in page order; 0 is the body. parts: texts (str, decoded) and children (int) of each node."""

    def __init__(self, source: str):
        self.tags, self.parents, self.parts = ["body"], [-1], [[]]
        self.kinds, self.dropped = [0], [False]
        self._parse(source)
        self.within, self.code = [False], [False]
        for i in range(1, len(self.tags)):
            tag, p = self.tags[self.parents[i]], self.parents[i]
            self.within.append(self.within[p] or tag in ("article", "main"))
            self.code.append(self.code[p] or tag in ("pre", "code"))

    def _parse(self, source: str) -> None:
        stack, at, find = Stack(), 0, _TOKEN.search
        while True:
            m = find(source, at)
            text = source[at : m.start()] if m else source[at:]
            if text:
                self.parts[stack.nodes[-1]].append(html.unescape(text))
            if m is None:
                return
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(stack, tag)
            elif tag in ("html", "body"):
                continue
            else:
                self._open(stack, tag, m[3])
                if tag in RAW and not m[3].endswith("/"):
                    end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(source, at)
                    at = end.end() if end else len(source)
                    self._close(stack, tag)

    def _open(self, stack: Stack, tag: str, attributes: str) -> None:
        if tag in BLOCK and stack.blocks and stack.tags[stack.blocks[-1]] == "p":
            stack.cut(stack.blocks[-1])  # a block ends the paragraph that is open around it
        if tag in CLOSES:
            stack.end_within(CLOSES[tag], STOPS[tag])
        parent, node = stack.nodes[-1], len(self.tags)
        self.tags.append(tag)
        self.parents.append(parent)
        self.parts.append([])
        self.kinds.append(_kind(tag, attributes, stack.last("article") > 0))
        self.parts[parent].append(node)
        if tag not in VOID and not attributes.endswith("/"):
            stack.push(node, tag)

    def _close(self, stack: Stack, tag: str) -> None:
        place = stack.last(tag)
        # an inline element that was opened outside the innermost block isn't ended within it
        if place and (tag in BLOCK or not stack.blocks or place > stack.blocks[-1]):
            stack.cut(place)

    def measures(self) -> tuple[list[int], list[int], list[int], list[int]]:
        """Characters, tags, characters in links and tags in links below each node, without what is dropped."""
        n = len(self.tags)
        c, t, lc, lt = [0] * n, [0] * n, [0] * n, [0] * n
        linked = [False] * n
        for i in range(n):
            linked[i] = self.tags[i] == "a" or i > 0 and linked[self.parents[i]]
            if not self.dropped[i]:
                c[i] = sum(len(" ".join(x.split())) for x in self.parts[i] if isinstance(x, str))
                lc[i] = c[i] if linked[i] else 0
        for i in range(n - 1, 0, -1):
            if not self.dropped[i]:
                p = self.parents[i]
                c[p] += c[i]
                lc[p] += lc[i]
                t[p] += t[i] + 1
                lt[p] += lt[i] + (self.tags[i] == "a")
        return c, t, lc, lt

    def _settle(self, links: list[bool]) -> None:
        """What is dropped: what its kind says, and link lists; within an article, of what is named only containers that are boilerplate as a whole."""
        n = len(self.tags)
        self.dropped = [False] * n
        for i in range(1, n):
            self.dropped[i] = self.dropped[self.parents[i]] or self.kinds[i] == 1 or links[i]
        if any(k > 1 for k in self.kinds):
            c, _, lc, _ = self.measures()
            for i in range(1, n):
                whole = not self.within[i] or self.tags[i] in CONTAINERS and not self.code[i] and (self.kinds[i] == 3 or lc[i] > 0.5 * c[i])
                self.dropped[i] = self.dropped[i] or self.dropped[self.parents[i]] or self.kinds[i] > 1 and whole

    def core(self) -> int:
        """The node that holds the main text."""
        n = len(self.tags)
        self._settle([False] * n)
        c, t, lc, lt = self.measures()
        # outside an article, lists of links are menus, whatever they are called
        links = [not self.within[i] and self.tags[i] in ("ul", "ol", "table") and lt[i] >= 3 and lc[i] > 0.8 * c[i] for i in range(n)]
        self._settle(links)
        core = self._densest()
        if core and self.tags[core] not in ("article", "main"):  # without an article, the core is one
            for i in range(1, n):
                self.within[i] = self.within[i] or self.parents[i] == core or self.parents[i] > 0 and self.within[self.parents[i]]
            self._settle(links)
        return core

    def _densities(self) -> list[float]:
        c, t, lc, lt = self.measures()
        base = lc[0] / max(1, c[0])

        def density(i: int) -> float:
            if self.dropped[i] or not c[i]:
                return 0.0
            wide = math.log(max(1.0, c[i] / max(1, c[i] - lc[i]) * lc[i] + base * c[i] + math.e))
            return c[i] / max(1, t[i]) * math.log(max(1.0, c[i] / max(1, lc[i]) * max(1, t[i]) / max(1, lt[i]))) / max(1.0, math.log(wide))

        return [density(i) for i in range(len(self.tags))]

    def _core_of(self, each: list[float]) -> int:
        """The node with the largest sum of its children's densities; the first of equals."""
        total = [0.0] * len(each)
        for i in range(1, len(each)):
            total[self.parents[i]] += each[i]
        return max(range(len(each)), key=lambda i: (round(total[i], 6), -i))

    def _densest(self) -> int:
        each = self._densities()
        core = node = self._core_of(each)
        least = min(each[i] for i in self._up(core))
        while node:
            parent = self.parents[node]
            beside = [x for x in self.parts[parent] if isinstance(x, int) and x != node and each[x] > 0]
            dense = [x for x in beside if each[x] >= least]
            titles = [x for x in beside if self.tags[x] in HEADINGS]
            if dense or titles and len(titles) == len(beside):
                core = parent
            node = parent
        # an element that says it is the article has what is less dense in it, such as its title
        return next((i for i in self._up(core) if self.tags[i] in ("article", "main")), core)

    def _up(self, node: int) -> Iterator[int]:
        while node >= 0:
            yield node
            node = self.parents[node]

    def blocks(self, core: int) -> list[str]:
        out: list[str] = []
        now: list[str] = []

        def end() -> None:
            text = " ".join("".join(now).split())
            if text:
                out.append(text)
            now.clear()

        work: list[tuple[int, int, bool]] = [(core, 0, False)]  # node, next part, whether only headings count
        while work:
            node, k, only = work.pop()
            parts = self.parts[node]
            while k < len(parts):
                x = parts[k]
                k += 1
                if isinstance(x, str):
                    if not only:
                        now.append(x)
                    continue
                if self.dropped[x]:
                    continue
                tag = self.tags[x]
                if tag in BLOCK:
                    end()
                elif tag in ("br", "img"):
                    now.append(" ")
                inner = (only or tag == "header") and tag not in HEADINGS
                if self.parts[x]:
                    work.append((node, k, only))
                    work.append((x, 0, inner))
                    break
            else:
                if self.tags[node] in BLOCK:
                    end()
        end()
        return out


def main_text(source: str) -> str:
    page = Page(source.replace("\x00", ""))
    return "\n".join(page.blocks(page.core()))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(x or "") for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
