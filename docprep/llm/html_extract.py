"""Main text of web pages by tag-path ratios.

A page is read into text blocks, each with its path of tags from the root (class names included). Per path,
text length and punctuation are summed over its blocks and divided by their count; the two ratios are smoothed
over the paths in page order, multiplied and compared with a threshold drawn from their spread. Paths above it are
content. Text in elements made for something else (navigation, forms, scripts ...) has no weight. A class, id or role
that says so only lowers the ratio of the paths below it; the ratio decides whether the element stays, and the
name counts for nothing on an element that holds half the content text. Forms, field sets, headers and menus count for nothing
either, unless one holds three quarters of the content text: then it is wrapped round the page. (A header inside an article is a header: it
goes, with the title in it.) The article is the element that holds most
content text; all its other blocks, short ones too, belong to it.

Elements form a tree of numbers that grow inwards; every sum over what an element holds is one pass from the last number to the first,
so the work is in proportion to the page, however deep it nests.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprep.llm.common import by_rows

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SILENT = frozenset("script style noscript template head title iframe object annotation annotation-xml canvas audio video select textarea datalist button".split())
OTHER = frozenset("nav footer aside dialog search".split())
#: Elements that are no article text either, but may be wrapped round a whole page.
WRAPPERS = frozenset("form fieldset header menu".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: Elements that a new one of the same group ends.
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("thead", "tbody", "tfoot", "tr", "td", "th"), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tfoot", "tr", "td", "th")}
SCOPES = frozenset("html body table td th ul ol dl div article section main aside nav header footer form".split())
#: Elements that may hold a whole article.
ROOTS = frozenset("html body main article section div td center".split())
#: Words in class names, ids and roles of elements that are often no article text.
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar\w*|side|aside|footer\w*|foot|header|masthead|topbar|toolbar|"
    r"cookies?|consent|gdpr|notice\w*|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|comments?|commentlist|respond|replies|reply|disqus|discussion|related|recommend\w*|"
    r"share\w*|sharing|social|widget\w*|pagination|pager|complementary|contentinfo|search|skip|hidden|copyright|legal|disclaimer|outbrain|taboola|form)(?:$|[\s_-])"
)
#: Those of them that as often name a part of an article.
PLAIN = re.compile(r"side|aside|foot|header|notice\w*|alert|overlay|banner|respond|repl(?:y|ies)|discussion|related|recommend\w*|share\w*|sharing|social|search|skip|hidden|copyright|legal|disclaimer|form|nav|login|signup")
#: What is left of a path's ratio below a name of the two sorts.
DOUBTFUL, UNLIKELY = 0.5, 0.1
#: And below a wrapper: next to nothing.
WRAPPED = 1e-9
_SPACE = re.compile(r"\s+")
_SIGNS = re.compile(r"[.,;:!?…。，、；：！？¿¡]")


#: A comment, a tag with its attributes (quotes may hold ">"; else up to the next ">"), or another declaration.
_MARKUP = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^'">])*+|[^>]*+)>|[!?/][^>]*+>)""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Elements whose content is no markup.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
_HIDING = re.compile(r"display\s*:\s*none")


class Element(NamedTuple):
    """An element that shapes blocks: its parent's number, path, step, whether it is apart, what its name leaves (0: all)."""

    parent: int
    path: int
    step: str
    other: bool
    suspect: float
    tag: str


class Block(NamedTuple):
    element: int
    text: str


def _left_by(names: str) -> float:
    words = [w for w in re.split(r"[\s_-]+", names) if BOILERPLATE.fullmatch(w)]
    return DOUBTFUL if all(PLAIN.fullmatch(w) for w in words) else UNLIKELY


class _Reader:
    """Blocks of a page and the tree of the elements they stand in; number 0 is the page."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = []  # tag, number of the innermost element that shapes blocks
        self.open: dict[str, list[int]] = defaultdict(list)  # places in the stack of each tag
        self.tree = [Element(-1, 0, "", False, 0.0, "")]
        self.paths: dict[tuple[int, str], int] = {(-1, ""): 0}
        self.silent = 0
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.roots = {0}  # elements that may hold a whole article

    def read(self, html: str) -> None:
        at = 0
        while m := _MARKUP.search(html, at):
            if m.start() > at:
                self.data(html[at : m.start()])
            at = m.end()
            if tag := m["tag"]:
                tag = tag.lower()
                if m["end"]:
                    self.end(tag)
                else:
                    attrs = m["attrs"]
                    # In drawings and formulas a slash ends the element.
                    if attrs.endswith("/") and tag not in ("svg", "math") and (self.open["svg"] or self.open["math"]):
                        continue
                    self.start(tag, attrs)
                    if tag in RAW:
                        close = RAW[tag].search(html, at)
                        at = close.start() if close else len(html)
        if at < len(html):
            self.data(html[at:])
        self.flush()

    def data(self, text: str) -> None:
        if not self.silent:
            self.parts.append(unescape(text) if "&" in text else text)

    def inner(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            self.parts.clear()
            if text:
                self.blocks.append(Block(self.inner(), text))

    def pop_to(self, at: int) -> None:
        if self.inner() != (self.stack[at - 1][1] if at else 0):  # inline elements end no block
            self.flush()
        for tag, _ in self.stack[at:]:
            self.silent -= tag in SILENT
            self.open[tag].pop()
        del self.stack[at:]

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if tag in CLOSES_P:
            self._end_within("p", SCOPES)
        for other in SAME.get(tag, ()):
            self._end_within(other, ("table",) if tag[0] == "t" else ("ul", "ol", "dl", "select"))
        if tag in ("br", "text"):
            self.parts.append(" ")
        if tag in VOID or (tag in ("path", "svg", "math") and attributes.endswith("/")):
            return
        step, other, suspect = tag, tag in OTHER, WRAPPED if tag in WRAPPERS else 0.0
        if attributes and not attributes.isspace():
            found = {k.lower(): unescape(v.strip("\"'")).lower() for k, v in _ATTRIBUTE.findall(attributes)}
            names = " ".join(found[k] for k in ("class", "id", "role") if found.get(k))
            step = ".".join((tag, *found.get("class", "").split()))
            other |= "hidden" in found or found.get("aria-hidden") == "true" or bool(_HIDING.search(found.get("style", "")))
            if not suspect and tag not in ("article", "main", "body", "html") and BOILERPLATE.search(names):
                suspect = _left_by(names)
        apart = other or (tag in SILENT and not tag.startswith("annotation"))
        if apart or suspect:
            self.flush()
        above = self.inner()
        if tag in BLOCKS or apart or suspect:
            around = self.tree[above]
            path = self.paths.setdefault((around.path, step), len(self.paths))
            self.tree.append(Element(above, path, step, apart or around.other, suspect, tag))
            above = len(self.tree) - 1
            if tag in ROOTS or "articlebody" in attributes.lower():
                self.roots.add(above)
        self.silent += tag in SILENT
        self.open[tag].append(len(self.stack))
        self.stack.append((tag, above))

    def _nearest(self, tags) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def _end_within(self, tag: str, scopes) -> None:
        if self.open.get(tag) and self.open[tag][-1] > self._nearest(scopes):
            self.pop_to(self.open[tag][-1])

    def end(self, tag: str) -> None:
        if self.open.get(tag) and (tag in BLOCKS or self.open[tag][-1] >= self._nearest(("article", "main", "body", "td", "th"))):
            self.pop_to(self.open[tag][-1])
        elif tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")


class _Page:
    """Sums over the blocks of a page by path and by element."""

    def __init__(self, reader: _Reader):
        self.tree, self.blocks, self.roots = reader.tree, reader.blocks, reader.roots
        self.path = [e.path for e in self.tree]
        self.other = [e.other for e in self.tree]
        self.suspects = [i for i, e in enumerate(self.tree) if e.suspect]

    def downward(self, start: list, own) -> list:
        """A value for each element by ``own(number, value of the parent)``."""
        out = start
        for i in range(1, len(self.tree)):
            out.append(own(i, out[self.tree[i].parent]))
        return out

    def held(self, amounts: Iterator[tuple[int, float]]) -> list[float]:
        """What each element holds, of amounts by element."""
        out = [0.0] * len(self.tree)
        for i, n in amounts:
            out[i] += n
        for i in range(len(self.tree) - 1, 0, -1):
            out[self.tree[i].parent] += out[i]
        return out

    def left(self, trusted: set[int]) -> list[float]:
        """What names leave of the text in each element, those of ``trusted`` elements aside."""
        return self.downward([1.0], lambda i, above: above if not self.tree[i].suspect or i in trusted else min(above, self.tree[i].suspect))


def content_paths(page: _Page, spread: float = 0.5, left: list[float] | None = None) -> set[int]:
    """Paths whose smoothed, fused text and punctuation ratio is over the threshold.

    ``left``: what of the text in each element counts, see ``_Page.left``; without it names do not count.
    """
    order: dict[int, int] = {}
    for b in page.blocks:
        order.setdefault(page.path[b.element], len(order))
    length, signs, count, named = (np.zeros(len(order)) for _ in range(4))
    other = np.zeros(len(order), bool)
    for element, text in page.blocks:
        k = order[page.path[element]]
        length[k] += len(text)
        signs[k] += len(_SIGNS.findall(text))
        count[k] += 1
        other[k] |= page.other[element]
        if left is not None:
            named[k] += len(text) * (1 - left[element])
    kernel = np.array([0.05, 0.9, 0.05])

    def smooth(x: np.ndarray) -> np.ndarray:
        return np.convolve(np.pad(x, 1, mode="edge"), kernel, "valid")

    fused = smooth(length / count) * (1 + smooth(signs / count)) * np.sqrt(count) * (1 - named / length)
    fused[other] = 0
    limit = min(spread * fused.std(), fused.max())
    return {p for p, k in order.items() if fused[k] >= limit and fused[k] > 0}


def _trusted(page: _Page, good: set[int]) -> set[int]:
    """Elements whose name or tag counts for nothing, since they hold so much of the content, unless an article stands beside them."""
    content = page.held((e, len(t)) for e, t in page.blocks if page.path[e] in good and not page.other[e])
    # Text of all article elements, and what of it stands in an element or around it.
    article = page.downward([-1], lambda i, above: i if above < 0 and page.tree[i].tag in ("article", "main") else above)
    written = page.held((e, len(t)) for e, t in page.blocks if article[e] >= 0 and not page.other[e])
    out = set()
    for a in page.suspects:
        outer = article[page.tree[a].parent]
        own = written[outer] if outer >= 0 and written[a] else written[a]
        share = 3 / 4 if page.tree[a].suspect == WRAPPED else 1 / 2
        if content[a] >= share * content[0] and 4 * (written[0] - own) < content[a]:
            out.add(a)
    return out


def main_text(html: str | None) -> str:
    """The article's blocks in page order, one a line; empty when there is none."""
    reader = _Reader()
    reader.read(html or "")
    page = _Page(reader)
    if not page.blocks:
        return ""
    good, left = content_paths(page), [1.0] * len(page.tree)
    if page.suspects:
        # What holds most of the content is no side matter, whatever its name.
        trusted = _trusted(page, good)
        left = page.left(trusted)
        good = content_paths(page, left=left)
        held = page.held((e, len(t)) for e, t in page.blocks if page.path[e] in good and not page.other[e])
        whole = page.held((e, len(t)) for e, t in page.blocks)
        dropped = {a for a in page.suspects if a not in trusted and 2 * held[a] < whole[a]}
        gone = page.downward([False], lambda i, above: above or i in dropped)
        page.blocks = [b for b in page.blocks if not gone[b.element]]
    content = [b for b in page.blocks if page.path[b.element] in good and not page.other[b.element]]
    if not content:
        return ""
    weight = page.held((e, len(t) * left[e]) for e, t in content)
    reached = page.held((e, 1) for e, _ in content)
    able = [a for a in page.roots if reached[a]]
    most = max(weight[a] for a in able)
    named = [a for a in able if page.tree[a].tag in ("article", "main") and 2 * weight[a] >= most]
    # Numbers grow inwards: of equal weights the innermost.
    root = max(named or able, key=lambda a: (weight[a], a))
    within = page.downward([root == 0], lambda i, above: above or i == root)
    inside = [b for b in page.blocks if within[b.element] and not page.other[b.element]]
    if root == 0:
        # No element is the article's own: from the first to the last content block, with a heading before it.
        marks = [i for i, b in enumerate(inside) if page.path[b.element] in good]
        first, last = marks[0], marks[-1]
        while first and re.match(r"h[1-6](?:$|\.)", page.tree[inside[first - 1].element].step):
            first -= 1
        inside = inside[first : last + 1]
    return "\n".join(b.text for b in inside)


def _extract(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [main_text(h) for h in batch.column(2).to_pylist()]
    return pa.record_batch({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64(), size=len(texts))})


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from by_rows(batches, _extract, 256)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: ``page_id``, ``url``, ``text``, ``n_chars``.

    Null or empty html gives an empty text. Null ids and repeated rows keep their rows; extra columns are ignored. No
    shuffle: a page is read within its task.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_each, "page_id long, url string, text string, n_chars long")
