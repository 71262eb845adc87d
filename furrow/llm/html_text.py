"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams a page's events. Block elements cut the page
into lines; each line has its text, the tags met in it, and how much of it is link
text. The text-to-tag ratio of the lines is smoothed with a Gaussian, and lines
above a threshold (half the standard deviation of the smoothed ratios) cluster
into content regions, which take in the rest of their blocks, headings before them
and short gaps. Article elements are a prior: their lines need a quarter of the
threshold, and where one has a cluster, lines outside of articles are left out. Menus, headers, footers, sidebars,
notices, adverts, forms and comments, known by element, role or class, count as
lines without text.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: HTML's block-level elements, void elements, and elements without main text.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NOT_TEXT = set("head title script style noscript template iframe object svg math canvas audio video select option textarea button datalist".split())
NOT_MAIN = set("nav footer aside menu dialog".split())
#: No main text either, unless they hold an article or most of the text.
FORMS = {"form", "fieldset"}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = set(
    "ad ads adv advert advertisement advertising adslot adsense sponsor sponsored promo promotion banner sidebar "
    "nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist "
    "respond replies disqus cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup "
    "share sharing social related recommended widget widgets pagination pager login search skip side rail crumbs topnav "
    "sidenav disclaimer".split()
)
#: Headers of pages; inside an article a header holds its heading.
OUTSIDE_ARTICLE = {"header"}
ARTICLES = {"article", "main"}
#: An open element of these ends when the next of its kind begins.
ENDS_BEFORE = {
    "p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
}
SCOPES = set("ul ol dl table div section article main body".split())

SIGMA = 1.0
THRESHOLD = 0.5
MOST_LINKS = 0.5
#: Inside an article a line needs this share of the threshold.
ARTICLE = 0.25
#: Lines of text between two clusters that belong to both.
MOST_GAP = 3

_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME = re.compile(r"[^a-z0-9]+")


class _Node:
    __slots__ = ("tag", "parent", "off", "named_off", "form", "article")

    def __init__(self, tag: str, parent: _Node | None, off: bool = False, named_off: bool = False):
        self.tag, self.parent, self.off, self.named_off = tag, parent, off, named_off
        self.form = tag in FORMS
        self.article = self if tag in ARTICLES else parent.article if parent else None


class _Line:
    __slots__ = ("node", "parts", "tags", "links")

    def __init__(self, node: _Node):
        self.node, self.parts, self.tags, self.links = node, [], 0, 0


class Lines(HTMLParser):
    """Collects a page's lines from parser events; broken nesting is mended as far as blocks need it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", None)
        self.stack = [self.root]
        self.lines = [_Line(self.root)]
        self.in_link = 0
        self.silent: list[str] = []

    def _cut(self) -> None:
        if self.lines[-1].parts:
            self.lines.append(_Line(self.stack[-1]))
        else:
            self.lines[-1].node = self.stack[-1]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.lines[-1].tags += 1
        if tag in NOT_TEXT:
            self.silent.append(tag)
            return
        if self.silent and tag in ("body", "article", "main", "header", "nav", "p", "div") and "head" in self.silent:
            self.silent.clear()  # a head that was never closed
        if tag == "a":
            self.in_link += 1
        elif tag == "br":
            self.lines[-1].parts.append(" ")
        if tag not in BLOCKS:
            return
        while len(self.stack) > 1 and tag in ENDS_BEFORE.get(self.stack[-1].tag, ()):
            self.stack.pop()
        if tag not in VOID:
            self.stack.append(self._node(tag, dict(attrs)))
        self._cut()
        self.lines[-1].tags += 1

    def _node(self, tag: str, attrs: dict[str, str | None]) -> _Node:
        parent = self.stack[-1]
        off = tag in NOT_MAIN or (attrs.get("role") or "").lower() in ROLES
        off |= tag in OUTSIDE_ARTICLE and parent.article is None
        off |= "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(_HIDDEN.search(attrs.get("style") or ""))
        named = False
        if tag not in ("html", "body", "article", "main"):
            classes, own = (attrs.get("class") or "").lower(), (attrs.get("id") or "").lower()
            if parent.article is None:
                named = not (NAMES | OUTSIDE_ARTICLE).isdisjoint(_NAME.split(f"{classes} {own}"))
            else:  # here ids are anchors: one like "related-work" has to be made of such names alone
                named = _all_names(own) or (
                    any(map(_all_names, classes.split())) if tag in HEADINGS else not NAMES.isdisjoint(_NAME.split(classes))
                )
        elif tag == "article":
            named = not {"comment", "comments", "reply"}.isdisjoint(_NAME.split((attrs.get("class") or "").lower()))
        node = _Node(tag, parent, off, named)
        if tag in ARTICLES and not named:
            up: _Node | None = parent
            while up is not None:  # what holds an article isn't an advert, whatever its class
                up.named_off, up.form, up = False, False, up.parent
        return node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag not in BLOCKS:  # a self-closed svg silences nothing after it
            if tag in VOID or tag != "a":
                self.lines[-1].tags += 1
                if tag == "br":
                    self.lines[-1].parts.append(" ")
                return
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.lines[-1].tags += 1
        if tag in NOT_TEXT:
            if tag in self.silent:
                while self.silent.pop() != tag:
                    pass
            return
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
        if tag not in BLOCKS:
            return
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].tag == tag:
                del self.stack[at:]
                break
            if tag in ENDS_BEFORE and self.stack[at].tag in SCOPES:
                break
        if tag in SCOPES:
            self.in_link = 0
        self._cut()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.lines[-1].parts.append(data)
            if self.in_link:
                self.lines[-1].links += len("".join(data.split()))


def _all_names(name: str) -> bool:
    words = [w for w in _NAME.split(name) if w]
    return bool(words) and NAMES.issuperset(words)


def _free_forms(lines: list[_Line]) -> None:
    """Forms that hold most of the page's text are its frame, not a form of it."""
    total, sizes = 0, {}
    for line in lines:
        forms, node, n = [], line.node, len("".join("".join(line.parts).split()))
        while node is not None and not (node.off or node.named_off):
            if node.form:
                forms.append(node)
            node = node.parent
        if node is None:
            total += n
            for form in forms:
                sizes[form] = sizes.get(form, 0) + n
    for form, n in sizes.items():
        form.form = 2 * n <= total


def _off(node: _Node | None) -> bool:
    while node is not None:
        if node.off or node.named_off or node.form:
            return True
        node = node.parent
    return False


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(2 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def main_text(html: str | None) -> str:
    """The main text's blocks, joined by two newlines. Null, empty and text-free pages give an empty text."""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    _free_forms(parser.lines)
    lines = []
    for line in parser.lines:
        text = " ".join("".join(line.parts).split())
        if text:
            lines.append((line, "" if _off(line.node) else text))
    if not any(text for _, text in lines):
        return ""
    raw = np.array([len(text) / max(1, line.tags) for line, text in lines], float)
    ratios = smoothed(raw)
    limit = THRESHOLD * ratios.std()
    content = ratios > limit
    # Articles are a prior: their lines need less, and where one has a cluster, only articles do.
    inside = np.array([line.node.article is not None for line, _ in lines])
    shown = np.array([bool(text) for _, text in lines])
    plain = np.array([line.links <= MOST_LINKS * len("".join(text.split())) for line, text in lines])
    seeds = shown & plain & content
    of = inside if (seeds & inside).any() else ~inside if (seeds & ~inside).any() else np.ones(len(lines), bool)
    seeds &= of
    if not seeds.any():
        seeds[max(range(len(lines)), key=lambda i: len(lines[i][1]))] = True
    # A line mostly of links outside articles counts if it is long itself, or stands beside other text in one block.
    beside = {(line.node.parent, line.node.tag) for (line, _), seed in zip(lines, seeds, strict=True) if seed}
    linked = np.array([(line.node.parent, line.node.tag) in beside for line, _ in lines]) | (raw > limit)
    may = shown & of & (plain | inside | linked)
    kept = may & (seeds | (ratios > np.where(inside, ARTICLE, 1.0) * limit))
    # A line that is long itself takes in those on both sides that stand in one block with it; a cluster, the headings before it.
    block = seeds & (raw > limit) if (seeds & (raw > limit)).any() else seeds.copy()
    for step in (1, -1):
        for at in range(len(lines))[::step]:
            by = at - step
            if may[at] and 0 <= by < len(lines):
                block[at] |= block[by] and _siblings(lines[at][0], lines[by][0])
                kept[at] |= block[at] or step < 0 and kept[by] and lines[at][0].node.tag in HEADINGS
    # Clusters with a short gap between them, all of it text, are one.
    ends = np.flatnonzero(kept)
    for a, b in zip(ends, ends[1:], strict=False):
        if 1 < b - a <= MOST_GAP + 1 and may[a + 1 : b].all():
            kept[a:b] = True
    return "\n\n".join(text for (_, text), keep in zip(lines, kept, strict=True) if keep)


def _siblings(a: _Line, b: _Line) -> bool:
    """Whether two lines stand side by side in one block: a short paragraph belongs to the long ones beside it."""
    return a.node is b.node or a.node.parent is b.node.parent and a.node.parent is not None


def extracted(htmls: pa.Array) -> pa.Array:
    return pa.array([main_text(h.as_py()) for h in htmls], pa.string())


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages with the main text of each page in the column ``text`` (replaced where there is one) and its n_chars.

    Each page is worked off by itself, whole and whatever its length or nesting, so no
    shuffle. Null and empty pages give an empty text of 0 characters. Repeated pages
    give equal texts; an empty table gives an empty result. Other columns pass through.
    """
    return pages.withColumn(text, F.arrow_udf(extracted, "string")(F.col(html))).withColumn(
        "n_chars", F.char_length(text).cast("long")
    )
