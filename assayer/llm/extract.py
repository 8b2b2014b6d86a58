"""Main text of HTML pages by line-block distribution.

Markup is stripped so that every block of text is a line. A line's length counts without
the text of its links (but for a paragraph's or a headline's), and not at all where
markup says that it is a menu, a notice, a form and so on; such elements stand between
empty lines. The lengths are summed over a
sliding window of lines. Where the sum surges from nothing, text begins; where it dives
to nothing again, text ends; all lines between the two points are kept, and no others. A
page has as many such stretches as it has breaks.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines in a window, and empty lines around an element that is set aside.
WINDOW = 3
GAP = WINDOW + 1

# Names of HTML elements by their role.
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "noembed", "noframes"}
DROPPED = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "textarea", "fieldset", "label", "audio", "video"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "col", "colgroup", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Void elements that end a line.
BREAKS = {"br", "hr"}
#: Elements whose end tag may be left out, and the tags that then end them.
CLOSED_BY = {"p": {"p", "div", "ul", "ol", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "form", "footer", "header", "aside", "nav", "hr", "main"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
ARTICLE = {"article", "main"}
#: Blocks whose links are text as any other.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "figcaption", "pre"}

#: Words that name what is no article text in a class, id or role.
ASIDE_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertisements", "advertising", "adsense", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "commentlist", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "disclaimer", "discussion", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pager", "pagination", "popup", "promo", "promoted", "promotion", "related", "replies", "reply", "respond", "responses", "search", "share", "sharing", "sidebar", "sidebars", "signup", "skip", "social", "sponsor", "sponsored", "subnav", "subscribe", "subscription", "toolbar", "topbar", "topnav", "widget", "widgets"}
#: Those that do so as the first word of several, whatever follows.
FIRST_WORDS = {"ad", "ads", "advert", "advertisement", "comments", "cookie", "cookies", "disqus", "footer", "gdpr", "menu", "nav", "navbar", "newsletter", "sidebar", "sponsored", "widget"}
#: Words after such a word that say no more than that it is an element.
SHAPES = {"area", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "copy", "group", "holder", "icons", "inner", "item", "items", "left", "links", "list", "main", "message", "module", "outer", "overlay", "panel", "posts", "region", "right", "row", "section", "slot", "stories", "text", "thread", "top", "trail", "unit", "wrap", "wrapper"}
#: Those that inside an article may as well name a part of its text: a recipe's menu, a paper's
#: discussion. There the lines decide, by their lengths without links.
DOUBTFUL_INSIDE = {"breadcrumb", "breadcrumbs", "menu", "nav", "navbar", "navigation", "pager", "pagination", "related", "search", "subnav", "toolbar", "topbar", "topnav"}
#: Those that do so as the id of a section.
DOUBTFUL_IDS = {"discussion", "notice", "notices", "responses"}
#: Of the characters of a doubtful stretch, the share that must stand outside of links.
PLAIN_SHARE = 0.5
#: A class that begins so speaks of something else than the element itself.
ABOUT_OTHERS = {"has", "with", "without", "no", "is", "not"}

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
MARKS = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Text, its characters that count (outside links, or all in prose), whether it is in an article, whether it is set
#: aside, and its characters outside links if it is doubtful, else -1.
Line = tuple[str, int, bool, bool, int]
#: What an element's marks say.
SURE, DOUBTFUL = 2, 1


def _says_aside(name: str, inside: bool, section_id: bool = False) -> int:
    """SURE if one class, id or role names what is no article text (share-bar, not share-price), DOUBTFUL if it may, else 0."""
    words = [w.lower() for w in WORDS.findall(name)]
    if not words or words[0] in ABOUT_OTHERS:
        return 0
    while len(words) > 1 and words[-1] in SHAPES:
        words.pop()
    if inside and words[-1] == "header":
        return 0
    if inside and (words[-1] in DOUBTFUL_INSIDE or section_id and words[-1] in DOUBTFUL_IDS):
        return DOUBTFUL
    return SURE if words[-1] in ASIDE_WORDS or words[0] in FIRST_WORDS else 0


def _set_aside(name: str, attributes: str, inside: bool, by_class: bool) -> int:
    """SURE for elements whose text isn't the article's, DOUBTFUL where their lines have to tell, else 0.

    A header inside the article is its own.
    """
    if name in DROPPED:
        return 0 if inside and name == "header" else SURE
    if not attributes or name in ("html", "body", *ARTICLE):
        return 0
    most = 0
    for m in MARKS.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return SURE
        if key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return SURE
        if key in ("class", "id", "role") and by_class:
            most = max(most, *[_says_aside(one, inside, key == "id" and name == "section") for one in value.split()], 0)
    return most


class _Page:
    """Open elements and lines of one page, tag by tag."""

    def __init__(self, by_class: bool) -> None:
        self.by_class = by_class
        self.lines: list[Line] = []
        self.text: list[tuple[str, bool]] = []
        # Open elements; None for one that was closed out of turn. Places by name and of blocks.
        self.stack: list[str | None] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.aside_at = self.doubt_at = self.links = self.inside = 0
        self.any_inside = False

    def add(self, text: str) -> None:
        self.text.append((text, self.links > 0))

    def end_line(self) -> None:
        if self.text:
            whole = " ".join(entities.unescape("".join(t for t, _ in self.text)).split())
            if whole:
                prose = bool(self.blocks) and self.stack[self.blocks[-1]] in PROSE
                plain = whole if prose else " ".join(entities.unescape("".join(t for t, linked in self.text if not linked)).split())
                outside = len(" ".join(entities.unescape("".join(t for t, linked in self.text if not linked)).split())) if self.doubt_at else -1
                self.lines.append((whole, len(plain), self.inside > 0, self.aside_at > 0, outside))
            self.text.clear()

    def gap(self) -> None:
        self.lines.extend([("", 0, False, False, -1)] * GAP)

    def pop(self) -> None:
        name = self.stack[-1]
        if name is not None:
            if name in BLOCK or len(self.stack) in (self.aside_at, self.doubt_at):
                self.end_line()
            self.places[name].pop()
            if name in BLOCK:
                self.blocks.pop()
            self.links -= name == "a"
            self.inside -= name in ARTICLE
        self.stack.pop()
        if len(self.stack) < self.aside_at:
            self.aside_at = 0
            self.gap()
        if len(self.stack) < self.doubt_at:
            self.doubt_at = 0
            self.gap()

    def end_tag(self, name: str) -> None:
        if not self.places[name]:
            if name in BLOCK:
                self.end_line()
            return
        at = self.places[name][-1]
        # An inline end tag doesn't close the blocks opened after its start.
        if name not in BLOCK and self.blocks and self.blocks[-1] > at:
            if at + 1 not in (self.aside_at, self.doubt_at):
                self.places[name].pop()
                self.links -= name == "a"
                self.stack[at] = None
            return
        while len(self.stack) > at:
            self.pop()

    def start_tag(self, name: str, attributes: str) -> None:
        while self.blocks and name in CLOSED_BY.get(self.stack[self.blocks[-1]], ()):
            for _ in range(len(self.stack) - self.blocks[-1]):
                self.pop()
        if name in BLOCK or name in BREAKS:
            self.end_line()
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            return
        says = 0 if self.aside_at else _set_aside(name, attributes, self.inside > 0, self.by_class)
        if says == SURE or says == DOUBTFUL and not self.doubt_at:
            self.end_line()
            self.gap()
            if says == SURE:
                self.aside_at = len(self.stack) + 1
            else:
                self.doubt_at = len(self.stack) + 1
        self.places[name].append(len(self.stack))
        if name in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(name)
        self.links += name == "a"
        self.inside += name in ARTICLE
        self.any_inside |= name in ARTICLE and not self.aside_at


def lines_of(page: str, by_class: bool = True) -> tuple[list[Line], bool]:
    """Lines of a page, and whether it has an article or main element.

    by_class: elements are set aside by their class, id and role too. Elements that are
    set aside stand between GAP empty lines.
    """
    state, at, n = _Page(by_class), 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            state.add(page[at:])
            break
        if m.start() > at:
            state.add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            state.end_tag(name)
        elif name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*(?:>|$)", re.I).search(page, at)
            at = close.end() if close else n
        else:
            state.start_tag(name, m[3] or "")
    while state.stack:
        state.pop()
    state.end_line()
    return state.lines, state.any_inside


def weights(lines: list[Line], marked: bool) -> list[int]:
    """What each line counts for. Where the page marks its article, other lines count nothing.

    A line of a doubtful element counts what stands outside of its links, if that is PLAIN_SHARE or more of all
    that the element holds, else nothing: so a list of links dives, and a text of the same name surges.
    """
    out = [0 if aside else len(text) * inside if marked else plain for text, plain, inside, aside, _ in lines]
    at, n = 0, len(lines)
    while at < n:
        end = at
        while end < n and lines[end][4] >= 0:
            end += 1
        if end > at:
            outside = [lines[i][4] for i in range(at, end)]
            dense = sum(outside) >= PLAIN_SHARE * sum(len(lines[i][0]) for i in range(at, end))
            out[at:end] = [w if dense and not lines[at + i][3] and (lines[at + i][2] or not marked) else 0 for i, w in enumerate(outside)]
        at = end + 1
    return out


def stretches(weight: list[int]) -> list[tuple[int, int]]:
    """Places of the first line and after the last one between each surge and the dive after it.

    The window sum of a line is that of the WINDOW lines from it on. It surges where it
    leaves nothing and dives where it is nothing again; a stretch begins and ends with a
    line that counts.
    """
    found, start, n = [], None, len(weight)
    window = sum(weight[:WINDOW])
    for i in range(n + 1):
        if start is None and i < n and window and weight[i]:
            start = i
        elif start is not None and not window:
            end = i
            while not weight[end - 1]:
                end -= 1
            found.append((start, end))
            start = None
        window += (weight[i + WINDOW] if i + WINDOW < n else 0) - (weight[i] if i < n else 0)
    return found


def main_text(page: str | None) -> str:
    """The page's article: blocks joined by a space, "" for a null, empty or textless page.

    A page that classes leave nothing of is read again without them.
    """
    if not page:
        return ""
    for by_class in (True, False):
        lines, marked = lines_of(page, by_class)
        kept = [lines[i][0] for start, end in stretches(weights(lines, marked)) for i in range(start, end) if lines[i][0] and (lines[i][2] or not marked)]
        if kept:
            return " ".join(kept)
    return ""


def extracted(html: Column) -> Column:
    """Main text of a column of whole pages; "" for null, empty and textless ones."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(main_text, na_action=None)

    return texts(F.coalesce(html.cast("string"), F.lit("")))


def extract_pages(pages: DataFrame, name: str = "main_text") -> DataFrame:
    """All rows and columns of ``pages`` (html) plus ``name``, the page's main text.

    A null, empty or textless html gives "". Pages of any length are read whole; repeated
    rows stay; an empty table gives an empty result. ``pages`` may not have a column
    ``name``.
    """
    if name.lower() in (c.lower() for c in pages.columns):
        raise ValueError(f"pages has a column {name}")
    return pages.withColumn(name, extracted(F.col("html")))
