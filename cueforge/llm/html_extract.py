"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block-level piece of text. A line
weighs its characters outside links. The weights of WINDOW lines that follow
each other are summed; where the sums rise from zero the text surges, where
they fall to zero it dives, and the lines between a surge and its dive are one
region. A region has its highest sum as its peak.

Markup tells windows where they may not reach: a menu, header, footer, form or
other element that is boilerplate by its name leaves WINDOW empty lines, as do
the borders of an article (or the main element). Of a page that marks articles,
the one with the highest peak is the text, and of a page that marks none, all
regions are that reach SURGE, or else the highest. A class or id takes out an
element only if one of its names says nothing else than boilerplate, it is no
heading and holds no article; on a page without a marked article it must be the
smaller part of the page, or reader comments.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a window, and characters of a window that make text of it.
WINDOW, SURGE = 3, 86
#: A class takes no element out that has more than this part of a page's text outside links.
LARGE = 0.5

# Elements whose text is no text of the page.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "textarea", "title")
# Elements that are boilerplate by name.
BOILERPLATE = ("head", "nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog", "fieldset", "label")
# Roles that are boilerplate.
ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar")
# Words of a class or id that mark boilerplate.
MARKS = (
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "newsletter", "subscribe", "subscription", "signup", "login",
    "sidebar", "aside", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "header", "masthead", "footer", "comment", "comments", "respond", "replies", "disqus", "share", "sharing", "social", "related",
    "recommended", "popup", "modal", "overlay", "widget", "toolbar", "search", "skip", "copyright",
)
# Words of a class or id that mark reader comments, however long they are.
COMMENTS = ("comment", "comments", "respond", "replies", "disqus")
# Words beside those marks that say nothing of their own.
NEUTRAL = (
    "site", "page", "post", "article", "entry", "blog", "global", "top", "bottom", "left", "right", "main", "primary", "secondary", "box", "area", "block", "bar", "wrapper", "wrap", "container", "inner", "outer", "content", "list", "item", "items",
    "links", "link", "section", "panel", "text", "form", "js", "m", "l", "u",
)
# Elements that begin and end a block.
BLOCKS = (
    "address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "hr", "html", "li", "main", "ol", "option", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", *BOILERPLATE,
)
# Elements without an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: Elements that hold the page, and headings, are not judged by class.
PAGE = ("html", "body", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6")

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?<!/)>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_LINK = re.compile(r"<a\b.*?(?:</a\s*>|\Z)", re.S | re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_BLOCKS, _BOILERPLATE, _VOID, _MARKS, _NEUTRAL, _COMMENTS = frozenset(BLOCKS), frozenset(BOILERPLATE), frozenset(VOID), frozenset(MARKS), frozenset(NEUTRAL), frozenset(COMMENTS)


@dataclass
class Line:
    text: str
    linked: int  # code points inside links
    article: int  # the article it lies in, from 1, or 0

    @property
    def weight(self) -> int:
        return max(0, len(self.text) - self.linked)


def _marked(value: str) -> str:
    """'hint' where a class or id has a name of marks and neutral words alone ('site-footer', not 'with-sidebar' or 'related-work'), 'name' if they mark comments."""
    hint = ""
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name) if not w.isdigit()]
        if any(w in _MARKS for w in words) and all(w in _MARKS or w in _NEUTRAL for w in words):
            hint = "name" if hint == "name" or any(w in _COMMENTS for w in words) else "hint"
    return hint


def _boilerplate(name: str, attributes: str, inside: bool) -> str:
    """'name' or 'hint' where an element may be boilerplate, by its name or what it says of itself; inside: in an article, whose header is text."""
    if name in _BOILERPLATE:
        return "" if inside and name == "header" else "name"
    if name in PAGE or not attributes:
        return ""
    hint = ""
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "")
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return "name"
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "name"
        if key in ("class", "id") and (found := _marked(value)):
            hint = "name" if "name" in (hint, found) else found
    return hint


def _end(tags: list[re.Match], k: int) -> tuple[int, int] | None:
    """Where the element that tag k begins ends, and the tag to go on with; a paragraph ends before the next block."""
    name, depth = tags[k][2].lower(), 1
    for j in range(k + 1, len(tags)):
        other = tags[j][2].lower()
        if name == "p" and other in _BLOCKS and not (other == "p" and tags[j][1]):
            return tags[j].start(), j
        if other == name:
            depth += -1 if tags[j][1] else 1
            if not depth:
                return tags[j].end(), j + 1
    return None


def _plain(run: str) -> int:
    """About the characters of a run of markup that are text outside links."""
    return len(" ".join(html.unescape(_TAG.sub(" ", _LINK.sub(" ", run))).split()))


def lines_of(page: str) -> list[Line]:
    """The lines of a page in order; boilerplate elements and the borders of articles are WINDOW empty lines."""
    page = _HIDDEN.sub(" ", page)
    tags = list(_TAG.finditer(page))
    roots = [t.start() for t in tags if not t[1] and t[2].lower() in ("article", "main")]
    lines: list[Line] = []
    held: list[str] = []
    linked, links, depth, articles, at, k = 0, 0, 0, 0, 0, 0
    whole = -1

    def flush(gap: bool = False) -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            lines.append(Line(text, linked, articles if depth else 0))
        linked = 0
        if gap:
            lines.extend([Line("", 0, 0)] * WINDOW)

    def take(run: str) -> None:
        nonlocal linked
        if run:
            run = html.unescape(run)
            held.append(run)
            linked += len(run) if links else 0

    def left_out(kind: str, start: int, end: int) -> bool:
        """Whether an element that may be boilerplate is; one that holds an article never is."""
        nonlocal whole
        first = bisect.bisect_left(roots, start)
        if first < len(roots) and roots[first] < end:
            return False
        # where an article is marked, nothing else is in doubt
        if kind == "name" or roots:
            return True
        if whole < 0:
            whole = _plain(page)
        return _plain(page[start:end]) <= whole * LARGE

    while k < len(tags):
        tag = tags[k]
        take(page[at : tag.start()])
        at, closes, name = tag.end(), bool(tag[1]), tag[2].lower()
        if not closes and name not in _VOID and (kind := _boilerplate(name, tag[3], depth > 0)) and (end := _end(tags, k)) is not None and left_out(kind, tag.start(), end[0]):
            if name in _BLOCKS:
                flush(gap=name in _BOILERPLATE and not depth)
            at, k = end
            continue
        if name in ("article", "main"):
            flush(gap=True)
            # the outermost of them is an article; those in it are part of it
            articles += int(not closes and not depth)
            depth = max(0, depth + (-1 if closes else 1))
        elif name in _BLOCKS:
            flush()
        elif name == "br":
            held.append(" ")
        elif name == "a":
            links = max(0, links + (-1 if closes else 1))
        k += 1
    take(page[at:])
    flush()
    return lines


def regions(lengths: list[int]) -> list[tuple[int, int, int]]:
    """(surge, dive, peak) of each run of lines: its bounds, and the largest window sum inside it."""
    size = np.array([*lengths, *[0] * WINDOW], np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    sums = total[WINDOW:] - total[:-WINDOW]
    full = np.concatenate([[False], sums > 0, [False]])
    rise, fall = np.flatnonzero(full[1:] & ~full[:-1]), np.flatnonzero(~full[1:] & full[:-1])
    # sums rise as soon as a window's last line has text, and fall when its first has none
    return [(int(a) if a or size[0] else 0, int(b), int(sums[a:b].max())) for a, b in zip(rise.tolist(), fall.tolist(), strict=True)]


def main_text(page: str | None) -> str:
    """The main text of a page, its blocks joined by line feeds; '' for null, empty and text-free pages."""
    lines = lines_of(page or "")
    found = regions([x.weight for x in lines])
    peaks: dict[int, int] = {}
    for a, b, peak in found:
        for own in {x.article for x in lines[a:b] if x.article}:
            peaks[own] = max(peaks.get(own, 0), peak)
    if peaks:
        # all of the article, what stands between its regions included
        own = max(peaks, key=lambda k: (peaks[k], -k))
        kept = [x for x in lines if x.article == own]
    else:
        chosen = [r for r in found if r[2] >= SURGE] or sorted(found, key=lambda r: -r[2])[:1]
        kept = [x for a, b, _ in chosen for x in lines[a:b]]
    return "\n".join(x.text for x in kept if x.text)


def extract_text(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The main text of every whole page: (keep..., text string, n_chars long), one row for each row in.

    A narrow map. Null and empty pages give '', an empty table an empty one;
    repeated rows are extracted each; pages may be of any length, one is held
    at a time; columns of df that are not named are not read.
    """
    fields = [df.schema[c] for c in keep]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    return df.select(*keep, F.col(html_col).cast("string")).mapInArrow(extract, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", text string, n_chars long")
