"""Main text of web pages by composite text density.

Every element of a page gets its characters per tag, lowered where links hold the
characters. The subtree whose children's densities add up to the most is the core of
the article; the least density on the path from the body to it is the threshold that
other parts must reach to belong to it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsieve.llm.texts import plain

# Element kinds of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
# An element that the beginning of one of these ends, if it is still open.
_ENDS = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
    "tbody": ("tr", "td", "th", "thead", "tbody"),
}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements beyond which an open one is not looked for.
_SCOPE = frozenset("ul ol dl table tbody thead select td th div section article aside main body html".split())

# Parts that are not the article: elements, roles, and words of class names and ids.
_ASIDE = frozenset(
    "head script style noscript template iframe svg math canvas object nav footer aside form button select input "
    "textarea dialog menu title".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu".split())
_WORDS = re.compile(
    r"(?:ads?|adverts?|advertis\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|menu|nav|navbar|navigation|"
    r"breadcrumbs?|footer|masthead|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|"
    r"subscription|signup|login|social|share|sharing|related|recommended|comments?|commentlist|disqus|replies|"
    r"respond|widget|pagination|pager|toolbar|search|hidden)$",
    re.IGNORECASE,
)
_SIDE_WORDS = re.compile(r"(?:header|topbar)$", re.IGNORECASE)
# A name like "has-sidebar" says what is elsewhere.
_ABOUT = frozenset("has with no is without show hide open not".split())
_KEPT = frozenset("html body main article".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.DOTALL
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")


def _is_aside(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is no part of an article, by its kind and its names."""
    if tag in _ASIDE or tag == "header" and not in_article:
        return True
    if not attributes or tag in _KEPT:
        return False
    names = ""
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "role" and value.lower() in _ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return True
        if key in ("class", "id"):
            names += " " + value
    for name in names.split():
        words = re.split(r"[-_:]+|(?<=[a-z])(?=[A-Z])", name)
        if words[0].lower() in _ABOUT:
            continue
        if any(_WORDS.match(w) or (not in_article and _SIDE_WORDS.match(w)) for w in words):
            return True
    return False


class _Page:
    """Elements of a page in the order of their beginning, and its texts."""

    def __init__(self, source: str):
        self.tag, self.parent, self.aside = ["#page"], [-1], [False]
        # Texts by element, and None where a block begins or ends.
        self.texts: list[tuple[int, str] | None] = []
        open_, in_article = [0], [False]
        self.open_tags: Counter[str] = Counter()
        at = 0
        while at < len(source):
            m = _TAG.search(source, at)
            if m is None:
                self._text(open_[-1], source[at:])
                break
            if m.start() > at:
                self._text(open_[-1], source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if self.open_tags[tag]:
                    while self.tag[open_[-1]] != tag:
                        self._close(open_, in_article)
                    self._close(open_, in_article)
                continue
            if tag == "br":
                self._text(open_[-1], " ")
            # A paragraph ends where a block begins; so do items and cells of their kind.
            ends = _ENDS.get(tag, ()) if tag in _INLINE or tag in _VOID else ("p", *_ENDS.get(tag, ()))
            for k in range(len(open_) - 1, 0, -1) if any(self.open_tags[e] for e in ends) else ():
                name = self.tag[open_[k]]
                if name in ends:
                    while len(open_) > k:
                        self._close(open_, in_article)
                elif name in _SCOPE:
                    break
            i = len(self.tag)
            self.tag.append(tag)
            self.parent.append(open_[-1])
            self.aside.append(self.aside[open_[-1]] or _is_aside(tag, m[3], in_article[-1]))
            if tag not in _INLINE and tag != "br":
                self.texts.append(None)
            if tag in _VOID or m[3].endswith("/") and tag not in _INLINE | _SCOPE | {"p"}:
                continue
            if tag in _RAW:
                # What is inside is not markup; without an end tag it is the rest.
                end = re.compile(f"</{tag}", re.IGNORECASE).search(source, at)
                at = end.start() if end else len(source)
            open_.append(i)
            self.open_tags[tag] += 1
            in_article.append(in_article[-1] or tag == "article")
        self.texts.append(None)

    def _text(self, node: int, text: str) -> None:
        if self.tag[node] not in _RAW:
            self.texts.append((node, html.unescape(text) if "&" in text else text))

    def _close(self, open_: list[int], in_article: list[bool]) -> None:
        tag = self.tag[open_.pop()]
        self.open_tags[tag] -= 1
        if tag not in _INLINE:
            self.texts.append(None)
        in_article.pop()


def _densities(page: _Page) -> tuple[list[float], list[float]]:
    """Composite text density of every element, and the sum over its children."""
    n = len(page.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for text in page.texts:
        if text is not None and not page.aside[text[0]]:
            chars[text[0]] += len(_SPACE.sub(" ", text[1]).strip())
    linked = [False] * n
    for i in range(1, n):
        linked[i] = linked[page.parent[i]] or page.tag[i] == "a"
        link_chars[i] = chars[i] if linked[i] else 0
        link_tags[i] = 1 if page.tag[i] == "a" and not page.aside[i] else 0
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        tags[p] += tags[i] + (0 if page.aside[i] else 1)
        chars[p] += chars[i]
        link_chars[p] += link_chars[i]
        link_tags[p] += link_tags[i]
    body = page.tag.index("body") if "body" in page.tag else 0
    share = link_chars[body] / max(1, chars[body])
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        c, t, lc, lt = chars[i], max(1, tags[i]), link_chars[i], max(1, link_tags[i])
        if c:
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            odds = c / max(1, lc) * t / lt
            # The base is at least 1: a page without links is not lowered at all.
            density[i] = max(0.0, c / t * math.log(odds + 1.0) / max(1.0, math.log(base) + 1.0))
        if i:
            total[page.parent[i]] += density[i]
    return density, total


def main_text(source: str) -> str:
    """The article of a page as blocks, one a line; empty if there is none."""
    page = _Page(source)
    n = len(page.tag)
    density, total = _densities(page)
    candidates = [i for i in range(n) if density[i] > 0]
    if not candidates:
        return ""
    core = max(candidates, key=lambda i: (total[i], density[i], i))
    path = [core]
    while path[-1] > 0 and page.tag[path[-1]] != "body":
        path.append(page.parent[path[-1]])
    threshold = min(density[i] for i in path if density[i] > 0)
    # An article or main element around the core is the whole of it.
    whole = next((i for i in path if page.tag[i] in ("article", "main")), core)
    chosen = [False] * n
    on_path = set(path)
    inside_whole = page.tag[whole] in ("article", "main")
    for i in range(n):
        p = page.parent[i]
        within = p >= 0 and chosen[p]
        # Without such an element, what is as dense beside the path and headings belong to it.
        fits = density[i] >= threshold or page.tag[i] in _HEADINGS
        beside = not inside_whole and i not in on_path and fits and p in on_path
        chosen[i] = not page.aside[i] and (within or i == whole or beside)
    blocks: list[str] = []
    now: list[str] = []
    for text in page.texts:
        if text is None:
            if now and (block := _SPACE.sub(" ", "".join(now)).strip()):
                blocks.append(block)
            now = []
        elif chosen[text[0]]:
            now.append(text[1])
    return "\n".join(blocks)


def extract_pages(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html"
) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` (code points), a row per row.

    A null page counts as empty and has an empty text, as has one without an article.
    Null ids and urls stay null, repeated rows give repeated rows, other columns are
    not read, whatever their names.
    """

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(plain(t)) for t in batch], dtype=object)

    return pages.select(
        F.col(page_id).alias("page_id"),
        F.col(url).alias("url"),
        F.pandas_udf(texts, "string")(F.col(source)).alias("text"),
    ).withColumn("n_chars", F.char_length("text").cast("long"))
