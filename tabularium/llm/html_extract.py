"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative; the weights are log odds of each kind of
token inside against outside the main text, counted over labelled pages (html_pages). One linear scan finds
the contiguous region with the best sum, and its blocks, less elements that never are main text, are the result. Those are elements
of certain kinds, hidden ones (the attribute hidden, aria-hidden="true", display:none, visibility:hidden), and those of which a whole
class name, the id or the role says so; a name that also says something else ("related-work") doesn't count.

A null, empty or textless page gives an empty text. Broken markup is read as browsers do: unclosed elements end with their
parents, stray end tags are ignored, an unclosed comment or script runs to the end of the page.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import ship
from .html_pages import LABELLED

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(\s*=\s*)?")
_VALUE = re.compile(r"[^\s>]*")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# HTML element kinds.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "textarea", "title", "select", "xmp"}
NEVER = {"head", "nav", "footer", "aside", "form", "button", "dialog", "menu"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "ruby", "rt", "rp"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ARTICLE = {"article", "main"}
# Words of class and id names, and roles, of what is not main text.
ROLES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay",
    "newsletter", "subscribe", "subscription", "signup", "login", "sidebar", "related", "recommended", "recommendations", "share", "sharing", "social", "comment", "comments", "reply", "replies", "disqus", "respond",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "masthead", "toolbar", "widget", "widgets", "contentinfo", "complementary", "search", "topbar", "skip", "tags", "byline-links", "header",
}
# Words that say nothing about what an element holds; a name counts only if all its other words are in ROLES.
NEUTRAL = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "column", "container", "form", "global", "group", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "page", "panel", "posts", "primary",
    "reader", "right", "row", "secondary", "section", "side", "site", "slot", "thread", "top", "unit", "user", "wrap", "wrapper",
}
#: What an element that ends with its parents or its like closes on opening.
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


def _attributes(page: str, at: int, closing: dict[str, bool]) -> tuple[dict[str, str], int, bool]:
    """(attributes by lower-case name, place after the tag's end, whether it closes itself) of a start tag whose name ends at `at`.

    A quote that is never closed counts as a character; closing remembers which characters don't come any more, so a page is read once.
    """
    out: dict[str, str] = {}
    while (m := _ATTRIBUTE.match(page, at)) is not None:
        name, at, value = m[1].lower(), m.end(), ""
        if m[2]:
            quote = page[at : at + 1]
            end = page.find(quote, at + 1) if quote in ("'", '"') and closing.get(quote, True) else -1
            if end >= 0:
                value, at = page[at + 1 : end], end + 1
            else:
                if quote in ("'", '"'):
                    closing[quote] = False
                v = _VALUE.match(page, at)
                value, at = v[0], v.end()
        out.setdefault(name, value)
    end = page.find(">", at)
    return out, end + 1 if end >= 0 else len(page), page[end - 1 : end] == "/" if end >= 0 else False


def _is_hidden(attributes: dict[str, str]) -> bool:
    if attributes.get("hidden", "until-found").strip().lower() != "until-found" or attributes.get("aria-hidden", "").strip().lower() == "true":
        return True
    declared = [d.partition(":") for d in attributes.get("style", "").lower().split(";")]
    return any((name.strip(), value.replace("!important", "").strip()) in (("display", "none"), ("visibility", "hidden")) for name, _, value in declared)


def _names_role(attributes: dict[str, str], exempt: set[str]) -> bool:
    """Whether its role, or a whole name among its classes or its id, says that an element is no main text."""
    if attributes.get("role", "").strip().lower() in ROLES | {"dialog", "alertdialog", "menubar", "form"}:
        return True
    for name in [*attributes.get("class", "").split(), attributes.get("id", "")]:
        words = {w.lower() for w in _WORD.findall(name)}
        if words and words <= ROLES | NEUTRAL and words & (ROLES - exempt):
            return True
    return False


def _is_never(name: str, attributes: dict[str, str], in_article: bool, by_names: bool) -> bool:
    if name in NEVER or (name == "header" and not in_article) or (attributes and _is_hidden(attributes)):
        return True
    if not attributes or not by_names or name in ("html", "body", "article", "main"):
        return False
    return _names_role(attributes, {"header"} if in_article or name in HEADINGS else set())


def kind_of(name: str) -> str:
    """The kind of a tag, as the weights tell them apart."""
    if name in INLINE and name != "a":
        return "inline"
    if name in HEADINGS:
        return "heading"
    return name if name in ("a", "p", "br", "li", "ul", "td", "div", "article", "blockquote", "pre") else "other"


def tokens(page: str, by_names: bool = True) -> Iterator[tuple[str, str, bool, bool]]:
    """(kind, text, never, block) in page order: kind "word" or "link" for a stretch of text, else a tag's kind; never:
    inside what is not main text; block: whether a block ends here. Every character is read a bounded number of times.
    by_names=False leaves out what only its class, id or role tells."""
    stack: list[tuple[str, bool]] = []
    opened: Counter[str] = Counter()
    closing: dict[str, bool] = {}
    never, at, n = 0, 0, len(page)
    lower: str | None = None

    def text_kind() -> str:  # within an article a link's words are words
        return "link" if opened["a"] and not (opened["article"] or opened["main"]) else "word"

    def pop() -> str:
        nonlocal never
        x, was = stack.pop()
        opened[x] -= 1
        never -= was
        return x

    while at < n:
        start = page.find("<", at)
        start = n if start < 0 else start
        if start > at:
            yield text_kind(), page[at:start], bool(never), False
            at = start
            continue
        after = page[at + 1 : at + 2]
        if after in ("!", "?"):
            ends, skip = ("-->", 4) if page.startswith("<!--", at) else (">", 2)
            end = page.find(ends, at + skip) if closing.get(ends, True) else -1
            closing[ends] = end >= 0
            at = n if end < 0 else end + len(ends)
            continue
        is_end = after == "/"
        m = _NAME.match(page, at + 1 + is_end)
        closed = closing.get(">", True) and page.find(">", at) >= 0 if m else False
        if m is None or not closed:  # no tag: the character stands for itself
            closing[">"] = closing.get(">", True) and (m is None or closed)
            yield text_kind(), "<", bool(never), False
            at += 1
            continue
        name = m[0].lower()
        if is_end:  # an end tag closes up to its like, and itself belongs to what it ends
            at = page.find(">", m.end()) + 1
            inside = bool(never)
            if opened[name]:
                while pop() != name:
                    pass
            yield kind_of(name), "", inside, name not in INLINE and name != "br"
            continue
        attributes, at, whole = _attributes(page, m.end(), closing)
        if name in RAW:  # its content is not markup
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{name}", at) if closing.get(f"</{name}", True) else -1
            closing[f"</{name}"] = end >= 0
            close = page.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else n
            continue
        closes = _CLOSES.get(name, {"p"} if name not in INLINE and name != "br" else None)
        while closes and stack and stack[-1][0] in closes | (INLINE if any(x in closes for x, _ in stack[-4:]) else set()):
            if pop() in closes:
                break
        if name not in VOID and not whole:
            bad = _is_never(name, attributes, bool(opened["article"] or opened["main"]), by_names)
            stack.append((name, bad))
            opened[name] += 1
            never += bad
        yield kind_of(name), "", bool(never), name not in INLINE and name != "br"


@lru_cache(1)
def weights() -> dict[str, float]:
    """Log odds of each kind of token inside against outside the main text of the labelled pages; words stay above and tags below 0."""
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    for page in LABELLED:
        before, rest = page.split("{{")
        main, after = rest.split("}}")
        for part, count in ((main, inside), (before, outside), (after, outside)):
            for kind, text, never, _ in tokens(part):
                if not never:
                    count[kind] += len(text.split()) if kind in ("word", "link") else 1
    a, b = sum(inside.values()), sum(outside.values())
    kinds = {*inside, *outside, "word", "link", "p", "a", "br", "li", "ul", "td", "div", "article", "blockquote", "pre", "heading", "inline", "other"}
    odds = {k: math.log((inside[k] + 0.5) / (a + 1) / ((outside[k] + 0.5) / (b + 1))) for k in kinds}
    # A tag that the main text has as well costs little, but something; the labelled pages have some kinds only inside.
    return {k: max(v, 0.1) if k == "word" else v if k == "link" else min(v, -0.05) for k, v in odds.items()}


def best_region(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous run with the largest sum (the first and longest of equals); empty if none is above 0."""
    best, begin, end, low, low_at, total = 0.0, 0, 0, 0.0, 0, 0.0
    for k, x in enumerate(scores):
        if total < low:
            low, low_at = total, k
        total += x
        if total - low > best or total - low == best > 0 and low_at == begin:
            best, begin, end = total - low, low_at, k + 1
    return begin, end


def main_text(page: str | None) -> str:
    """Blocks of the best region, joined by two line ends."""
    if not page:
        return ""
    # A page all of whose text is under names that say otherwise is read without them.
    return _best_text(list(tokens(page))) or _best_text(list(tokens(page, by_names=False)))


def _best_text(found: list[tuple[str, str, bool, bool]]) -> str:
    """The blocks of the best region of these tokens."""
    weight = weights()
    scores = [0.0 if never else weight[kind] * len(html.unescape(text).split()) if kind in ("word", "link") else weight[kind] for kind, text, never, _ in found]
    begin, end = best_region(scores)
    # A region that begins or ends within a block takes the block in whole.
    while begin > 0 and not found[begin - 1][3] and not found[begin][3]:
        begin -= 1
    while end < len(found) and not found[end][3] and not found[end - 1][3]:
        end += 1
    blocks, open_ = [], []
    for kind, text, never, block in found[begin:end]:
        if block:
            blocks.append("".join(open_))
            open_ = []
        elif never:
            continue
        elif kind in ("word", "link"):
            open_.append(text)
        elif kind == "br":
            open_.append(" ")
    blocks.append("".join(open_))
    clean = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in clean if b)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html), from its whole html."""
    ship(pages.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html")).mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")
