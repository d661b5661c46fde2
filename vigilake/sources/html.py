"""HTML pages as ordered elements, and link arithmetic.

One Arrow job tokenizes pages; everything after it is relational. A page's text
is kept once, as tokens; an element knows its place, its last descendant, the
headings it stands under and the interval of tokens inside it, so a page takes
memory in proportion to its length however deep its elements nest. The parsers
filter and pair elements and read the text of those they keep.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vigilake.functions.text import bind, strip, text

ELEMENT = (
    "STRUCT<pos: INT, last: INT, parent: INT, tag: STRING, begin: INT, end: INT, href: STRING, id: STRING, cls: STRING,"
    " cells: ARRAY<INT>, links: ARRAY<STRING>, h2: INT, h3: INT, h4: INT, in_item: BOOLEAN, row: INT, child_lists: INT,"
    " child_link: INT>"
)
_KEEP = {
    "title", "h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "ul", "ol", "a", "table", "tr", "td", "th", "div", "section",
    "article", "main", "time", "span", "option", "blockquote",
}
_VOID = {"br", "img", "meta", "link", "input", "hr", "wbr"}
_SILENT = {"script", "style"}
# Tokens that are no text start with a character no text holds.
_BREAK, _SIGN = "\0\n", "\0"
_MARK = {"u": "u", "ins": "u", "i": "i", "em": "i", "b": "strong", "strong": "strong"}
# Tags an opening tag closes first when they are still open.
_CLOSES = {
    "p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    **{t: {"p"} for t in ("div", "ul", "ol", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6")},
}


class _Elements(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.done: list[dict] = []
        self.open: list[dict] = []
        self.tokens: list[str] = []
        self.items = 0  # open list items
        self.linked: set[int] = set()  # cells whose first link was seen
        self.under = {"h2": -1, "h3": -1, "h4": -1}
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.tokens.append(_BREAK)
        if tag in _VOID:
            return
        if tag in _SILENT:
            self.silent += 1
        for closed in _CLOSES.get(tag, ()):
            barrier = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i]["tag"] == closed), None)
            limit = {"li": {"ul", "ol"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}}.get(closed, set())
            if barrier is not None and not any(e["tag"] in limit for e in self.open[barrier + 1:]):
                self._close(barrier)
        if tag in _MARK:
            self.tokens.append(f"{_SIGN}<{_MARK[tag]}>")
        if tag not in _KEEP:
            return
        a = dict(attrs)
        pos = len(self.done)
        element = {
            "pos": pos, "last": pos, "parent": self.open[-1]["pos"] if self.open else -1, "tag": tag, "begin": len(self.tokens), "end": 0,
            "href": a.get("href") or a.get("value"), "id": a.get("id"), "cls": a.get("class"), "cells": [], "links": [],
            "in_item": self.items > 0, **self.under, "row": next((e["pos"] for e in reversed(self.open) if e["tag"] == "tr"), -1),
            "child_lists": 0, "child_link": -1,
        }
        self.items += tag == "li"
        if self.open and tag in ("ul", "ol"):
            self.open[-1]["child_lists"] += 1
        if self.open and tag == "a" and self.open[-1]["child_link"] < 0:
            self.open[-1]["child_link"] = element["pos"]
        if tag in self.under:
            below = {"h2": ("h2", "h3", "h4"), "h3": ("h3", "h4"), "h4": ("h4",)}[tag]
            self.under.update({k: -1 for k in below})
            self.under[tag] = element["pos"]
        if tag in ("td", "th"):
            row = next((e for e in reversed(self.open) if e["tag"] == "tr"), None)
            if row is not None:
                row["cells"].append(pos)
                row["links"].append(None)
        if tag == "a":
            cell = next((e for e in reversed(self.open) if e["tag"] in ("td", "th")), None)
            if cell is not None and cell["row"] >= 0:
                row = self.done[cell["row"]]
                at = row["cells"].index(cell["pos"])
                if cell["pos"] not in self.linked:
                    self.linked.add(cell["pos"])
                    row["links"][at] = element["href"]
        self.done.append(element)
        self.open.append(element)

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        if tag in _MARK:
            self.tokens.append(f"{_SIGN}</{_MARK[tag]}>")
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                self._close(i)
                break

    def handle_data(self, data):
        if not self.silent:
            self.tokens.append(data.replace(_SIGN, "\ufffd"))

    def _close(self, index: int) -> None:
        for e in self.open[index:]:
            e["end"], e["last"] = len(self.tokens), len(self.done) - 1
            self.items -= e["tag"] == "li"
        del self.open[index:]


def parse_page(html: str | None) -> tuple[list[dict], list[str]]:
    """Elements of one page in document order, and its tokens."""
    parser = _Elements()
    parser.feed(html or "")
    parser.close()
    parser._close(0)
    return parser.done, parser.tokens


def parse_elements(html: str | None) -> list[dict]:
    """Elements of one page with their texts and those of their cells."""
    elements, tokens = parse_page(html)

    def flat(e: dict) -> str:
        parts = (" " if t == _BREAK else "" if t.startswith(_SIGN) else t for t in tokens[e["begin"]:e["end"]])
        return " ".join("".join(parts).split())

    return [{**e, "text": flat(e), "cells": [flat(elements[c]) for c in e["cells"]]} for e in elements]


def html_elements(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with their ``elements`` and ``tokens`` instead of the HTML.

    The job is one narrow map over Arrow batches; it needs no shuffle and its
    parallelism is the input's.
    """
    keep = [f for f in pages.schema.fields if f.name != html]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"elements ARRAY<{ELEMENT}>", "tokens ARRAY<STRING>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf.drop(columns=[html])
            read = [parse_page(h) for h in pdf[html]]
            out["elements"], out["tokens"] = [r[0] for r in read], [r[1] for r in read]
            yield out

    return pages.mapInPandas(run, schema)


def _inside(e: Column) -> Column:
    return F.slice("tokens", e["begin"] + 1, e["end"] - e["begin"])


def text_of(e: Column) -> Column:
    """Text of an element, white space collapsed; NULL for none."""
    parts = F.transform(_inside(e), lambda t: F.when(t == _BREAK, " ").when(F.startswith(t, F.lit(_SIGN)), "").otherwise(t))
    return F.trim(F.regexp_replace(F.array_join(parts, ""), r"(?U)[\s\x1c-\x1f]+", " "))


def rich_of(e: Column) -> Column:
    """Text of an element with its line breaks and marks of emphasis."""
    parts = F.transform(_inside(e), lambda t: F.when(F.startswith(t, F.lit(_SIGN)), F.substring(t, 2, 20)).otherwise(F.regexp_replace(t, r"[\r\n\t]+", " ")))
    joined = F.regexp_replace(F.array_join(parts, ""), r"(?U)<(u|i|strong)>\s*</\1>", "")
    joined = F.regexp_replace(joined, r"</(u|i|strong)>[ \t]*<\1>", " ")
    rows = F.transform(F.split(joined, "\n"), lambda row: strip(F.regexp_replace(row, r"[ \t]+", " ")))
    return strip(F.regexp_replace(F.array_join(rows, "\n"), r"\n{3,}", "\n\n"))


def with_text(elements: Column) -> Column:
    """Elements with their ``text``."""
    return F.transform(elements, lambda e: e.withField("text", text_of(e)))


def cells_of(e: Column) -> Column:
    """Texts of the cells of a table row."""
    return F.transform(e["cells"], lambda pos: text_of(F.get("elements", pos)))


def around(e: Column, of: Column) -> Column:
    """The elements of an array that an element lies in, outermost first."""
    return F.filter(of, lambda a: (a["pos"] < e["pos"]) & (e["pos"] <= a["last"]))


def elements_of(tag: str | tuple[str, ...], under: Column | None = None) -> Column:
    tags = (tag,) if isinstance(tag, str) else tag
    return F.filter("elements" if under is None else under, lambda e: e["tag"].isin(*tags))


def first_text(tag: str) -> Column:
    return text_of(F.get(elements_of(tag), F.lit(0)))


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of a link on the page ``base``."""
    def joined(b: Column) -> Column:
        scheme = F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)", 1)
        host = F.regexp_extract(b, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*", 0)
        whole = F.regexp_extract(b, r"^[^?#]*", 0)
        folder = F.when(whole == host, F.concat(host, F.lit("/"))).otherwise(F.regexp_replace(whole, "[^/]*$", ""))
        h = strip(text(href))
        return (
            F.when(F.rlike(h, F.lit(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:")), h).when(h == "", b)
            .when(h.startswith("//"), F.concat(scheme, h)).when(h.startswith("/"), F.concat(host, h))
            .when(h.startswith("#"), F.concat(F.regexp_extract(b, "^[^#]*", 0), h))
            .when(h.startswith("?"), F.concat(whole, h)).otherwise(F.concat(folder, h))
        )

    return bind(text(base), joined)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(text(url), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


# Tags kept in a sanitized section.
ALLOWED_TAGS = (
    "p", "b", "strong", "i", "em", "u", "ul", "ol", "li", "a", "br", "h4", "h5", "h6", "span",
)


def sanitize_html(c: Column) -> Column:
    """Section HTML with only the allowed tags and link attributes, cut where
    section 17 starts, empty paragraphs dropped."""
    value = F.regexp_replace(text(c), r"(?is)<(script|style|head|title)\b.*?</\1\s*>|<meta\b[^>]*>|<!--.*?-->|<!doctype[^>]*>", "")
    stop = r"(?:17\b|PCI/PI/MG|Patient\s+Counseling|MEDICATION\s+GUIDE|How\s+should\s+I\s+use)"
    value = F.regexp_replace(value, rf"(?isU)<(h4|h5|h6|p|strong|b)\b[^>]*>(?:(?!</\1\s*>).)*?\b{stop}.*$", "")
    names = "|".join(ALLOWED_TAGS)
    value = F.regexp_replace(value, rf"(?i)</?(?!(?:{names})\b)[a-z][^>]*>", "")
    plain = "|".join(t for t in ALLOWED_TAGS if t != "a")
    value = F.regexp_replace(value, rf"(?i)<({plain})\s[^>]*>", "<$1>")
    value = F.regexp_replace(
        value, r'(?i)<a\s(?:[^>]*?\s)?href="([^"]*)"[^>]*>', '<a href="$1" target="_blank" rel="noopener noreferrer">')
    return strip(F.regexp_replace(value, r"(?iU)<p>\s*</p>", ""))
