"""Extraction from landed pages: one Arrow job makes rows of elements; everything after it is columns."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain

# Elements whose text isn't read, that hold records, that name them, and that have no end tag.
DROPPED = ("script", "style", "noscript", "nav", "footer")
CONTAINERS = ("article", "li", "tr", "section", "dl")
HEADINGS = ("h1", "h2", "h3", "h4", "strong", "a")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr")
#: The surroundings of a link: so many ancestors, up to the one that brings the text above so many characters.
ANCESTORS, CONTEXT_CHARS = 4, 2500
BATCH_ROWS = 256


class _Reader(HTMLParser):
    """Elements in page order and the pieces of text in page order; an element has the pieces and the elements between its
    begin and its end."""

    def __init__(self, dropped=DROPPED):
        super().__init__(convert_charrefs=True)
        self.dropped = dropped
        #: [tag, class, href, rel, parent, first piece, end of pieces, end of elements]
        self.elements: list[list] = []
        self.pieces: list[str] = []
        self.open: list[int] = []
        self.silent = 0
        self.texts: dict[int, str] = {}

    def handle_starttag(self, tag, attrs):
        if tag == "p" or tag in ("li", "tr", "td", "th"):
            self._close_same(tag)
        a = dict(attrs)
        n = len(self.pieces)
        self.elements.append([tag, a.get("class") or "", a.get("href"), a.get("rel") or "", self.open[-1] if self.open else -1, n, n, len(self.elements) + 1])
        if tag not in VOID:
            self.open.append(len(self.elements) - 1)
            self.silent += tag in self.dropped

    def _close_same(self, tag):
        stop = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr",), "th": ("tr",), "p": ("div", "article", "section", "td", "li")}[tag]
        for k in range(len(self.open) - 1, -1, -1):
            name = self.elements[self.open[k]][0]
            if name == tag:
                self._pop(k)
                return
            if name in stop:
                return

    def _pop(self, k):
        for i in self.open[k:]:
            self.silent -= self.elements[i][0] in self.dropped
            self.elements[i][6:] = len(self.pieces), len(self.elements)
        del self.open[k:]

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.elements[self.open[k]][0] == tag:
                self._pop(k)
                return

    def handle_data(self, data):
        if data.strip() and not self.silent:
            self.pieces.append(data)

    def close(self):
        super().close()
        self._pop(0)

    def text(self, i: int) -> str:
        if i not in self.texts:
            self.texts[i] = _words(self.pieces[self.elements[i][5] : self.elements[i][6]])
        return self.texts[i]


def _words(parts: list[str]) -> str:
    return " ".join(" ".join(parts).replace("\x00", "").replace("\ufffd", "").split())


#: A tag as the parser reads it without doubt: in lower case, its attributes in double quotes without references.
_TAG = re.compile(r'<(?:(/)([a-z][a-z0-9]*)|([a-z][a-z0-9]*)((?: [a-z][a-z0-9-]*="[^"&<>]*")*))>')
_ATTRIBUTE = re.compile(r'([a-z][a-z0-9-]*)="([^"]*)"')
#: Elements whose content isn't markup, and the parser's end of reading.
_RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext"))


def _simple(html: str, reader: _Reader) -> bool:
    """Gives the reader a page of tags without doubt and of text, by one expression; False, and nothing given, for others."""
    begins = list(_TAG.finditer(html))
    if len(begins) != html.count("<") or any(m[3] in _RAW for m in begins):
        return False
    at = 0
    for m in begins:
        if m.start() > at:
            reader.handle_data(unescape(html[at : m.start()]))
        at = m.end()
        if m[1]:
            reader.handle_endtag(m[2])
        else:
            reader.handle_starttag(m[3], _ATTRIBUTE.findall(m[4]))
    if at < len(html):
        reader.handle_data(unescape(html[at:]))
    return True


def _read(html: str | None, dropped=DROPPED) -> _Reader:
    reader = _Reader(dropped)
    if html and _simple(html, reader):
        reader._pop(0)
        return reader
    reader.feed(html or "")
    reader.close()
    return reader


def rows(reader: _Reader, only: str | None = None) -> list[dict]:
    """Links, containers and table rows of a page; only: the containers of one tag."""
    found, text = reader.elements, reader.text
    out = []
    for i, (tag, cls, href, rel, *_, last) in enumerate(found):
        if only and tag != only:
            continue
        base = {"idx": i, "tag": tag, "cls": cls, "href": None, "heading": None, "rel": rel, "cells": None, "kind": None}
        if tag == "a" and href is not None:
            out.append(base | {"kind": "link", "text": text(i), "href": href})
        if tag in CONTAINERS:
            inside = range(i + 1, last)
            tags = {found[k][0] for k in inside}
            heading = next((text(k) for h in HEADINGS if h in tags for k in inside if found[k][0] == h and text(k)), None)
            link = next((found[k][2] for k in inside if found[k][0] == "a" and found[k][2] and not found[k][2].startswith(("mailto:", "tel:", "javascript:"))), None) if "a" in tags else None
            cells = [text(k) for k in inside if found[k][0] in ("td", "th")] if tag == "tr" else None
            out.append(base | {"kind": "container", "text": text(i), "heading": heading, "href": link, "cells": cells})
    return out


def read(html: str | None) -> tuple[list[dict], str, str]:
    """Rows of a page (links, containers, table rows), its title and its body text."""
    reader = _read(html)
    found, text = reader.elements, reader.text
    title = next((text(i) for h in ("h1", "h2", "h3", "title") for i, e in enumerate(found) if e[0] == h and text(i)), "")
    body = next((text(i) for h in ("main", "article", "body") for i, e in enumerate(found) if e[0] == h and text(i)), "")
    return rows(reader), title, body


def _above(found: list[list], i: int, most: int) -> list[int]:
    """The nearest ancestors of an element."""
    out = []
    while len(out) < most and (i := found[i][4]) >= 0:
        out.append(i)
    return out


_ROW = "kind string, idx int, tag string, cls string, text string, href string, heading string, rel string, cells array<string>"
_ARROW = pa.schema([("page_id", pa.int64()), ("kind", pa.string()), ("idx", pa.int32()), ("tag", pa.string()), ("cls", pa.string()), ("text", pa.string()), ("href", pa.string()), ("heading", pa.string()), ("rel", pa.string()), ("cells", pa.list_(pa.string()))])


_APART = str.maketrans({k: " " for k in range(128) if not chr(k).isalnum()})


def _plain(text: str) -> str:
    return " ".join(text.lower().translate(_APART).split()) if text.isascii() else plain(text)


def linked(html: str | None, terms: list[str]) -> list[tuple[int, str, str]]:
    """(idx, href, text) of a page's links whose surroundings hold one of the normalised terms: the link's own text and the
    whole text of each ancestor below body (menus and footers too), where the climb ends as CONTEXT_CHARS and ANCESTORS say."""
    reader = _read(html, ("script", "style"))
    found = reader.elements
    normal: dict[int, str] = {}
    out = []
    for i, (tag, _, href, *_) in enumerate(found):
        if tag != "a" or href is None:
            continue
        chain, size = [], -1
        for p in [i, *_above(found, i, ANCESTORS)]:
            if found[p][0] in ("body", "html"):
                break
            if p not in normal:
                normal[p] = _plain(reader.text(p))
            chain.append(normal[p])
            size += len(reader.text(p)) + 1
            if p != i and size > CONTEXT_CHARS:
                break
        context = " ".join(c for c in chain if c)
        if any(t in context for t in terms):
            out.append((i, href, reader.text(i)))
    return out


def context_links(pages: DataFrame, terms) -> DataFrame:
    """(page_id, idx, href, text) of the links of pages (page_id, html) whose surroundings hold one of the terms. The words
    are tested inside the Arrow job, as the surroundings of all links of a page are many times the page."""
    terms = [plain(t) for t in terms]

    def found(batches):
        for batch in batches:
            rows = [(page_id, *r) for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in linked(html, terms)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.string()))], ["page_id", "idx", "href", "text"])

    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(found, "page_id long, idx int, href string, text string")


def _elements(tag: str | None):
    def found(batches):
        for batch in batches:
            out = []
            for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [(page_id, r) for r in rows(_read(html), tag)]
            columns = [pa.array([i for i, _ in out], pa.int64()), *(pa.array([r[f.name] for _, r in out], f.type) for f in list(_ARROW)[1:])]
            yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)

    return found


def _details(batches):
    for batch in batches:
        read_pages = [read(h) for h in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for _, t, _ in read_pages], pa.string()), pa.array([b for _, _, b in read_pages], pa.string())], ["page_id", "title", "body"])


def elements(pages: DataFrame, only: str | None = None) -> DataFrame:
    """(page_id, kind, idx, tag, cls, text, href, heading, rel, cells) of pages (page_id, html); only: the containers of one tag,
    other rows aren't made."""
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(_elements(only), f"page_id long, {_ROW}")


def details(pages: DataFrame) -> DataFrame:
    """(page_id, title, body)."""
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(_details, "page_id long, title string, body string")


def html_to_text(html: Column) -> Column:
    """Tags, comments, scripts and styles out, white space collapsed; entities stay. Native."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<[^>]*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[\x00�]", ""), r"\s+", " "))
