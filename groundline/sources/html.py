"""Text of HTML pages: the title as first heading, what frames the content left out, table rows on one line, headings marked."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundline.functions.text import clean_lines
from groundline.runtime import spread

#: Elements, roles and parts of class or id words that frame the content.
FRAME_TAGS = ("script", "style", "noscript", "svg", "canvas", "iframe", "nav", "footer", "aside", "form", "button", "input", "select", "textarea", "link", "meta", "template")
FRAME_ROLES = ("navigation", "banner", "contentinfo", "search", "menu", "dialog")
FRAME_WORDS = ("nav", "navbar", "menu", "footer", "sidebar", "breadcrumb", "cookie", "consent", "social", "share", "newsletter", "subscribe", "related", "recommend", "promo", "banner", "advert", "popup", "modal", "skip-link", "skiplink", "copyright")
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


#: Elements within a line; all others begin and end one.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end where another of their kind begins.
IMPLIED = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))


class Reader(HTMLParser):
    """Collects lines of text; inside a frame nothing is collected, a row of a table is one line, and a row in a cell is part of the cell."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.title: list[str] = []
        self.line: list[str] = []
        self.open: list[tuple[str, bool]] = []  # tag, frames the content
        self.rows: list[list[list[str]]] = []  # open rows, their cells, the cells' texts

    def frames(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        said = {k: (v or "").lower() for k, v in attrs}
        names = f"{said.get('class', '')} {said.get('id', '')}".split()
        return tag in FRAME_TAGS or said.get("role") in FRAME_ROLES or any(w in n for n in names for w in FRAME_WORDS)

    def hidden(self) -> bool:
        return any(frame for _, frame in self.open)

    def end_line(self, mark: str = "") -> None:
        text = " ".join("".join(self.line).split())
        self.line = []
        if text and self.rows and self.rows[-1]:
            self.rows[-1][-1].append(text)
        elif text:
            self.lines.append(mark + text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in IMPLIED and self.open and self.open[-1][0] in IMPLIED[tag]:
            self.handle_endtag(self.open[-1][0])
        if not self.hidden() and tag not in INLINE:
            self.end_line()
        if tag in VOID:
            return
        self.open.append((tag, self.frames(tag, attrs)))
        if self.hidden():
            return
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append([])

    def handle_endtag(self, tag: str) -> None:
        if tag not in [t for t, _ in self.open]:
            return
        while True:
            hidden = self.hidden()
            last, _ = self.open.pop()
            if not hidden:
                self.ended(last)
            if last == tag:
                return

    def ended(self, tag: str) -> None:
        if tag == "title":
            self.title += self.line
            self.line = []
        elif tag in HEADINGS and not self.rows:
            self.end_line("#" * int(tag[1]) + " ")
        elif tag not in INLINE:
            self.end_line()
        if tag == "tr" and self.rows:
            self.line = [" | ".join(c for c in (" ".join(x) for x in self.rows.pop()) if c)]
            self.end_line()

    def handle_data(self, data: str) -> None:
        if not self.hidden():
            self.line.append(data)

    def text(self) -> str:
        self.close()
        while self.open:
            self.handle_endtag(self.open[-1][0])
        self.end_line()
        title = " ".join("".join(self.title).split())
        return "\n".join([f"# {title}"] * bool(title) + self.lines)


def html_text(html: str | None) -> str:
    reader = Reader()
    reader.feed(html or "")
    return reader.text()


def with_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with the text of their HTML as a further column; broken markup is read as far as it goes, null gives an empty text."""

    @F.pandas_udf("string")
    def read(htmls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for h in htmls:
            yield h.map(html_text)

    return spread(pages).withColumn(text_col, clean_lines(read(F.col(html_col))))


def headings(html: Column) -> Column:
    """The headings of a page by expressions alone: level and text of each."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<(h[1-6][^>]*>.*?)</h[1-6]>"))
    return F.transform(found, lambda x: F.struct(F.substring(x, 2, 1).cast("int").alias("level"), F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)^h[1-6][^>]*>", ""), r"(?s)<[^>]*>", "")).alias("text")))
