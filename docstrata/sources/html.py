"""Visible text of HTML pages. Nesting and hidden parts need a parser, so this is one pandas pass per batch."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

HIDDEN = frozenset("script style head noscript template svg".split())
BLOCK = frozenset("p div li ul ol tr td th table section article header footer nav h1 h2 h3 h4 h5 h6 br pre blockquote title body".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Visible(HTMLParser):
    """Collects (heading path, text) of visible blocks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.path: list[tuple[int, str]] = []
        self.words: list[str] = []
        self.level = 0
        self.blocks: list[tuple[str, str]] = []

    def close_block(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if not text:
            return
        if self.level:
            self.path = [p for p in self.path if p[0] < self.level] + [(self.level, text)]
        self.blocks.append((" > ".join(t for _, t in self.path), text))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.close_block()
        if tag in VOID:
            return
        a = dict(attrs)
        hidden = tag in HIDDEN or "hidden" in a or "display:none" in (a.get("style") or "").replace(" ", "")
        self.open.append((tag, hidden or (bool(self.open) and self.open[-1][1])))
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.level = int(tag[1])

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.close_block()
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.level = 0
        names = [t for t, _ in self.open]
        if tag in names:
            del self.open[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][1]):
            self.words.append(data)


def blocks_of(html: str | None) -> list[tuple[str, str]]:
    p = Visible()
    p.feed(html or "")
    p.close()
    p.close_block()
    return p.blocks


def visible_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block, heading_path, text) of pages (page_id, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, h, t) for i, html in zip(b["page_id"], b["html"], strict=True) for k, (h, t) in enumerate(blocks_of(html))]
            yield pd.DataFrame(rows, columns=["page_id", "block", "heading_path", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, block int, heading_path string, text string")
