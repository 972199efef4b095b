"""Score protocols and results pages: marks from HTML tables, dates and names from text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class _Rows(HTMLParser):
    """Rows of the tables: the class of a row's first cell and all cells' texts."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[str, list[str]]] = []
        self.row: list[str] | None = None
        self.kind, self.cell = "", False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "tr":
            self.row, self.kind = [], ""
        elif tag in ("td", "th") and self.row is not None:
            self.kind = self.kind or dict(attrs).get("class") or ""
            self.row.append("")
            self.cell = True

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th"):
            self.cell = False
        elif tag == "tr" and self.row is not None:
            self.rows.append((self.kind, [re.sub(r"\s+", " ", c).strip() for c in self.row]))
            self.row = None

    def handle_data(self, data: str) -> None:
        if self.cell and self.row:
            self.row[-1] += data


def protocol_rows(html: str | None) -> list[tuple[str, str, list[float | None]]]:
    """(kind, name, scores): rows of class num are elements, left out if a cell is a dash; rows of class cn are components. Blank cells are nulls."""
    parser = _Rows()
    parser.feed(html or "")
    out = []
    for kind, cells in parser.rows:
        if kind not in ("num", "cn") or len(cells) < 2 or (kind == "num" and "-" in cells):
            continue
        number = lambda c: float(c) if re.fullmatch(r"-?\d+(\.\d+)?", c) else None
        out.append(("element" if kind == "num" else "component", cells[1] if kind == "num" else cells[0], [number(c) for c in cells[2 if kind == "num" else 1 :]]))
    return out


def protocols(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) to (page_id, line, kind, name, position, score): a row a judge's position on a line."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, i, k, n, j + 1, s) for p, h in zip(pdf["page_id"], pdf["html"]) for i, (k, n, scores) in enumerate(protocol_rows(h)) for j, s in enumerate(scores)]
            yield pd.DataFrame(rows, columns=["page_id", "line", "kind", "name", "position", "score"])

    return pages.select("page_id", "html").mapInPandas(parse, "page_id long, line int, kind string, name string, position int, score double")


def positions(rows: DataFrame) -> DataFrame:
    """rows (element_id, scores array, judges array) exploded by place; pairs without a score are no marks."""
    pairs = rows.select("element_id", F.posexplode(F.arrays_zip(F.col("judges"), F.col("scores"))).alias("at", "x"))
    return pairs.select("element_id", (F.col("at") + 1).alias("position"), F.col("x.judges").alias("judge"), F.col("x.scores").alias("score")).where("score IS NOT NULL")


def title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1), "\\s+", " "))


def event_title(text: Column) -> tuple[Column, Column]:
    """A year at the start of a title, and the rest."""
    year = F.regexp_extract(text, "^\\s*((?:19|20)[0-9]{2})\\b", 1)
    return F.when(year != "", year.cast("int")), F.trim(F.regexp_replace(text, "^\\s*(?:19|20)[0-9]{2}\\b", ""))
