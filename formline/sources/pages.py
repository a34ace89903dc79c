"""Event rows out of saved web pages.

Pages are a table (page_id, html, ...); every page is handled on its own, whole,
without a shuffle.  What regular expressions can do stays in Spark; ragged tables
go through a small standard-library parser in ``mapInPandas``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, date_of, flag, lookup, number, parse_minutes
from ..operators.rows import HEADERS, LEAD_COLUMNS, keep_existing, not_dnp, not_summary

# Ids of the wanted table, in order of preference.
TABLE_IDS = ("player_game_log_reg", "pgl_basic")
# Columns read as numbers.
NUMERIC = (
    "game_num", "gs", "fg", "fga", "fg_pct", "fg3", "fg3a", "fg3_pct", "ft", "fta", "ft_pct", "orb", "drb", "trb",
    "ast", "stl", "blk", "tov", "pf", "pts", "plus_minus", "game_score",
)
COMMENT = r"(?s)<!--(.*?)-->"


def comment_blocks(pages: DataFrame, *, page="page_id", html="html", wanted: Sequence[str] = ()) -> DataFrame:
    """The content of every HTML comment, or of those that mention a wanted text."""
    blocks = pages.select(page, F.posexplode(F.regexp_extract_all(html, F.lit(COMMENT), 1)).alias("position", "comment"))
    if not wanted:
        return blocks
    mention = F.lit(False)
    for text in wanted:
        mention |= F.contains("comment", F.lit(text))
    return blocks.where(mention)


def page_title(html: Column | str) -> Column:
    return F.regexp_extract(col(html), r"(?s)<title>(.*?)</title>", 1)


def page_links(pages: DataFrame, *, page="page_id", html="html") -> DataFrame:
    """Target and text of every link of a list item, in page order."""
    item = r'<li><a href="([^"]*)">([^<]*)</a></li>'
    pairs = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(item), 1).alias("href"), F.regexp_extract_all(html, F.lit(item), 2).alias("text")
    )
    return pages.select(page, F.posexplode(pairs).alias("position", "l")).select(
        page, "position", F.col("l.href").alias("href"), F.col("l.text").alias("text")
    )


def table_html(html: Column | str, ids: Sequence[str] = TABLE_IDS) -> Column:
    """Markup of the wanted table: in the live page first, else inside a comment; null if absent."""
    html = col(html)
    live = F.regexp_replace(html, COMMENT, "")
    comments = F.array_join(F.regexp_extract_all(html, F.lit(COMMENT), 1), "\n")
    found = []
    for text in (live, comments):
        for table_id in ids:
            pattern = rf"(?s)<table[^>]*\bid\s*=\s*[\"']{re.escape(table_id)}[\"'][^>]*>.*?</table>"
            found.append(F.nullif(F.regexp_extract(text, pattern, 0), F.lit("")))
    return F.coalesce(*found)


def regular_rows(pages: DataFrame, *, page="page_id", html="html", ids: Sequence[str] = TABLE_IDS) -> DataFrame:
    """Cells of every table row by regular expressions: for tables without spanning cells."""
    rows = pages.select(page, table_html(html, ids).alias("_table")).where(F.col("_table").isNotNull())
    rows = rows.select(
        page, F.posexplode(F.regexp_extract_all("_table", F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), 1)).alias("position", "_row")
    )
    cells = F.regexp_extract_all("_row", F.lit(r"(?s)<t[hd][^>]*>(.*?)</t[hd]>"), 1)
    return rows.select(page, "position", F.transform(cells, lambda c: F.trim(F.regexp_replace(c, r"<[^>]*>", ""))).alias("cells"))


TABLE_TAG = re.compile(r"<(/?)table\b[^>]*>", re.IGNORECASE)


def _parted(html: str) -> tuple[str, str]:
    """The live page, and the content of its comments by lines, as ``COMMENT`` finds them."""
    live, comments, at = [], [], 0
    while (start := html.find("<!--", at)) >= 0 and (end := html.find("-->", start + 4)) >= 0:
        live.append(html[at:start])
        comments.append(html[start + 4 : end])
        at = end + 3
    return "".join([*live, html[at:]]), "\n".join(comments)


def find_table(html: str | None, ids: Sequence[str] = TABLE_IDS) -> str | None:
    """Markup of the wanted table, tables nested in it included: in the live page first, else inside a comment."""
    if not html:
        return None
    live, comments = _parted(html)
    for text in (live, comments):
        for table_id in ids:
            begin = table_id in text and re.search(rf"<table[^>]*\bid\s*=\s*[\"']{re.escape(table_id)}[\"'][^>]*>", text)
            depth = 0
            for tag in TABLE_TAG.finditer(text, begin.start()) if begin else ():
                depth += -1 if tag[1] else 1
                if depth == 0:
                    return text[begin.start() : tag.end()]
            if begin:
                return text[begin.start() :]
    return None


def _spans(attributes) -> Iterator[int]:
    """The columns and rows that a cell of these attributes fills."""
    given = dict(attributes)
    return (max(1, int(n)) if (n := given.get(name) or "1").isdigit() else 1 for name in ("colspan", "rowspan"))


class _TableParser(HTMLParser):
    """Collects the rows of one table; cells that span columns or rows are repeated.

    The text of a nested table belongs to the cell that holds it.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.head: list[list[str]] = []
        self.body: list[list[str]] = []
        self._row: list[tuple[str, int, int]] | None = None
        self._cell: list[str] | None = None
        self._span, self._down, self._in_head, self._depth = 1, 1, False, 0
        self._above: dict[int, tuple[int, str]] = {}  # columns that cells of earlier rows still fill

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self._depth += 1
        if self._depth != 1:
            return
        if tag == "thead":
            self._in_head = True
        elif tag == "tr":
            self._end_row()
            self._row = []
        elif tag in ("td", "th") and self._row is not None:
            self._end_cell()
            self._cell, self._span, self._down = [], 1, 1
            if attrs:
                self._span, self._down = _spans(attrs)

    def handle_endtag(self, tag):
        if self._depth == 1:
            if tag in ("td", "th"):
                self._end_cell()
            elif tag in ("tr", "table", "tbody"):
                self._end_row()
            elif tag == "thead":
                self._end_row()
                self._in_head, self._above = False, {}
        if tag == "table":
            self._depth -= 1

    def handle_data(self, data):
        if self._cell is not None:
            self._cell.append(data)

    def _end_cell(self):
        if self._cell is not None:
            text = " ".join("".join(self._cell).split())
            self._row.append((text, self._span, self._down))
            self._cell = None

    def _end_row(self):
        self._end_cell()
        if self._row:
            (self.head if self._in_head else self.body).append(self._placed(self._row))
        self._row = None

    def _placed(self, row: list[tuple[str, int, int]]) -> list[str]:
        """The texts by column, with those of cells from above in between."""
        if not self._above and all(span == down == 1 for _, span, down in row):
            return [text for text, _, _ in row]
        out: list[str] = []
        below: dict[int, tuple[int, str]] = {}

        def from_above() -> None:
            while len(out) in self._above:
                rows, text = self._above[len(out)]
                if rows > 1:
                    below[len(out)] = (rows - 1, text)
                out.append(text)

        for text, span, down in row:
            from_above()
            for _ in range(span):
                if down > 1:
                    below[len(out)] = (down - 1, text)
                out.append(text)
        from_above()
        self._above = below
        return out


# Tags that every reader of HTML takes the same way, if they are written out whole.
KNOWN = frozenset(
    "table thead tbody tfoot tr td th a abbr b i u em strong small span sup sub div p br caption colgroup col".split()
)
# Whether a tag ends a row, and what it begins.
_KINDS = {"td": (False, "cell"), "th": (False, "cell"), "/td": (False, ""), "/th": (False, ""), "thead": (False, "thead")}
_KINDS |= {"tr": (True, "tr")} | {tag: (True, "") for tag in ("/tr", "/tbody", "/thead", "/table")}
_ATTRIBUTE = r"""\s+([a-zA-Z][a-zA-Z0-9_-]*)(?:=("[^"<>&]*"|'[^'<>&]*'|[^\s"'<>&=`/]+))?"""
ATTRIBUTE = re.compile(_ATTRIBUTE, re.ASCII)
_UNNAMED = _ATTRIBUTE.replace("([a", "(?:[a").replace('("', '(?:"')
PLAIN_TAG = re.compile(rf"<(/?[a-zA-Z]+)((?:{_UNNAMED})*)\s*>", re.ASCII)


def _feed_plain(parser: _TableParser, markup: str) -> bool:
    """Gives the parser the rows of one table of known, well-formed tags without another in it, found by one pattern.

    The rows are those that feeding it the markup gives; False, and nothing done, for any other markup.
    """
    parts = PLAIN_TAG.split(markup)
    names, given = parts[1::3], parts[2::3]
    if not names or markup.count("<") != len(names):
        return False
    lower = {name: name.lower() for name in set(names)}
    if not KNOWN.issuperset(name.removeprefix("/") for name in lower.values()):
        return False
    if any(g and name[0] == "/" for name, g in zip(names, given, strict=True)):
        return False
    tables = [i for i, name in enumerate(names) if lower[name] in ("table", "/table")]
    if lower[names[0]] != "table" or tables not in ([0], [0, len(names) - 1]) or lower[names[tables[-1]]] != ("/table" if tables[1:] else "table"):
        return False
    kinds = {name: _KINDS[tag] for name, tag in lower.items() if tag in _KINDS}
    row = cell = None
    span = down = 1
    for name, attributes, text in zip(names, given, parts[3::3], strict=True):
        if name in kinds:
            ends_row, begins = kinds[name]
            if cell is not None and begins != "thead":
                row.append((" ".join("".join(cell).split()), span, down))
                cell = None
            if ends_row:
                parser._row = row
                parser._end_row()
                row = [] if begins == "tr" else None
                if name[1:].lower() == "thead":
                    parser._in_head, parser._above = False, {}
            elif begins == "cell" and row is not None:
                cell, span, down = [], 1, 1
                if attributes:
                    span, down = _spans((n.lower(), (v[1:-1] if v[0] in "\"'" else v) if v else None) for n, v in ATTRIBUTE.findall(attributes))
            elif begins == "thead":
                parser._in_head = True
        if text and cell is not None:
            cell.append(unescape(text) if "&" in text else text)
    return True


def parse_table(markup: str) -> tuple[list[str], list[list[str | None]]]:
    """Header names and rows of one table; blank cells are missing, short rows are padded."""
    parser = _TableParser()
    if not _feed_plain(parser, markup):
        parser.feed(markup)
        parser.close()
    head, body = parser.head, parser.body
    names = head[-1] if head else (body.pop(0) if body else [])
    width = max([len(names), *map(len, body)], default=0)
    header, seen = [], {}
    for i in range(width):
        name = names[i] if i < len(names) and names[i] else f"Unnamed: {i}"
        repeat = seen.get(name, 0)
        seen[name] = repeat + 1
        header.append(f"{name}.{repeat}" if repeat else name)
    return header, [[c or None for c in row] + [None] * (width - len(row)) for row in body]


def parsed_tables(
    pages: DataFrame, *, page="page_id", html="html", ids: Sequence[str] = TABLE_IDS, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per page that has the table: header names and rows of cells, and the columns to ``keep``."""
    kept = [page, *keep]
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [find_table(text, ids) for text in batch["_html"]]
            tables = [parse_table(t) for t in found if t is not None]
            rows = batch.loc[[t is not None for t in found], kept]
            columns = {"header": [h for h, _ in tables], "cells": [r for _, r in tables]}
            # A batch without a table still needs columns of lists.
            yield rows.assign(**{c: pd.Series(v, rows.index, object) for c, v in columns.items()})

    schema = f"{kinds}, header array<string>, cells array<array<string>>"
    return pages.select(*kept, F.col(html).alias("_html")).mapInPandas(parse, schema)


def gamelog_rows(
    pages: DataFrame,
    *,
    page="page_id",
    html="html",
    metadata: Sequence[str] = ("player_id", "player_name", "position", "season"),
    ids: Sequence[str] = TABLE_IDS,
    date_format: str = "yyyy-MM-dd",
) -> DataFrame:
    """Pages to typed log rows: headers renamed, repeated headers, totals and unplayed rows dropped.

    ``metadata`` columns of the page table are carried to its rows.  Headers the map does
    not know stay in the ``extra`` map.
    """
    carried = [c for c in metadata if c in pages.columns]
    tables = parsed_tables(pages, page=page, html=html, ids=ids, keep=carried)
    names = F.transform("header", lambda h: lookup(h, HEADERS, h))
    # A repeated header row starts with the first header text.
    body = F.filter("cells", lambda r: ~r[0].eqNullSafe(F.lit("Rk")))
    tables = tables.select(page, *carried, names.alias("names"), body.alias("body"))

    def only_marks(i: Column) -> Column:
        return F.forall("body", lambda r: F.coalesce(F.trim(r[i]), F.lit("")).isin("@", "", "nan"))

    named = F.array_position("names", F.lit("home_away")).cast("int")
    marked = F.filter(F.sequence(F.lit(0), F.size("names") - 1), only_marks)
    away_at = F.when(named > 0, named - 1).otherwise(F.try_element_at(marked, F.lit(1)))
    rows = tables.withColumn("away_at", away_at).select(
        page, *carried, "names", "away_at", F.posexplode("body").alias("row_number", "cells")
    )
    columns = [c for c in dict.fromkeys(HEADERS.values()) if c != "home_away"]

    def cell(name: str) -> Column:
        at = F.array_position("names", F.lit(name)).cast("int")
        return F.when(at > 0, F.try_element_at("cells", at))

    pairs = F.map_from_entries(
        F.filter(
            F.zip_with("names", "cells", lambda n, c: F.struct(n.alias("k"), c.alias("v"))),
            lambda p: ~p["k"].isin(*columns, "home_away"),
        )
    )
    mark = F.trim(F.get("cells", F.col("away_at")))
    home = F.when(F.col("away_at").isNull(), F.lit(1)).otherwise(1 - flag(mark == "@"))
    rows = rows.select(page, *carried, "row_number", home.alias("home_game"), *[cell(c).alias(c) for c in columns if c not in carried], pairs.alias("extra"))
    rows = not_dnp(not_summary(rows, date=date_of("game_date", date_format), rank="rank"), "mp")
    rows = rows.withColumns(
        {c: number(c) for c in NUMERIC}
        | {"minutes": parse_minutes("mp"), "game_date": date_of("game_date", date_format)}
    ).drop("mp")
    return keep_existing(rows, [page, "row_number", *LEAD_COLUMNS], lead_only=True)
