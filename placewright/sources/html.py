"""Markup as columns, and HTML tables as rows."""

from __future__ import annotations

import re
from html.entities import name2codepoint
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def cell_text(html: Column) -> Column:
    """Text with line breaks where a line, paragraph or item ends; scripts and styles left out."""
    own = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")
    own = F.regexp_replace(F.regexp_replace(own, "<(?:br|/p|/div|/li)[^>]*>", "\n"), "<[^>]*>", "")
    return F.trim(F.regexp_replace(own, r"[ \t]+", " "))


def unescape(c: Column) -> Column:
    """Character references as characters: HTML's names, and numbers in either notation. What is none stays."""
    names = F.create_map(*[F.lit(x) for name, code in sorted(name2codepoint.items()) for x in (name, chr(code))])

    def read(part: Column, at: Column) -> Column:
        name = F.regexp_extract(part, r"^(#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]*);", 1)
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10)).when(name.startswith("#"), F.substring(name, F.lit(2), F.length(name))).try_cast("int")
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        sign = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise(F.get(F.map_values(F.map_filter(names, lambda k, _: k == name)), 0))
        rest = F.substring(part, F.length(name) + 2, F.length(part))
        return F.when(at == 0, part).when((name != "") & sign.isNotNull(), F.concat(sign, rest)).otherwise(F.concat(F.lit("&"), part))

    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(F.split(c, "&"), read), "")).otherwise(c)


def plain(html: Column) -> Column:
    """Text of a cell with its references decoded; references are read after the tags, so ``&lt;`` makes no tag."""
    return F.trim(unescape(cell_text(html)))


def detail_map(html: Column) -> Column:
    """Key and value cells of a detail page as a map, markup inside cells as their text; of equal keys the last holds."""
    cell = r"([^<]*+(?:<(?!/?t[hdr]\b)[^<]*+)*+)"  # anything but another cell or row
    pairs = rf"(?i)<t[hd]\b[^>]*>{cell}</t[hd]>\s*<td\b[^>]*>{cell}</td>"
    clean = lambda i: F.transform(F.regexp_extract_all(html, F.lit(pairs), F.lit(i)), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " ")))
    both = F.arrays_zip(clean(1).alias("k"), clean(2).alias("v"))
    keys = F.array_distinct(clean(1))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(both, lambda p: p["k"] == k), -1)["v"]))


class _Cells(HTMLParser):
    """Cells of a page's tables with their spans, links and images, and the number of rows of each table."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.table, self.row, self.cells, self.rows, self.open = -1, -1, [], [], None

    def handle_starttag(self, tag, attrs):
        said = dict(attrs)
        if tag == "table":
            self.table, self.row = self.table + 1, -1
            self.rows.append(0)
        elif tag == "tr":
            self.row += 1
            if self.table >= 0:
                self.rows[self.table] = self.row + 1
            self.open = None
        elif tag in ("td", "th") and self.row >= 0:
            self.open = [self.table, self.row, tag == "th", _span(said.get("rowspan")), _span(said.get("colspan")), [], [], []]
            self.cells.append(self.open)
        elif tag == "br" and self.open:
            self.open[5].append("\n")
        elif tag == "a" and self.open and said.get("href"):
            self.open[6].append(said["href"])
        elif tag == "img" and self.open and said.get("src"):
            self.open[7].append(said["src"])

    def handle_endtag(self, tag):
        if tag in ("td", "th", "table"):
            self.open = None
        elif tag in ("p", "div", "li") and self.open:
            self.open[5].append("\n")

    def handle_data(self, data):
        if self.open:
            self.open[5].append(data)


#: A tag and the text after it, where both can be read by themselves: no references, comments or declarations, values in double quotes, no element whose content is no markup.
_TOKEN = re.compile(r'(<(/?)(?!(?:script|style|textarea|title|iframe|noembed|noframes|noscript|plaintext|xmp)\b)([a-z][a-z0-9]*)((?:[ \t\n]+[a-z][a-z0-9_-]*="[^"<>&]*")*)[ \t\n]*>([^<&]*))', re.IGNORECASE | re.ASCII)
_VALUE = re.compile(r'([a-z][a-z0-9_-]*)="([^"]*)"', re.IGNORECASE | re.ASCII)


def _span(value: str | None) -> int:
    return max(1, min(1000, int(v) if (v := (value or "1").strip()).isdigit() else 1))


def _plain_cells(page: str) -> tuple[list, list] | None:
    """The cells and row counts of ``_Cells`` for a page of plain markup, some times as fast; None for one that has anything else."""
    start = page.find("<")
    start = len(page) if start < 0 else start
    tokens = _TOKEN.findall(page, start)
    if sum([len(t[0]) for t in tokens]) != len(page) - start or "&" in page:
        return None
    table, row, cells, rows, cell = -1, -1, [], [], None
    for _, ends, name, values, text in tokens:
        tag = name.lower()
        if ends:
            if values:
                return None
            if tag in ("td", "th", "table"):
                cell = None
            elif cell and tag in ("p", "div", "li"):
                cell[5].append("\n")
        elif tag in ("td", "th"):
            if row >= 0:
                said = {k.lower(): v for k, v in _VALUE.findall(values)} if values else {}
                cell = [table, row, tag == "th", _span(said.get("rowspan")), _span(said.get("colspan")), [], [], []]
                cells.append(cell)
        elif tag == "tr":
            row += 1
            if table >= 0:
                rows[table] = row + 1
            cell = None
        elif tag == "table":
            table, row = table + 1, -1
            rows.append(0)
        elif cell:
            if tag == "br":
                cell[5].append("\n")
            elif values and tag in ("a", "img"):
                url = {k.lower(): v for k, v in _VALUE.findall(values)}.get("href" if tag == "a" else "src")
                if url:
                    cell[6 if tag == "a" else 7].append(url)
        if text and cell:
            cell[5].append(text)
    return cells, rows


def grid(html: str) -> list[tuple]:
    """(table, row, column, is header, is the cell's own place, text, first row, rows of the table, a place is taken twice, links, images) of
    every place that a cell covers."""
    found = _plain_cells(html or "")
    if found is None:
        parser = _Cells()
        parser.feed(html)
        found = parser.cells, parser.rows
    taken: set[tuple[int, int, int]] = set()
    out = []
    for table, row, header, down, across, parts, links, images in found[0]:
        text = "".join(parts)
        text = "\n".join(line for part in text.split("\n") if (line := " ".join(part.split()))) if "\n" in text else " ".join(text.split())
        rows = found[1][table] if table >= 0 else 0
        column = 0
        while (table, row, column) in taken:
            column += 1
        if down == across == 1:
            taken.add((table, row, column))
            out.append((table, row, column, header, True, text, row, rows, False, links, images))
            continue
        places = [(r, c) for r in range(row, row + down) for c in range(column, column + across)]
        clash = any((table, r, c) in taken for r, c in places)
        for r, c in places:
            if (table, r, c) not in taken:
                taken.add((table, r, c))
                out.append((table, r, c, header, (r, c) == (row, column), text, row, rows, clash, links, images))
    return out


CELL = {"table": "int", "row": "int", "col": "int", "header": "boolean", "origin": "boolean", "text": "string", "from_row": "int", "rows": "int", "clash": "boolean", "links": "array<string>", "images": "array<string>"}


def table_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key`` and the columns of ``CELL``: tables with spans written out. Sections, continued rows and contracts are joins and windows over
    these rows. A span that reaches beyond the last row gives places there (``row`` >= ``rows``)."""
    kind = dict(pages.dtypes)[key]

    def run(batches):
        for batch in batches:
            rows = [(k, *cell) for k, page in zip(batch[key], batch[html], strict=True) for cell in grid(page)]
            yield pd.DataFrame(rows, columns=[key, *CELL])

    return pages.select(key, html).mapInPandas(run, ", ".join(f"{c} {t}" for c, t in {key: kind, **CELL}.items()))


PLACE = {"col": pa.int32(), "origin": pa.bool_(), "text": pa.string(), "from_row": pa.int32(), "links": pa.list_(pa.string()), "images": pa.list_(pa.string())}


def page_tables(pages: DataFrame, key: str, html: str, at_once: int = 256) -> DataFrame:
    """``key, table, n_rows, clash, grid``: each table of a page (one row for a key) as one row that holds the cells of ``table_cells`` by
    row and column, so what is asked of whole tables needs no shuffle."""
    kind = dict(pages.dtypes)[key]

    def lists(values: list, sizes: list) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(list(accumulate(sizes, initial=0)), pa.int32()), values)

    def made(key_of: pa.Array, pages: list) -> pa.RecordBatch:
        at, table_of, counts, clashes, n_rows, row_of, n_cells, places = [], [], [], [], [], [], [], []
        for j, page in enumerate(pages):
            found: dict[int, list] = {}
            for table, row, col, _, origin, text, from_row, rows, clash, links, images in grid(page):
                own = found.setdefault(table, [rows, False, {}])
                own[1] |= clash
                own[2].setdefault(row, []).append((col, origin, text, from_row, links, images))
            for table, (rows, clash, held) in sorted(found.items()):
                at.append(j)
                table_of.append(table)
                counts.append(rows)
                clashes.append(clash)
                n_rows.append(len(held))
                for row, cells in sorted(held.items()):
                    row_of.append(row)
                    n_cells.append(len(cells))
                    places.extend(sorted(cells, key=lambda c: c[0]))
        columns = zip(*places, strict=True) if places else [()] * len(PLACE)
        cells = pa.StructArray.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, PLACE.values(), strict=True)], list(PLACE))
        rows = pa.StructArray.from_arrays([pa.array(row_of, pa.int32()), lists(cells, n_cells)], ["row", "cells"])
        return pa.RecordBatch.from_arrays(
            [key_of.take(pa.array(at, pa.int32())), pa.array(table_of, pa.int32()), pa.array(counts, pa.int32()), pa.array(clashes, pa.bool_()), lists(rows, n_rows)], [key, "table", "n_rows", "clash", "grid"])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, at_once):
                part = batch.slice(i, at_once)
                yield made(part.column(key), part.column(html).to_pylist())

    cells = "array<struct<col:int,origin:boolean,text:string,from_row:int,links:array<string>,images:array<string>>>"
    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, table int, n_rows int, clash boolean, grid array<struct<row:int,cells:{cells}>>")
