"""Rows, columns and Markdown tables from the boxes of words on a page.

Boxes(key..., idx, word, left, top, height, conf): a page's boxes are few (a sheet of paper), so they meet per page in one
array, in which they may also be given, and many pages are folded over together; pages are spread by their key. Three ways to group rows, which differ in the order of boxes, in what a box
is compared with, and by how much it may differ: `lines` (top of a row's first box, 20), `rows` (the same, half the
height of the page's first box), `centres` (the running mean of the row's centres, half the page's mean height).

Edge cases: boxes without a word or under the least confidence are left out of tables; a page without rows of two cells has no
table (null); equal boxes keep their order by idx.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import folds
from vellum.functions.scans import UNITS, is_header
from vellum.functions.tables import markdown_row

LINE_GAP = 20
COLUMN_GAP = 30
LEAST_CONFIDENCE = 20


#: What boxes are ordered by, in turn.
ORDERS = {"lines": ("top", "left", "idx"), "rows": ("top", "idx"), "centres": ("idx",)}


def pages(boxes: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """keys, boxes: the boxes of each page in one array, by idx."""
    return boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "word", "left", "top", "height", *more))).alias("boxes"))


def _numbered(way: str, boxes: dict[str, np.ndarray], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the boxes in the way's order, and their rows."""
    at = folds.ordered(lengths, *[boxes[c] for c in ORDERS[way]])
    top, height = boxes["top"][at], boxes["height"][at]
    some, firsts = lengths > 0, np.cumsum(lengths) - lengths
    limit = np.full(len(lengths), float(LINE_GAP))
    if way == "rows":
        limit[some] = height[firsts[some]] * 0.5
    elif way == "centres":
        limit[some] = np.add.reduceat(height, firsts[some]) / lengths[some] * 0.5 if some.any() else 0.0
    place = top + height / 2 if way == "centres" else top
    return at, folds.row_numbers(place, lengths, limit, way == "centres")


PARTS = ("idx", "left", "top", "height")


def _read(boxes: pa.StructArray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    lists = {c: folds.flat(boxes.field(c)) for c in PARTS}
    return {c: x for c, (x, _) in lists.items()}, lists["idx"][1]


def parts(*more: str, boxes: str = "boxes") -> Column:
    """A page's array of boxes as a struct of arrays."""
    return F.struct(*[F.col(f"{boxes}.{c}").alias(c) for c in (*PARTS, *more)])


def numbered(way: str, boxes: Column) -> Column:
    """struct<at array<int>, rows array<int>> of a page's boxes, a struct of arrays: their places in the way's order, from 0, and their rows, from 1."""

    @F.arrow_udf("struct<at: array<int>, rows: array<int>>")
    def run(page: pa.Array) -> pa.Array:
        found, lengths = _read(page)
        at, rows = _numbered(way, found, lengths)
        firsts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        return pa.StructArray.from_arrays([folds.nested(at - firsts, lengths), folds.nested(rows, lengths)], ["at", "rows"])

    return run(boxes)


def grouped(boxes: DataFrame, keys: list[str], way: str) -> DataFrame:
    """keys, boxes (in the way's order) with `row`, from 1."""
    found = pages(boxes, keys).withColumn("_n", numbered(way, parts()))
    return found.withColumn("boxes", F.zip_with("_n.at", "_n.rows", lambda i, r: F.get("boxes", i).withField("row", r))).drop("_n")


def _inferred(table: Column, n: Column) -> Column:
    """Headers of a table without any: Parameter first, then by the first three rows' cells."""
    units = [u for u in UNITS if u == u.lower()]

    def name(i):
        cells = F.transform(F.slice(table, 1, 3), lambda row: F.get(row, i))
        some = lambda test: F.exists(cells, test)
        unit = lambda c: F.exists(F.array(*[F.lit(u) for u in units]), lambda u: F.contains(F.lower(c), u))
        bounds = lambda c: F.contains(c, F.lit("-")) | F.contains(F.lower(c), F.lit("bis")) | F.contains(F.lower(c), F.lit("to"))
        return F.when(i == 0, "Parameter").when(some(lambda c: c.rlike("[0-9]")), "Value").when(some(unit), "Unit").when(some(bounds), "Reference Range").otherwise(F.concat(F.lit("Column "), i + 1))

    return F.transform(F.sequence(F.lit(0), n - 1), name)


def _table(boxes: Column) -> Column:
    """struct<n_rows, n_columns, table array<array<string>>>: a page's cells by rows and columns, rows of two filled cells or more."""

    @F.arrow_udf("struct<n_rows: int, n_columns: int, table: array<array<string>>>")
    def run(page: pa.Array) -> pa.Array:
        found, lengths = _read(page)
        words = page.field("word").flatten()
        # boxes without a word or under the least confidence are left out
        good = (folds.flat(page.field("conf"))[0] >= LEAST_CONFIDENCE) & pc.fill_null(pc.not_equal(pc.utf8_trim(words, " "), ""), False).to_numpy(zero_copy_only=False)
        lengths = np.bincount(folds.owners(lengths)[good], minlength=len(lengths))
        found, words = {c: x[good] for c, x in found.items()}, words.filter(pa.array(good))
        owner, n = folds.owners(lengths), len(lengths)
        at, rows = _numbered("rows", found, lengths)
        row = np.empty(len(at), np.int64)
        row[at] = rows
        # a word's column is how many starts there are up to it
        by_left = folds.ordered(lengths, found["left"])
        opens = folds.opened(found["left"][by_left], lengths, COLUMN_GAP)
        before = np.concatenate(([0], np.cumsum(opens)))
        column = np.empty(len(at), np.int64)
        column[by_left] = before[1:] - before[np.cumsum(lengths) - lengths][owner]
        n_rows, n_columns = np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.maximum.at(n_rows, owner, row)
        np.maximum.at(n_columns, owner, column)
        order = folds.ordered(lengths, row.astype(float), column.astype(float), found["left"], found["top"], found["idx"])
        row, column = row[order], column[order]
        fresh = lambda *by: np.flatnonzero(np.concatenate(([True], np.any([np.diff(x) != 0 for x in by], axis=0)))[: len(by[0])])
        # cells: words of one row and column; lines: cells of one row, of which those of two cells or more stay, with all columns
        cell = fresh(owner, row, column)
        cells = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(cell, len(order)), pa.int32()), words.take(pa.array(order))), " ")
        line = fresh(owner[cell], row[cell])
        members = np.diff(np.append(line, len(cell)))
        stays = members > 1
        page = owner[cell][line[stays]]
        upto = np.concatenate(([0], np.cumsum(n_columns[page])))
        kept = np.flatnonzero(np.repeat(stays, members))
        filled = np.full(upto[-1], len(cells))
        filled[np.repeat(upto[:-1], members[stays]) + column[cell][kept] - 1] = kept
        lines = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.concat_arrays([cells, pa.array([""])]).take(pa.array(filled)))
        tables = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(page, minlength=n)))), pa.int32()), lines)
        columns = [pa.array(n_rows, pa.int32()), pa.array(n_columns, pa.int32()), tables]
        return pa.StructArray.from_arrays(columns, ["n_rows", "n_columns", "table"])

    return run(boxes)


def markdown_tables(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_rows, n_columns, markdown of every page: boxes by rows, cells by the columns' starts, rows of two filled cells or more."""
    return markdown_pages(pages(boxes, keys, "conf"), keys, parts("word", "conf"))


def markdown_pages(pages: DataFrame, keys: list[str], boxes: Column) -> DataFrame:
    """The same from pages, whose boxes are a struct of arrays."""
    # a condition on the table itself would go below it, and have it made twice
    pages = pages.select(*keys, F.inline(F.filter(F.array(_table(boxes)), lambda t: t["n_rows"] > 0)))
    first = F.get("table", F.lit(0))
    headers = F.when(is_header(first), first).otherwise(_inferred(F.col("table"), F.col("n_columns")))
    body = F.when(is_header(first), F.slice("table", F.lit(2), F.size("table"))).otherwise(F.col("table"))
    lines = F.concat(F.array(F.lit("\n### Laboratory Results\n"), markdown_row(headers), markdown_row(F.array_repeat(F.lit("---"), F.col("n_columns")))), F.transform(body, markdown_row))
    some = (F.col("n_rows") >= 2) & (F.col("n_columns") >= 2) & (F.size("table") > 0)
    return pages.select(*keys, "n_rows", "n_columns", F.when(some, F.array_join(lines, "\n")).alias("markdown"))
