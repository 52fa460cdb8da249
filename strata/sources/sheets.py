"""Mapping sheets of any number and any headers, in one scan.

A sheet is a CSV file with a header of its own. All files are read as lines by one scan; a
sheet's lines go to one task in their order (a quoted cell may run over many of them), which
cuts them into records as they pass by. No task holds a whole sheet, so neither the size nor
the number of the files has a bound.
"""

from __future__ import annotations

import csv
import io
import itertools
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.sources import fs

SHEET = "sheet string, row int, names array<string>, cells array<string>"
BATCH = 2000                                      # rows that a parsing task hands on at a time


def header_names(cells: list) -> list[str]:
    """Column names of a header: a blank one is named by its place, a repeated one (in any
    case of letters) gets its place added."""
    seen: dict[str, int] = {}
    for c in cells:
        seen[(c or "").lower()] = seen.get((c or "").lower(), 0) + 1
    return [f"_c{i}" if not c else f"{c}{i}" if seen[c.lower()] > 1 else c for i, c in enumerate(cells)]


def parse_sheet(text: str | None) -> tuple[list, list]:
    """(names, rows) of a CSV text: quotes doubled inside quotes, line breaks inside quoted
    cells; an empty cell is NULL, a quoted empty one is not; lines without any cell are none;
    short rows are filled with NULL and cells beyond the header dropped."""
    records = _records(io.StringIO((text or "").removeprefix("﻿"), newline=""))
    names = header_names(next(records, []))
    return names, [_fitted(cells, len(names)) for cells in records]


def _records(lines: Iterable[str]) -> Iterator[list]:
    """The cells of each record that has any, read from lines as they come."""
    csv.field_size_limit(sys.maxsize)
    for cells in csv.reader(lines, quoting=csv.QUOTE_NOTNULL):
        if cells:
            yield [c and c.replace("\r\n", "\n") for c in cells]


def _fitted(cells: list, n: int) -> list:
    return (cells + [None] * n)[:n]


def _lines(found: Iterable[tuple]) -> Iterator[str]:
    """A sheet's lines with their ends, also at a lone carriage return. A reader of lines does
    not tell whether the last one had an end; the file's size does (less a byte order mark)."""
    read, held = -1, None
    for _, line, size in found:
        if held is not None:
            yield from io.StringIO(held + "\n", newline="")
        read, held = read + len(line.encode()) + 1, line
    if held is not None:
        yield from io.StringIO(held if size - read in (0, 3) else held + "\n", newline="")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the sheets whose lines come in order, sheet by sheet."""
    kinds = [pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())]
    lines = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns)))
    for sheet, found in itertools.groupby(lines, key=lambda x: x[0]):
        records = _records(_lines(found))
        names = header_names(next(records, []))
        rows = enumerate(_fitted(cells, len(names)) for cells in records)
        while part := list(itertools.islice(rows, BATCH)):
            columns = [[sheet] * len(part), [i for i, _ in part], [names] * len(part), [cells for _, cells in part]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["sheet", "row", "names", "cells"])


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """One row a sheet row: ``sheet`` (the file), ``row`` (from 0), ``names`` and ``cells``."""
    reader = spark.read
    if "*" not in path and fs.siblings(spark, f"{path.rstrip('/')}/*.csv"):
        reader = reader.option("pathGlobFilter", "*.csv")
    lines = reader.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("sheet"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), "value", F.col("_metadata.file_size").alias("size"))
    whole = lines.repartition("sheet").sortWithinPartitions("sheet", "block", "place")
    return whole.select("sheet", "value", "size").mapInArrow(_parsed, SHEET)


def load_sheets(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all sheets under the union of their headers, every column text. Headers
    that differ in case alone are one; rows and columns without any value are dropped. The
    headers (names, not rows) come from one aggregate, over the few ways in which a sheet's rows
    are filled."""
    rows = read_sheets(spark, path)
    ways = rows.select("sheet", "names", F.transform("cells", lambda c: c.isNotNull()).alias("filled")).distinct()
    cell = ways.select("sheet", F.explode(F.arrays_zip("names", "filled", F.sequence(F.lit(0), F.size("names") - 1).alias("place"))).alias("x"))
    found = (cell.where("x.filled").groupBy(F.lower("x.names").alias("key"))
             .agg(F.min(F.struct("sheet", "x.place", "x.names")).alias("first")).collect())
    names = [(r.key, r.first.names) for r in sorted(found, key=lambda r: (r.first.sheet, r.first.place))]
    if not names:
        return spark.createDataFrame([], "struct<>")
    cells = F.map_from_arrays(F.transform("names", F.lower), "cells")
    full = rows.where(F.exists("cells", lambda c: c.isNotNull())).select(cells.alias("m"))
    return full.select(*[F.col("m")[key].alias(name) for key, name in names])
