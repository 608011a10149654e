"""Row addressing by line number: count, get, ranges, pages, previews.

Every operator is a range filter on ``row_id``; on a table written in ``row_id`` order
the Parquet statistics skip everything outside the range.  For files as they are, a
``RowManifest`` has the same operators and reads only the files a range needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.functions.text import numbered

# How many lines a range request and a preview return unless told otherwise.
DEFAULT_RANGE = 10
PREVIEW_LINES = 100


def line_count(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count(F.lit(1)).alias("line_count"))


def total_lines(lines: DataFrame) -> Column:
    """The line count as a scalar subquery, usable inside any expression."""
    return lines.agg(F.count(F.lit(1))).scalar()


def get_line(lines: DataFrame, index: int) -> DataFrame:
    return lines.filter(F.col("row_id") == index)


def get_lines(lines: DataFrame, start: int = 0, count: int = DEFAULT_RANGE) -> DataFrame:
    """Lines ``[start, start + count)`` in order."""
    return window(lines, start, count)


def window(lines: DataFrame, start: int | Column, count: int) -> DataFrame:
    """Rows ``[start, start + count)`` in order."""
    row = F.col("row_id")
    return lines.filter((row >= start) & (row < F.lit(start) + count)).orderBy("row_id")


def format_numbered(lines: DataFrame) -> DataFrame:
    """Each line as ``L{n}: {line}``."""
    return lines.select("row_id", numbered(F.col("row_id"), F.col("line")).alias("text"))


def range_header(lines: DataFrame, start: int = 0, count: int = DEFAULT_RANGE) -> DataFrame:
    """The heading above a range: ``Lines a-b of N:`` or a note that there are none."""
    total = F.col("line_count")
    last = F.least(F.lit(start + count), total)
    found = F.format_string("Lines %d-%d of %d:", F.lit(start + 1), last, total)
    none = F.format_string("No lines found at index %d (dataset has %d lines)", F.lit(start), total)
    return line_count(lines).select(F.when(last > start, found).otherwise(none).alias("header"))


def preview(lines: DataFrame, count: int = PREVIEW_LINES) -> DataFrame:
    return lines.orderBy("row_id").limit(count)


def rows_around(lines: DataFrame, line_number: int, height: int) -> DataFrame:
    """A page of ``height`` rows centred on a 1-based line number, clamped to the data."""
    wanted = F.least(F.lit(max(line_number - 1, 0)), total_lines(lines) - 1)
    top = F.greatest(wanted - height // 2, F.lit(0))
    return window(lines, top, height)


def _last_top(lines: DataFrame, height: int) -> Column:
    return F.greatest(total_lines(lines) - height, F.lit(0))


def page(lines: DataFrame, number: int, height: int) -> DataFrame:
    """The 0-based page ``number``; scrolling stops at the last full page."""
    return window(lines, F.least(F.lit(number * height), _last_top(lines, height)), height)


def tail(lines: DataFrame, height: int) -> DataFrame:
    return window(lines, _last_top(lines, height), height)


def first_n_matches(matches: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows in row order, by a distributed top-k."""
    return matches.orderBy("row_id").limit(limit)
