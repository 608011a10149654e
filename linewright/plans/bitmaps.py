"""Flags of rows as bitmaps, attached to lines without moving them.

One bitmap of 4 KB holds the flags of 32,768 neighbouring row ids.  The bitmaps are written,
counted and, up to a checked number, broadcast; the lines are not shuffled.  More bitmaps than that
are broadcast range by range, each range meeting only its own lines: on lines stored in row order
the ranges skip each other's files, so together they read the lines once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.plans.durable import written

# Bitmaps that may be broadcast: 200 MB, flags for over a billion and a half rows.
BITMAP_BUCKETS = 50_000
# Ranges of row ids that are flagged one after the other, each with bitmaps of that size; more
# flags than these passes hold are joined by row instead.
MAX_PASSES = 16
# Row ids of one bitmap.
_BUCKET_ROWS = 32_768


def is_set(bitmap: Column, row_id: str = "row_id") -> Column:
    """Whether the row's bit is set in the bitmap of its bucket; a NULL bitmap has none."""
    position = F.bitmap_bit_position(row_id)
    byte = F.substring(bitmap, F.floor(position / 8).cast("int") + 1, F.lit(1))
    bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (position % 8).cast("int"))
    return F.coalesce(bit == 1, F.lit(False))


def with_flags(
    lines: DataFrame, marks: DataFrame, flags: list[str], bitmap_buckets: int | None = None
) -> DataFrame:
    """Add a BOOLEAN column per flag: true for the row ids that ``marks`` flags.

    ``marks`` has ``row_id`` and a BOOLEAN column per flag; a row may be marked many times.
    More bitmaps than ``bitmap_buckets`` are taken in up to MAX_PASSES ranges; beyond those, marks
    and lines are joined by row.
    """
    limit = BITMAP_BUCKETS if bitmap_buckets is None else bitmap_buckets
    packed, buckets = written(
        marks.groupBy(F.bitmap_bucket_number("row_id").alias("_bucket")).agg(
            *[
                F.expr(
                    f"bitmap_construct_agg(bitmap_bit_position(row_id)) FILTER (WHERE {flag})"
                ).alias(flag)
                for flag in flags
            ]
        ),
        "flags",
    )
    passes = -(-buckets // limit) if limit else MAX_PASSES + 1
    if passes > MAX_PASSES:
        largest = [F.max(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in flags]
        joined = lines.join(marks.groupBy("row_id").agg(*largest), "row_id", "left")
        return joined.withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in flags})
    if passes <= 1:
        return _flagged(lines, packed, flags)
    shares = [i / passes for i in range(1, passes)]
    cuts = packed.agg(F.percentile_approx("_bucket", shares, 1_000_000)).first()[0]
    bounds = [None, *sorted(set(cuts)), None]
    parts = [
        _flagged(_between(lines, low, high), packed.filter(_in_range(F.col("_bucket"), low, high)), flags)
        for low, high in zip(bounds[:-1], bounds[1:], strict=True)
    ]
    return reduce(DataFrame.unionByName, parts)


def _in_range(bucket: Column, low: int | None, high: int | None) -> Column:
    """Buckets above ``low``, up to ``high``."""
    above = F.lit(True) if low is None else bucket > low
    return above if high is None else above & (bucket <= high)


def _between(lines: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """The lines of a range of buckets; the bounds on the id itself are what files are skipped by."""
    row = F.col("row_id")
    part = lines
    if low is not None:
        part = part.filter(row > (low - 1) * _BUCKET_ROWS)
    if high is not None:
        part = part.filter(row <= (high + 1) * _BUCKET_ROWS)
    return part.filter(_in_range(F.bitmap_bucket_number("row_id"), low, high))


def _flagged(lines: DataFrame, packed: DataFrame, flags: list[str]) -> DataFrame:
    bucketed = lines.withColumn("_bucket", F.bitmap_bucket_number("row_id"))
    joined = bucketed.join(F.broadcast(packed), "_bucket", "left")
    return joined.withColumns({f: is_set(F.col(f)) for f in flags}).drop("_bucket")
