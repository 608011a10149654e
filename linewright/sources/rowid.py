"""Dense 0-based row ids in file order, without a global sort.

A scan hands out rows split by split, and inside one split ``monotonically_increasing_id``
grows by one per row.  So a row's id is its position in the split plus the number of rows
in all splits before it.  The counts come from one aggregate with a row per split; the
lines themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A split row is about 100 bytes, so this many stay near 100 MB when broadcast.  It is
# also the row count for 100 TB at the default split size.
MAX_BROADCAST_SPLITS = 1_000_000

_FILE, _BLOCK, _TICK = "_file", "_block", "_tick"
POSITION = (_FILE, _BLOCK, _TICK)


def scan_position(df: DataFrame) -> DataFrame:
    """Add the columns that place a row within its file scan."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias(_FILE),
        F.col("_metadata.file_block_start").alias(_BLOCK),
        F.monotonically_increasing_id().alias(_TICK),
    )


def split_offsets(positioned: DataFrame) -> DataFrame:
    """One row per split: its first tick and the number of rows before it.

    Running sums go file by file; only one total per file meets in the last window, the
    same magnitude as the file listing Spark's driver already holds.
    """
    splits = positioned.groupBy(_FILE, _BLOCK).agg(
        F.min(_TICK).alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    in_file = Window.partitionBy(_FILE).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    files = splits.groupBy(_FILE).agg(F.sum("_rows").alias("_file_rows"))
    files = files.select(
        F.col(_FILE),
        F.coalesce(
            F.sum("_file_rows").over(
                Window.orderBy(_FILE).rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_file_base"),
    )
    placed = splits.withColumn("_in_file", F.coalesce(F.sum("_rows").over(in_file), F.lit(0)))
    return placed.join(files, _FILE).select(
        _FILE, _BLOCK, (F.col("_file_base") + F.col("_in_file") - F.col("_first")).alias("_shift")
    )


def split_bound(scan: DataFrame) -> int:
    """An upper bound on the number of splits, from planning alone (no job runs).

    A task reads consecutive pieces of its bin; every file adds at most one piece that
    does not start a task.
    """
    return scan.rdd.getNumPartitions() + len(scan.inputFiles())


def with_row_id(df: DataFrame, keep_source: bool = False) -> DataFrame:
    """Prepend ``row_id`` to a DataFrame that reads files directly.

    Files count in path order.  ``keep_source`` also keeps the path as ``source_path``.
    """
    return numbered_rows(scan_position(df), df.columns, keep_source)


def numbered_rows(
    positioned: DataFrame, columns: list[str], keep_source: bool = False
) -> DataFrame:
    """``row_id`` and ``columns`` of one or several scans that ``scan_position`` has marked."""
    offsets = split_offsets(positioned.select(*POSITION))
    if split_bound(positioned) <= MAX_BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    source = [F.col(_FILE).alias("source_path")] if keep_source else []
    return positioned.join(offsets, [_FILE, _BLOCK]).select(
        (F.col(_TICK) + F.col("_shift")).alias("row_id"), *columns, *source
    )


def parquet_row_id(df: DataFrame, keep_source: bool = False) -> DataFrame:
    """Row ids for a Parquet scan: position in the file plus the rows of earlier files.

    The per-file counts need no data pages, only row positions.
    """
    columns = df.columns
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias(_FILE),
        F.col("_metadata.row_index").alias("_position"),
    )
    counts = placed.groupBy(_FILE).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy(_FILE).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        _FILE, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base")
    )
    if len(df.inputFiles()) <= MAX_BROADCAST_SPLITS:
        bases = F.broadcast(bases)
    source = [F.col(_FILE).alias("source_path")] if keep_source else []
    return placed.join(bases, _FILE).select(
        (F.col("_base") + F.col("_position")).alias("row_id"), *columns, *source
    )
