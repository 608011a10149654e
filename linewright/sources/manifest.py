"""Row ranges without scanning or counting everything: a written table of splits and their rows.

``write_manifest`` reads a dataset once and writes, for each split of each file, the number of its
first row.  ``RowManifest`` then answers counts from that table alone, turns a range of rows into
the files that hold it before anything is read, and numbers lines from it, so no later action
counts rows.  A file is the least that is read.

Splits must fall in the same places each time.  A session of its own reads with a fixed split size
that is also the cost of opening a file: then every split is a task, and a row's position in its
task is its position in the split.  The caller's settings are not touched.  Parquet scans know row
positions by themselves, so there a file is one entry.

A file that has changed or joined the dataset since fails the query that reads it.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewright.operators import rows as row_access
from linewright.sources.formats import JSONL, PARQUET, TSV, parse_format
from linewright.sources.readers import row_to_json, scan_csv_lines, scan_jsonl
from linewright.sources.rowid import MAX_BROADCAST_SPLITS, POSITION, scan_position

SPLIT_BYTES = 128 << 20
# Low bits of a scan's running id: the position of a row in its task.
_IN_TASK = (1 << 33) - 1
_ENTRIES = "file string, block long, first_row long, rows long, size long, modified timestamp"
_ABOUT = "path string, fmt string, multiline boolean, split_bytes long"


def _scanning_session(spark: SparkSession, split_bytes: int) -> SparkSession:
    """A session whose scans have one split of ``split_bytes`` per task."""
    child = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            child.conf.set(key, value)
    child.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    child.conf.set("spark.sql.files.openCostInBytes", str(split_bytes))
    child.conf.unset("spark.sql.files.maxPartitionNum")
    return child


def _scan(
    spark: SparkSession, paths: str | list[str], fmt: str, multiline: bool
) -> DataFrame | None:
    """``line, file, block, place, size, modified``: lines and their places in their splits."""
    stamps = [F.col("_metadata.file_size").alias("size")]
    stamps.append(F.col("_metadata.file_modification_time").alias("modified"))
    if fmt == PARQUET:
        frame = spark.read.option("mergeSchema", "true").parquet(
            *([paths] if isinstance(paths, str) else paths)
        )
        return frame.select(
            row_to_json(frame).alias("line"),
            F.col("_metadata.file_path").alias("file"),
            F.lit(0).cast("long").alias("block"),
            F.col("_metadata.row_index").alias("place"),
            *stamps,
        )
    if fmt == JSONL:
        marked = scan_position(scan_jsonl(spark, paths)).select("line", *POSITION, *stamps)
    else:
        marked = scan_csv_lines(spark, paths, "\t" if fmt == TSV else ",", multiline, stamps)
    if marked is None:
        return None
    file, block, tick = POSITION
    return marked.select(
        "line",
        F.col(file).alias("file"),
        F.col(block).alias("block"),
        F.col(tick).bitwiseAND(F.lit(_IN_TASK)).alias("place"),
        "size",
        "modified",
    )


def write_manifest(
    spark: SparkSession,
    path: str,
    table_path: str,
    fmt: str = "auto",
    multiline: bool = True,
    split_bytes: int = SPLIT_BYTES,
) -> RowManifest:
    """Count the rows of every split once and write the table.

    Files follow each other in path order, as in the readers.  First rows are running sums
    inside ranges of splits plus the totals of the ranges before, so no task holds all splits.
    """
    chosen = parse_format(fmt, path)
    scan = _scan(_scanning_session(spark, split_bytes), path, chosen, multiline)
    if scan is None:
        splits = spark.createDataFrame(
            [], "file string, block long, rows long, size long, modified timestamp"
        )
    else:
        splits = scan.groupBy("file", "block").agg(
            F.count(F.lit(1)).alias("rows"),
            F.max("size").alias("size"),
            F.max("modified").alias("modified"),
        )
    splits.write.parquet(f"{table_path}/counts")
    counts = spark.read.schema(splits.schema).parquet(f"{table_path}/counts")
    ranges = counts.orderBy("file", "block").withColumn("range", F.spark_partition_id())
    ranges.write.parquet(f"{table_path}/ranges")
    ranges = spark.read.schema(ranges.schema).parquet(f"{table_path}/ranges")
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.groupBy("range").agg(F.sum("rows").alias("range_rows"))
    # One row per partition of the sort.
    bases = bases.select(
        "range", F.coalesce(F.sum("range_rows").over(earlier.orderBy("range")), F.lit(0)).alias("base")
    )
    inside = F.sum("rows").over(earlier.partitionBy("range").orderBy("file", "block"))
    entries = ranges.withColumn("inside", F.coalesce(inside, F.lit(0))).join(
        F.broadcast(bases), "range"
    )
    entries.select(
        "file", "block", (F.col("base") + F.col("inside")).alias("first_row"), *splits.columns[2:]
    ).write.parquet(f"{table_path}/entries")
    about = spark.createDataFrame([(path, chosen, multiline, split_bytes)], _ABOUT)
    about.coalesce(1).write.parquet(f"{table_path}/about")
    return RowManifest(spark, table_path)


@dataclass
class RowManifest:
    """A dataset's written split table; ``RowManifest(spark, table_path)`` opens it again."""

    spark: SparkSession
    table_path: str

    def entries(self) -> DataFrame:
        """``file, block, first_row, rows, size, modified`` of each split that has rows."""
        return self.spark.read.schema(_ENTRIES).parquet(f"{self.table_path}/entries")

    def line_count(self) -> DataFrame:
        total = F.coalesce(F.sum("rows"), F.lit(0)).cast("long")
        return self.entries().agg(total.alias("line_count"))

    def total(self) -> int:
        return self.line_count().first()["line_count"]

    def files(self, first: int, count: int) -> list[str]:
        """The files that hold rows ``[first, first + count)``; nothing but the table is read."""
        held = self._overlapping(first, count).select("file").distinct().collect()
        return sorted(row["file"] for row in held)

    def _overlapping(self, first: int, count: int) -> DataFrame:
        last = F.col("first_row") + F.col("rows")
        return self.entries().filter((F.col("first_row") < first + count) & (last > first))

    def lines(self, first: int | None = None, count: int = 0) -> DataFrame:
        """``row_id, line`` of rows ``[first, first + count)``, or of all rows."""
        path, fmt, multiline, split_bytes = self._about()
        if first is None:
            paths, splits = path, self.entries()
            few = splits.count() <= MAX_BROADCAST_SPLITS
        else:
            paths = [unquote(file) for file in self.files(first, count)]
            splits, few = self._overlapping(first, count), len(paths) <= MAX_BROADCAST_SPLITS
        scan = None
        if paths:
            scan = _scan(_scanning_session(self.spark, split_bytes), paths, fmt, multiline)
        if scan is None:
            return self.spark.createDataFrame([], "row_id long, line string")
        known = splits.select(
            "file", "block", "first_row", F.struct("size", "modified").alias("stamp")
        )
        known = F.broadcast(known) if few else known
        # All rows: a split that is not in the table is an error.  A range: it is outside.
        placed = scan.join(known, ["file", "block"], "left" if first is None else "inner")
        same = F.col("stamp").eqNullSafe(F.struct("size", "modified"))
        changed = F.concat(F.lit("changed since the manifest was written: "), F.col("file"))
        row_id = F.when(same, F.col("first_row") + F.col("place")).otherwise(F.raise_error(changed))
        lines = placed.select(row_id.alias("row_id"), "line")
        lines = DataFrame(lines._jdf, self.spark)
        return lines if first is None else row_access.window(lines, first, count)

    def _about(self) -> tuple[str, str, bool, int]:
        return tuple(self.spark.read.schema(_ABOUT).parquet(f"{self.table_path}/about").first())

    def get_line(self, index: int) -> DataFrame:
        return self.lines(index, 1)

    def get_lines(self, start: int = 0, count: int = row_access.DEFAULT_RANGE) -> DataFrame:
        """Lines ``[start, start + count)`` in order."""
        return self.lines(start, count)

    def preview(self, count: int = row_access.PREVIEW_LINES) -> DataFrame:
        return self.lines(0, count)

    def rows_around(self, line_number: int, height: int) -> DataFrame:
        """A page of ``height`` rows centred on a 1-based line number, clamped to the data."""
        wanted = min(max(line_number - 1, 0), self.total() - 1)
        return self.lines(max(wanted - height // 2, 0), height)

    def page(self, number: int, height: int) -> DataFrame:
        """The 0-based page ``number``; scrolling stops at the last full page."""
        return self.lines(min(number * height, max(self.total() - height, 0)), height)

    def tail(self, height: int) -> DataFrame:
        return self.lines(max(self.total() - height, 0), height)
