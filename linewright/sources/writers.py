"""Sinks for record lines and the reports that go with them."""

from __future__ import annotations

import posixpath
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.operators.fix import skip_policy
from linewright.plans.bitmaps import with_flags

# Rows of one part file: no more than the first, and few parts below the second.
MOST_ROWS, FEW_ROWS = 200_000, 5_000
# Ids count as dense while they fill at least one part in this many of their range.
DENSE = 4


def in_row_order(lines: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Partitions that follow each other in ``row_id`` order, each sorted.

    Dense ids are cut into equal ranges by arithmetic.  That needs their extent, a scan of
    the ids alone, where a global sort would run the whole plan once more to sample it;
    ids with large gaps still take the sort.  ``ids`` may name a frame that has at least
    these ids and is cheaper to scan.
    """
    extent = (lines if ids is None else ids).agg(
        F.min("row_id").alias("low"),
        F.max("row_id").alias("high"),
        F.count(F.lit(1)).alias("rows"),
    )
    low, high, rows = extent.first()
    if not rows or high - low + 1 > DENSE * rows:
        return lines.orderBy("row_id")
    usual = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(-(-rows // MOST_ROWS), min(usual, -(-rows // FEW_ROWS)))
    share = (F.col("row_id") - low).cast("double") / F.lit(float(high - low + 1))
    slot = F.least(F.floor(share * parts).cast("int"), F.lit(parts - 1))
    return lines.repartitionById(parts, slot).sortWithinPartitions("row_id")


def _runs(lines: DataFrame, ids: DataFrame) -> list[int] | None:
    """The first row id of each partition, if each is a run of consecutive ids; else None.

    ``ids`` is ``lines`` before rows were left out.  Where no shuffle stands between the scan and
    both, they have the same partitions.  An empty partition has a negative number.
    """
    for frame in (lines, ids):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        if re.search(r"(?<!Broadcast)(?<!Reused)Exchange|Coalesce|Union|CartesianProduct", plan):
            return None
    tick = F.monotonically_increasing_id()
    placed = ids.select("row_id", F.spark_partition_id().alias("part"), tick.alias("tick"))
    shift = F.col("row_id") - F.col("tick").bitwiseAND((1 << 33) - 1)
    found = placed.groupBy("part").agg(F.min(shift).alias("low"), F.max(shift).alias("high"))
    # One row per partition of the scan.
    first = dict.fromkeys(range(ids.rdd.getNumPartitions()), -1)
    for row in found.toLocalIterator():
        if row["low"] != row["high"] or row["low"] < 0:
            return None
        first[row["part"]] = row["low"]
    if lines.rdd.getNumPartitions() != len(first):
        return None
    return [first[part] for part in sorted(first)]


def write_lines(
    lines: DataFrame, path: str, mode: str = "errorifexists", ids: DataFrame | None = None
) -> None:
    """Write ``line`` as text; the part files follow each other in ``row_id`` order.

    Lines read in row order, each partition a run of consecutive ids, are written where they are:
    their files are named by the first row of the run.  Others are dealt into ranges of ids.
    """
    runs = _runs(lines, lines if ids is None else ids)
    if runs is None:
        in_row_order(lines, ids).select("line").write.mode(mode).text(path)
        return
    spark = lines.sparkSession
    folder = _Swap(spark, path)
    if folder.exists(path):
        if mode in ("errorifexists", "error"):
            raise FileExistsError(f"{path} exists")
        if mode == "ignore":
            return
        if mode == "append":
            in_row_order(lines, ids).select("line").write.mode(mode).text(path)
            return
    staged = f"{path}.parts-{uuid.uuid4().hex}"
    lines.select("line").write.text(staged)
    for status in folder.filesystem.listStatus(folder.to_path(staged)):
        name = status.getPath().getName()
        part = re.match(r"part-(\d+)-", name)
        if part:
            first = runs[int(part[1])]
            folder.move(f"{staged}/{name}", f"{staged}/rows-{max(first, 0):019d}-{name}")
    if folder.exists(path):
        folder.delete(path)
    folder.move(staged, path)


def unique_lines(
    lines: DataFrame, duplicates: DataFrame, bitmap_buckets: int | None = None
) -> DataFrame:
    """Lines not flagged as duplicates, without those that are not valid UTF-8.

    The flags are attached as bitmaps, so the lines need no shuffle.
    """
    readable = lines.filter(F.is_valid_utf8("line"))
    marks = duplicates.filter("is_duplicate").select("row_id", F.lit(True).alias("_copy"))
    marked = with_flags(readable, marks, ["_copy"], bitmap_buckets)
    return marked.filter(~F.col("_copy")).select(*lines.columns)


def export_unique(
    lines: DataFrame, duplicates: DataFrame, path: str, mode: str = "errorifexists"
) -> None:
    write_lines(unique_lines(lines, duplicates), path, mode, ids=lines)


def write_fixed(
    fixed: DataFrame, path: str, skip_invalid: bool = False, mode: str = "errorifexists"
) -> None:
    """Write the result of ``fix``; rejected lines stay verbatim unless ``skip_invalid``."""
    write_lines(skip_policy(fixed, skip_invalid), path, mode, ids=fixed)


def fixed_output_path(path: str, explicit: str | None = None) -> str:
    """``{stem}_fixed.{ext}`` next to the input, or the explicit path."""
    if explicit:
        return explicit
    folder, name = posixpath.split(path)
    stem, extension = posixpath.splitext(name)
    return posixpath.join(folder, f"{stem}_fixed{extension}")


def fixed_output_path_col(path: Column) -> Column:
    """:func:`fixed_output_path` for a column of paths."""
    return F.regexp_replace(path, r"^(|.*/)([^/]+?)(\.[^./]*)?$", "$1$2_fixed$3")


class _Swap:
    """The folders of a replacement in place: new data, old data, and the marker between them."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.path, self.staged, self.aside = path, f"{path}.tmp", f"{path}.old"
        self.marker = f"{path}.swap"
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.filesystem = self.to_path(path).getFileSystem(conf)

    def exists(self, path: str) -> bool:
        return self.filesystem.exists(self.to_path(path))

    def move(self, source: str, target: str) -> None:
        if not self.filesystem.rename(self.to_path(source), self.to_path(target)):
            raise OSError(f"cannot rename {source} to {target}")

    def delete(self, path: str) -> None:
        self.filesystem.delete(self.to_path(path), True)

    def mark(self) -> None:
        """From here on the staged data is complete and counts."""
        self.filesystem.create(self.to_path(self.marker), True).close()

    def finish(self) -> None:
        """Carry on from wherever a marked replacement stopped; each step may be done already."""
        if self.exists(self.staged):
            if self.exists(self.path):
                if self.exists(self.aside):
                    self.delete(self.aside)
                self.move(self.path, self.aside)
            self.move(self.staged, self.path)
        self.delete(self.marker)
        self.delete(self.aside)


def finish_overwrite(spark: SparkSession, path: str) -> bool:
    """Complete a replacement at ``path`` that was stopped half way; whether there was one.

    A replacement that stopped before its new data was complete is not taken up: the old data is
    still in place.
    """
    swap = _Swap(spark, path)
    marked = swap.exists(swap.marker)
    if marked:
        swap.finish()
    return marked


def overwrite_in_place(lines: DataFrame, path: str) -> None:
    """Replace the text at ``path`` by ``lines``, which may have been read from it.

    The new data is complete under ``{path}.tmp`` before the old is touched, and a marker
    ``{path}.swap`` says so.  Then the old is moved aside, the new moved in, and the old deleted.
    Stopped in between, ``finish_overwrite`` or the next call brings it to its end.
    """
    spark: SparkSession = lines.sparkSession
    finish_overwrite(spark, path)
    swap = _Swap(spark, path)
    write_lines(lines, swap.staged, mode="overwrite")
    swap.mark()
    swap.finish()


def dedup_report(stats: DataFrame) -> DataFrame:
    """One line of text for the result of ``dedup_stats``."""
    return stats.select(
        F.format_string(
            "%d total | %d unique | %d duplicates (%.1f%%) | strategy: %s",
            "total_lines",
            "unique_count",
            "duplicate_count",
            F.col("dedup_ratio") * 100,
            "strategy",
        ).alias("report")
    )


def lint_report(summary: DataFrame) -> DataFrame:
    return summary.select(F.format_string("Found %d issues", "issues").alias("report"))


def fix_report(summary: DataFrame) -> DataFrame:
    return summary.select(
        F.format_string(
            "Total lines: %d | Fixed lines: %d | Unchanged lines: %d | Skipped lines: %d",
            "total_lines",
            "fixed_lines",
            "unchanged_lines",
            "skipped_lines",
        ).alias("report")
    )
