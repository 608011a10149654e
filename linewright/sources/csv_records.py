"""Records of delimited files with quoted newlines, read by many tasks per file.

Spark splits text files at physical lines, and whether a line is inside quotes depends on all lines
before it.  So a first scan finds, for each split, where it would end if it began inside quotes and
if it began outside, and how many records would start in it; put together split after split this
gives the true beginning of each, one small row per split.  A second scan joins the lines of each
record.  Only a record that crosses the border of a split leaves its task: its pieces, at most two
per split, are put together by the number of the record.  The values are then read by Spark's own
CSV parser.

A quote opens a value only where a value begins, as in Spark's parser; quotes inside unquoted
values are plain characters.  Empty lines between records are skipped.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.plans.durable import written
from linewright.sources.rowid import MAX_BROADCAST_SPLITS

# Kinds of pieces: a whole record, and parts of one that crosses a border of splits.
WHOLE, PART = 0, 1
_SUMMARY = "file string, block long, end_outside boolean, end_inside boolean, outside long, inside long"
_PLACED = "file string, block long, quoted boolean, first_record long, file_records long"
_PIECES = "file string, kind int, record long, block long, text string"
_CLOSING = re.compile('(?:[^"]|"")*+"')


@lru_cache(maxsize=None)
def _opening(sep: str) -> re.Pattern[str]:
    return re.compile(f'(?:^|{re.escape(sep)})"')


def quoted_after(line: str, quoted: bool, sep: str) -> bool:
    """Whether the end of a line is inside quotes, given whether its start is."""
    if '"' not in line:
        return quoted
    at = 0
    if quoted:
        closed = _CLOSING.match(line)
        if closed is None:
            return True
        at = closed.end()
    while True:
        # A value that begins the line counts only at its very start.
        opened = _opening(sep).search(line, at)
        if opened is None:
            return False
        closed = _CLOSING.match(line, opened.end())
        if closed is None:
            return True
        at = closed.end()


def _splits(batches: Iterator[pa.RecordBatch], begin: Callable, each: Callable, end: Callable):
    """Go through the lines of a task split by split; ``begin`` gets a split's first row."""
    current = None
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        for row, (key, line) in enumerate(zip(zip(files, blocks), batch.column("line").to_pylist())):
            if key != current:
                if current is not None:
                    yield from end()
                begin(key, batch, row)
                current = key
            each(line.removesuffix("\r"))
        yield from end(True)
    if current is not None:
        yield from end()


def _summaries(sep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def begin(key, batch, row) -> None:
            state.update(key=key, outside=False, inside=True, starts=[0, 0])

        def each(line: str) -> None:
            # Two readings at once: of a split that begins outside quotes, and of one inside.
            for number, name in enumerate(("outside", "inside")):
                if not state[name] and line:
                    state["starts"][number] += 1
                state[name] = quoted_after(line, state[name], sep)

        def end(more: bool = False) -> Iterator[pa.RecordBatch]:
            if not more:
                row = (*state["key"], state["outside"], state["inside"], *state["starts"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([value]) for value in row],
                    names=["file", "block", "end_outside", "end_inside", "outside", "inside"],
                )

        return _splits(batches, begin, each, end)

    return run


def _chained(splits: pa.Table) -> pa.Table:
    """The true beginning of each split of one file, and how many records start before it."""
    rows = sorted(splits.to_pylist(), key=lambda r: r["block"])
    quoted, records, out = False, 0, []
    for row in rows:
        out.append({"file": row["file"], "block": row["block"], "quoted": quoted, "first_record": records})
        records += row["inside"] if quoted else row["outside"]
        quoted = row["end_inside"] if quoted else row["end_outside"]
    for row in out:
        row["file_records"] = records
    schema = pa.schema(
        [
            ("file", pa.string()),
            ("block", pa.int64()),
            ("quoted", pa.bool_()),
            ("first_record", pa.int64()),
            ("file_records", pa.int64()),
        ]
    )
    return pa.Table.from_pylist(out, schema=schema)


def _joined(sep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"out": []}

        def begin(key, batch, row) -> None:
            quoted = batch.column("quoted")[row].as_py()
            first = batch.column("first_record")[row].as_py()
            # A split that begins inside quotes goes on with the record before its first.
            state.update(key=key, quoted=quoted, record=first - 1, lines=[], whole=not quoted)

        def give(kind: int) -> None:
            if state["lines"]:
                file, block = state["key"]
                state["out"].append((file, kind, state["record"], block, "\n".join(state["lines"])))
            state["lines"], state["whole"] = [], True

        def each(line: str) -> None:
            if not state["quoted"]:
                if not line:
                    return
                state["record"] += 1
            state["lines"].append(line)
            state["quoted"] = quoted_after(line, state["quoted"], sep)
            if not state["quoted"]:
                give(WHOLE if state["whole"] else PART)

        def end(more: bool = False) -> Iterator[pa.RecordBatch]:
            if not more:
                # What is still open goes on in the next split.
                give(PART)
            if state["out"]:
                columns = zip(*state["out"], strict=True)
                types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    names=["file", "kind", "record", "block", "text"],
                )
                state["out"] = []

        return _splits(batches, begin, each, end)

    return run


def csv_records(spark: SparkSession, paths: list[str], sep: str) -> DataFrame:
    """``file, record, text``: each record of each file, numbered in its file, header included.

    ``file_records`` is the number of records of the file.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    summaries = lines.mapInArrow(_summaries(sep), _SUMMARY)
    # A row per split: a file's splits are one group.
    placed, splits = written(summaries.groupBy("file").applyInArrow(_chained, _PLACED), "csv-splits")
    side = F.broadcast(placed) if splits <= MAX_BROADCAST_SPLITS else placed
    marked = lines.join(side, ["file", "block"])
    if splits > MAX_BROADCAST_SPLITS:
        # A shuffle takes the lines out of order.
        raise ValueError(f"more than {MAX_BROADCAST_SPLITS} splits; raise spark.sql.files.maxPartitionBytes")
    pieces, parts = written(
        marked.mapInArrow(_joined(sep), _PIECES), "csv-pieces", F.col("kind") == PART
    )
    whole = pieces.filter(F.col("kind") == WHOLE).select("file", "record", "text")
    if parts:
        ordered = F.array_sort(F.collect_list(F.struct("block", "text")))
        crossing = pieces.filter(F.col("kind") == PART).groupBy("file", "record").agg(ordered.alias("parts"))
        text = F.array_join(F.col("parts")["text"], "\n").alias("text")
        whole = whole.unionByName(crossing.select("file", "record", text))
    totals = placed.groupBy("file").agg(F.max("file_records").alias("file_records"))
    return whole.join(F.broadcast(totals), "file")
