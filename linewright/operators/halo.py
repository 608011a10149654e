"""Context of search hits in one scan, with only the borders of row runs shuffled.

Rows of a scan come in runs of consecutive row ids.  A hit whose context lies inside its run is
finished where it is read.  What the others need are the first and last rows of runs: these border
rows, at most twice the context at either end, are written with the hits that reach beyond their
run, and joined by row id.  A frame whose rows come in no order has runs of one row; then all rows
are border rows, and each is shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.plans.durable import written

# Kinds of rows that a scan gives: a border row, a hit left open, a hit with its context.
BORDER, OPEN, DONE = 0, 1, 2
_FOUND = "kind int, row_id long, line string, rows array<struct<row_id:long,line:string>>"
_PIECE = pa.struct([("row_id", pa.int64()), ("line", pa.string())])
_ARROW = pa.schema(
    [("kind", pa.int32()), ("row_id", pa.int64()), ("line", pa.string()), ("rows", pa.list_(_PIECE))]
)
# Bytes of finished contexts given out at once, or one context.
_CONTEXT_BYTES = 16 << 20


def _given(kind: int, ids: np.ndarray, line: pa.Array | None, rows: pa.Array | None) -> pa.RecordBatch:
    columns = [
        pa.array(np.full(len(ids), kind, np.int32)),
        pa.array(ids),
        pa.nulls(len(ids), pa.string()) if line is None else line,
        pa.nulls(len(ids), _ARROW.field("rows").type) if rows is None else rows,
    ]
    return pa.record_batch(columns, schema=_ARROW)


def _finished(
    ids: np.ndarray, lines: pa.Array, sizes: np.ndarray, hits: np.ndarray, context: int
) -> Iterator[pa.RecordBatch]:
    """The hits at these places with the rows around them, some bytes at a time."""
    wide = 2 * context + 1
    ends = np.append(0, np.cumsum(sizes + 16))
    cost = np.cumsum(ends[hits + context + 1] - ends[hits - context])
    start = 0
    while start < len(hits):
        spent = cost[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(cost, spent + _CONTEXT_BYTES, "right")))
        some = hits[start:stop]
        places = (some[:, None] + np.arange(-context, context + 1)[None, :]).ravel()
        pieces = pa.StructArray.from_arrays(
            [pa.array(ids[places]), lines.take(pa.array(places))], fields=list(_PIECE)
        )
        offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * wide)
        yield _given(DONE, ids[some], None, pa.ListArray.from_arrays(offsets, pieces))
        start = stop


def _runs(context: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hit = np.zeros(0, np.int64), np.zeros(0, bool)
        shown, lines, earlier = np.zeros(0, bool), pa.array([], pa.string()), 0

        def taken(more: bool) -> Iterator[pa.RecordBatch]:
            """Give out what the held rows settle; ``more`` rows may follow in the last run."""
            nonlocal ids, hit, shown, lines, earlier
            n = len(ids)
            starts = np.append(0, np.flatnonzero(np.diff(ids) != 1) + 1)
            run_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
            first = starts.copy()
            # The first run began before the rows still held.
            first[0] -= earlier
            begin, end = first[run_of], np.append(starts[1:], n)[run_of] - 1
            goes_on = (run_of == len(starts) - 1) & more
            place = np.arange(n)
            # A hit near the border of its run needs rows on its other side, too.
            border = (place - begin < 2 * context) | (~goes_on & (end - place < 2 * context))
            known = np.asarray(lines.is_valid())
            fresh = np.flatnonzero(border & ~shown & known)
            if len(fresh):
                yield _given(BORDER, ids[fresh], lines.take(pa.array(fresh)), None)
            shown |= border
            at = np.flatnonzero(hit)
            before, after = at - context < begin[at], at + context > end[at]
            waits = after & goes_on[at] & ~before
            open_ = at[(before | after) & ~waits]
            if len(open_):
                yield _given(OPEN, ids[open_], None, None)
            yield from _finished(ids, lines, _sizes(lines), at[~before & ~after], context)
            hit[at[~waits]] = False
            # A row that waits for what follows is at most twice the context back.
            kept = max(int(starts[-1]), n - 2 * context - 1)
            earlier = kept - int(first[-1])
            ids, hit, shown, lines = ids[kept:], hit[kept:], shown[kept:], lines.slice(kept)

        for batch in batches:
            if not len(batch):
                continue
            ids = np.append(ids, np.asarray(batch.column("row_id")))
            hit = np.append(hit, np.asarray(batch.column("hit").fill_null(False)).astype(bool))
            shown = np.append(shown, np.zeros(len(batch), bool))
            lines = pa.concat_arrays([lines, batch.column("line").cast(pa.string())])
            yield from taken(True)
        if len(ids):
            yield from taken(False)

    return run


def _sizes(lines: pa.Array) -> np.ndarray:
    """Bytes of each line; NULL has none."""
    _, offsets, _ = lines.buffers()
    ends = np.frombuffer(offsets, np.int32)[lines.offset : lines.offset + len(lines) + 1]
    return np.diff(ends.astype(np.int64))


def hit_contexts(
    lines: DataFrame, hit: Column, context: int, broadcast_rows: int
) -> DataFrame:
    """``row_id``, ``rows``: each row where ``hit`` holds, with the readable rows around it in order.

    ``rows`` are ``row_id, line`` structs of ids within ``context``.  The scan is read once.
    """
    line = F.when(F.is_valid_utf8("line"), F.col("line"))
    marked = lines.select(F.col("row_id").cast("long").alias("row_id"), line.alias("line"), hit.alias("hit"))
    found, n_open = written(
        marked.mapInArrow(_runs(context), _FOUND), "halo", F.col("kind") == OPEN
    )
    done = found.filter(F.col("kind") == DONE).select(
        "row_id", F.filter("rows", lambda r: r["line"].isNotNull()).alias("rows")
    )
    around = F.sequence(F.col("row_id") - context, F.col("row_id") + context)
    wanted = found.filter(F.col("kind") == OPEN).select(
        F.col("row_id").alias("_hit"), F.explode(around).alias("row_id")
    )
    if n_open * (2 * context + 1) <= broadcast_rows:
        wanted = F.broadcast(wanted)
    borders = found.filter(F.col("kind") == BORDER).select("row_id", "line")
    pieces = borders.join(wanted, "row_id").select("_hit", F.struct("row_id", "line").alias("piece"))
    joined = pieces.groupBy(F.col("_hit").alias("row_id")).agg(
        F.array_sort(F.collect_list("piece")).alias("rows")
    )
    return done.unionByName(joined)
