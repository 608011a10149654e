"""Dense tiles: fingerprints compared all with all, in packed arrays.

XOR and popcount of two packed arrays cost a few nanoseconds a pair, so up to a size that grows with
the distance it is cheaper to compare everything than to make keys (a fingerprint has 165 keys at
distance 8).  Plans that know their row counts choose by :func:`cheaper`.

* ``tile_pairs`` deals both sides into tiles and tests each tile against each.
* ``own_pairs`` does so for one table with itself, each two tiles once, and hands pairs on as they are
  found.  ``own_tiles_pay`` tells from a sample if keys would have rows meet so often that testing what
  meets costs more than comparing everything.
* ``settle_by_tiles`` makes the first-fit choice: a tile of ids in order is settled by itself, in one
  task of bounded size, and its kept ids are swept over the rest, so pairs are never listed.  A row
  that has found the first kept id it is close to is not compared any further.  ``tile_rounds`` does
  the same as long as a tile's few kept ids drop more rows than keys would for the same cost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.plans.durable import written

# Ids settled by one task: their fingerprints are 128 KB.
TILE_ROWS = 16_384
# Rows of one side of a tile of pairs.
PAIR_ROWS = 8_192
# Measured costs: a pair in a tile, and a key made, shuffled and joined.
PAIR_SECONDS, KEY_SECONDS = 4e-9, 1.5e-6
# The same for a pair of ``own_pairs``, which are tested in blocks of the cache, and for two rows that
# met on a key.
OWN_PAIR_SECONDS, MET_SECONDS = 1.5e-9, 2e-8
# Rows of a tile of ``own_pairs`` at most, and the tiles of smaller tables.
OWN_ROWS, OWN_TILES = 65_536, 16
# Rows looked at to tell how many meet on keys.
MEET_ROWS = 20_000
# Pairs handed on at once.
PAIR_BATCH = 1 << 20
# Cells of a matrix held at once, and of a block in the cache.
_CELLS = 1 << 21
_BLOCK_ROWS, _BLOCK_COLUMNS = 8, 4096


def cheaper(left_rows: int, right_rows: int, keys: int) -> bool:
    """Whether comparing everything costs less than ``keys`` keys for every row."""
    return left_rows * right_rows * PAIR_SECONDS <= (left_rows + right_rows) * keys * KEY_SECONDS


def _prints(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks()).view(np.uint64)


def close_cells(
    left: np.ndarray, right: np.ndarray, k: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, distance) of the cells within ``k``, some rows of ``left`` at a time."""
    step = max(1, _CELLS // max(1, len(right)))
    for start in range(0, len(left), step):
        apart = np.bitwise_count(left[start : start + step, None] ^ right[None, :])
        row, column = np.nonzero(apart <= k)
        yield row + start, column, apart[row, column]


def _pairs(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        found = [empty]
        if left.num_rows and right.num_rows:
            a, b = np.asarray(left.column("a")), np.asarray(right.column("b"))
            for row, column, apart in close_cells(
                _prints(left.column("fp_a")), _prints(right.column("fp_b")), k
            ):
                ordered = a[row] < b[column]
                found.append(
                    [a[row][ordered], b[column][ordered], apart[ordered].astype(np.int32)]
                )
        columns = [np.concatenate(part) for part in zip(*found, strict=True)]
        return pa.table(dict(zip(("a", "b", "distance"), columns, strict=True)))

    return run


def tile_pairs(
    left: DataFrame, right: DataFrame, k: int, left_rows: int, right_rows: int
) -> DataFrame:
    """All pairs ``a < b`` of ``id, fp`` rows within ``k``, with their distance."""
    down, across = max(1, -(-left_rows // PAIR_ROWS)), max(1, -(-right_rows // PAIR_ROWS))

    def dealt(
        rows: DataFrame, side: str, own: str, tiles: int, other: str, copies: int
    ) -> DataFrame:
        return rows.select(
            F.col("id").alias(side),
            F.col("fp").alias(f"fp_{side}"),
            F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other),
        )

    one = dealt(left, "a", "y", down, "x", across).groupBy("y", "x")
    two = dealt(right, "b", "x", across, "y", down).groupBy("y", "x")
    return one.cogroup(two).applyInArrow(_pairs(k), "a long, b long, distance int")


def own_tiles_pay(prints: DataFrame, rows: int, masks: list[int]) -> bool:
    """Whether comparing all rows with all costs less than keys by ``masks``, with what meets on them."""
    if cheaper(rows, rows, len(masks)):
        return True
    some = prints.select("fp")
    if rows > MEET_ROWS:
        some = some.sample(MEET_ROWS / rows, seed=0)
    values = _prints(some.toArrow().column("fp"))
    met = 0
    for mask in masks:
        sizes = np.unique(values & np.uint64(mask), return_counts=True)[1]
        met += int((sizes * (sizes - 1)).sum())
    share = met / max(1, len(values) * (len(values) - 1))
    keyed = 2 * rows * len(masks) * KEY_SECONDS + share * rows * rows * MET_SECONDS
    return rows * rows / 2 * OWN_PAIR_SECONDS <= keyed


def _near_blocks(
    left: np.ndarray, right: np.ndarray, k: int, same: bool
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, distance) of the cells within ``k``, block by block; if same, above the diagonal."""
    for top in range(0, len(left), _BLOCK_ROWS):
        some = left[top : top + _BLOCK_ROWS, None]
        for start in range(top if same else 0, len(right), _BLOCK_COLUMNS):
            apart = np.bitwise_count(some ^ right[None, start : start + _BLOCK_COLUMNS])
            row, column = np.nonzero(apart <= k)
            found = apart[row, column]
            row, column = row + top, column + start
            if same:
                above = column > row
                row, column, found = row[above], column[above], found[above]
            if len(row):
                yield row, column, found


def _own_pairs(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        ids, prints = np.asarray(rows.column("id")), _prints(rows.column("fp"))
        place = np.asarray(rows.column("place"))
        # A tile with itself has one side.
        first, second = place == 0, place == 1
        same = not second.any() and rows.column("y")[0].as_py() == rows.column("x")[0].as_py()
        a, b = ids[first], ids[first if same else second]
        held: list[list[np.ndarray]] = []
        size = 0

        def merged() -> pa.RecordBatch:
            columns = [np.concatenate(part) for part in zip(*held, strict=True)]
            return pa.record_batch(columns, names=["a", "b", "distance"])

        for row, column, apart in _near_blocks(
            prints[first], prints[first if same else second], k, same
        ):
            one, two = a[row], b[column]
            held.append([np.minimum(one, two), np.maximum(one, two), apart.astype(np.int32)])
            size += len(row)
            if size >= PAIR_BATCH:
                yield merged()
                held, size = [], 0
        if size:
            yield merged()

    return run


def own_pairs(prints: DataFrame, rows: int, k: int) -> DataFrame:
    """All pairs ``a < b`` of the ``id, fp`` rows of one table within ``k``, with their distance.

    A row goes once to each tile, so what is shuffled grows with rows x tiles; no pair is.
    """
    size = min(OWN_ROWS, max(PAIR_ROWS, -(-rows // OWN_TILES)))
    tiles = max(1, -(-rows // size))
    dealt = prints.select(
        "id",
        "fp",
        F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int").alias("tile"),
        F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other"),
    ).select(
        "id",
        "fp",
        F.least("tile", "other").alias("y"),
        F.greatest("tile", "other").alias("x"),
        (F.col("tile") > F.col("other")).cast("int").alias("place"),
    )
    cells = dealt.repartition(tiles * (tiles + 1) // 2, "y", "x").groupBy("y", "x")
    return cells.applyInArrow(_own_pairs(k), "a long, b long, distance int")


def settled(ids: np.ndarray, prints: np.ndarray, k: int) -> np.ndarray:
    """The canonical id of each row, going through the rows in order."""
    canonical = np.full(len(ids), -1, np.int64)
    open_ = np.arange(len(ids))
    while len(open_):
        first = open_[0]
        near = np.bitwise_count(prints[open_] ^ prints[first]) <= k
        canonical[open_[near]] = ids[first]
        open_ = open_[~near]
    return canonical


def _settle(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        ids, prints = np.asarray(rows.column("id")), _prints(rows.column("fp"))
        order = np.argsort(ids, kind="stable")
        ids, prints = ids[order], prints[order]
        columns = [pa.array(ids), pa.array(prints.view(np.int64)), pa.array(settled(ids, prints, k))]
        yield pa.record_batch(columns, names=["id", "fp", "canonical"])

    return run


def first_close(
    prints: np.ndarray, kept: np.ndarray, kept_prints: np.ndarray, k: int
) -> pa.Array:
    """For each print the first of ``kept`` (in order) within ``k``, or NULL."""
    out = np.zeros(len(prints), np.int64)
    found = np.zeros(len(prints), bool)
    step = max(1, _CELLS // max(1, len(prints)))
    for start in range(0, len(kept), step):
        open_ = np.flatnonzero(~found)
        if not len(open_):
            break
        some = kept_prints[start : start + step]
        near = np.bitwise_count(prints[open_][:, None] ^ some[None, :]) <= k
        any_ = near.any(axis=1)
        out[open_[any_]] = kept[start + near[any_].argmax(axis=1)]
        found[open_[any_]] = True
    return pa.array(out, mask=~found)


def _sweep(kept: np.ndarray, kept_prints: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.asarray(batch.column("fp")).view(np.uint64)
            near = first_close(prints, kept, kept_prints, k)
            yield pa.record_batch(
                [batch.column("id"), batch.column("fp"), near], names=["id", "fp", "canonical"]
            )

    return run


def sweep_pays(kept: int, rows: int, keys: int) -> bool:
    """Whether comparing a row with the kept ids of a tile costs less than the keys it saves.

    A later row is dropped about as often as a row of the tile was.
    """
    return kept * PAIR_SECONDS <= (1 - kept / rows) * keys * KEY_SECONDS


def tile_rounds(
    prints: DataFrame, rows: int, k: int, keys: int | None = None
) -> tuple[list[DataFrame], DataFrame, int]:
    """Settled parts (``id``, ``canonical``), and the ``id``, ``fp`` rows left, with their count.

    What a round tells the next is its kept ids, at most TILE_ROWS of them.  No row is left unless
    ``keys`` per row is given: then rounds end where making keys for the rows left costs less, and
    none of these is close to a kept id.
    """
    shape = "id long, fp long, canonical long"
    spread = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts, remaining, left = [], prints.select("id", "fp"), rows
    while left:
        tile = remaining
        if left > TILE_ROWS:
            # Exact up to a million ids; more only make the tile a little smaller or larger.
            share = 0.99 * TILE_ROWS / left
            bound = remaining.agg(F.percentile_approx("id", share, 1_000_000)).first()[0]
            tile = remaining.filter(F.col("id") <= bound)
        done, size = written(tile.repartition(1).mapInArrow(_settle(k), shape), "tile")
        if left <= TILE_ROWS:
            parts.append(done)
            return parts, remaining.limit(0), 0
        kept = done.filter("id = canonical").select("id", "fp").orderBy("id").toArrow()
        if keys is not None and not cheaper(left, left, keys) and not sweep_pays(kept.num_rows, size, keys):
            break
        parts.append(done)
        later = remaining.filter(F.col("id") > bound).repartition(spread)
        sweep = _sweep(np.asarray(kept.column("id").combine_chunks()), _prints(kept.column("fp")), k)
        swept, left = written(later.mapInArrow(sweep, shape), "swept", F.col("canonical").isNull())
        parts.append(swept.filter(F.col("canonical").isNotNull()))
        remaining = swept.filter(F.col("canonical").isNull()).select("id", "fp")
    return parts, remaining, left


def settle_by_tiles(prints: DataFrame, rows: int, k: int) -> DataFrame:
    """``id``, ``canonical`` of the first-fit choice, TILE_ROWS ids after each other."""
    parts, _, _ = tile_rounds(prints, rows, k)
    if not parts:
        return prints.select("id", F.col("id").alias("canonical"))
    return reduce(DataFrame.unionAll, [part.select("id", "canonical") for part in parts])
