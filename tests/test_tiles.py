"""Dense tiles against the sequential definition and against the keyed plan."""

import random

import numpy as np
import pytest
from test_dedup import first_fit, frame_of, noisy_prints

from linewright.operators import dedup as D
from linewright.plans import tiles
from linewright.plans.hamming import BlockScheme, signed


@pytest.mark.parametrize("k", [1, 3, 6, 10])
def test_many_tiles_settle_in_order(spark, monkeypatch, k):
    monkeypatch.setattr(tiles, "TILE_ROWS", 37)
    monkeypatch.setattr(tiles, "_CELLS", 64)
    rows = noisy_prints(400, seed=40 + k, centres=9, flips=2 * k)
    flags = D.dedup_fingerprints(frame_of(spark, rows), k).collect()
    assert {r.row_id: r.canonical_id for r in flags} == first_fit(rows, k)


def test_a_tile_is_bounded(monkeypatch, spark):
    seen = []
    monkeypatch.setattr(tiles, "TILE_ROWS", 50)
    original = tiles.written

    def counted(frame, label, *rest):
        table, rows = original(frame, label, *rest)
        if label == "tile":
            seen.append(table.count())
        return table, rows

    monkeypatch.setattr(tiles, "written", counted)
    rng = random.Random(1)
    rows = [(i * 7, rng.getrandbits(64)) for i in range(500)]
    flags = D.dedup_fingerprints(frame_of(spark, rows), 6).collect()
    assert not any(r.is_duplicate for r in flags)
    assert max(seen) <= 50 and sum(seen) == 500


@pytest.mark.parametrize("k", [3, 8])
def test_tiled_pairs_equal_keyed_pairs(spark, monkeypatch, k):
    monkeypatch.setattr(tiles, "PAIR_ROWS", 30)
    monkeypatch.setattr(tiles, "_CELLS", 100)
    frame = frame_of(spark, noisy_prints(250, seed=k, centres=4, flips=k))
    one = sorted(map(tuple, D.near_duplicate_pairs(frame, k).collect()))
    two = sorted(map(tuple, D.near_duplicate_pairs(frame, k, tiles=False).collect()))
    assert one == two and one


@pytest.mark.parametrize("k, rows, batch", [(3, 30, 5), (6, 30, 1 << 20), (8, 1000, 50)])
def test_a_table_with_itself_tests_each_pair_once(spark, monkeypatch, k, rows, batch):
    for name, value in (("OWN_ROWS", rows), ("PAIR_ROWS", 10), ("PAIR_BATCH", batch), ("_BLOCK_COLUMNS", 7)):
        monkeypatch.setattr(tiles, name, value)
    values = noisy_prints(250, seed=k, centres=4, flips=k)
    first = {value: row for row, value in reversed(values)}
    expected = sorted(
        (min(i, j), max(i, j), (x ^ y).bit_count())
        for x, i in first.items()
        for y, j in first.items()
        if i < j and (x ^ y).bit_count() <= k
    )
    table = spark.createDataFrame([(i, signed(x)) for x, i in first.items()], "id long, fp long")
    got = sorted(map(tuple, tiles.own_pairs(table, len(first), k).collect()))
    assert got == expected and got
    assert tiles.own_pairs(table.limit(0), 0, k).collect() == []


def test_rows_that_meet_on_most_keys_are_compared_without_keys(spark, monkeypatch):
    monkeypatch.setattr(tiles, "cheaper", lambda *_: False)
    monkeypatch.setattr(D, "pairs_within", lambda *_, **__: pytest.fail("keys were made"))
    values = noisy_prints(400, seed=5, centres=2, flips=5)
    pairs = D.near_duplicate_pairs(frame_of(spark, values), 6)
    first = {value: row for row, value in reversed(values)}
    expected = sum((x ^ y).bit_count() <= 6 for x in first for y in first if first[x] < first[y])
    assert pairs.count() == expected > 1000


def test_keys_are_made_where_few_rows_meet(spark):
    draw = np.random.default_rng(1)
    prints = draw.integers(-(2**63), 2**63, 3000)
    table = spark.createDataFrame([(i, int(x)) for i, x in enumerate(prints)], "id long, fp long")
    masks = BlockScheme.build(6).masks
    assert tiles.own_tiles_pay(table, 3000, masks)
    assert not tiles.own_tiles_pay(table, 10**7, masks)
    near = table.withColumn("fp", table["fp"].bitwiseAND(0xFFF))
    assert tiles.own_tiles_pay(near, 10**7, masks)


def test_the_plan_follows_the_measured_rows():
    keys = {k: BlockScheme.build(k).key_count for k in (3, 8, 10)}
    assert keys == {3: 20, 8: 165, 10: 286}
    assert tiles.cheaper(10_000, 10_000, keys[3]) and not tiles.cheaper(30_000, 30_000, keys[3])
    assert tiles.cheaper(100_000, 100_000, keys[8]) and not tiles.cheaper(1_000_000, 1_000_000, keys[8])


def test_settled_and_swept():
    prints = np.array([0, 1, 0b111, 0b1111, 1 << 63], np.uint64)
    ids = np.array([5, 6, 7, 8, 9])
    assert tiles.settled(ids, prints, 1).tolist() == [5, 5, 7, 7, 5]
    assert tiles.settled(ids[:0], prints[:0], 1).tolist() == []
    near = tiles.first_close(prints, np.array([1, 2, 3]), np.array([0b11, 0, 1], np.uint64), 1)
    assert near.to_pylist() == [2, 1, 1, None, 2]


def test_copy_pairs(spark):
    rows = noisy_prints(300, seed=77)
    flags = D.dedup_fingerprints(frame_of(spark, rows), 4)
    prints, canonical = dict(rows), first_fit(rows, 4)
    first, members = {}, {}
    for row, value in rows:
        first.setdefault(value, row)
        members[value] = members.get(value, 0) + 1
    expected = sorted(
        (canonical[row], row, members[value], (value ^ prints[canonical[row]]).bit_count())
        for value, row in first.items()
        if canonical[row] != row
    )
    got = sorted(map(tuple, D.copy_pairs(flags).collect()))
    assert got == expected and any(distance for *_, distance in got)
    assert sum(r[2] for r in got) + sum(members[prints[r]] for r in {canonical[i] for i, _ in rows}) == 300


def test_no_fingerprints(spark):
    assert tiles.settle_by_tiles(spark.createDataFrame([], "id long, fp long"), 0, 3).collect() == []
    flags = D.dedup_fingerprints(frame_of(spark, [(1, signed(5) % 2**64)]), 3)
    assert D.copy_pairs(flags).collect() == []
