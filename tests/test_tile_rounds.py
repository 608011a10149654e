"""Rounds of tiles before keys: taken while few kept ids drop many rows."""

import random

import pytest

from linewright.plans import first_fit as plan
from linewright.plans import tiles


def sequential(rows, k):
    kept, out = [], {}
    for row, value in sorted(rows):
        near = [i for i, fp in kept if (fp ^ value).bit_count() <= k]
        out[row] = min(near) if near else row
        if not near:
            kept.append((row, value))
    return out


def frame_of(spark, rows):
    signed = [(row, value - (1 << 64) if value >> 63 else value) for row, value in rows]
    return spark.createDataFrame(signed, "id bigint, fp bigint")


def clustered(count, centres, flips, seed):
    rng = random.Random(seed)
    middle = [rng.getrandbits(64) for _ in range(centres)]
    values = {}
    while len(values) < count:
        value = rng.choice(middle)
        for bit in rng.sample(range(64), rng.randint(0, flips)):
            value ^= 1 << bit
        values.setdefault(value, len(values))
    return [(row, value) for value, row in values.items()]


def test_few_kept_rows_need_no_keys(spark, monkeypatch):
    rows = clustered(400, 5, 4, 1)
    monkeypatch.setattr(tiles, "TILE_ROWS", 50)
    monkeypatch.setattr(tiles, "cheaper", lambda *_: False)
    monkeypatch.setattr(plan, "pairs_within", lambda *_, **__: pytest.fail("keys were made"))
    found = plan.first_fit(frame_of(spark, rows), len(rows), 10).collect()
    assert {r.id: r.canonical for r in found} == sequential(rows, 10)


@pytest.mark.parametrize("k,rounds", [(3, 0), (6, 1), (6, 3)])
def test_rows_left_by_the_rounds_go_by_keys(spark, monkeypatch, k, rounds):
    rows = clustered(300, 60, 5, 7)
    asked = []

    def pays(*_):
        asked.append(1)
        return len(asked) <= rounds

    monkeypatch.setattr(tiles, "TILE_ROWS", 40)
    monkeypatch.setattr(tiles, "cheaper", lambda *_: False)
    monkeypatch.setattr(tiles, "sweep_pays", pays)
    found = plan.first_fit(frame_of(spark, rows), len(rows), k, first_prefix=50).collect()
    assert len(found) == len(rows)
    assert {r.id: r.canonical for r in found} == sequential(rows, k)


def test_rounds_pay_where_many_rows_are_dropped():
    assert tiles.sweep_pays(1_500, 16_000, 286)
    assert not tiles.sweep_pays(15_000, 16_000, 20)
    assert not tiles.sweep_pays(16_000, 16_000, 286)
