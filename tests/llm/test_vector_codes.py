import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewright.llm import vector_codes as module
from linewright.llm.vector_codes import assign, fit_codes, vector_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    """Full scans with Python integers."""
    kept = [
        (i, [math.floor(4096 * float(np.float32(x))) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    wide = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [
        [(v + [0] * parts * wide)[p * wide : (p + 1) * wide] for p in range(parts)] for _, v, _ in kept
    ]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, part):
        found = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in books[p]]
        best = min(found)
        return found.index(best), best

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for c in cut:
                held.setdefault(nearest(p, c[p])[0], []).append(c[p])
            books[p] = [
                [sum(x) // len(held[e]) for x in zip(*held[e], strict=True)] if e in held else book
                for e, book in enumerate(books[p])
            ]
    digest = hashlib.sha256(
        ",".join(str(x) for book in books for e in book for x in e).encode()
    ).hexdigest()
    out, by_label = [], {}
    for (i, _, label), c in zip(kept, cut, strict=True):
        found = [nearest(p, c[p]) for p in range(parts)]
        error = sum(d for _, d in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for e, _ in found), error, label))
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in out), key=str)


def got(frame, **options):
    return sorted(map(tuple, vector_codes(frame, **options).collect()), key=str)


def rows_of(seed, count, dims=16, spread=1.0):
    draw = np.random.default_rng(seed)
    return [
        (i, draw.normal(0, spread, dims).astype(np.float32).tolist(), int(i % 3) if i % 7 else None)
        for i in range(count)
    ]


def test_against_brute_force(spark):
    rows = rows_of(1, 300)
    rows += [(1000 + i, rows[5][1], 0) for i in range(120)]
    rows += [(2000, None, 1), (2001, [1.0, None], 1), (2002, [float("nan")] * 16, 2)]
    rows += [(2003, [float("inf")] * 16, 2), (None, rows[9][1], 1), (7, rows[8][1], None), (7, rows[8][1], None)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"codes": F.lit(1), "totals": F.lit("x")})
    assert got(frame.repartition(5)) == brute(rows)


def test_ties_go_to_the_lower_index(spark):
    # Few different values, so that many distances are equal.
    draw = np.random.default_rng(2)
    rows = [(i, (draw.integers(-2, 3, 16) / 4096).tolist(), 0) for i in range(200)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


@pytest.mark.parametrize("count", [0, 1, 5, 16])
def test_few_rows(spark, count):
    rows = rows_of(3, count)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert got(frame) == brute(rows)


def test_other_lengths(spark):
    rows = [(i, v[: 5 + i % 12], label) for i, v, label in rows_of(4, 60)] + [(100, [], 1)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert got(spark.createDataFrame([(1, [], None)], SCHEMA)) == brute([(1, [], None)])


def test_other_parameters(spark):
    rows = rows_of(5, 80)
    state, books, count = fit_codes(spark.createDataFrame(rows, SCHEMA), parts=4, entries=3, rounds=2)
    assert books.shape == (4, 3, 4) and count == 80
    errors = {r["vec_id"]: sum(r["errors"]) for r in state.collect()}
    assert errors == {i: e for i, _, e, _, _ in brute(rows, 4, 3, 2)}


def test_large_components_raise(spark):
    frame = spark.createDataFrame([(1, [40000.0], 0)], SCHEMA)
    with pytest.raises(Exception, match="components must be below"):
        vector_codes(frame).collect()


def test_active_entries_give_what_a_full_scan_gives(monkeypatch):
    draw = np.random.default_rng(6)
    compared = []
    distances = module._distances

    def counted(parts, book, entries):
        compared.append(len(parts) * len(entries))
        return distances(parts, book, entries)

    for trial in range(40):
        parts = draw.integers(-4, 5, (200, 2))
        book = draw.integers(-4, 5, (16, 2))
        codes, errors = assign(parts, book, None, None, None)
        after = book.copy()
        changed = draw.choice(16, trial % 6, replace=False)
        after[changed] += draw.integers(-1, 2, (len(changed), 2))
        moved = (after != book).any(axis=1)
        monkeypatch.setattr(module, "_distances", counted)
        compared.clear()
        fast = assign(parts, after, moved, codes, errors)
        work = sum(compared)
        monkeypatch.setattr(module, "_distances", distances)
        full = assign(parts, after, None, None, None)
        assert np.array_equal(fast[0], full[0]) and np.array_equal(fast[1], full[1])
        lost = int(moved[codes].sum())
        assert work == lost * 16 + (200 - lost) * int(moved.sum())
