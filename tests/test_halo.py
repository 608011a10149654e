"""Contexts found run by run against the definition, for any order and any borders."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linewright.operators import halo, search

NUMBER = st.integers(0, 60)


def brute(rows, hits, context):
    """Per hit the rows within the context, in order."""
    by_id = dict(rows)
    return {
        hit: [(i, by_id[i]) for i in range(hit - context, hit + context + 1) if by_id.get(i) is not None]
        for hit in hits
    }


def through(partitions, hits, context):
    """What the kernel and the join on border rows give."""
    done, opened, borders = {}, [], {}
    for batches in partitions:
        frames = [
            pa.record_batch(
                [
                    pa.array([i for i, _ in rows], pa.int64()),
                    pa.array([t for _, t in rows], pa.string()),
                    pa.array([i in hits for i, _ in rows], pa.bool_()),
                ],
                names=["row_id", "line", "hit"],
            )
            for rows in batches
        ]
        for out in halo._runs(context)(iter(frames)):
            for row in out.to_pylist():
                if row["kind"] == halo.BORDER:
                    assert row["row_id"] not in borders
                    borders[row["row_id"]] = row["line"]
                elif row["kind"] == halo.OPEN:
                    opened.append(row["row_id"])
                else:
                    done[row["row_id"]] = [(r["row_id"], r["line"]) for r in row["rows"] if r["line"] is not None]
    assert not set(done) & set(opened) and len(set(opened)) == len(opened)
    for hit in opened:
        done[hit] = [(i, borders[i]) for i in range(hit - context, hit + context + 1) if i in borders]
    return done, borders


@settings(max_examples=300, deadline=None)
@given(
    st.lists(NUMBER, unique=True, max_size=40),
    st.booleans(),
    st.sets(NUMBER, max_size=12),
    st.sets(NUMBER, max_size=6),
    st.integers(0, 4),
    st.integers(1, 7),
    st.integers(1, 3),
)
def test_any_order_and_any_batches(ids, in_order, hits, unreadable, context, size, parts):
    ids = sorted(ids) if in_order else ids
    rows = [(i, None if i in unreadable else f"line {i}") for i in ids]
    hits = {i for i in hits if i in ids and i not in unreadable}
    cut = [rows[k * len(rows) // parts : (k + 1) * len(rows) // parts] for k in range(parts)]
    partitions = [[p[i : i + size] for i in range(0, len(p), size)] for p in cut]
    done, _ = through(partitions, hits, context)
    assert done == brute(rows, hits, context)


def test_only_borders_leave_a_run(monkeypatch):
    monkeypatch.setattr(halo, "_CONTEXT_BYTES", 100)
    rows = [(i, "x" * (i % 50)) for i in range(1000)]
    hits = set(range(0, 1000, 3))
    partitions = [[rows[:300], rows[300:400]], [rows[400:999], rows[999:]]]
    done, borders = through(partitions, hits, 5)
    assert done == brute(rows, hits, 5)
    assert sorted(borders) == [*range(10), *range(390, 410), *range(990, 1000)]


def lines_of(spark, count, parts):
    frame = spark.range(0, count, 1, parts)
    return frame.selectExpr("id AS row_id", "concat('line ', id) AS line")


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_search(spark, monkeypatch, broadcast):
    monkeypatch.setattr(search, "MAX_BROADCAST_ROWS", broadcast)
    lines = lines_of(spark, 1000, 7)
    rows = [(i, f"line {i}") for i in range(1000)]
    hits = [i for i in range(1000) if str(i).endswith("3")]
    expected = {
        hit: "".join(f"{'>>> ' if i == hit else '    '}L{i + 1}: {t}\n" for i, t in around)
        for hit, around in brute(rows, hits, 3).items()
    }
    for frame in (lines, lines.repartition(5)):
        found = search.search_with_context(frame, "3$", 3).collect()
        assert {r.row_id: r.context for r in found} == expected and len(found) == len(hits)


def test_few_rows_are_written_as_borders(spark):
    found = halo.hit_contexts(lines_of(spark, 1000, 4), search._is_hit("7$"), 2, 10**6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "rlike" not in plan.lower() and found.count() == 100


def test_no_lines_and_no_hits(spark):
    lines = lines_of(spark, 10, 2)
    assert search.search_with_context(lines, "nothing", 2).collect() == []
    assert search.search_with_context(lines.limit(0), "line", 2).collect() == []
    assert np.all([r.context.count("\n") == 1 for r in search.search_with_context(lines, "line", 0).collect()])
