import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewright.llm import top_k as module
from linewright.llm.top_k import top_k

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(rows, asked, k):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(256 * float(np.float32(x))) for x in v]

    kept = [(i, w) for i, v in rows if i is not None and (w := whole(v)) is not None]
    out = []
    for q, v in asked:
        if q is None or (own := whole(v)) is None:
            continue
        scored = sorted((-sum(a * b for a, b in zip(own, w)), i) for i, w in kept if i != q)  # noqa: B905
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 5])
def test_against_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(module, "QUERY_BLOCK", 7)
    monkeypatch.setattr(module, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(module, "STRIPE", 9)
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=8).round(1).tolist()) for i in range(200)]
    # Ties, repeated vectors, sparse and awkward ones.
    rows += [(300 + i, rows[3][1]) for i in range(60)] + [(400, [0.0] * 8), (401, []), (402, [3.0])]
    rows += [(403, None), (404, [1.0, None]), (405, [float("nan")]), (406, [float("inf")] * 8), (None, [1.0] * 8)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit(1), "block": F.lit("b")})
    asked = [r for r in rows if r[0] is not None and r[0] % 20 == 0] + [(405, [float("nan")])]
    queries = spark.createDataFrame(asked, SCHEMA)
    assert sorted(map(tuple, top_k(frame, queries, k).collect())) == brute(rows, asked, k)


def test_few_rows_and_none(spark):
    frame = spark.createDataFrame([(1, [1.0]), (2, [2.0])], SCHEMA)
    assert [tuple(r) for r in top_k(frame, frame.filter("vec_id = 1"), 5).collect()] == [(1, 1, 2, 131072)]
    assert top_k(frame.limit(0), frame, 5).collect() == []
    assert top_k(frame, frame.limit(0), 5).collect() == []


def test_large_components(spark):
    frame = spark.createDataFrame([(1, [9000.0, 1.0]), (2, [9000.0, 0.0]), (3, [-1.0, 0.5])], SCHEMA)
    got = [tuple(r) for r in top_k(frame, frame.filter("vec_id = 1"), 5).collect()]
    assert got == [(1, 1, 2, 2304000**2), (1, 2, 3, 2304000 * -256 + 256 * 128)]
