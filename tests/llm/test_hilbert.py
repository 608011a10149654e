import itertools
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linewright.llm.hilbert import (
    curve_tables,
    hilbert_index,
    hilbert_shards,
    shard_bounds,
    value_ranks,
    write_shards,
)


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 1)])
def test_neighbours_on_the_curve_are_neighbours_in_space(spark, dims, bits):
    cells = list(itertools.product(range(1 << bits), repeat=dims))
    names = [f"c{i}" for i in range(dims)]
    frame = spark.createDataFrame(cells, ", ".join(f"{n} int" for n in names))
    rows = frame.withColumn("at", hilbert_index([F.col(n) for n in names], bits)).collect()
    path = sorted((r["at"], tuple(r[n] for n in names)) for r in rows)
    assert [at for at, _ in path] == list(range(len(cells)))
    assert all(
        sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1
        for (_, p), (_, q) in itertools.pairwise(path)
    )


def test_tables_hold_each_digit_once_per_state():
    digits, nexts = curve_tables(3)
    assert all(sorted(digits[s : s + 8]) == list(range(8)) for s in range(0, len(digits), 8))
    assert max(nexts) < len(digits) // 8


def test_counts_slots_and_checksums(spark, docs_of, awkward):
    rows = awkward * 9
    got = hilbert_shards(docs_of(rows).withColumn("shard", F.lit("x")), 7).collect()
    counts = Counter(r["shard"] for r in got)
    assert sorted(counts) == list(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    assert sum(counts.values()) == len(rows)
    for shard, count in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(count))
    def facts(text):
        raw = (text or "").encode()
        return len(raw) + 16, zlib.crc32(raw)

    expected = Counter((i, *facts(t)) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == expected


def test_fewer_rows_than_shards_and_no_rows(docs_of):
    few = hilbert_shards(docs_of([(1, "a"), (2, "b")]), 5).collect()
    assert sorted(r["slot"] for r in few) == [0, 0]
    assert hilbert_shards(docs_of([]), 5).collect() == []


def test_filters_skip_shards(spark, tmp_path):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.lit("t").alias("text"),
        F.concat(F.lit("l"), (F.col("id") % 4).cast("string")).alias("lang"),
        F.concat(F.lit("s"), (F.floor(F.col("id") / 4) % 8).cast("string")).alias("source"),
        (F.xxhash64("id") % 1000 + 1000).alias("n_chars"),
    )
    placed = hilbert_shards(docs, 32)
    path = str(tmp_path / "shards")
    write_shards(docs, placed, path)
    written = spark.read.parquet(path)
    assert written.count() == 4000
    bounds = shard_bounds(written, ["lang", "source", "n_chars"]).collect()
    hit = [b for b in bounds if b["min_lang"] <= "l0" <= b["max_lang"] and b["min_source"] <= "s0" <= b["max_source"]]
    assert 0 < len(hit) < len(bounds) / 3


def test_long_values_with_a_common_head_keep_their_order(spark, monkeypatch):
    monkeypatch.setattr("linewright.llm.hilbert.HOT_ROWS", 20)
    rows = [
        (i, f"text {i}", "en", f"https://a.long.name.example/site{i * i % 50:02}" if i % 9 else None, i % 13)
        for i in range(600)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sources = sorted(r[3] for r in rows if r[3])
    ordinals = {s: sources.index(s) for s in set(sources)}
    ranked, total = value_ranks(docs, "source")
    assert {r["value"]: r["ordinal"] for r in ranked.collect()} == ordinals and total == len(sources)

    def cell(values, value):
        """Cuts of 64 cells below the value."""
        if value is None:
            return 0
        cuts = [max(v for v in values if v <= int(i / 64 * len(sources))) for i in range(1, 64)]
        return sum(cut < value for cut in cuts)

    got = {r["doc_id"]: r for r in hilbert_shards(docs, 8, ["source", "lang"]).collect()}
    by_curve = sorted((r["curve"], i) for i, r in got.items())
    cells = [(i, cell(set(ordinals.values()), ordinals.get(s)), 0) for i, _, _, s, _ in rows]
    frame = spark.createDataFrame(cells, "doc_id long, one int, two int")
    index = hilbert_index([F.col("one"), F.col("two")], 6)
    expected = {r["doc_id"]: r["at"] for r in frame.withColumn("at", index).collect()}
    assert {i: r["curve"] for i, r in got.items()} == expected
    # Few values share a cell of 64, and none of the others share an index.
    assert len(set(expected.values())) >= len(ordinals) // 2
    for place, (_, doc_id) in enumerate(by_curve):
        assert got[doc_id]["shard"] == place * 8 // len(rows)
