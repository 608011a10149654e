import random

import pytest
from pyspark.sql import functions as F

from linewright.operators import dedup as D
from linewright.plans import hamming
from linewright.plans.attach import attach_groups
from linewright.plans.durable import written
from linewright.plans.hamming import BlockScheme, ball, pairs_within, signed
from linewright.sources import writers


def first_fit(rows, k):
    kept, result = [], {}
    for row, print_ in sorted(rows):
        for other, other_print in kept:
            if (print_ ^ other_print).bit_count() <= k:
                result[row] = other
                break
        else:
            kept.append((row, print_))
            result[row] = row
    return result


def noisy_prints(count, seed, centres=6, flips=5):
    """Fingerprints scattered around a few centres, with many exact copies."""
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(centres)]
    rows = []
    for row in range(count):
        value = base[0] if rng.random() < 0.4 else rng.choice(base)
        for _ in range(rng.randint(0, flips)):
            value ^= 1 << rng.randrange(64)
        rows.append((row * 3 + 1, value))
    return rows


def frame_of(spark, rows):
    data = [(row, signed(value)) for row, value in rows]
    return spark.createDataFrame(data, "row_id bigint, fingerprint bigint").repartition(4)


@pytest.mark.parametrize(
    "k, options",
    [
        (0, {}),
        (1, {}),
        (3, {}),
        (8, {}),
        (3, {"tiles": False}),
        (3, {"blocks": 4, "tiles": False}),
        (3, {"first_prefix": 40, "growth": 2, "tiles": False}),
        (3, {"bucket_limit": 2, "cell_tests": 5, "broadcast_keys": 0, "tiles": False}),
        (2, {"bucket_limit": 1, "cell_tests": 3, "first_prefix": 50, "growth": 3, "tiles": False}),
        (7, {"cell_tests": 10, "broadcast_keys": 0, "tiles": False}),
        (64, {}),
    ],
)
def test_first_fit_matches_sequential(spark, k, options):
    rows = noisy_prints(300, seed=k)
    expected = first_fit(rows, k)
    flags = D.dedup_fingerprints(frame_of(spark, rows), k, cold_members=20, **options)
    got = flags.collect()
    assert {r.row_id: r.canonical_id for r in got} == expected
    assert all(r.is_duplicate == (r.row_id != r.canonical_id) for r in got)
    assert {r.row_id: r.fingerprint % 2**64 for r in got} == dict(rows)


def test_one_dense_cluster(spark):
    """A third of all fingerprints in one bucket: still exact, through variants."""
    rng = random.Random(5)
    fixed = rng.getrandbits(64)
    rows = [(i, rng.getrandbits(64)) for i in range(200)]
    rows += [(200 + i, fixed ^ rng.getrandbits(12)) for i in range(100)]
    expected = first_fit(rows, 3)
    got = D.dedup_fingerprints(frame_of(spark, rows), 3, bucket_limit=10, cell_tests=50, tiles=False).collect()
    assert {r.row_id: r.canonical_id for r in got} == expected


@pytest.mark.parametrize(
    "k, options",
    [
        (3, {}),
        (5, {}),
        (9, {}),
        (3, {"tiles": False}),
        (5, {"tiles": False}),
        (1, {"bucket_limit": 2, "cell_tests": 4, "tiles": False}),
        (3, {"bucket_limit": 2, "cell_tests": 4, "tiles": False}),
        (4, {"bucket_limit": 1, "cell_tests": 2, "broadcast_keys": 0, "tiles": False}),
        (5, {"cell_tests": 3, "broadcast_keys": 0, "tiles": False}),
        (8, {"cell_tests": 6, "tiles": False}),
    ],
)
def test_pairs_are_complete_and_unique(spark, k, options):
    rows = noisy_prints(150, seed=10 + k)
    distinct = {}
    for row, value in rows:
        distinct.setdefault(value, row)
    nodes = [(row, value) for value, row in distinct.items()]
    expected = sorted(
        (a, b, (x ^ y).bit_count())
        for a, x in nodes
        for b, y in nodes
        if a < b and (x ^ y).bit_count() <= k
    )
    pairs = D.near_duplicate_pairs(frame_of(spark, rows), k, **options).collect()
    assert sorted(tuple(p) for p in pairs) == expected


def test_two_sided_pairs(spark):
    rng = random.Random(3)
    left = [(i, rng.getrandbits(64)) for i in range(60)]
    right = [(100 + i, left[i % 60][1] ^ (1 << rng.randrange(64))) for i in range(60)]
    scheme = BlockScheme.build(3)

    def table(rows):
        data = [(i, signed(v)) for i, v in rows]
        return written(spark.createDataFrame(data, "id bigint, fp bigint"), "t")[0]

    expected = {(a, b) for a, x in left for b, y in right if (x ^ y).bit_count() <= 3}
    for tiles in (True, False):
        got = pairs_within(table(left), table(right), scheme, 60, 60, tiles=tiles).collect()
        assert {(p.a, p.b) for p in got} == expected and len(got) == len(expected)


def test_block_scheme():
    scheme = BlockScheme.build(3, [abs(i - 32) for i in range(64)])
    assert sum(scheme.blocks) == 2**64 - 1 and len(scheme.blocks) == 6
    assert len(scheme.masks) == 20 and all(m.bit_count() >= 30 for m in scheme.masks)
    assert ball(4, 1) == 5
    with pytest.raises(ValueError):
        BlockScheme.build(3, blocks=3)


def test_exact(spark, lines_of):
    lines = lines_of("a", "b", "a", "", "", "a")
    flags = D.dedup(lines, "exact")
    got = sorted((r.row_id, r.canonical_id, r.is_duplicate) for r in flags.collect())
    assert got == [(0, 0, False), (1, 1, False), (2, 0, True), (3, 3, False), (4, 3, True), (5, 0, True)]
    hot = D.dedup_exact(lines.repartition(3), cold_members=1)
    assert sorted((r.row_id, r.canonical_id, r.is_duplicate) for r in hot.collect()) == got
    stats = D.dedup_stats(flags, "exact").first()
    assert (stats.total_lines, stats.unique_count, stats.duplicate_count) == (6, 3, 3)
    assert stats.dedup_ratio == 0.5 and stats.strategy == "exact"
    clusters = {r.canonical_id: r["size"] for r in D.duplicate_clusters(flags).collect()}
    assert clusters == {0: 3, 3: 2}
    assert D.duplicate_bitmap(flags).first().duplicates == 3


def test_labels_and_empty_input(spark, lines_of):
    assert D.strategy_label("exact") == "exact"
    assert D.strategy_label("anything", 5) == "simhash(t=5)"
    empty = spark.createDataFrame([], "row_id bigint, line string")
    for strategy in ("exact", "simhash"):
        stats = D.dedup_stats(D.dedup(empty, strategy)).first()
        assert (stats.total_lines, stats.dedup_ratio) == (0, 0.0)


def test_similar_lines(lines_of):
    lines = lines_of(
        '{"t":"The quick brown fox jumps over the lazy dog near the river bank every morning"}',
        '{"u":"The quick brown fox jumps over the lazy dog near the river bank every morning"}',
        '{"t":"Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor"}',
        '{"id":1}',
        "",
        "no strings",
    )
    got = {r.row_id: r.canonical_id for r in D.dedup(lines).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 3}
    exempt = D.dedup(lines, min_content_bytes=1)
    assert {r.row_id: r.canonical_id for r in exempt.collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5}
    sample = D.duplicate_samples(D.dedup(lines), 2).collect()
    assert [tuple(r) for r in sample] == [(2, 1, 0), (5, 4, 0)]


def test_partitioning_does_not_matter(spark):
    lines = spark.createDataFrame(
        [(i, f'{{"t":"text number {i % 7} and some more words to share"}}') for i in range(200)],
        "row_id bigint, line string",
    )
    one = D.dedup(lines.coalesce(1)).orderBy("row_id").collect()
    many = D.dedup(lines.repartition(13)).orderBy("row_id").collect()
    assert one == many


def test_attach_groups_hot_cold_and_null(spark):
    rows = spark.range(100).select(
        F.when(F.col("id") % 10 == 9, None).otherwise(F.when(F.col("id") < 60, 0).otherwise(F.col("id"))).alias("k"),
        "id",
    )
    groups = rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("members"), F.max("id").alias("m"))
    plain = rows.join(groups, "k", "left").select("id", "k", "m").orderBy("id").collect()
    split = attach_groups(rows, groups, "k", 100, "left", cold_members=3, null_keys=True)
    assert split.select("id", "k", "m").orderBy("id").collect() == plain


@pytest.mark.parametrize("buckets", [50_000, 0])
def test_unique_lines(spark, buckets):
    texts = [f"t{i % 70}" for i in range(500)]
    lines = spark.createDataFrame(
        [(i * 997 - 3000, text) for i, text in enumerate(texts)], "row_id bigint, line string"
    )
    kept = writers.unique_lines(lines, D.dedup_exact(lines), bitmap_buckets=buckets)
    assert sorted(r.row_id for r in kept.collect()) == [i * 997 - 3000 for i in range(70)]


def test_one_wide_bucket_is_spread(spark):
    """Thousands of fingerprints that share most bits: no cell tests more than its share."""
    rng = random.Random(9)
    scheme = BlockScheme.build(8)
    # All agree on the blocks of the first choice.
    values = sorted({rng.getrandbits(64) & ~scheme.masks[0] for _ in range(3000)})
    frame = spark.createDataFrame([(i, signed(v)) for i, v in enumerate(values)], "id bigint, fp bigint")
    keyed = hamming._keyed(frame, scheme, "a"), hamming._keyed(frame, scheme, "b")
    sizes = hamming._large_buckets(*keyed, scheme, scheme.variants(), 100_000).collect()
    assert sizes and not any(r["wide"] for r in sizes)
    largest = max(sizes, key=lambda r: r["across"] * r["down"])
    assert len(values) ** 2 / (largest["across"] * largest["down"]) <= 110_000
    got = pairs_within(frame, frame, scheme, len(values), len(values), cell_tests=100_000, tiles=False)
    expected = sum(
        (values[i] ^ values[j]).bit_count() <= 8 for i in range(len(values)) for j in range(i)
    )
    assert got.count() == got.select("a", "b").distinct().count() == expected
