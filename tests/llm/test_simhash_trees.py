import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from linewright.llm import simhash_trees as trees
from linewright.llm.components import components
from linewright.llm.simhash_trees import one_of_each, simhash_components
from llm_support import by_id


def brute_print(text, shingle=4):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_labels(prints, ids, distance=4):
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(prints)):
        if ids[i] is not None:
            root = find(i)
            least[root] = min(least.get(root, ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(prints))]


def near(prose, seed, words=300):
    base = prose(seed, words).split()
    for k in range(6):
        yield " ".join(w + ("!" if i == 7 + 40 * k else "") for i, w in enumerate(base))


@pytest.fixture
def small_leaves(monkeypatch):
    """Many leaves and in-memory splits, so that borders are crossed."""
    monkeypatch.setattr(trees, "LEAF_HOMES", 4)
    monkeypatch.setattr(trees, "_LEAST_SAMPLE", 2)
    monkeypatch.setattr(trees, "_BLOCK", 64)


def test_components_against_brute_force(docs_of, prose, awkward, small_leaves):
    rows = [(100 + i, t) for i, t in enumerate(t for s in range(15) for t in near(prose, s))]
    rows += [(500 + i, prose(700 + i, 3 + i % 5)) for i in range(60)] + awkward + [(None, "")]
    got = simhash_components(docs_of(rows)).collect()
    prints = [brute_print(t) for _, t in rows]
    labels = brute_labels(prints, [i for i, _ in rows])
    expected = [(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, labels, strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    assert len({c for _, _, c in expected}) < len(rows) - 40


def test_planted_distances_are_all_found(small_leaves):
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 63, 400, dtype=np.uint64)
    flips = np.zeros(400, np.uint64)
    for _ in range(4):
        flips ^= np.uint64(1) << draw.integers(0, 64, 400).astype(np.uint64)
    prints = np.concatenate([base, base ^ flips])
    forest = trees._trees(prints, len(prints), 4)
    assert all(t.leaves > 8 for t in forest)
    found = set()
    for tree in forest:
        row, leaf, home = tree.route(prints)
        assert np.array_equal(np.sort(row[home]), np.arange(len(prints)))
        for k in range(tree.leaves):
            at = row[leaf == k]
            label = trees.linked(prints[at], home[leaf == k], tree.band(prints[at]), tree.reach, 4)
            found |= {(int(at[i]), int(at[j])) for i in range(len(at)) for j in range(i) if label[i] == label[j]}
    assert all((i + 400, i) in found or (i, i + 400) in found for i in range(400))


def test_tree_prunes(small_leaves, monkeypatch):
    draw = np.random.default_rng(5)
    prints = draw.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    monkeypatch.setattr(trees, "LEAF_HOMES", 500)
    for tree in trees._trees(prints[:4000], len(prints), 4):
        row, leaf, home = tree.route(prints)
        work = sum((home & (leaf == k)).sum() * (leaf == k).sum() for k in range(tree.leaves))
        assert work < 0.25 * len(prints) ** 2


def test_large_leaves_are_cut(docs_of, prose, monkeypatch):
    monkeypatch.setattr(trees, "LEAF_ROWS", 10)
    rows = [(i, t) for i, t in enumerate(t for s in range(8) for t in near(prose, s))]
    got = simhash_components(docs_of(rows)).collect()
    prints = [brute_print(t) for _, t in rows]
    labels = brute_labels(prints, [i for i, _ in rows])
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(labels))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(frame).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_one_of_each(docs_of, prose, awkward):
    docs = docs_of([(9, prose(50, 200)), (8, prose(50, 200)), *awkward]).withColumn("_id", F.lit(1))
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 8 in ids and 9 not in ids and 1 in ids and 2 not in ids
    # Rows decide: the repeated row 4 stays once, the row without an id is a copy of row 5.
    assert sorted(ids) == [1, 4, 5, 6, 7, 8, 8]
    assert one_of_each(docs_of([])).collect() == []
    assert simhash_components(docs_of([])).collect() == []
    assert by_id(simhash_components(docs_of([(3, None)])))[3]["fingerprint"] == "0" * 16


def test_one_of_each_of_shared_ids_and_none(docs_of, prose):
    one, two, three = prose(1, 200), prose(2, 200), prose(3, 200)
    rows = [(1, one), (1, one), (1, two), (2, two), (3, one), (None, three), (None, three), (None, one)]
    prints = {t: brute_print(t) for t in (one, two, three)}
    assert min((prints[a] ^ prints[b]).bit_count() for a, b in [(one, two), (one, three), (two, three)]) > 4
    # Row 1 names the components of both its texts.
    kept = [(r["doc_id"], r["text"]) for r in one_of_each(docs_of(rows)).collect()]
    assert sorted(kept, key=str) == sorted([(1, one), (1, two), (None, three)], key=str)
