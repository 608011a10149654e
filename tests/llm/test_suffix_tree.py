import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewright.llm import suffix_tree
from linewright.llm.suffix_tree import suffix_tree_scores
from llm_support import SF_DIR, by_id


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", lower), None]


def is_held_out(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 == 1


def check_base(rows, got):
    counts = Counter(w for i, t in rows if not is_held_out(i) for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    expected = Counter()
    for doc_id, text in rows:
        words = tokens(text)
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)
        known = sum(counts[w] > 0 for w in words)
        expected[(doc_id, is_held_out(doc_id), len(words), known, total, round(base, 6))] += 1
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    assert Counter((*[r[n] for n in names], round(r["base_score"], 6)) for r in got) == expected


@pytest.mark.parametrize("common", [1e-6, 1e-2, 1.0])
def test_base_scores_against_brute_force(docs_of, prose, awkward, monkeypatch, common):
    monkeypatch.setattr(suffix_tree, "COMMON_SHARE", common)
    rows = [(100 + i, prose(i, 50 + i)) for i in range(40)] + awkward
    docs = docs_of(rows).withColumns({"row": F.lit(1), "key": F.lit(2), "held_out": F.lit(3)})
    check_base(rows, suffix_tree_scores(docs).collect())


def test_held_out_text_is_better_predicted(docs_of):
    draw = np.random.default_rng(1)
    follow = {w: draw.choice(30, 3, replace=False) for w in range(30)}

    def text():
        word, out = 0, []
        for _ in range(60):
            word = int(draw.choice(follow[word]))
            out.append(f"t{word}")
        return " ".join(out)

    rows = suffix_tree_scores(docs_of([(i, text()) for i in range(300)])).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 30
    gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    # Three successors of thirty: close to a factor of ten per word.
    assert gain > 0.8


class BruteTree:
    """The model by its definition, with plain dictionaries."""

    def __init__(self, texts, evidence, next_count, keep, smoothing=16.0, depth=3):
        rows = [tokens(t) for t in texts]
        self.count = Counter(w for r in rows for w in r)
        self.total = sum(self.count.values())
        self.smoothed = self.total + 0.5 * (len(self.count) + 1)
        follow = {}
        for r in rows:
            for i, w in enumerate(r):
                for d in range(1, min(depth, i) + 1):
                    follow.setdefault(tuple(r[i - d : i]), Counter())[w] += 1
        self.own, self.scale, diverging = {}, {}, set()
        for context in sorted(follow, key=len):
            n = sum(follow[context].values())
            if n < evidence:
                continue
            listed = {w: c for w, c in follow[context].items() if c >= next_count}
            parent = {w: self.own[context[1:]][w] if len(context) > 1 else self.base(w) for w in listed}
            own = {w: (c + smoothing * parent[w]) / (n + smoothing) for w, c in listed.items()}
            rest, taken = 1 - sum(own.values()), 1 - sum(parent.values())
            scale = math.log(max(rest, 1e-12) / max(taken, 1e-12))
            told = sum(own[w] * math.log(own[w] / parent[w]) for w in own)
            self.own[context], self.scale[context] = own, scale
            if listed and (told + max(rest, 1e-12) * scale) * n >= keep:
                diverging.add(context)
        self.kept = {c[i:] for c in diverging for i in range(len(c))}
        self.depth = depth

    def base(self, word):
        return (self.count[word] + 0.5) / self.smoothed

    def log(self, before, word):
        value = math.log(self.base(word))
        for d in range(1, min(self.depth, len(before)) + 1):
            context = tuple(before[len(before) - d :])
            if context not in self.kept:
                break
            own = self.own[context].get(word)
            value = math.log(own) if own else value + self.scale[context]
        return value

    def score(self, text):
        row = tokens(text)
        return sum(self.log(row[:i], w) for i, w in enumerate(row)) / math.log(10)


@pytest.fixture
def small(monkeypatch):
    """Evidence that a small corpus has, and a bitmap that lets many runs through by chance."""
    for name, value in (("EVIDENCE", 6), ("NEXT_COUNT", 2), ("KEEP_DIVERGENCE", 0.5), ("BITMAP_BITS", 12)):
        monkeypatch.setattr(suffix_tree, name, value)


def chained(seed, count):
    draw = np.random.default_rng(seed)
    follow = {w: draw.choice(25, 4, replace=False) for w in range(25)}
    rows = []
    for i in range(count):
        word, out = int(draw.integers(25)), []
        for _ in range(int(draw.integers(1, 60))):
            word = int(draw.choice(follow[word])) if draw.random() < 0.9 else int(draw.integers(25))
            out.append(f"t{word}" if draw.random() < 0.95 else f"rare{draw.integers(1000)}")
        rows.append((i, " ".join(out)))
    return rows


@pytest.mark.parametrize("entries", [10**6, 0])
@pytest.mark.parametrize("common", [1e-6, 0.02, 1.0])
def test_scores_against_a_brute_force_tree(docs_of, awkward, small, monkeypatch, entries, common):
    monkeypatch.setattr(suffix_tree, "MODEL_ENTRIES", entries)
    monkeypatch.setattr(suffix_tree, "COMMON_SHARE", common)
    rows = chained(3, 150) + [(i if i is None else 1000 + i, t) for i, t in awkward]
    tree = BruteTree([t for i, t in rows if not is_held_out(i)], 6, 2, 0.5)
    lengths = Counter(map(len, tree.kept))
    assert lengths[1] > 10 and lengths[2] > 10 and lengths[3] > 3
    docs = docs_of(rows).withColumns({"row": F.lit(1), "word": F.lit(2), "context": F.lit("c")})
    got = suffix_tree_scores(docs).collect()
    check_base(rows, got)
    expected = Counter((i, round(tree.score(t), 6)) for i, t in rows)
    assert Counter((r["doc_id"], round(r["score"], 6)) for r in got) == expected


@pytest.mark.parametrize("entries, words", [(10**6, 0), (600, 40), (1500, 10**6)])
def test_a_large_tree_is_scored_in_slices(docs_of, awkward, small, monkeypatch, entries, words):
    monkeypatch.setattr(suffix_tree, "MODEL_ENTRIES", entries)
    monkeypatch.setattr(suffix_tree, "COMMON_WORDS", words)
    monkeypatch.setattr(suffix_tree, "COMMON_SHARE", 0.02)
    monkeypatch.setattr(suffix_tree, "COMMON_COUNT", 3)
    monkeypatch.setattr(suffix_tree, "WHOLE_TOKENS", 0 if entries == 600 else 10**6)
    monkeypatch.setattr(suffix_tree, "_scores_by_joins", lambda *_: pytest.fail("positions were joined"))
    sent, collected = [], suffix_tree.SuffixTree.collected

    def seen(levels, *slice_):
        tree = collected(levels, *slice_)
        sent.append(sum(len(level[0]) + len(level[2]) for level in tree.levels))
        return tree

    monkeypatch.setattr(suffix_tree.SuffixTree, "collected", seen)
    rows = chained(3, 150) + [(i if i is None else 1000 + i, t) for i, t in awkward]
    rows += rows[:20]
    tree = BruteTree([t for i, t in rows if not is_held_out(i)], 6, 2, 0.5)
    got = suffix_tree_scores(docs_of(rows)).collect()
    check_base(rows, got)
    expected = Counter((i, round(tree.score(t), 6)) for i, t in rows)
    assert Counter((r["doc_id"], round(r["score"], 6)) for r in got) == expected
    assert len(sent) == -(-sum(sent) // entries) and (entries > 1500 or max(sent) < sum(sent))


def test_words_are_sent_up_to_a_number(docs_of, monkeypatch):
    rows = [(0, "a " * 40 + "b " * 9 + "c " * 9 + "d d e f")]
    counts = suffix_tree.word_counts(docs_of(rows).select("text"))
    found = []
    for share, words, count in (
        *((0.2, words, 1) for words in (0, 1, 2, 3, 4, 10**6)),
        *((0.2, 10**6, count) for count in (3, 10)),
        (1.0, 0, 1),
    ):
        monkeypatch.setattr(suffix_tree, "COMMON_SHARE", share)
        monkeypatch.setattr(suffix_tree, "COMMON_WORDS", words)
        monkeypatch.setattr(suffix_tree, "COMMON_COUNT", count)
        least = suffix_tree._common_count(counts, 63)
        found.append(counts.filter(F.col("n") >= least).count())
    assert found == [1, 1, 1, 3, 4, 7, 3, 1, 0]


def test_longer_runs_of_a_large_corpus_are_looked_over(docs_of, monkeypatch):
    for name, value in {"EVIDENCE": 20, "NEXT_COUNT": 4}.items():
        monkeypatch.setattr(suffix_tree, name, value)
    draw = np.random.default_rng(7)
    rows = [(i, "a b " + " ".join(f"a b w{n}" for n in draw.integers(0, 400, 5))) for i in range(150)]
    texts = docs_of(rows).select("text").repartition(5)
    words = [t.split() for _, t in rows]
    after = Counter()
    for w in words:
        after.update(zip(w, w[1:], [*w[2:], None], strict=False))
    every = suffix_tree.Bitmap(np.full(1, 255, np.uint8), 3)
    sizes = []
    for whole in (10**9, 0):
        monkeypatch.setattr(suffix_tree, "WHOLE_TOKENS", whole)
        found = [r["n"] for r in suffix_tree.next_counts(texts, 2, every, every, 3000).collect()]
        assert sum(n >= 4 for n in found) == sum(n >= 4 for n in after.values())
        sizes.append(sum(n < 4 for n in found))
    assert sizes[1] < 0.1 * sizes[0]


def test_probabilities_after_any_context_sum_to_one():
    rows = chained(4, 200)
    tree = BruteTree([t for _, t in rows], 6, 2, 0.5)
    for context in [(), *sorted(tree.kept)[:60]]:
        total = sum(math.exp(tree.log(list(context), w)) for w in tree.count)
        # The rest is for a word that was never seen.
        unseen = math.exp(tree.log(list(context), "never seen"))
        assert abs(total + unseen - 1) < 1e-9


def test_the_tree_grows_with_the_corpus(docs_of, small):
    sizes = []
    for count in (40, 400):
        texts = docs_of(chained(5, count)).select("text")
        counts = suffix_tree.word_counts(texts).cache()
        total, distinct = counts.agg(F.sum("n"), F.count("n")).first()
        levels = suffix_tree.fit(texts, counts, total, distinct)
        sizes.append([level.n_states for level in levels])
        for shorter, level in zip(levels, levels[1:], strict=False):
            suffixes = {r["suffix"] for r in level.states.collect()}
            assert suffixes <= {r["context"] for r in shorter.states.collect()}
    assert sum(sizes[1]) > 2 * sum(sizes[0]) > 0


def test_a_bitmap_misses_nothing(spark):
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 5000)
    frame = spark.createDataFrame([(int(k),) for k in keys], "key long")
    for power in (10, 17, 20):
        suffix_tree_bits, suffix_tree.BITMAP_BITS = suffix_tree.BITMAP_BITS, power
        try:
            bitmap = suffix_tree._bitmap(frame, 10**6)
        finally:
            suffix_tree.BITMAP_BITS = suffix_tree_bits
        assert bitmap.holds(keys.view(np.uint64)).all()
    others = np.arange(10**5, dtype=np.uint64)
    assert bitmap.holds(others).mean() < 0.01


@pytest.mark.parametrize("limits", [{}, {"PART_TOKENS": 500, "FLUSH_WORDS": 700}])
def test_pairs_that_are_not_often_enough_are_not_counted(docs_of, monkeypatch, limits):
    for name, value in ({"EVIDENCE": 20, "NEXT_COUNT": 4} | limits).items():
        monkeypatch.setattr(suffix_tree, name, value)
    draw = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{n}" for n in draw.integers(0, 150, 90))) for i in range(150)]
    rows += [(1000 + i, "often met") for i in range(5)] + [(2000, "w1 w2 " * 100)]
    texts = docs_of(rows).select("text").repartition(5)
    pairs = Counter(p for _, t in rows for w in [tokens(t)] for p in zip(w, w[1:], strict=False))
    words = suffix_tree.word_counts(texts).withColumn("root", F.lit(0).cast("long"))
    runs = suffix_tree._bitmap(words.filter("n >= 4").select("key"), 200)
    listed = suffix_tree._bitmap(words.filter("n >= 4").select("root", "key"), 200)
    found = suffix_tree.next_counts(texts, 1, runs, listed, len(rows) * 91)
    counted = [r["n"] for r in found.collect()]
    assert sorted(n for n in counted if n >= 4) == sorted(n for n in pairs.values() if n >= 4)
    assert sum(n < 4 for n in counted) < 0.1 * sum(n < 4 for n in pairs.values())


def test_empty_tables(docs_of):
    assert suffix_tree_scores(docs_of([])).collect() == []
    alone = suffix_tree_scores(docs_of([(i, "a b") for i in range(40) if is_held_out(i)])).collect()
    assert alone and all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in alone)


def test_tables(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check_base(rows, by_id(suffix_tree_scores(docs)).values())
