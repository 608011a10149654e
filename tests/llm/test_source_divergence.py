import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewright.llm import source_divergence as module
from linewright.llm.source_divergence import chunk_counts, chunks_of, source_divergence, term_chunks
from linewright.llm.words import numbered

SCHEMA = "doc_id bigint, lang string, source string, text string"


def terms_of(text):
    found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in found]


def brute(rows, least=30, ranks=50):
    docs, counts, groups = {}, {}, {}
    for n, (_, lang, source, text) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.setdefault(lang, set()).add(source)
        for t in terms_of(text):
            docs.setdefault((lang, t), set()).add(n)
            counts.setdefault((lang, source), Counter())[t] += 1
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for (l, t), d in docs.items() if l == lang and len(d) >= least)
        size = len(kept)

        def shares(of, kept=kept, size=size):
            total = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 5) // (total + 5 * size) for t in kept}

        own = {s: counts.get((lang, s), Counter()) for s in sources}
        p = {s: shares(own[s]) for s in sources}
        q = shares(sum(own.values(), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, top in (("pair", pairs, None), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, r + 1) for r, (v, i) in enumerate(found[:top])]
    return sorted(out)


def made_rows(seed, count, sources=4):
    draw = np.random.default_rng(seed)
    pool = ["The", "the,", "word", "Word.", "word-by-word", "Ünder", "naïve!", "日本語", "x1y", "--", " z"]
    pool += [f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = []
    for i in range(count):
        words = draw.choice(pool, draw.integers(0, 25)).tolist()
        text = [" ", "\n", "\t "][i % 3].join(words)
        rows.append((i, ["en", "de"][i % 2], f"s{i % sources}", text))
    return rows


def got(frame, **options):
    return sorted(map(tuple, source_divergence(frame, **options).collect()))


AWKWARD = [
    (900, None, None, "the word"),
    (901, "en", None, None),
    (902, None, "s1", ""),
    (903, "en", "only here", "Qqq " * 50),
    (904, "fr", "s0", "\x00 12 _ !"),
    (905, "en", "s0", "the," * 3000 + "x" * 5000),
    (None, "de", "s2", "word word"),
    (1, "en", "s0", "the the"),
    (1, "en", "s0", "the the"),
]


@pytest.mark.parametrize("least", [1, 8, 30])
def test_against_brute_force(spark, least, monkeypatch):
    monkeypatch.setattr(module, "TILE_TERMS", 7)
    monkeypatch.setattr(module, "TILE_SOURCES", 2)
    rows = made_rows(least, 160) + AWKWARD
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"term": F.lit(1), "chunk": F.lit("c")})
    assert got(frame.repartition(5), least_documents=least) == brute(rows, least)


def test_without_broadcasts_and_with_few_ranks(spark, monkeypatch):
    monkeypatch.setattr(module, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(module, "_HELD_CHUNKS", 20)
    monkeypatch.setattr(module, "_EMIT_ROWS", 7)
    rows = made_rows(5, 120, sources=11)
    assert got(spark.createDataFrame(rows, SCHEMA), least_documents=12, term_ranks=3) == brute(rows, 12, 3)


def test_terms_spread_over_rare_chunks(spark):
    # Every chunk is in one document, so no chunk settles the term; 30 documents do.
    rows = [(i, "en", f"s{i % 2}", f"{i}alpha{i} {i}.alpha {i}beta") for i in range(30)]
    rows[7] = (7, "en", "s1", "7alpha7 7.alpha")
    found = got(spark.createDataFrame(rows, SCHEMA))
    assert found == brute(rows)
    assert {r[3] for r in found if r[2] == "term"} == set()
    extra = [*rows, (31, "en", "s0", "31beta"), (32, "en", "s1", "alpha")]
    found = got(spark.createDataFrame(extra, SCHEMA))
    assert found == brute(extra) and {r[3] for r in found if r[2] == "term"} == {"alpha", "beta"}


def test_long_chunks_are_cut_between_terms():
    text = "a-b," * 40 + "ü" * 100 + " " + "z" * 200 + " 1" * 3 + " " + "9" * 100
    found, own = chunks_of(text.encode())
    assert own == set(found)
    assert all(len(c) <= 64 or len(terms_of(c.decode())) == 1 for c in found)
    total = Counter()
    for chunk in found:
        total.update(terms_of(chunk.decode()))
    assert total == Counter(terms_of(text))


def test_chunks_of_texts_side_by_side():
    draw = np.random.default_rng(3)
    letters = list("aB,. \n-ü日0\x00") + ["", " ", "x" * 70]
    texts = ["".join(draw.choice(letters, draw.integers(0, 60))) for _ in range(300)]
    raw = [text.encode() for text in texts]
    offsets = np.append(0, np.cumsum([len(r) for r in raw]))
    words = term_chunks(np.frombuffer(b"".join(raw), np.uint8), offsets)
    numbers, different = numbered(words)
    found = [different[n].as_py() for n in numbers.tolist()]
    ends = np.cumsum(words.counts).tolist()
    for text, start, end in zip(texts, [0, *ends], ends, strict=False):
        expected = []
        for chunk in re.split("[ \n]+", text):
            terms = terms_of(chunk)
            inner = re.sub(r"^[\x00-\x40]+|[\x00-\x40]+$", "", chunk).replace("B", "b")
            expected += [inner] if terms and len(inner.encode()) <= 64 else terms
        assert [c.decode() for c in found[start:end]] == expected


def test_spellings_of_a_term_are_one_chunk(spark):
    rows = [(i, "en", "s0", text) for i, text in enumerate(["Word, word", "(word) a-b", "WORD. A-b!", "--"])]
    slim = module._slim(spark.createDataFrame(rows, SCHEMA).coalesce(1), "lang", "source", "text")
    counts = chunk_counts(slim).select("chunk", "times", "documents").collect()
    assert sorted(map(tuple, counts)) == [("a-b", 2, 2), ("word", 4, 3)]


def test_no_rows(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(1, None, None, None)], SCHEMA)) == []
