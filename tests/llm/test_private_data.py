import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linewright.llm import private_data as pii
from linewright.llm.private_data import beliefs, masked, private_spans
from llm_support import SF_DIR, by_id

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute(text):
    spans = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = (
                True,
                kind == 1 and all(int(p) <= 255 for p in m.group().split(".")),
                16 <= len(digits) <= 19 and pii.luhn(digits),
                8 <= len(digits) <= 15,
            )[kind]
            if good:
                spans.append((kind, *m.span()))
    return spans


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aZ019.@+-( )%_\né", max_size=60))
def test_base_spans_against_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_known_spans():
    text = "mail a.b@c.de. ip 1.2.3.255 1.2.3.256 card 4111 1111 1111 1111, call +1 (20) 555-0100."
    found = [(pii.KINDS[k], text[s:e]) for k, s, e in pii.base_spans(text)]
    assert found == [
        ("email", "a.b@c.de"),
        ("ip", "1.2.3.255"),
        ("card", "4111 1111 1111 1111"),
        ("phone", "+1 (20) 555-0100"),
    ]


def test_hard_texts_are_linear():
    for text in ("a" * 200_000, "a@" * 50_000, "1" * 200_000, "+1 " * 60_000, "1." * 90_000):
        pii.base_spans(text)
        pii.candidates(text)


def test_messages_on_a_tree_are_exact():
    draw = np.random.default_rng(0)
    unary, pair = draw.normal(size=(5, 3)), draw.normal(size=(2, 3, 3))
    links = np.array([(0, 1, 0), (1, 2, 0), (1, 3, 1), (3, 4, 0)])
    total = np.zeros((5, 3))
    for labels in np.ndindex(*[3] * 5):
        score = sum(unary[i, x] for i, x in enumerate(labels))
        score += sum(pair[k, labels[a], labels[b]] for a, b, k in links)
        for i, x in enumerate(labels):
            total[i, x] += np.exp(score)
    exact = total / total.sum(axis=1, keepdims=True)
    assert np.allclose(beliefs(unary, links, pair), exact, atol=1e-3)


def corpus():
    rows = []
    for i in range(60):
        phone = f"+1 ({200 + i}) 555-{1000 + 37 * i}"
        rows.append((i, f"call {phone} or write n{i}@host.example.org about 2024 and v{i}."))
    return rows


def test_a_repeated_number_is_found_where_the_pattern_misses_it(docs_of):
    rows = [*corpus(), (100, "ring +1 (321) 555-7777 today. 555-7777 again, and 555-7777. chapter 12")]
    spans = by_id(private_spans(docs_of(rows)))[100]["spans"].split(",")
    text = rows[-1][1]
    found = [text[int(a) : int(b)] for a, b in (s.split(":")[1:] for s in spans)]
    assert found == ["+1 (321) 555-7777", "555-7777", "555-7777"]


def test_clean_texts_gain_nothing(docs_of, prose):
    rows = [*corpus(), *[(200 + i, f"{prose(i, 50)} version 3.0 of 1998, page {i}") for i in range(20)]]
    got = by_id(private_spans(docs_of(rows)))
    assert all(got[200 + i]["spans"] == "" for i in range(20))


def test_counts_and_digest(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = by_id(private_spans(docs))
    for row in docs.collect():
        spans = brute(row["text"] or "")
        listed = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans]
        result = got[row["doc_id"]]
        assert result["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(result["spans"].split(",")) or not listed
        assert [result[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == i for s in spans) for i in range(4)]


def test_masking_and_awkward_rows(docs_of, awkward):
    rows = [*awkward, (50, "é a@b.cd, 🙂 1.2.3.4!")]
    docs = docs_of(rows).withColumn("row", F.lit(1))
    out = masked(docs)
    got = by_id(out)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert got[50]["text"] == "é <EMAIL>, 🙂 <IP>!" and got[1]["text"] is None
    assert private_spans(docs).count() == len(rows)
    assert private_spans(docs_of([])).collect() == [] and masked(docs_of([])).collect() == []


def chain(length, kinds=3):
    unary = np.zeros((length, kinds))
    unary[0, 1] = 6.0
    links = np.array([(i, i + 1, 0) for i in range(length - 1)])
    return unary, links, 5.0 * np.eye(kinds)[None]


def exact_chain(unary, pair):
    """Forward and backward sums along a chain."""
    before, after = np.zeros_like(unary), np.zeros_like(unary)
    for i in range(1, len(unary)):
        before[i] = np.logaddexp.reduce((before[i - 1] + unary[i - 1])[:, None] + pair, axis=0)
        before[i] -= before[i].max()
    for i in range(len(unary) - 2, -1, -1):
        after[i] = np.logaddexp.reduce((after[i + 1] + unary[i + 1])[None, :] + pair, axis=1)
        after[i] -= after[i].max()
    odds = np.exp(unary + before + after)
    return odds / odds.sum(axis=1, keepdims=True)


def test_evidence_travels_along_long_chains():
    unary, links, pair = chain(400)
    exact = exact_chain(unary, pair[0])
    assert exact[20, 1] > 0.5
    assert np.allclose(beliefs(unary, links, pair), exact, atol=1e-3)


def test_a_text_does_not_depend_on_the_others():
    draw = np.random.default_rng(2)
    pair = draw.normal(size=(4, 5, 5))
    alone, unary, links, text_of, at = [], [], [], [], 0
    for t, size in enumerate([3, 80, 1, 20, 40, 7]):
        own = draw.normal(size=(size, 5))
        own_links = [(i, i + 1, int(draw.integers(4))) for i in range(size - 1)]
        own_links += [(i, i + 3, 1) for i in range(size - 3)]
        alone.append(beliefs(own, np.array(own_links, np.int64).reshape(-1, 3), pair))
        unary.append(own)
        links += [(a + at, b + at, k) for a, b, k in own_links]
        text_of += [t] * size
        at += size
    together = beliefs(np.concatenate(unary), np.array(links), pair, np.array(text_of))
    assert np.array_equal(together, np.concatenate(alone))


def test_recall_of_planted_repeats(docs_of, prose):
    """Numbers and names that a pattern finds once are found again where it misses them."""
    rows, planted = list(corpus()), {}
    for i in range(120):
        number, again = f"+44 ({300 + i}) 555-{2000 + 31 * i}", f"555-{2000 + 31 * i}"
        text = f"{prose(i, 20)} call {number} soon. {prose(i + 500, 20)} or {again}, {prose(i + 900, 9)} {again}!"
        planted[1000 + i] = {(m.start(), m.end()) for m in re.finditer(f"(?<=[ ]){again}", text)} - {
            (text.index(number) + len(number) - len(again), text.index(number) + len(number))
        }
        rows.append((1000 + i, text))
    clean = [(5000 + i, f"{prose(i + 2000, 60)} in {1900 + i} there were {i + 3} of 12.5") for i in range(100)]
    got = by_id(private_spans(docs_of(rows + clean)))

    def spans(i):
        return {tuple(map(int, s.split(":")[1:])) for s in got[i]["spans"].split(",") if s}

    found = sum(len(places & spans(i)) for i, places in planted.items())
    assert found >= 0.9 * sum(map(len, planted.values()))
    assert sum(bool(spans(i)) for i, _ in clean) == 0
