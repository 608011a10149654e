import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from linewright.llm import queries, repeats
from linewright.llm.repeats import repeat_digests, without_repeats
from llm_support import SF_DIR, by_id


def brute(rows, window):
    """Words kept per row, comparing every window with every earlier one."""
    split = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    first = {}
    for doc, words in split:
        if doc is not None:
            for k in range(len(words) - window + 1):
                key = tuple(words[k : k + window])
                first[key] = min(first.get(key, (doc, k)), (doc, k))
    kept = []
    for doc, words in split:
        gone = set()
        if doc is not None:
            for k in range(len(words) - window + 1):
                if first[tuple(words[k : k + window])] < (doc, k):
                    gone.update(range(k, k + window))
        kept.append([w for p, w in enumerate(words) if p not in gone])
    return kept


def check(docs, rows, window=20):
    def entry(doc, text, words):
        digest = hashlib.sha256(" ".join(words).encode()).hexdigest()
        total = len(re.findall("[^\x20\x09-\x0d]+", text or ""))
        return (doc, total, total - len(words), digest)

    expected = [entry(*r, k) for r, k in zip(rows, brute(rows, window), strict=True)]
    order = lambda r: str(r)
    assert sorted(map(tuple, repeat_digests(docs, window).collect()), key=order) == sorted(expected, key=order)


@pytest.mark.parametrize("window", [4, 20])
def test_against_brute_force(docs_of, prose, window):
    passage, other = prose(900, 50), prose(901, 27)
    rows = [(i, prose(i, 60, 12 if window == 4 else 300)) for i in range(12)]
    rows += [(20, f"{prose(20, 13)} {passage} {prose(21, 7)}"), (21, f"{passage} x {passage}")]
    rows += [(22, prose(22, 31) + "\n\n" + other), (23, other), (30, rows[0][1]), (31, rows[0][1])]
    rows += [(19, passage), (40, "z " * 90), (41, prose(5, 19))]
    check(docs_of(rows), rows, window)


def test_awkward_rows(docs_of, awkward):
    check(docs_of(awkward), awkward)
    docs = docs_of(awkward).withColumns({"span_starts": F.lit(1), "row": F.lit(2), "_doc_id": F.lit(3)})
    out = without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(awkward)
    rows = by_id(out)
    assert rows[1]["text"] is None and rows[2]["text"] == "" and rows[3]["text"] == " \t\n "
    assert rows[8]["text"] == awkward[-1][1]
    assert repeat_digests(docs_of([])).collect() == []


def test_small_flushes_and_joins_give_the_same(docs_of, prose, monkeypatch):
    monkeypatch.setattr("linewright.llm.repeats.MAX_BROADCAST_BYTES", 0)
    rows = [(i, prose(i % 6, 80)) for i in range(30)]
    check(docs_of(rows), rows)


def test_kept_words_keep_their_white_space(docs_of, prose):
    passage = prose(3, 25)
    docs = docs_of([(1, passage), (2, f"a\n\tb  {passage}\n c  d\n")])
    assert by_id(without_repeats(docs))[2]["text"] == "a\n\tb  c  d\n"


def test_an_odd_window_is_refused(docs_of):
    with pytest.raises(ValueError, match="even"):
        repeats.repeated_spans(docs_of([(1, "a")]), 7)


def test_against_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    expected = sorted(duck.execute(queries.OP2_SQL).fetchall())
    assert sorted(map(tuple, queries.op2_block_anchors(spark, SF_DIR).collect())) == expected
