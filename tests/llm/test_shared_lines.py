import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewright.llm import shared_lines as module
from linewright.llm.shared_lines import shared_line_digests, without_shared_lines
from llm_support import SF_DIR


def key_of(line):
    stripped = re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+\Z", "", line)
    return re.sub("[A-Z]", lambda m: m.group().lower(), stripped)


def brute(rows, documents=2, least=10):
    """The lines that stay, per row."""
    held = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key_of(line)) >= least:
                held.setdefault(key_of(line), set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [
            line
            for line in lines
            if doc_id is None
            or len(held.get(key_of(line), ())) < documents
            or doc_id == min(held[key_of(line)])
        ]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def digested(rows):
    return sorted(
        ((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in rows), key=str
    )


def made_rows(seed=0):
    draw = np.random.default_rng(seed)
    lines = [f"Line number {i} of the pool" for i in range(60)] + ["short", "", "  \t", "1234567890"]
    lines += ["ÄÖÜäöüßßßß", "日本語日本語日本語日", "日本語日本語日本語", "ＡＢＣ ＤＥＦ ＧＨＩ"]
    rows = []
    for i in range(80):
        chosen = draw.choice(len(lines), draw.integers(0, 12)).tolist()
        text = "\n".join(
            ["", " ", "\t\v"][c % 3] + (lines[c].upper() if c % 5 == i % 5 else lines[c]) + ["", "\r", "\f "][i % 3]
            for c in chosen
        )
        rows.append((i, text))
    return rows


def test_against_brute_force(docs_of, awkward):
    rows = made_rows() + [(200 + i, t) for i, t in enumerate(t for _, t in made_rows(1)[:5])]
    rows += [(i if i is None else 300 + i, t) for i, t in awkward] + [(None, rows[3][1])]
    docs = docs_of(rows).withColumns({"lost": F.lit(1), "line": F.lit("l"), "_doc_id": F.lit(2)})
    got = sorted(map(tuple, shared_line_digests(docs).collect()), key=str)
    assert got == digested(brute(rows))


@pytest.mark.parametrize("documents, least", [(2, 10), (4, 1)])
def test_texts_come_back(docs_of, awkward, documents, least, monkeypatch):
    # No broadcast, and small slices.
    monkeypatch.setattr(module, "MAX_BROADCAST_BYTES", 0)
    monkeypatch.setattr(module, "_EMIT_ROWS", 3)
    rows = made_rows(3) + [(i if i is None else 300 + i, t) for i, t in awkward]
    docs = docs_of(rows).withColumns({"row": F.lit(1), "lost": F.lit("l"), "doc": F.col("doc_id")})
    made = without_shared_lines(docs, documents, least)
    assert made.columns == docs.columns
    expected = [
        (i, None if text is None else t)
        for (i, _, _, t), (_, text) in zip(brute(rows, documents, least), rows, strict=True)
    ]
    got = [(r["doc_id"], r["text"]) for r in made.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_a_line_of_every_document(docs_of, monkeypatch):
    monkeypatch.setattr("linewright.llm.shared_lines.HOT_HOLDERS", 10)
    rows = [(i, f"a line that all of them hold\nown line of {i} alone") for i in range(300)]
    got = {r["doc_id"]: r["n_dropped"] for r in shared_line_digests(docs_of(rows)).collect()}
    assert got == {i: int(i > 0) for i in range(300)}


def test_no_rows(docs_of):
    assert shared_line_digests(docs_of([])).collect() == []
    assert without_shared_lines(docs_of([])).collect() == []


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(map(tuple, shared_line_digests(docs).collect()), key=str)
    assert got == digested(brute(rows)) and sum(n for _, _, n, _ in got) > 0
