import hashlib
import zlib
from collections import Counter
from decimal import Decimal

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linewright.llm.piece_sampling import (
    Vocabulary,
    decode,
    decode_pieces,
    encode_sampled,
    sample,
    sampling_digests,
    spaced,
    unit_logs,
)
from linewright.llm.words import text_chunks
from llm_support import SF_DIR, by_id

MODEL = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = Vocabulary(MODEL)


def encoded(texts, keys, seed=0):
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    out, row = [], 0
    for part, *source in text_chunks([batch]):
        data, offsets = spaced(*source)
        own = np.array(keys[row : row + len(part)], np.uint64)
        with np.errstate(over="ignore"):
            ids, counts = sample(VOCABULARY, data, offsets, own, seed)
        texts_back = decode(VOCABULARY, ids, counts)
        ends = np.cumsum(counts).tolist()
        out += [(ids[e - n : e].tolist(), t) for e, n, t in zip(ends, counts.tolist(), texts_back, strict=True)]
        row += len(part)
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_decoding_is_lossless(texts):
    for text, (ids, back) in zip(texts, encoded(texts, range(len(texts))), strict=True):
        assert back.decode() == text
        assert b"".join(VOCABULARY.pieces[i] for i in ids) == (f" {text}" if text else "").encode()


@pytest.mark.parametrize("word", ["hear", "on", "xyz", "été"])
def test_draws_follow_the_lattice(word):
    weights = {p: 1 / (2 + r) for r, p in enumerate([p for i, p in enumerate(VOCABULARY.pieces) if i >= 259])}
    unit = f" {word}".encode()

    def ways(rest):
        if not rest:
            yield (), 1.0
            return
        for size in range(1, len(rest) + 1):
            options = [(rest[:size], weights[rest[:size]])] if rest[:size] in weights else []
            options += [(b"byte" + rest[:1], 1 / 32000)] if size == 1 else []
            for piece, weight in options:
                for more, further in ways(rest[size:]):
                    yield (piece, *more), weight * further

    exact = Counter()
    for pieces, weight in ways(unit):
        exact[pieces] += weight
    total = sum(exact.values())
    n = 20_000
    seen = Counter(
        tuple(VOCABULARY.pieces[i] if i >= 259 else b"byte" + VOCABULARY.pieces[i] for i in ids)
        for ids, _ in encoded([word] * n, range(n))
    )
    assert all(abs(seen[p] / n - w / total) < 0.015 for p, w in exact.items())
    assert set(seen) <= set(exact)


def test_same_row_same_pieces_and_other_rows_others(docs_of, prose):
    text = prose(1, 200)
    docs = docs_of([(1, text), (2, text), (1, text)])
    rows = encode_sampled(docs, MODEL).collect()
    one = [r["ids"] for r in rows if r["doc_id"] == 1]
    two = [r["ids"] for r in rows if r["doc_id"] == 2]
    assert one[0] == one[1] != two[0]
    again = encode_sampled(docs.repartition(3), MODEL).filter("doc_id = 2").first()["ids"]
    assert again == two[0]
    assert encode_sampled(docs, MODEL, seed=1).filter("doc_id = 2").first()["ids"] != two[0]
    assert by_id(decode_pieces(encode_sampled(docs, MODEL), MODEL))[2]["text"] == text


def test_awkward_rows(docs_of, awkward):
    rows = [*awkward, (20, "\n" * 300), (21, " " * 300), (22, "日" * 500), (23, "▁\t\r\x0b")]
    docs = docs_of(rows).withColumns({"row_key": F.lit(1), "ids": F.lit(2)})
    got = sampling_digests(docs, MODEL).collect()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in got) == Counter((i, digest(t)) for i, t in rows)
    assert all(r["lossless"] for r in got)
    assert all(r["n_pieces"] == 0 for r in got if r["doc_id"] in (1, 2))
    assert sampling_digests(docs_of([]), MODEL).collect() == []


def test_digests_are_of_the_encoded_ids(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    ids = by_id(encode_sampled(docs, MODEL))
    for r in sampling_digests(docs, MODEL).collect():
        raw = np.array(ids[r["doc_id"]]["ids"], "<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(raw) and r["lossless"]


def exact_ways(unit):
    """Sums of weights to each border, in decimals of many digits."""
    weights = {p: Decimal(1) / (2 + r) for r, p in enumerate([p for i, p in enumerate(VOCABULARY.pieces) if i >= 259])}
    sums = [Decimal(1)]
    for end in range(1, len(unit) + 1):
        total = sums[-1] / 32000
        for size in range(1, min(VOCABULARY.longest, end) + 1):
            total += sums[end - size] * weights.get(unit[end - size : end], 0)
        sums.append(total)
    return sums, weights


@pytest.mark.parametrize("text", ["theinformationofthenation" * 20, "日本語のテキスト" * 70, "aGVsbG8gd29ybGQ" * 40])
def test_a_long_unit_has_one_lattice(text):
    unit = f" {text}".encode()
    assert len(unit) > 500
    sums, weights = exact_ways(unit)
    logs = unit_logs(VOCABULARY, unit)
    assert all(abs(Decimal(float(log)).exp() / s - 1) < Decimal("1e-9") for log, s in zip(logs, sums, strict=True))
    # The last piece is drawn with its exact probability, wherever a cut at 64 bytes would lie.
    end, n = len(unit), 400
    exact = {
        size: float(sums[end - size] * weights.get(unit[end - size :], 0) / sums[end])
        + (float(sums[end - 1] / 32000 / sums[end]) if size == 1 else 0.0)
        for size in range(1, VOCABULARY.longest + 1)
    }
    drawn = Counter(len(VOCABULARY.pieces[ids[-1]]) for ids, _ in encoded([text] * n, range(n)))
    assert all(abs(drawn[size] / n - p) < 0.1 for size, p in exact.items())
    assert all(exact[size] > 0 for size in drawn)


def test_pieces_reach_over_every_64th_byte():
    text = "information" * 200
    over = 0
    for ids, back in encoded([text] * 20, range(20)):
        assert back.decode() == text
        ends = set(np.cumsum([len(VOCABULARY.pieces[i]) for i in ids]).tolist())
        over += sum(at not in ends for at in range(64, 2200, 64))
    assert over > 300
