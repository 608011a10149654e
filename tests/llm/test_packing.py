import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linewright.llm import packing
from linewright.llm.packing import Places, WordEncoder, pack, shortest_pack_first
from linewright.llm.words import text_chunks
from llm_support import SF_DIR

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(TOKENIZER)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aZéÉ×÷ÿÞΣß.,%$!' \n\t<|>1_-\u0301\x85\x1c", max_size=30), min_size=1, max_size=6))
def test_ids_are_those_of_the_whole_text(texts):
    own = _ENCODER
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    ids, lengths = zip(*[own.encode(*c) for _, *c in text_chunks([batch])], strict=True)
    ids, lengths = np.concatenate(ids).tolist(), np.concatenate(lengths).tolist()
    for text, length in zip(texts, lengths, strict=True):
        assert own.tokenizer.encode(text, add_special_tokens=False).ids == ids[:length], text
        ids = ids[length:]


_ENCODER = WordEncoder(TOKENIZER)


def test_special_tokens_and_a_small_cache(encoder, monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 3)
    for text in ("a<|endoftext|>b", "<|ENDOFTEXT|> x, y.", "one two three four five", "six seven."):
        batch = pa.record_batch([pa.array([text])], names=["text"])
        ids, _ = encoder.encode(*next(iter(text_chunks([batch])))[1:])
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_word_is_looked_up_once_for_many_texts():
    class Watched(dict):
        looked_up = 0

        def _look(self, name, *key):
            Watched.looked_up += 1
            return getattr(super(), name)(*key)

        def get(self, *key):
            return self._look("get", *key)

        def __getitem__(self, key):
            return self._look("__getitem__", key)

        def __contains__(self, key):
            return self._look("__contains__", key)

    own = WordEncoder(TOKENIZER)
    own.index = Watched()
    texts = ["The cat, the dog"] * 500 + ["the"]
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    ids, lengths = own.encode(*next(iter(text_chunks([batch])))[1:])
    expected = own.tokenizer.encode(texts[0], add_special_tokens=False).ids
    assert ids.tolist() == expected * 500 + expected[:1]
    assert lengths.tolist() == [len(expected)] * 500 + [1]
    assert Watched.looked_up <= 2 * len(own.index)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 200), max_size=12))
def test_patterns_place_every_piece_once(histogram):
    patterns = shortest_pack_first(histogram, 50)
    assert all(sum(lengths) <= 50 for lengths, _ in patterns)
    used = Counter()
    for lengths, count in patterns:
        for length in lengths:
            used[length] += count
    assert used == Counter(histogram)
    places = Places(patterns, 50)
    taken = {}
    for length, count in histogram.items():
        sequence, offset = places.of(np.full(count, length), np.arange(count))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            taken.setdefault(s, []).append((o, length))
    assert sorted(taken) == list(range(sum(count for _, count in patterns)))
    for rows in taken.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length


def test_the_shortest_pack_is_taken_first():
    # 30 and 28 are open; 20 fits both and goes to 28, then 19 to the other.
    assert shortest_pack_first({30: 1, 28: 1, 20: 1, 19: 1}, 50) == [((30, 19), 1), ((28, 20), 1)]


def test_padding_is_small():
    draw = np.random.default_rng(0)
    lengths = np.minimum(draw.lognormal(6, 1, 20_000).astype(int) + 1, 4096)
    patterns = shortest_pack_first(dict(Counter(lengths.tolist())), 4096)
    assert lengths.sum() / (4096 * sum(c for _, c in patterns)) > 0.99


def check(docs, rows, limit, encoder):
    got = pack(docs, TOKENIZER, limit).collect()
    pieces, sequences = Counter(), {}
    for r in got:
        key = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
        pieces[tuple(r[k] for k in key)] += 1
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    expected = Counter()
    for doc_id, text in rows:
        ids = [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        for start in range(0, len(ids), limit):
            piece = np.array(ids[start : start + limit], "<u4")
            expected[(doc_id, start, len(piece), zlib.crc32(piece), len(ids))] += 1
    assert pieces == expected
    for rows_of in sequences.values():
        at = 0
        for offset, length in sorted(rows_of):
            assert offset == at
            at += length
        assert at <= limit
    assert sorted(sequences) == list(range(len(sequences)))


@pytest.mark.parametrize("limit", [16, 4096])
def test_pieces_against_brute_force(docs_of, awkward, prose, encoder, limit):
    rows = awkward + [(100 + i, prose(i, 7 * i)) for i in range(30)] + [(200, "")] * 40
    docs = docs_of(rows).withColumns({"length": F.lit(1), "rank": F.lit(2)})
    check(docs, rows, limit, encoder)


def test_no_rows(docs_of):
    assert pack(docs_of([]), TOKENIZER).collect() == []


def test_tables(spark, encoder):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    check(docs, [(r["doc_id"], r["text"]) for r in docs.collect()], 4096, encoder)


def test_other_tokenizers_encode_whole_texts(docs_of):
    """A tokenizer that keeps case and spaces does not go by words."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = packing._encoder(path)
    assert isinstance(encoder, packing.TextEncoder) and isinstance(packing._encoder(TOKENIZER), WordEncoder)
    rows = [(1, "Hello World, this is Fine."), (2, ""), (3, None), (4, "<|endoftext|> é  x\n\n"), (5, "ab " * 9000)]
    got = pack(docs_of(rows), path, 1024).collect()
    for doc_id, text in rows:
        ids = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = sorted((r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == doc_id)
        expected = [
            (s, len(ids[s : s + 1024]), zlib.crc32(np.array(ids[s : s + 1024], "<u4").tobytes()))
            for s in range(0, len(ids), 1024)
        ]
        assert pieces == expected
    assert encoder.tokenizer.encode(rows[0][1]).ids[:2] == [15496, 2159]
