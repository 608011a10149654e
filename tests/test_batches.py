"""Column functions hold the Python objects of one run of a batch, not of all of it."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linewright.functions import tokens as T
from linewright.functions.batches import by_runs, runs
from workloads.counting import byte_ranks, byte_tokenizer, word_tokenizer


def test_runs_keep_every_text_in_order():
    texts = pa.array(["aa", None, "", "b" * 9, "c", "é", None])
    cut = [run.to_pylist() for run in runs(texts, 4)]
    assert cut == [["aa", None, ""], ["b" * 9], ["c", "é", None]]
    assert by_runs(texts, pa.string(), lambda part: part, 1).to_pylist() == texts.to_pylist()
    assert by_runs(texts.slice(0, 0), pa.string(), lambda part: part).to_pylist() == []
    nulls = pa.array([None, None], pa.string())
    assert by_runs(nulls, pa.string(), lambda part: part, 1).to_pylist() == [None, None]


class _Sent:
    value = {"name": "bytes", "pat_str": r"[\s\S]", "mergeable_ranks": byte_ranks(), "special_tokens": {}}


BYTES = T.Tokenizer("bytes", T.TIKTOKEN, _Sent())


@pytest.mark.parametrize("make", ["offsets", "details", "ids", "counts", "segments"])
def test_tokens_of_a_large_batch_are_not_held_at_once(make, monkeypatch):
    kept = []
    monkeypatch.setattr(T.F, "arrow_udf", lambda function, kind: _Kept(kept, function))
    monkeypatch.setattr(T, "_readable", lambda text: text)
    {
        "offsets": lambda: T.token_offsets(None, BYTES),
        "details": lambda: T.token_details(None, BYTES),
        "ids": lambda: T.token_ids(None, BYTES),
        "counts": lambda: T.count_tokens_udf(BYTES),
        "segments": lambda: T.token_segments(None, BYTES),
    }[make]()
    batch = pa.array(["ab" * 1000] * 300)
    tracemalloc.start()
    sizes = [len(part) for part in kept[0](iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 300 and len(sizes) > 3
    # A token takes some hundred bytes, and there are 600,000.
    assert peak < 600 * T.ENCODED_BYTES


class _Kept:
    def __init__(self, kept, function):
        kept.append(function)

    def asNondeterministic(self):
        return lambda column: column


def test_nulls_and_wide_characters_over_runs(spark, monkeypatch):
    texts = ["aé", None, "", "日本 x", None]
    rows = [(i, texts[i % 5] and texts[i % 5] * (1 + i % 3)) for i in range(50)]
    frame = spark.createDataFrame(rows, "row_id bigint, line string").coalesce(1)
    line = F.col("line")
    words, letters = word_tokenizer(spark), byte_tokenizer(spark)
    found = frame.select(
        "line", T.token_ids(line, letters).alias("ids"), T.token_offsets(line, letters).alias("s"),
    ).collect()
    for row in found:
        raw = None if row.line is None else list(row.line.encode())
        assert row.ids == raw
        spans = None if row.s is None else [tuple(s) for s in row.s]
        assert spans == (None if raw is None else [(i, i + 1) for i in range(len(raw))])
    for row in frame.select("line", T.token_details(line, words).alias("d")).collect():
        if row.line is None:
            assert row.d is None
            continue
        cut = [row.line.encode()[d.byte_start : d.byte_end].decode() for d in row.d]
        assert "".join(cut) == row.line.replace(" ", "") and {d.text for d in row.d} <= {"?"}
