import hashlib
import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linewright.llm import chat_format, queries
from linewright.llm.chat_format import format_conversations, format_digests, read_back
from llm_support import SF_DIR, by_id

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_template(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "user", "there"), (1, 2, "assistant", "é<s>")]
    row = format_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert row["formatted"] == (
        "<|im_start|>user\nhi<|im_sep|>there<|im_end|>\n<|im_start|>assistant\né\\ls><|im_end|>\n"
    )
    (span,) = row["loss_spans"]
    assert row["formatted"][span["start"] : span["end"]] == "é\\ls>"


_PARTS = ["<|im_start|>", "<|im_sep|>", "<|im_end|>", "</s>", "[INST]", "[/INST]", "\\", "\n", "b", "l", "é"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_PARTS), max_size=8).map("".join), min_size=60, max_size=60))
def test_round_trip(spark, texts):
    roles = ["user", "assistant", "assistant", "<|im_end|>\n", None]
    rows = [(i // 6, i % 6, roles[i % 5], t) for i, t in enumerate(texts)]
    formatted = format_conversations(spark.createDataFrame(rows, SCHEMA))
    found = by_id(read_back(formatted), "conv_id")
    for conv in range(10):
        own = [r for r in rows if r[0] == conv]
        assert [(t["role"], t["text"]) for t in found[conv]["turns"]] == [(r[2] or "", r[3]) for r in own]
        assert found[conv]["loss_texts"] == [r[3] for r in own if r[2] == "assistant"]
        marks = re.findall(r"<\|im_start\|>|<\|im_sep\|>", found[conv]["formatted"])
        assert len(marks) == len(own) and "INST]" not in found[conv]["formatted"].replace("\\sINST]", "").replace("\\s/INST]", "")


def test_long_conversations_and_small_runs(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "_RUN", 7)
    rows = [(1, i, "assistant" if i % 3 else "user", f"t{i} 🙂") for i in range(500)]
    found = read_back(format_conversations(spark.createDataFrame(rows, SCHEMA))).first()
    assert found["loss_texts"] == [r[3] for r in rows if r[2] == "assistant"]
    assert len(found["turns"]) == 500


def test_awkward_rows(spark):
    rows = [
        (None, 0, "user", None), (None, 0, "user", None), (1, None, None, "x"), (1, 0, "assistant", ""),
        (2, 5, "user", "b"), (2, 5, "user", "a"), (2, 5, "user", "a"), (3, 0, "user", "z" * 200_000),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"turns": F.lit(1), "entry": F.lit(2)})
    got = by_id(format_digests(frame), "conv_id")
    assert {k: v["n_turns"] for k, v in got.items()} == {None: 2, 1: 2, 2: 3, 3: 1}
    assert got[2]["turns_sha256"] == hashlib.sha256(b"user\na\nuser\na\nuser\nb\n").hexdigest()
    assert got[1]["loss_chars"] == 0
    assert format_digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_against_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF_DIR}/conversations.parquet'")
    expected = sorted(duck.execute(queries.OP8_SQL).fetchall())
    assert sorted(map(tuple, queries.op8_relational_chat(spark, SF_DIR).collect())) == expected
