"""The batch form of content extraction against its definition, line by line."""

import inspect
import json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linewright.functions import hashing, quoting
from linewright.functions.quoting import content_bytes, content_rows

PIECES = st.sampled_from(['"', "\\", ":", ",", "}", "]", "{", "[", "a", "é", "\\\\", '\\"', '":"', " ", "\n"])


def split(lines):
    raw, bounds = hashing._byte_view(pa.array(lines, pa.string()))
    body, offsets = content_rows(raw, bounds)
    assert offsets[0] == 0 and offsets[-1] == len(body) and len(offsets) == len(lines) + 1
    return [body[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=14).map("".join), max_size=6))
def test_any_bytes(lines):
    assert split(lines) == [content_bytes(line.encode()) for line in lines]


VALUES = st.recursive(
    st.none() | st.integers() | st.text(max_size=6) | st.sampled_from(['"', "\\", "a\nb", "\\n", '\\"']),
    lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3),
    max_leaves=8,
)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(VALUES, st.booleans()), max_size=5), st.integers(1, 40))
def test_json_lines_in_small_chunks(values, chunk):
    lines = [json.dumps(value, ensure_ascii=ascii_only) for value, ascii_only in values]
    usual, quoting.CHUNK_BYTES = quoting.CHUNK_BYTES, chunk
    try:
        assert split(lines) == [content_bytes(line.encode()) for line in lines]
    finally:
        quoting.CHUNK_BYTES = usual


@pytest.mark.parametrize(
    "line",
    [
        "",
        '"',
        "\\",
        '{"a":"open',
        '{"a":"open\\',
        '{"a":"open\\\\',
        '{"a":"x\\\\"}',
        '{"a":"x\\\\\\"y"}',
        '\\"a":"b"',
        'x\\\\"a":"b"',
        '{"a":"b" "c"}',
        ':"v',
        '"a\\',
    ],
)
def test_borders_of_lines(line):
    around = ['{"k":"v"}', line, '{"k":"w"}', line, "", line]
    assert split(around) == [content_bytes(text.encode()) for text in around]


def test_nulls_and_slices():
    lines = pa.array(['{"a":"one"}', None, '{"a":"two"}', ""], pa.string())
    raw, bounds = hashing._byte_view(lines.slice(1, 2))
    body, offsets = content_rows(raw, bounds)
    assert body.tobytes() == b"two " and offsets.tolist() == [0, 0, 4]
    empty = content_rows(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    assert len(empty[0]) == 0 and empty[1].tolist() == [0]


def test_lines_are_not_read_one_by_one(monkeypatch):
    def never(line):
        raise AssertionError("read alone")

    monkeypatch.setattr(quoting, "content_bytes", never)
    lines = [json.dumps({"id": i, "text": f'say "{i}" \\ and\n more', "tags": ["a", "b"]}) for i in range(500)]
    assert len(split(lines)) == 500
    assert "for " not in inspect.getsource(quoting._chunk)
