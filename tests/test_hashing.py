import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linewright.functions import hashing as H

# Lines and the content that is read from them; fingerprints follow by definition.
CONTENT = [
    ('{"question":"how far is it","answer":"two miles"}', "how far is it two miles "),
    ('{"turns":[{"who":"guest","said":"Is it late?"}]}', "who guest Is it late? "),
    ('{"a":["x1","y2","z3"],"b":"w"}', "x1 w "),
    (r'{"a":"line\nbreak \u00e9"}', "linenbreak u00e9 "),
    ('{"o":{"k":"v"}}', "k v "),
    ('{"a":"hi"}', "hi "),
    ('{"id":1,"ok":true}', ""),
    ("no record at all", ""),
    ("", ""),
]


def fnv(data: bytes) -> int:
    value = H.FNV_OFFSET
    for byte in data:
        value = ((value ^ byte) * H.FNV_PRIME) % 2**64
    return value


def simhash(data: bytes, shingle: int = 4) -> int:
    if len(data) < shingle:
        return fnv(data)
    hashes = [fnv(data[i : i + shingle]) for i in range(len(data) - shingle + 1)]
    votes = [sum(1 if h >> i & 1 else -1 for h in hashes) for i in range(64)]
    return sum(1 << i for i in range(64) if votes[i] > 0)


def rows(texts):
    return H._byte_view(pa.array(texts, pa.string()))


def test_fingerprints_by_definition(spark):
    frame = spark.createDataFrame(CONTENT, "line string, content string")
    content = H.extract_content(F.col("line"))
    found = frame.select(
        "line",
        "content",
        H.fingerprint_hex(H.simhash64(content)).alias("sim"),
        H.fingerprint_hex(H.simhash64_json(F.col("line"))).alias("json"),
        H.fingerprint_hex(H.fnv1a64(F.col("line"))).alias("fnv"),
    ).collect()
    for r in found:
        assert r.sim == r.json == f"{simhash(r.content.encode()):016x}"
        assert r.fnv == f"{fnv(r.line.encode()):016x}"


def test_nulls_stay_null(spark):
    frame = spark.createDataFrame([(1, None), (2, "abcdef")], "i int, t string")
    got = {r.i: r.s for r in frame.select("i", H.simhash64(F.col("t")).alias("s")).collect()}
    assert got[1] is None and got[2] % 2**64 == simhash(b"abcdef")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=30), st.integers(2, 6))
def test_simhash_matches_definition(texts, shingle):
    raw, bounds = rows(texts)
    got = H.simhash_rows(raw, bounds[:-1], bounds[1:], shingle)
    assert got.tolist() == [simhash(t.encode(), shingle) for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=300), min_size=1, max_size=120))
def test_fnv_matches_definition(texts):
    raw, bounds = rows(texts)
    assert H.fnv_rows(raw, bounds[:-1], bounds[1:]).tolist() == [fnv(t.encode()) for t in texts]


def test_blocks_and_slices(monkeypatch):
    """Texts longer than a work block, and arrays that are slices of larger ones."""
    monkeypatch.setattr(H, "_BLOCK", 100)
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(32, 126, n))) for n in (0, 3, 4, 700, 5, 260, 99, 1)]
    array = pa.array(["skip", *texts, "skip"])[1:-1]
    raw, bounds = H._byte_view(array)
    got = H.simhash_rows(raw, bounds[:-1], bounds[1:], 4)
    assert got.tolist() == [simhash(t.encode()) for t in texts]


@pytest.mark.parametrize("a, b, distance", [(0b1010, 0b1001, 2), (-1, 0, 64), (7, 7, 0)])
def test_hamming(spark, a, b, distance):
    frame = spark.createDataFrame([(a, b)], "a bigint, b bigint")
    assert frame.select(H.hamming_distance(F.col("a"), F.col("b"))).first()[0] == distance


def one(spark, column, value):
    frame = spark.createDataFrame([(value,)], "v string")
    return frame.select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "line, content",
    [
        *CONTENT,
        (r'{"a":"open \"x', 'open "x'),
        (r'{"a":"b\"c","d:e":"f"}', 'b"c f '),
        ('{"a":"lone\\', "lone"),
        ('{"a":"b" "c", "d"}', "b c "),
    ],
)
def test_extract_content(spark, line, content):
    assert one(spark, H.extract_content, line) == content


def test_extract_content_of_very_long_values(spark):
    line = '{"a":"' + r"x\n" * 200_000 + '"}'
    length = one(spark, lambda c: F.length(H.extract_content(c)), line)
    assert length == 400_001


def test_extract_content_of_invalid_utf8_is_empty(spark):
    def broken(column):
        raw = F.concat(F.lit('{"a":"x').cast("binary"), F.unhex(F.lit("FF")), column.cast("binary"))
        return H.extract_content(raw.cast("string"))

    assert one(spark, broken, '"}') == ""
