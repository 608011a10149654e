import pytest
from pyspark.sql import functions as F

from linewright.functions import text as T


def one(spark, column, value, kind="string"):
    frame = spark.createDataFrame([(value,)], f"v {kind}")
    return frame.select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "value, blank",
    [("", True), (" \t\r", True), ("  　", True), ("\x1c", False), (" x ", False)],
)
def test_is_blank(spark, value, blank):
    assert one(spark, T.is_blank, value) is blank


@pytest.mark.parametrize(
    "size, two, one_decimal",
    [
        (500, "500 B", "500 B"),
        (1536, "1.50 KB", "1.5 KB"),
        (1_500_000, "1.43 MB", "1.4 MB"),
        (2_500_000_000, "2.33 GB", "2.3 GB"),
        (640, "640 B", "640 B"),
        (1664, "1.62 KB", "1.6 KB"),
    ],
)
def test_sizes(spark, size, two, one_decimal):
    assert one(spark, T.size_human, size, "bigint") == two
    assert one(spark, T.format_size, size, "bigint") == one_decimal


@pytest.mark.parametrize(
    "before, after",
    [
        ("<think>a\n\nb", "<think>a</think>\n\nb"),
        ("<think>a", "<think>a</think>"),
        ("<think>x<think>y", "<think>x<think>y</think>"),
        ("<think>a</think>b<think>c", "<think>a</think>b<think>c</think>"),
        ("<think><think>a</think>", "<think><think>a</think>"),
        ("a</think>", "a</think>"),
        ("é<think>ü\n\nñ", "é<think>ü</think>\n\nñ"),
        ("plain", "plain"),
    ],
)
def test_close_think_tag(spark, before, after):
    assert one(spark, T.close_think_tag, before) == after


@pytest.mark.parametrize(
    "before, after",
    [
        ("a</think>b", "<think>a</think>b"),
        ("a</think></think>", "<think><think>a</think></think>"),
        ("<think>a", "<think>a"),
    ],
)
def test_open_think_tag(spark, before, after):
    assert one(spark, T.open_think_tag, before) == after


def test_whitespace_columns(spark):
    assert one(spark, T.strip_trailing_whitespace, "x \n y \t \n") == "x \n y"
    assert one(spark, T.strip_trailing_whitespace, "x\x1c") == "x\x1c"
    assert one(spark, T.strip_space_before_newline, "a  \nb \n\nc ") == "a\nb\n\nc "
    assert one(spark, lambda c: T.truncate_preview(c, 8), "abcdefghij") == "abcde..."
    assert one(spark, lambda c: T.truncate_preview(c, 10), "abcdefghij") == "abcdefghij"
