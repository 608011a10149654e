import pytest
from pyspark.sql import functions as F

from linewright.operators import rows, search


@pytest.fixture
def hundred(spark):
    return (
        spark.range(100)
        .select(F.col("id").alias("row_id"), F.concat(F.lit("line "), F.col("id")).alias("line"))
        .repartition(5)
    )


def ids(frame):
    return [r.row_id for r in frame.collect()]


def test_addressing(hundred):
    assert ids(rows.get_line(hundred, 7)) == [7]
    assert ids(rows.get_line(hundred, 100)) == []
    assert ids(rows.get_lines(hundred)) == list(range(10))
    assert ids(rows.get_lines(hundred, 95, 20)) == list(range(95, 100))
    assert ids(rows.page(hundred, 2, 10)) == list(range(20, 30))
    assert ids(rows.page(hundred, 50, 30)) == list(range(70, 100))
    assert ids(rows.tail(hundred, 3)) == [97, 98, 99]
    assert ids(rows.tail(hundred, 300)) == list(range(100))
    assert ids(rows.rows_around(hundred, 50, 10)) == list(range(44, 54))
    assert ids(rows.rows_around(hundred, 0, 4)) == [0, 1, 2, 3]
    assert ids(rows.rows_around(hundred, 999, 4)) == [97, 98, 99]
    assert len(ids(rows.preview(hundred, 20))) == 20
    assert rows.line_count(hundred).first().line_count == 100


def test_headers(hundred):
    assert rows.range_header(hundred, 90, 20).first().header == "Lines 91-100 of 100:"
    assert rows.range_header(hundred, 100, 20).first().header == (
        "No lines found at index 100 (dataset has 100 lines)"
    )
    assert rows.format_numbered(rows.get_line(hundred, 4)).first().text == "L5: line 4"


def test_search(hundred):
    assert ids(search.search(hundred, r"^line \d$").orderBy("row_id")) == list(range(10))
    assert ids(search.search(hundred, "line", limit=3)) == [0, 1, 2]
    assert ids(search.search(hundred, "line", limit=0)) == []
    with pytest.raises(Exception):
        search.search(hundred, "(").collect()


def test_unicode_classes(lines_of):
    lines = lines_of("é", "x\r", "٣")
    assert ids(search.search(lines, r"^\w$")) == [0, 2]
    assert ids(search.search(lines, r"\d")) == [2]


def test_context(hundred):
    found = search.search_with_context(hundred, "line (0|50|51)$", 1).orderBy("row_id").collect()
    assert [(r.row_id, r.context) for r in found] == [
        (0, ">>> L1: line 0\n    L2: line 1\n"),
        (50, "    L50: line 49\n>>> L51: line 50\n    L52: line 51\n"),
        (51, "    L51: line 50\n>>> L52: line 51\n    L53: line 52\n"),
    ]
    assert search.search_with_context(hundred, "line", 2, limit=None).count() == 100


def test_many_hits_give_the_same_context(hundred, monkeypatch):
    few = sorted(map(tuple, search.search_with_context(hundred, "[36]$", 2).collect()))
    monkeypatch.setattr(search, "MAX_BROADCAST_ROWS", 0)
    assert sorted(map(tuple, search.search_with_context(hundred, "[36]$", 2).collect())) == few


def test_nothing_is_cut_unless_asked(spark):
    lines = spark.range(3000).selectExpr("id as row_id", "concat('line ', id) as line")
    assert len(ids(rows.get_lines(lines, 100, 2000))) == 2000
    assert rows.range_header(lines, 100, 2000).first().header == "Lines 101-2100 of 3000:"
    assert search.search_with_context(lines, "line", 1).count() == 3000
    assert search.search_summary(lines, "line").first().matches == 3000
    limited = search.search_summary(lines, "line", limit=7).first()
    assert limited.summary == "Found the first 7 match(es) for `line` in 3000 lines"


def test_summary(hundred):
    row = search.search_summary(hundred, "line 1").first()
    assert row.summary == "Found 11 match(es) for `line 1` in 100 lines"
    assert search.search_summary(hundred, "zz").first().summary == "No matches found for pattern: `zz`"
