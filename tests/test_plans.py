"""Shapes of physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from linewright.functions import tokens as T
from linewright.operators import dedup, fix, lint, rows, search
from linewright.operators.annotate import annotate
from linewright.plans.bitmaps import with_flags
from linewright.sources import readers, writers
from linewright.sources.manifest import write_manifest
from linewright.sources.readers import read_jsonl
from workloads.counting import word_tokenizer

DOCS = "/root/testdata/sf0.001/documents.parquet"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def python_nodes(frame):
    return len(re.findall(r"ArrowEvalPython", plan(frame)))


@pytest.fixture
def texts(spark):
    return readers.lines_from_dataframe(spark.read.parquet(DOCS), "doc_id", "text")


def test_per_line_operators_do_not_shuffle(spark, texts):
    for frame in (
        lint.lint(texts, ["a"]),
        lint.failing_rows(texts, ["a"]),
        fix.skip_policy(fix.fix(texts), skip_invalid=True),
        dedup.fingerprints(texts),
        search.search(texts, "a"),
        texts.select(T.count_tokens(F.col("line"), word_tokenizer(spark))),
    ):
        assert "Exchange" not in plan(frame)


def test_python_runs_once_per_row(spark, texts):
    fixed = fix.fix(texts)
    issues = lint.lint(texts, ["a"])
    for frame in (
        issues,
        lint.lint_rule(texts, "think_tags"),
        lint.failing_rows(texts, ["a"]),
        lint.first_issue(issues),
        fix.fix_counts_by_type(fixed),
        fix.fix_summary(fixed),
        fix.skip_policy(fixed, skip_invalid=True),
        fix.rejected_lines(fixed),
    ):
        assert python_nodes(frame) == 1


def test_unused_python_is_pruned(texts):
    assert python_nodes(fix.fix(texts).agg(F.max("row_id"))) == 0
    assert python_nodes(dedup.fingerprints(texts).select("row_id")) == 0


def test_scans_read_only_what_is_needed(spark, texts):
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(dedup.fingerprints(texts))
    assert "ReadSchema: struct<>" in plan(rows.line_count(texts))


def test_row_ranges_reach_the_scan(texts):
    shown = plan(rows.get_lines(texts, 5, 10))
    assert "GreaterThanOrEqual(doc_id,5)" in shown and "LessThan(doc_id,15)" in shown
    assert "EqualTo(doc_id,7)" in plan(rows.get_line(texts, 7))


def test_flags_do_not_move_lines(spark, texts):
    issues = spark.range(3).select(F.col("id").alias("row_id"))
    flags = issues.withColumn("is_duplicate", F.lit(True))
    for frame in (annotate(texts, issues, flags), lint.rows_with_issues(texts, issues)):
        lines_side = plan(frame).split("BroadcastHashJoin", 1)[1].split("BroadcastExchange", 1)[0]
        assert "Exchange" not in lines_side


def test_limits_are_top_k(texts):
    assert "TakeOrderedAndProject" in plan(search.search(texts, "a", limit=5))
    assert "TakeOrderedAndProject" in plan(rows.preview(texts))


def test_row_ids_do_not_shuffle_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("x\ny\n")
    shown = plan(readers.read_jsonl(spark, str(tmp_path)))
    assert "BroadcastHashJoin" in shown and "SortMergeJoin" not in shown
    lines_side = shown.split("BroadcastHashJoin", 1)[1].split("BroadcastExchange", 1)[0]
    assert "Exchange" not in lines_side


@pytest.mark.parametrize("buckets", [1, 2, 5])
def test_flags_beyond_the_limit_move_no_lines(spark, buckets):
    lines = spark.range(0, 200_000, 1, 4).selectExpr("id AS row_id", "concat('line ', id) AS line")
    marks = lines.filter("row_id % 7 = 0 OR row_id > 190000").selectExpr(
        "row_id", "row_id % 7 = 0 AS a", "row_id > 190000 AS b"
    )
    marked = with_flags(lines, marks, ["a", "b"], bitmap_buckets=buckets)
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Exchange hashpartitioning" not in plan
    wrong = marked.filter("a <> (row_id % 7 = 0) OR b <> (row_id > 190000)")
    assert wrong.count() == 0 and marked.count() == 200_000


def test_lines_in_row_order_are_written_where_they_are(spark, tmp_path, monkeypatch):
    source = str(tmp_path / "in")
    spark.range(0, 5000, 1, 6).selectExpr("concat('line ', id) AS value").write.text(source)
    rows = write_manifest(spark, source, str(tmp_path / "manifest"))
    lines = rows.lines()

    def never(*_):
        raise AssertionError("shuffled")

    monkeypatch.setattr(writers, "in_row_order", never)
    writers.write_lines(lines, str(tmp_path / "out"))
    back = read_jsonl(spark, str(tmp_path / "out"))
    assert back.count() == 5000
    assert back.filter(F.col("line") != F.concat(F.lit("line "), F.col("row_id"))).count() == 0
    # Rows left out do not change what is a run.
    some = lines.filter("row_id % 3 = 0")
    writers.write_lines(some, str(tmp_path / "out"), mode="overwrite", ids=lines)
    back = read_jsonl(spark, str(tmp_path / "out"))
    assert [r.line for r in back.orderBy("row_id").collect()] == [f"line {i}" for i in range(0, 5000, 3)]
    with pytest.raises(FileExistsError):
        writers.write_lines(some, str(tmp_path / "out"), ids=lines)
    plan = some.select("line")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan


def test_lines_out_of_order_are_dealt_into_ranges(spark, tmp_path):
    lines = spark.range(0, 1000, 1, 4).selectExpr("(id * 37) % 1000 AS row_id", "'x' AS line")
    assert writers._runs(lines, lines) is None
    shuffled = spark.range(0, 1000, 1, 4).selectExpr("id AS row_id", "string(id) AS line").repartition(5)
    assert writers._runs(shuffled, shuffled) is None
    writers.write_lines(shuffled, str(tmp_path / "out"))
    back = read_jsonl(spark, str(tmp_path / "out"))
    assert back.filter(F.col("line") != F.col("row_id").cast("string")).count() == 0
