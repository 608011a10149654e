"""Files written from the tables grow in number, not in size."""

import pytest
from pyspark.sql import functions as F

from workloads import base


@pytest.fixture
def tables(spark, tmp_path):
    rows = spark.range(0, 120_000, 1, 3).select(
        F.col("id").alias("doc_id"),
        F.lit("a b").alias("text"),
        F.lit("en").alias("lang"),
        F.lit("web").alias("source"),
        F.lit(3).alias("n_chars"),
    )
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("kind", ["jsonl", "csv", "parquet", "dirty", "splits"])
def test_files_are_bounded(spark, tables, monkeypatch, kind):
    monkeypatch.setattr(base, "_WRITTEN", {})
    path = base.exported(spark, tables, kind)
    # The splits are the rows of one task in up to two files.
    tasks = F.regexp_extract(F.input_file_name(), r"part-(\d+)-", 1)
    if kind in ("parquet", "splits"):
        found = spark.read.parquet(path).groupBy(tasks).count()
    else:
        found = spark.read.text(path).groupBy(tasks).count()
    counts = [row["count"] for row in found.collect()]
    assert sum(counts) >= 120_000 and max(counts) < 1.25 * base.FILE_ROWS


def test_files_that_sql_counts_stay_four(spark, tables, monkeypatch):
    monkeypatch.setattr(base, "_WRITTEN", {})
    monkeypatch.setattr(base, "FILE_ROWS", 10_000)
    path = base.exported(spark, tables, "parquet_wide")
    assert len(spark.read.parquet(path).inputFiles()) == 4
