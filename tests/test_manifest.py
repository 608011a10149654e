"""Row ranges by a written manifest: same rows as the readers, files pruned, nothing counted."""

import os

import pytest
from pyspark.sql import functions as F

from linewright.operators import rows
from linewright.sources.manifest import RowManifest, write_manifest
from linewright.sources.readers import read_dataset


def collected(frame):
    return [tuple(r) for r in frame.orderBy("row_id").collect()]


@pytest.fixture
def jsonl(tmp_path):
    folder = tmp_path / "a b"
    folder.mkdir()
    number = 0
    for name, count in (("c.jsonl", 7), ("a.jsonl", 900), ("b.jsonl", 0), ("d.jsonl", 25)):
        with open(folder / name, "w") as file:
            for _ in range(count):
                file.write(f'{{"n": {number}, "t": "{"x" * (number % 40)}"}}\n' if number % 9 else "\n")
                number += 1
    return str(folder)


@pytest.fixture
def manifest(spark, jsonl, tmp_path):
    # Splits of 1,000 bytes: a.jsonl has many.
    return write_manifest(spark, jsonl, str(tmp_path / "manifest"), split_bytes=1000)


def scanned_files(frame):
    return sorted({os.path.basename(f) for f in frame.inputFiles() if "manifest" not in f})


def test_all_rows_as_the_reader_gives_them(spark, jsonl, manifest):
    assert manifest.entries().filter("file LIKE '%a.jsonl'").count() > 10
    expected = collected(read_dataset(spark, jsonl))
    assert collected(manifest.lines()) == expected and len(expected) == 932
    assert manifest.total() == 932
    again = RowManifest(spark, manifest.table_path)
    assert collected(again.lines()) == expected


@pytest.mark.parametrize(
    "first, count", [(0, 1), (899, 3), (906, 2), (0, 932), (931, 10), (932, 5), (500, 0), (5000, 1)]
)
def test_ranges(spark, jsonl, manifest, first, count):
    expected = collected(rows.get_lines(read_dataset(spark, jsonl), first, count))
    assert [tuple(r) for r in manifest.get_lines(first, count).collect()] == expected


def test_a_range_reads_its_files_only(manifest):
    assert scanned_files(manifest.get_line(42)) == ["a.jsonl"]
    assert scanned_files(manifest.get_lines(899, 3)) == ["a.jsonl", "c.jsonl"]
    assert scanned_files(manifest.tail(10)) == ["d.jsonl"]
    assert scanned_files(manifest.page(1, 900)) == ["a.jsonl", "c.jsonl", "d.jsonl"]
    assert manifest.files(10_000, 5) == []


def test_later_actions_count_nothing(manifest):
    plan = manifest.get_lines(100, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan and "SortMergeJoin" not in plan
    plan = manifest.lines()._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan and "SortMergeJoin" not in plan


def test_row_operators(spark, jsonl, manifest):
    lines = read_dataset(spark, jsonl)
    for got, expected in (
        (manifest.get_line(901), rows.get_line(lines, 901)),
        (manifest.preview(12), rows.preview(lines, 12)),
        (manifest.rows_around(3, 20), rows.rows_around(lines, 3, 20)),
        (manifest.rows_around(5000, 20), rows.rows_around(lines, 5000, 20)),
        (manifest.page(3, 25), rows.page(lines, 3, 25)),
        (manifest.page(99, 25), rows.page(lines, 99, 25)),
        (manifest.tail(30), rows.tail(lines, 30)),
        (manifest.tail(3000), rows.tail(lines, 3000)),
    ):
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in expected.collect()]
    assert manifest.line_count().first()["line_count"] == rows.line_count(lines).first()["line_count"]


def test_settings_and_frames_of_the_caller(spark, manifest):
    before = dict(spark.conf.getAll)
    lines = manifest.get_lines(0, 5)
    assert lines.sparkSession is spark
    joined = spark.range(3).join(lines, F.col("id") == F.col("row_id"))
    assert joined.count() == 3 and dict(spark.conf.getAll) == before


@pytest.mark.parametrize("fmt", ["csv", "tsv", "parquet"])
@pytest.mark.parametrize("multiline", [True, False])
def test_other_formats(spark, tmp_path, fmt, multiline):
    folder = str(tmp_path / f"data.{fmt}")
    frame = spark.range(300).selectExpr("id", "concat('v ', id) AS v", "IF(id % 7 = 0, NULL, 'w') AS w")
    writer = frame.repartitionByRange(3, "id").sortWithinPartitions("id").write
    if fmt == "parquet":
        writer.option("parquet.block.size", 512).parquet(folder)
    else:
        writer.csv(folder, header=True, sep="\t" if fmt == "tsv" else ",", escape='"')
    options = {} if fmt == "parquet" else {"multiline": multiline}
    expected = collected(read_dataset(spark, folder, fmt, **options))
    manifest = write_manifest(spark, folder, str(tmp_path / "m"), fmt, multiline, split_bytes=700)
    assert collected(manifest.lines()) == expected and len(expected) == 300
    assert [tuple(r) for r in manifest.get_lines(95, 12).collect()] == expected[95:107]
    assert len(manifest.files(0, 5)) == 1


def test_changed_files_fail(spark, jsonl, manifest):
    with open(f"{jsonl}/d.jsonl", "a") as file:
        file.write("more\n")
    with pytest.raises(Exception, match="changed since the manifest"):
        manifest.tail(3).collect()
    with pytest.raises(Exception, match="changed since the manifest"):
        manifest.lines().collect()
    assert manifest.get_line(3).count() == 1


def test_new_files_fail(spark, jsonl, manifest):
    with open(f"{jsonl}/e.jsonl", "w") as file:
        file.write("new\n")
    with pytest.raises(Exception, match="changed since the manifest"):
        manifest.lines().collect()


def test_empty_dataset(spark, tmp_path):
    folder = tmp_path / "none.jsonl"
    folder.mkdir()
    (folder / "a.jsonl").write_text("")
    manifest = write_manifest(spark, str(folder), str(tmp_path / "m"))
    assert manifest.total() == 0 and manifest.lines().collect() == []
    assert manifest.tail(5).collect() == [] and manifest.rows_around(1, 5).collect() == []
