import os
import subprocess
import sys

from pyspark.sql import functions as F

from linewright.plans import durable


def test_written_counts_and_survives(spark):
    frame = spark.range(100).select("id", (F.col("id") % 3 == 0).alias("third"))
    table, rows = durable.written(frame, "t", narrow=True)
    assert rows == 100 and table.count() == 100
    _, thirds = durable.written(frame, "t", F.col("third"))
    assert thirds == 34
    assert table.inputFiles()[0].startswith(f"file://{durable.shared_folder(spark)}/linewright/")


def test_empty_tables(spark):
    table, rows = durable.written(spark.range(10).filter("id > 99"), "empty")
    assert rows == 0 and table.collect() == []


def test_release_deletes_only_own_tables(spark, tmp_path, monkeypatch):
    other = tmp_path / "linewright" / "another-app"
    other.mkdir(parents=True)
    monkeypatch.setattr(durable, "shared_folder", lambda _: str(tmp_path))
    durable.written(spark.range(3), "t")
    own = tmp_path / "linewright" / spark.sparkContext.applicationId
    assert os.listdir(own)
    durable.release(spark)
    assert not own.exists() and other.exists()


def test_a_plain_local_session_needs_no_settings(tmp_path):
    """With an empty configuration folder: dedup, an export and a stream."""
    program = """
import sys
from pyspark.sql import SparkSession
from linewright.operators.dedup import dedup
from linewright.sources.readers import read_jsonl
from linewright.sources.writers import export_unique
from linewright.streaming.lines import load_available, stream_lines
spark = SparkSession.builder.master("local[2]").getOrCreate()
folder = sys.argv[1]
lines = read_jsonl(spark, folder + "/in")
export_unique(lines, dedup(lines, "exact"), folder + "/out")
print("kept", spark.read.text(folder + "/out").count())
print("streamed", load_available(stream_lines(spark, folder + "/in"))[1].count())
"""
    (tmp_path / "in").mkdir()
    (tmp_path / "conf").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"a":1}\n{"a":2}\n{"a":1}\n')
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": root}
    done = subprocess.run(
        [sys.executable, "-c", program, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True
    )
    assert "kept 2" in done.stdout and "streamed 3" in done.stdout, done.stderr[-2000:]
