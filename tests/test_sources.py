import gzip
import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from linewright.operators import catalog
from linewright.sources import addresses, formats, parquet_meta, readers, rowid, writers


def listed(frame):
    return [(r.row_id, r.line) for r in frame.orderBy("row_id").collect()]


def test_line_rules(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_bytes(b"a\r\n\nb\xff\nb")
    lines = readers.read_jsonl(spark, str(path))
    raw = lines.select("row_id", F.col("line").cast("binary").alias("line"))
    assert [(i, bytes(b)) for i, b in listed(raw)] == [(0, b"a\r"), (1, b""), (2, b"b\xff"), (3, b"b")]
    bad = lines.filter(~F.is_valid_utf8("line")).select("row_id").collect()
    assert [r.row_id for r in bad] == [2]


def test_empty_file_and_trailing_newline(spark, tmp_path):
    (tmp_path / "empty.jsonl").write_bytes(b"")
    assert readers.read_jsonl(spark, str(tmp_path / "empty.jsonl")).count() == 0
    (tmp_path / "one.jsonl").write_bytes(b"x\n")
    assert listed(readers.read_jsonl(spark, str(tmp_path / "one.jsonl"))) == [(0, "x")]


def test_row_ids_over_files_and_splits(spark, tmp_path):
    """Files of different size, cut into many splits, number in path order."""
    expected = []
    for name, count in (("a", 700), ("b", 5), ("c", 3000)):
        rows = [f"{name}-{i}-" + "x" * (i % 50) for i in range(count)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(rows) + "\n")
        expected += rows
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        lines = readers.read_jsonl(spark, str(tmp_path), keep_source=True)
        splits = lines.rdd.getNumPartitions()
        rows = lines.orderBy("row_id").collect()
        picked = lines.filter(F.col("source_path").endswith("c.jsonl")).agg(F.min("row_id")).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert splits > 5
    assert [(r.row_id, r.line) for r in rows] == list(enumerate(expected))
    assert picked[0] == 705


def test_row_ids_without_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rowid, "MAX_BROADCAST_SPLITS", 0)
    (tmp_path / "a.jsonl").write_text("1\n2\n")
    (tmp_path / "b.jsonl").write_text("3\n")
    lines = readers.read_jsonl(spark, str(tmp_path))
    assert listed(lines) == [(0, "1"), (1, "2"), (2, "3")]


def test_csv(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text('prompt,response\nHello,World\n"say ""hi"", a\nb",\n')
    assert [json.loads(line) for _, line in listed(readers.read_dataset(spark, str(path)))] == [
        {"prompt": "Hello", "response": "World"},
        {"prompt": 'say "hi", a\nb', "response": ""},
    ]


def test_csv_keys_are_sorted_and_last_duplicate_wins(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("b,a,b\n1,2,3\n")
    assert listed(readers.read_csv_lines(spark, str(path))) == [(0, '{"a":"2","b":"3"}')]


def test_csv_headers_of_their_own(spark, tmp_path):
    (tmp_path / "0.csv").write_text("a,b,a\n1,2,3\n")
    (tmp_path / "1.csv").write_text("b,a,b\nB,A,B2\n")
    (tmp_path / "2.csv").write_text('"x\ny",z\n7,8\n')
    (tmp_path / "3.csv").write_text("")
    with gzip.open(tmp_path / "4 %.csv.gz", "wt") as out:
        out.write("a\n9\n")
    assert listed(readers.read_csv_lines(spark, str(tmp_path))) == [
        (0, '{"a":"3","b":"2"}'),
        (1, '{"a":"A","b":"B2"}'),
        (2, '{"x\\ny":"7","z":"8"}'),
        (3, '{"a":"9"}'),
    ]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "0.csv").write_text("")
    assert listed(readers.read_csv_lines(spark, str(tmp_path / "empty"))) == []


def test_csv_odd_names(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("x.y,`q`,X.Y\n1,2,3\n")
    assert listed(readers.read_csv_lines(spark, str(path))) == [
        (0, '{"X.Y":"3","`q`":"2","x.y":"1"}')
    ]


@pytest.mark.parametrize("body", ["a,b\n1\n", "a,b\n1,2,3\n"])
def test_ragged_csv_fails(spark, tmp_path, body):
    path = tmp_path / "d.csv"
    path.write_text(body)
    with pytest.raises(Exception):
        readers.read_csv_lines(spark, str(path)).collect()


def test_tsv(spark, tmp_path):
    path = tmp_path / "d.tsv"
    path.write_text("a\tb\n1,5\t2\n")
    assert listed(readers.read_dataset(spark, str(path))) == [(0, '{"a":"1,5","b":"2"}')]


def test_parquet_lines_leave_out_nulls(spark, tmp_path):
    for name, start in (("p-1", 0), ("p-0", 3)):
        frame = spark.range(start, start + 3).select(
            "id", F.when(F.col("id") % 2 == 0, "x").alias("t")
        )
        pq.write_table(pa.Table.from_pylist([r.asDict() for r in frame.collect()]), tmp_path / f"{name}.parquet")
    assert listed(readers.read_parquet_lines(spark, str(tmp_path))) == [
        (0, '{"id":3}'),
        (1, '{"id":4,"t":"x"}'),
        (2, '{"id":5}'),
        (3, '{"id":0,"t":"x"}'),
        (4, '{"id":1}'),
        (5, '{"id":2,"t":"x"}'),
    ]


def test_parquet_shards_with_other_columns(spark, tmp_path):
    pq.write_table(pa.table({"id": [0, 1]}), tmp_path / "0.parquet")
    pq.write_table(pa.table({"extra": ["x"], "id": [2]}), tmp_path / "1.parquet")
    lines = [json.loads(line) for _, line in listed(readers.read_parquet_lines(spark, str(tmp_path)))]
    assert lines == [{"id": 0}, {"id": 1}, {"id": 2, "extra": "x"}]


def test_nested_times_and_bytes(spark):
    frame = spark.sql(
        "select named_struct('t', timestamp_ntz'2024-01-02 03:04:05.123456', 'n', 1) s, "
        "array(X'00ff', null) a, map('k', timestamp_ntz'2024-01-02 03:04:05') m, "
        "cast(null as struct<b: binary>) z"
    )
    assert json.loads(frame.select(readers.row_to_json(frame)).first()[0]) == {
        "s": {"t": "2024-01-02T03:04:05.123456", "n": 1},
        "a": ["00ff", None],
        "m": {"k": "2024-01-02T03:04:05"},
    }


def test_parquet_times_and_bytes(spark):
    frame = spark.sql(
        "select timestamp_ntz'2024-01-02 03:04:05' a, timestamp_ntz'2024-01-02 03:04:05.25' b, "
        "timestamp_ntz'2024-01-02 03:04:05.000001' c, X'00ff' d, date'2024-01-02' e, "
        "timestamp'2024-01-02 03:04:05' f"
    )
    assert json.loads(frame.select(readers.row_to_json(frame)).first()[0]) == {
        "a": "2024-01-02T03:04:05",
        "b": "2024-01-02T03:04:05.250",
        "c": "2024-01-02T03:04:05.000001",
        "d": "00ff",
        "e": "2024-01-02",
        "f": "2024-01-02T03:04:05Z",
    }


@pytest.mark.parametrize(
    "path, fmt",
    [
        ("data.jsonl", "jsonl"),
        ("a/data.parquet", "parquet"),
        ("data.pq", "parquet"),
        ("data.csv", "csv"),
        ("data.tsv", "tsv"),
        ("data.txt", "jsonl"),
        ("data", "jsonl"),
        ("data.CSV", "jsonl"),
        ("dir.csv/data", "jsonl"),
        ("a/.csv", "jsonl"),
    ],
)
def test_detect_format(spark, path, fmt):
    assert formats.detect_format(path) == fmt
    frame = spark.createDataFrame([(path,)], "p string")
    assert frame.select(formats.detect_format_col(F.col("p"))).first()[0] == fmt


@pytest.mark.parametrize(
    "option, fmt",
    [("jsonl", "jsonl"), ("PARQUET", "parquet"), ("csv", "csv"), ("auto", "parquet"), ("unknown", "parquet"), (None, "parquet")],
)
def test_parse_format(spark, option, fmt):
    frame = spark.createDataFrame([(option, "x.pq")], "o string, p string")
    assert frame.select(formats.parse_format_col(F.col("o"), F.col("p"))).first()[0] == fmt
    assert formats.parse_format(option, "x.pq") == fmt


def test_addresses(spark):
    cases = {
        "hf://someorg/data": ("someorg", "data", "default", "train"),
        "hf://someorg/data/validation": ("someorg", "data", "default", "validation"),
        "hf://someorg/data/en/train": ("someorg", "data", "en", "train"),
        "hf://a/b/c/d/e": ("a", "b", "c", "d/e"),
        "not_hf://foo/bar": None,
        "hf://single": None,
    }
    frame = spark.createDataFrame([(a,) for a in cases], "a string")
    target = addresses.resolve_split_address(F.col("a")).alias("t")
    got = {r.a: r.t and tuple(r.t) for r in frame.select("a", target).collect()}
    assert got == cases


def test_split_files(spark):
    listing = spark.createDataFrame(
        [("en", "train", "p0"), ("en", "train", "p1"), ("en", "test", "p2"), ("fr", "train", "p3")],
        "config string, split string, path string",
    )

    def chosen(config, split):
        return sorted(r.path for r in addresses.select_split_files(listing, config, split).collect())

    assert chosen("en", "train") == ["p0", "p1"]
    assert chosen("default", "train") == ["p0", "p1", "p3"]
    assert chosen("de", "train") == chosen("en", "nosuch") == []
    first = addresses.select_split_files(listing, "de", "train", first_file=True)
    assert [r.path for r in first.collect()] == ["p0"]


def test_row_groups(spark, tmp_path):
    path = str(tmp_path / "g.parquet")
    pq.write_table(pa.table({"id": list(range(10)), "s": [{"x": i} for i in range(10)]}), path, row_group_size=4)
    groups = parquet_meta.parquet_row_groups(spark, path).orderBy("row_group").collect()
    assert [(g.row_group, g.num_rows) for g in groups] == [(0, 4), (1, 4), (2, 2)]
    assert groups[0].offset == 4 and groups[0].offset < groups[1].offset < groups[2].offset
    meta = parquet_meta.parquet_file_meta(spark, path).first()
    assert (meta.file_size, meta.num_row_groups, meta.total_rows) == (os.path.getsize(path), 3, 10)
    assert meta["columns"] == ["id", "x"]
    rows = parquet_meta.read_row_group(spark, path, 1).orderBy("position").collect()
    assert [r.line for r in rows] == [f'{{"id":{i},"s":{{"x":{i}}}}}' for i in range(4, 8)]
    with pytest.raises(Exception, match="out of range"):
        parquet_meta.read_row_group(spark, path, 3).collect()


def test_not_parquet(spark, tmp_path):
    path = tmp_path / "x.parquet"
    path.write_bytes(b"nothing to see here")
    with pytest.raises(Exception):
        parquet_meta.parquet_row_groups(spark, str(path)).collect()


@pytest.mark.parametrize(
    "path, out",
    [("d/a.jsonl", "d/a_fixed.jsonl"), ("a", "a_fixed"), ("d.x/a", "d.x/a_fixed"), ("a.b.csv", "a.b_fixed.csv"), ("d/.x", "d/.x_fixed")],
)
def test_fixed_output_path(spark, path, out):
    frame = spark.createDataFrame([(path,)], "p string")
    assert frame.select(writers.fixed_output_path_col(F.col("p"))).first()[0] == out
    assert writers.fixed_output_path(path) == out
    assert writers.fixed_output_path(path, "other") == "other"


def test_overwrite_in_place(spark, tmp_path):
    path = str(tmp_path / "data")
    spark.range(5).select(F.col("id").cast("string")).coalesce(1).write.text(path)
    lines = readers.read_jsonl(spark, path)
    writers.overwrite_in_place(lines.filter("row_id > 2"), path)
    assert listed(readers.read_jsonl(spark, path)) == [(0, "3"), (1, "4")]
    assert sorted(os.listdir(tmp_path)) == ["data"]


def test_write_lines_in_order(spark, tmp_path):
    lines = spark.range(1000).select(F.col("id").alias("row_id"), F.col("id").cast("string").alias("line"))
    writers.write_lines(lines.repartition(7), str(tmp_path / "out"))
    back = readers.read_jsonl(spark, str(tmp_path / "out"))
    assert back.filter(F.col("row_id") != F.col("line").cast("bigint")).count() == 0


@pytest.mark.parametrize("step", [1, 1000])
def test_row_order_of_dense_and_sparse_ids(spark, step, monkeypatch):
    monkeypatch.setattr(writers, "MOST_ROWS", 15)
    ids = spark.range(200).select((F.col("id") * step + 7).alias("row_id"), F.lit("x").alias("line"))
    ordered = writers.in_row_order(ids.repartition(5))
    rows = [r.row_id for r in ordered.collect()]
    assert rows == [i * step + 7 for i in range(200)]
    if step == 1:
        assert ordered.rdd.getNumPartitions() == 14
    assert writers.in_row_order(ids.filter("row_id < 0")).count() == 0


def test_dataset_info(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_bytes(b"x" * 2047 + b"\n")
    info = catalog.dataset_info(spark, str(path)).first()
    assert (info.format, info.line_count, info.size_bytes, info.size_human) == ("JSONL", 1, 2048, "2.00 KB")
    entry = catalog.dataset_catalog(spark, [str(path)]).first()
    assert entry.description == "JSONL file with 1 lines (2.00 KB)"
    assert catalog.info_text(catalog.dataset_info(spark, str(path))).first().text.endswith("Size: 2.00 KB (2048 bytes)")


def _stop_after(monkeypatch, moves):
    """A process that dies after so many renames."""
    done = []
    original = writers._Swap.move

    def move(self, source, target):
        if len(done) == moves:
            raise KeyboardInterrupt
        done.append(source)
        original(self, source, target)

    monkeypatch.setattr(writers._Swap, "move", move)


@pytest.mark.parametrize("moves", [0, 1])
def test_a_stopped_overwrite_is_finished(spark, tmp_path, monkeypatch, moves):
    path = str(tmp_path / "data")
    lines = spark.createDataFrame([(i, f"l{i}") for i in range(10)], "row_id long, line string")
    writers.write_lines(lines, path)
    with monkeypatch.context() as patch:
        _stop_after(patch, moves)
        with pytest.raises(KeyboardInterrupt):
            writers.overwrite_in_place(readers.read_jsonl(spark, path).filter("row_id > 2"), path)
    assert writers.finish_overwrite(spark, path)
    assert [r.line for r in readers.read_jsonl(spark, path).orderBy("row_id").collect()] == [f"l{i}" for i in range(3, 10)]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["data"]
    assert not writers.finish_overwrite(spark, path)


def test_the_next_overwrite_finds_complete_data(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "data")
    lines = spark.createDataFrame([(i, f"l{i}") for i in range(6)], "row_id long, line string")
    writers.write_lines(lines, path)
    with monkeypatch.context() as patch:
        _stop_after(patch, 1)
        with pytest.raises(KeyboardInterrupt):
            writers.overwrite_in_place(lines.filter("row_id > 3"), path)
    # No data is at the path now; the next call brings the new data there before it replaces it.
    writers.overwrite_in_place(lines.filter("row_id < 2"), path)
    assert [r.line for r in readers.read_jsonl(spark, path).orderBy("row_id").collect()] == ["l0", "l1"]


def test_an_incomplete_overwrite_is_not_taken_up(spark, tmp_path):
    path = str(tmp_path / "data")
    lines = spark.createDataFrame([(0, "old")], "row_id long, line string")
    writers.write_lines(lines, path)
    (tmp_path / "data.tmp").mkdir()
    (tmp_path / "data.tmp" / "part-0").write_text("half")
    assert not writers.finish_overwrite(spark, path)
    writers.overwrite_in_place(lines.selectExpr("row_id", "'new' AS line"), path)
    assert [r.line for r in readers.read_jsonl(spark, path).orderBy("row_id").collect()] == ["new"]


def test_a_catalog_of_many_datasets_is_one_plan(spark, tmp_path):
    made = []
    for i in range(40):
        folder = tmp_path / f"set {i}+{'x' * (i % 3)}"
        folder.mkdir()
        kind = ("jsonl", "csv", "tsv")[i % 3]
        for part in range(i % 4):
            rows = [f"{n}{',;'[i % 2]}v" for n in range(i + part)]
            (folder / f"{part}.{kind}").write_text("\n".join(["a,b", *rows]) + "\n")
        path = str(folder) if kind == "jsonl" else str(folder / f"0.{kind}")
        if kind == "jsonl" or i % 4:
            made.append(path)
    parquet = str(tmp_path / "p.parquet")
    spark.range(77).repartition(3).write.parquet(parquet)
    empty = str(tmp_path / "e.parquet")
    spark.range(0).write.parquet(empty)
    made += [parquet, empty, str(tmp_path / "set 0+"), parquet]
    together = catalog.dataset_infos(spark, made)
    alone = [catalog.dataset_info(spark, path).first() for path in made]
    assert [tuple(r) for r in together.collect()] == [tuple(r) for r in alone]
    # The plan is the same for many paths as for a few.
    few = catalog.dataset_infos(spark, [made[0], made[1], made[2], parquet])

    def scans(frame):
        return frame._jdf.queryExecution().optimizedPlan().toString().count("Relation [")

    assert scans(together) == scans(few)


def test_catalog_entries(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("{}\n{}\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.jsonl").write_text("{}\n")
    paths = [str(tmp_path / "a.jsonl"), str(tmp_path / "sub"), str(tmp_path / "*.jsonl")]
    got = [tuple(r) for r in catalog.dataset_catalog(spark, paths).collect()]
    texts = ["JSONL file with 2 lines (6 B)", "JSONL file with 1 lines (3 B)", "JSONL file with 2 lines (6 B)"]
    assert got == [
        (f"dataset/{path}", f"Dataset: {path}", text, "application/jsonl")
        for path, text in zip(paths, texts, strict=True)
    ]
