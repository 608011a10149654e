"""Records found split by split against the whole-file reader and against Python's parser."""

import csv
import io
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linewright.sources import csv_records as module
from linewright.sources.readers import read_csv_lines

VALUES = st.text(alphabet='ab,;"\n é', max_size=6)


def by_definition(text, sep):
    """The state at each line end, reading the whole text character by character."""
    quoted, begins, out, i = False, True, [], 0
    while i < len(text):
        c = text[i]
        if quoted:
            if c == '"':
                if text[i + 1 : i + 2] == '"':
                    i += 1
                else:
                    quoted = False
            begins = False
        elif c == '"' and begins:
            quoted, begins = True, False
        else:
            begins = c in (sep, "\n")
        if c == "\n":
            out.append(quoted)
        i += 1
    return [*out, quoted]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(VALUES, min_size=1, max_size=4), min_size=1, max_size=5))
def test_states_of_written_files(rows):
    buffer = io.StringIO()
    csv.writer(buffer, lineterminator="\n").writerows(rows)
    text = buffer.getvalue()
    state, states = False, []
    for line in text.split("\n"):
        state = module.quoted_after(line, state, ",")
        states.append(state)
    assert states == by_definition(text, ",") and not states[-1]


@pytest.mark.parametrize(
    "line, quoted, after",
    [
        ('a"b,c', False, False),
        ('a,"b', False, True),
        ('a,"b""', False, True),
        ('a,"b"""', False, False),
        ('end",x', True, False),
        ('end","x', True, True),
        ('""', True, True),
        ("", True, True),
        ('a""b', False, False),
    ],
)
def test_states_of_lines(line, quoted, after):
    assert module.quoted_after(line, quoted, ",") == after


@pytest.fixture
def big(tmp_path):
    """Two files whose records hold quotes, newlines and separators, over many splits."""
    folder = tmp_path / "big data"
    folder.mkdir()
    rows = []
    for name, count in (("b.csv", 900), ("a.csv", 1500), ("c.csv", 0)):
        with open(folder / name, "w", newline="") as file:
            writer = csv.writer(file, lineterminator="\n")
            writer.writerow(["id", "text", "more"])
            for i in range(count):
                text = [f"line {i}\nand \"more\", {i}", "plain", "", "\n\n", "x\n" * (i % 40), 'q"'][i % 6]
                row = [f"{name}{i}", text, "é,\n" if i % 7 == 0 else "end"]
                writer.writerow(row)
                rows.append((name, row))
    expected = [
        json.dumps(dict(zip(("id", "more", "text"), (r[0], r[2], r[1]))), ensure_ascii=False, separators=(",", ":"))
        for _, r in sorted(rows, key=lambda x: x[0])
    ]
    return str(folder), expected


def small_splits(spark, size):
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    session.conf.set("spark.sql.files.openCostInBytes", str(size))
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.mark.parametrize("size", [300, 5000])
def test_a_large_file_is_read_by_many_tasks(spark, big, size):
    folder, expected = big
    session = small_splits(spark, size)
    assert session.read.text(folder).rdd.getNumPartitions() > 10
    got = read_csv_lines(session, folder).orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(2400))
    assert [json.loads(r.line) for r in got] == [json.loads(line) for line in expected]
    whole = read_csv_lines(spark, folder, keep_source=True).orderBy("row_id").collect()
    split = read_csv_lines(session, folder, keep_source=True).orderBy("row_id").collect()
    assert [tuple(r) for r in split] == [tuple(r) for r in whole]


def test_records_longer_than_splits(spark, tmp_path):
    path = tmp_path / "long.csv"
    long = "\n".join(f"part {i}" for i in range(400))
    path.write_text(f'a,b\n1,"{long}"\n2,"x\r\ny"\r\n\n3,z', newline="")
    got = read_csv_lines(small_splits(spark, 200), str(path)).orderBy("row_id").collect()
    assert [json.loads(r.line) for r in got] == [
        {"a": "1", "b": long},
        {"a": "2", "b": "x\ny"},
        {"a": "3", "b": "z"},
    ]


def test_ragged_rows_fail(spark, tmp_path):
    path = tmp_path / "ragged.csv"
    path.write_text("a,b\n" + '1,"x\ny"\n' * 50 + "1,2,3\n")
    with pytest.raises(Exception):
        read_csv_lines(small_splits(spark, 64), str(path)).collect()


def test_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n" + '1,"p\nq"\n' * 30)
    (tmp_path / "b.csv").write_text("y,x\n" + '2,"r\ns"\n' * 30)
    got = [json.loads(r.line) for r in read_csv_lines(small_splits(spark, 64), str(tmp_path)).orderBy("row_id").collect()]
    assert got == [{"x": "1", "y": "p\nq"}] * 30 + [{"x": "r\ns", "y": "2"}] * 30
