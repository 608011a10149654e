"""Every registered query against its SQL, on the smallest tables."""

import importlib.util
import os

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_spec = importlib.util.spec_from_file_location("spark_entry", f"{ROOT}/__spark_entry__.py")
ENTRY = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(ENTRY)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(value):
        return f"{value:.9g}" if isinstance(value, float) else str(value)

    return sorted(columns), sorted(tuple(text(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(ENTRY.queries()))
def test_query(spark, duck, name):
    frame = ENTRY.queries()[name](spark, SF_DIR)
    columns, rows = comparable(frame.columns, [tuple(r) for r in frame.collect()])
    sql = ENTRY.oracle_sql().get(name)
    if sql is None:
        return
    cursor = duck.execute(sql)
    assert (columns, rows) == comparable([c[0] for c in cursor.description], cursor.fetchall())


def test_entry(spark):
    assert {r.status for r in ENTRY.entry(spark).collect()} == {"ok", "error", "duplicate"}
