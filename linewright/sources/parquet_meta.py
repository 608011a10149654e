"""Parquet footers as tables, and reading single row groups, on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.sources.readers import row_to_json

ROW_GROUP_SCHEMA = (
    "path string, file_size bigint, row_group int, offset bigint, compressed_size bigint, "
    "num_rows bigint, columns array<string>"
)


def list_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path``, ``file_size`` of each file.  The content column is pruned, so nothing is read."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("file_size"))


def _open_file(path: str):
    """A seekable handle on any filesystem pyarrow knows."""
    from pyarrow import fs

    scheme = path.partition(":")[0]
    if scheme in ("file", ""):
        path = "file://" + path.removeprefix("file:").replace("//", "/")
    filesystem, inner = fs.FileSystem.from_uri(path)
    return filesystem.open_input_file(inner)


def _first_page(chunk) -> int:
    pages = [chunk.dictionary_page_offset, chunk.data_page_offset]
    return min(page for page in pages if page is not None)


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq

    schema = pa.schema(
        [
            ("path", pa.string()),
            ("file_size", pa.int64()),
            ("row_group", pa.int32()),
            ("offset", pa.int64()),
            ("compressed_size", pa.int64()),
            ("num_rows", pa.int64()),
            ("columns", pa.list_(pa.string())),
        ]
    )
    for batch in batches:
        for path, size in zip(batch["path"].to_pylist(), batch["file_size"].to_pylist()):
            with _open_file(path) as handle:
                footer = pq.read_metadata(handle)
            leaves = [
                footer.schema.column(i).path.rsplit(".", 1)[-1] for i in range(footer.num_columns)
            ]
            rows = []
            for index in range(footer.num_row_groups):
                group = footer.row_group(index)
                chunks = [group.column(i) for i in range(group.num_columns)]
                rows.append(
                    {
                        "path": path,
                        "file_size": size,
                        "row_group": index,
                        "offset": _first_page(chunks[0]) if chunks else 0,
                        "compressed_size": sum(c.total_compressed_size for c in chunks),
                        "num_rows": group.num_rows,
                        "columns": leaves,
                    }
                )
            if not rows:
                rows = [{"path": path, "file_size": size, "num_rows": 0, "columns": leaves}]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _footer_table(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return list_files(spark, paths).mapInArrow(_footers, ROW_GROUP_SCHEMA)


def parquet_row_groups(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per row group: index, offset of its first page, compressed size, rows.

    A file that is not Parquet fails the query.
    """
    return (
        _footer_table(spark, paths)
        .filter(F.col("row_group").isNotNull())
        .select("path", "row_group", "offset", "compressed_size", "num_rows")
    )


def parquet_file_meta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per file: size, number of row groups, rows, leaf column names."""
    return (
        _footer_table(spark, paths)
        .groupBy("path", "file_size", "columns")
        .agg(
            F.count("row_group").alias("num_row_groups"),
            F.sum("num_rows").alias("total_rows"),
        )
        .select("path", "file_size", "num_row_groups", "total_rows", "columns")
    )


def read_row_groups(spark: SparkSession, groups: DataFrame, like: str) -> DataFrame:
    """Lines of the listed row groups (``path``, ``row_group``); each is read on its own.

    Output: ``path``, ``row_group``, ``position``, ``line``.  ``like`` is a Parquet path
    with the same schema.  Groups spread over tasks; inside one, rows stream in batches.
    """
    shape = spark.read.parquet(like)
    names = shape.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape.schema)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            for path, group in zip(batch["path"].to_pylist(), batch["row_group"].to_pylist()):
                with _open_file(path) as handle:
                    source = pq.ParquetFile(handle)
                    if not 0 <= group < source.num_row_groups:
                        raise IndexError(f"row group {group} out of range in {path}")
                    seen = 0
                    for part in source.iter_batches(8192, row_groups=[group], columns=names):
                        count = part.num_rows
                        columns = [
                            pa.array([path] * count, pa.string()),
                            pa.array([group] * count, pa.int32()),
                            pa.array(range(seen, seen + count), pa.int64()),
                            *part.columns,
                        ]
                        seen += count
                        labels = ["path", "row_group", "position", *part.schema.names]
                        yield pa.RecordBatch.from_arrays(columns, labels)

    spread = groups.select("path", F.col("row_group").cast("int").alias("row_group")).repartition(
        "path", "row_group"
    )
    raw = spread.mapInArrow(rows_of, f"path string, row_group int, position bigint, {fields}")
    return raw.select("path", "row_group", "position", row_to_json(raw, names).alias("line"))


def read_row_group(spark: SparkSession, path: str, index: int) -> DataFrame:
    """Lines of one row group of one file."""
    groups = list_files(spark, path).select("path", F.lit(index).alias("row_group"))
    return read_row_groups(spark, groups, path)
