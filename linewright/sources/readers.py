"""Readers that turn any supported file into record lines: ``row_id``, ``line``."""

from __future__ import annotations

import csv
import logging
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright.functions.text import is_blank
from linewright.sources.csv_records import csv_records
from linewright.sources.formats import CSV, PARQUET, TSV, parse_format
from linewright.sources.rowid import (
    POSITION,
    numbered_rows,
    parquet_row_id,
    scan_position,
    with_row_id,
)

log = logging.getLogger(__name__)

Paths = str | Sequence[str]


def _as_list(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def scan_jsonl(spark: SparkSession, paths: Paths) -> DataFrame:
    """Lines without row ids.  Only ``\\n`` ends a line; ``\\r`` stays; blank lines stay."""
    return spark.read.option("lineSep", "\n").text(_as_list(paths)).withColumnRenamed(
        "value", "line"
    )


def read_jsonl(spark: SparkSession, paths: Paths, keep_source: bool = False) -> DataFrame:
    return with_row_id(scan_jsonl(spark, paths), keep_source)


def read_nonblank_lines(spark: SparkSession, paths: Paths) -> DataFrame:
    """JSONL without blank lines; ids count the remaining lines."""
    scan = scan_jsonl(spark, paths)
    return with_row_id(scan.filter(~is_blank(F.col("line"))))


def named(name: str) -> Column:
    """The top-level column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def _timestamp_text(column: Column, zoned: bool) -> Column:
    micros = F.date_format(column, "SSSSSS")
    fraction = (
        F.when(micros == "000000", "")
        .when(F.substring(micros, 4, 3) == "000", F.concat(F.lit("."), F.left(micros, F.lit(3))))
        .otherwise(F.concat(F.lit("."), micros))
    )
    zone = F.lit("Z") if zoned else F.lit("")
    return F.concat(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss"), fraction, zone)


def _is_plain(kind: T.DataType) -> bool:
    """Whether ``to_json`` already writes the type, and all it holds, as it should be."""
    if isinstance(kind, T.StructType):
        return all(_is_plain(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _is_plain(kind.elementType)
    if isinstance(kind, T.MapType):
        return _is_plain(kind.keyType) and _is_plain(kind.valueType)
    return not isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.BinaryType))


def _json_form(column: Column, kind: T.DataType) -> Column:
    """A value in the form its JSON text should take, at any depth.

    Timestamps keep their microseconds, and binary values are hexadecimal.
    """
    if _is_plain(kind):
        return column
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return _timestamp_text(column, isinstance(kind, T.TimestampType))
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(column))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _json_form(x, kind.elementType))
    if isinstance(kind, T.MapType):
        keyed = F.transform_keys(column, lambda k, v: _json_form(k, kind.keyType))
        return F.transform_values(keyed, lambda k, v: _json_form(v, kind.valueType))
    fields = [_json_form(column.getField(f.name), f.dataType).alias(f.name) for f in kind]
    return F.when(column.isNotNull(), F.struct(*fields))


def row_to_json(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """One JSON object per row, columns in order, NULLs left out."""
    wanted = list(columns) if columns is not None else df.columns
    fields = [_json_form(named(n), df.schema[n].dataType).alias(n) for n in wanted]
    return F.to_json(F.struct(*fields))


def read_parquet_lines(
    spark: SparkSession, paths: Paths, keep_source: bool = False
) -> DataFrame:
    """Rows as JSON lines; files may differ in columns, and no column of any of them is lost."""
    frame = spark.read.option("mergeSchema", "true").parquet(*_as_list(paths))
    lines = parquet_row_id(frame, keep_source)
    source = ["source_path"] if keep_source else []
    return lines.select("row_id", row_to_json(frame).alias("line"), *source)


def _first_record(spark: SparkSession, path: str, sep: str) -> tuple[str, ...] | None:
    """The header of one file: its first lines are read, through Spark's own filesystems."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(conf).open(place)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)
        source = codec.createInputStream(stream) if codec else stream
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(source, "UTF-8"))
        text = lines.readLine()
        while text is not None and text.count('"') % 2:
            more = lines.readLine()
            if more is None:
                break
            text += "\n" + more
    finally:
        stream.close()
    return None if text is None else tuple(next(csv.reader([text.lstrip("\ufeff")], delimiter=sep), ()))


def _by_header(spark: SparkSession, paths: list[str], sep: str) -> dict[tuple[str, ...], list[str]]:
    """Files by their header.  The driver lists the files of a scan anyway."""
    files = sorted(spark.read.text(paths).inputFiles())
    with ThreadPoolExecutor(16) as pool:
        headers = list(pool.map(lambda file: _first_record(spark, unquote(file), sep), files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for header, file in zip(headers, files):
        if header is not None:
            groups.setdefault(header, []).append(file)
    return groups


def read_csv_lines(
    spark: SparkSession,
    paths: Paths,
    sep: str = ",",
    keep_source: bool = False,
    multiline: bool = True,
    split_bytes: int | None = None,
) -> DataFrame:
    """Delimited text with a header row per file; every value is a string, keys are sorted.

    Files may have different headers; each is read by its own.  A repeated name keeps its last
    column.  A ragged row fails the query.  With ``multiline``, quoted newlines belong to their
    value: files of up to ``split_bytes`` (``spark.sql.files.maxPartitionBytes``) are one task
    each, and if any is larger the records are found split by split.
    """
    if multiline and _largest_file(spark, paths) > _split_bytes(spark, split_bytes):
        return _split_csv_lines(spark, paths, sep, keep_source)
    scan = scan_csv_lines(spark, paths, sep, multiline)
    if scan is None:
        empty = "row_id bigint, line string" + (", source_path string" if keep_source else "")
        return spark.createDataFrame([], empty)
    return numbered_rows(scan, ["line"], keep_source)


def plain_path(path: Column) -> Column:
    """A file's path without escapes; listings and scans spell local files differently."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "file:/")


def _split_bytes(spark: SparkSession, split_bytes: int | None) -> int:
    if split_bytes is not None:
        return split_bytes
    setting = spark.conf.get("spark.sql.files.maxPartitionBytes")
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(setting))


def _largest_file(spark: SparkSession, paths: Paths) -> int:
    files = spark.read.format("binaryFile").load(_as_list(paths))
    return files.agg(F.max("length")).first()[0] or 0


def _split_csv_lines(spark: SparkSession, paths: Paths, sep: str, keep_source: bool) -> DataFrame:
    """Record lines of large files; their records are found split by split, and then parsed."""
    groups = _by_header(spark, _as_list(paths), sep)
    records = csv_records(spark, _as_list(paths), sep)
    rows = records.groupBy("file").agg(F.max("file_records").alias("records"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    # A row per file, as in the driver's own listing; the first record of a file is its header.
    base = F.coalesce(F.sum(F.col("records") - 1).over(earlier), F.lit(0)).alias("base")
    placed = records.filter("record > 0").join(F.broadcast(rows.select("file", base)), "file")
    heads = [(file, number) for number, files in enumerate(groups.values()) for file in files]
    known = spark.createDataFrame(heads, "path string, head int")
    known = known.select(plain_path(F.col("path")).alias("plain"), "head")
    plain = plain_path(F.col("file"))
    placed = placed.withColumn("plain", plain).join(F.broadcast(known), "plain")
    parts = []
    for number, header in enumerate(groups):
        schema = ", ".join(f"_c{i} string" for i in range(len(header)))
        options = {"sep": sep, "escape": '"', "mode": "FAILFAST"}
        values = F.from_csv("text", schema, options)
        last = {name: f"_c{i}" for i, name in enumerate(header)}
        own = placed.filter(F.col("head") == number).withColumn("values", values)
        fields = [F.coalesce(F.col("values")[last[n]], F.lit("")).alias(n) for n in sorted(last)]
        source = [F.col("file").alias("source_path")] if keep_source else []
        row_id = (F.col("base") + F.col("record") - 1).alias("row_id")
        parts.append(own.select(row_id, F.to_json(F.struct(*fields)).alias("line"), *source))
    return reduce(DataFrame.unionByName, parts)


def scan_csv_lines(
    spark: SparkSession,
    paths: Paths,
    sep: str = ",",
    multiline: bool = True,
    extra: Sequence[Column] = (),
) -> DataFrame | None:
    """``line`` with the columns that place a row in its scan; None if no file has a header.

    ``extra`` are more columns of the scan's metadata.
    """
    groups = _by_header(spark, _as_list(paths), sep)
    options = {"sep": sep, "escape": '"', "multiLine": multiline, "header": True}
    scans = []
    for header, files in groups.items():
        # Columns by place: the header of these files is known, so it is only skipped.
        columns = [f"_c{i}" for i in range(len(header))]
        schema = T.StructType([T.StructField(name, T.StringType()) for name in columns])
        reader = spark.read.options(mode="FAILFAST", enforceSchema=True, **options)
        last = dict(zip(header, columns))
        pairs = [F.coalesce(named(last[n]), F.lit("")).alias(n) for n in sorted(last)]
        frame = scan_position(reader.schema(schema).csv([unquote(f) for f in files]))
        scans.append(frame.select(F.to_json(F.struct(*pairs)).alias("line"), *POSITION, *extra))
    return reduce(DataFrame.unionByName, scans) if scans else None


def read_tsv_lines(spark: SparkSession, paths: Paths, **options) -> DataFrame:
    return read_csv_lines(spark, paths, sep="\t", **options)


def read_dataset(spark: SparkSession, path: str, fmt: str = "auto", **options) -> DataFrame:
    """Read record lines from ``path`` in the given or detected format."""
    chosen = parse_format(fmt, path)
    if chosen == PARQUET:
        return read_parquet_lines(spark, path, **options)
    if chosen == CSV:
        return read_csv_lines(spark, path, **options)
    if chosen == TSV:
        return read_tsv_lines(spark, path, **options)
    return read_jsonl(spark, path, **options)


def lines_from_dataframe(
    df: DataFrame,
    row_id: str,
    text_col: str | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Rows in hand as record lines: a text column as it is, or a JSON object per row.

    ``row_id`` names any unique BIGINT column that orders the rows.
    """
    line = F.col(text_col) if text_col else row_to_json(df, columns)
    return df.select(F.col(row_id).cast("bigint").alias("row_id"), line.alias("line"))
