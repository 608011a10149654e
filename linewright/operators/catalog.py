"""Dataset facts: format, line count, size; and a catalog over many datasets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.functions.text import size_human
from linewright.sources.formats import CSV, FORMAT_NAMES, PARQUET, TSV, parse_format
from linewright.sources.parquet_meta import list_files
from linewright.sources.readers import scan_jsonl

# Fixed value: the type every dataset is served as.
MIME_TYPE = "application/jsonl"


def _rows(spark: SparkSession, paths: str | list[str], fmt: str) -> DataFrame:
    """A scan with as many rows as the datasets have lines; counting it reads no columns."""
    if fmt == PARQUET:
        if isinstance(paths, str):
            return spark.read.parquet(paths)
        # Datasets share no columns; rows are counted from the footers.
        return spark.read.schema("_none string").parquet(*paths)
    if fmt in (CSV, TSV):
        sep = "\t" if fmt == TSV else ","
        reader = spark.read if isinstance(paths, str) else spark.read.schema("_none string")
        return reader.csv(paths, header=True, sep=sep, escape='"', multiLine=True)
    return scan_jsonl(spark, paths)


def dataset_info(spark: SparkSession, path: str, fmt: str = "auto") -> DataFrame:
    """One row: ``path``, ``format``, ``line_count``, ``size_bytes``, ``size_human``.

    Sizes come from the file listing, rows from a count that Parquet answers from footers.
    """
    chosen = parse_format(fmt, path)
    count = _rows(spark, path, chosen).agg(F.count(F.lit(1))).scalar()
    size = list_files(spark, path).agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("size_bytes"))
    return size.select(
        F.lit(path).alias("path"),
        F.lit(FORMAT_NAMES[chosen]).alias("format"),
        count.alias("line_count"),
        "size_bytes",
        size_human(F.col("size_bytes")).alias("size_human"),
    )


def info_text(info: DataFrame) -> DataFrame:
    return info.select(
        F.format_string(
            "Dataset: %s\nFormat: %s\nLines: %d\nSize: %s (%d bytes)",
            "path",
            "format",
            "line_count",
            "size_human",
            "size_bytes",
        ).alias("text")
    )


def _qualified(spark: SparkSession, path: str) -> str:
    """The path as file listings spell it: with its filesystem."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    filesystem = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return filesystem.makeQualified(place).toString()


def _by_root(files: DataFrame, file: Column, roots: DataFrame) -> DataFrame:
    """Rows of a table with one row per file, once for each root above the file."""
    parts = F.split(file, "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )
    placed = files.withColumn("root", F.explode(above))
    return placed.join(F.broadcast(roots.select("root").distinct()), "root")


def dataset_infos(spark: SparkSession, paths: Sequence[str], fmt: str = "auto") -> DataFrame:
    """The rows of ``dataset_info`` for many plain paths, with one scan per format.

    The plan does not grow with the number of paths.  Files are listed once, rows are counted per
    file, and both are added up per path above them.
    """
    known = [(path, _qualified(spark, path), parse_format(fmt, path)) for path in paths]
    # The driver has the list of paths anyway.
    roots = spark.createDataFrame(
        [(i, path, root, FORMAT_NAMES[kind]) for i, (path, root, kind) in enumerate(known)],
        "place int, path string, root string, format string",
    )
    counts = []
    for kind in sorted({kind for _, _, kind in known}):
        own = sorted({path for path, _, k in known if k == kind})
        # A path below another one is read with it.
        scan = _rows(spark, _outermost(spark, own), kind)
        per_file = scan.groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.count(F.lit(1)).alias("rows")
        )
        plain = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
        named = roots.filter(F.col("format") == FORMAT_NAMES[kind])
        found = _by_root(per_file, plain, named).groupBy("root").agg(F.sum("rows").alias("rows"))
        counts.append(found.withColumn("format", F.lit(FORMAT_NAMES[kind])))
    rows = reduce(DataFrame.unionByName, counts)
    files = list_files(spark, _outermost(spark, [path for path, _, _ in known]))
    sizes = _by_root(files, F.col("path"), roots).groupBy("root").agg(
        F.sum("file_size").alias("size_bytes")
    )
    zero = F.lit(0).cast("long")
    return (
        roots.join(rows, ["root", "format"], "left")
        .join(sizes, "root", "left")
        .orderBy("place")
        .select(
            "path",
            "format",
            F.coalesce("rows", zero).alias("line_count"),
            F.coalesce("size_bytes", zero).alias("size_bytes"),
        )
        .withColumn("size_human", size_human(F.col("size_bytes")))
    )


def _outermost(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The paths that lie below none of the others."""
    by_root = {_qualified(spark, path).rstrip("/") + "/": path for path in paths}
    kept: list[str] = []
    last = None
    for root in sorted(by_root):
        if last is None or not root.startswith(last):
            kept.append(by_root[root])
            last = root
    return kept


def dataset_catalog(spark: SparkSession, paths: Sequence[str], fmt: str = "auto") -> DataFrame:
    """One entry per dataset: ``uri``, ``name``, ``description``, ``mime_type``.

    Plain paths share their scans; paths with wildcards are looked at one by one.
    """
    wild = [path for path in paths if set(path) & set("*?[{")]
    plain = [path for path in paths if path not in wild]
    parts = [dataset_infos(spark, plain, fmt)] if plain else []
    infos = reduce(DataFrame.unionByName, parts + [dataset_info(spark, p, fmt) for p in wild])
    return infos.select(
        F.concat(F.lit("dataset/"), F.col("path")).alias("uri"),
        F.concat(F.lit("Dataset: "), F.col("path")).alias("name"),
        F.format_string(
            "%s file with %d lines (%s)", "format", "line_count", "size_human"
        ).alias("description"),
        F.lit(MIME_TYPE).alias("mime_type"),
    )
