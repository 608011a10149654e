"""Record lines as a stream of files, loaded unit by unit.

Lint, fix and token functions are per line and keep no state, so the same operators take
a streaming DataFrame.  Row ids must come with the data: numbering lines needs all of them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from linewright.plans.durable import fresh_path
from linewright.sources.formats import CSV, PARQUET, TSV, parse_format
from linewright.sources.readers import row_to_json

PROGRESS_SCHEMA = "batch bigint, rows bigint, duration_ms bigint"
_RECORD = f"query string, {PROGRESS_SCHEMA}"
# Seconds between looks at a query's recent units, of which Spark keeps a hundred by default.
LOOK_SECONDS = 0.5
# Units written as one file, unless the query ends first.
UNITS_A_FILE = 1_000
# Where the units of a query are recorded, by query id.
_RECORDED: dict[str, str] = {}


def stream_rows(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "auto", files: int = 1
) -> DataFrame:
    """Typed rows from a folder; each micro-batch takes ``files`` new files.

    A row that does not fit the schema stops the stream, as it does when read in batch.
    """
    chosen = parse_format(fmt, path)
    reader = spark.readStream.option("maxFilesPerTrigger", files).schema(schema)
    if chosen == PARQUET:
        return reader.parquet(path)
    if chosen in (CSV, TSV):
        sep = "\t" if chosen == TSV else ","
        return reader.csv(
            path, header=True, sep=sep, escape='"', multiLine=True, mode="FAILFAST", enforceSchema=False
        )
    return reader.json(path, mode="FAILFAST")


def stream_lines(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """``line`` and ``source_path`` from a folder of JSONL files."""
    raw = spark.readStream.option("maxFilesPerTrigger", files).option("lineSep", "\n").text(path)
    return raw.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("source_path"))


def stream_record_lines(
    spark: SparkSession, path: str, schema: StructType, row_id: str, files: int = 1
) -> DataFrame:
    """Streaming Parquet rows as ``row_id`` (a key column of the data) and JSON ``line``."""
    rows = stream_rows(spark, path, schema, PARQUET, files)
    return rows.select(F.col(row_id).cast("bigint").alias("row_id"), row_to_json(rows).alias("line"))


def load_available(stream: DataFrame, label: str = "stream") -> tuple[StreamingQuery, DataFrame]:
    """Run a stream over everything present and return the query and the table it wrote.

    Table and stream checkpoint live in the shared folder.  When a file fails, the query
    stops with its error and the table keeps the units before it.
    """
    spark = stream.sparkSession
    target = fresh_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{target}/data")
        .option("checkpointLocation", f"{target}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    follow_progress(query, f"{target}/progress")
    return query, spark.read.schema(stream.schema).parquet(f"{target}/data")


def loaded_units(query: StreamingQuery) -> int:
    """Micro-batches finished since the stream began, over restarts too."""
    last = query.lastProgress
    return last.batchId + 1 if last else 0


def _append(spark: SparkSession, path: str, rows: list[dict]) -> None:
    """One small JSON file more; it appears when it is whole."""
    jvm = spark.sparkContext._jvm
    to_path = jvm.org.apache.hadoop.fs.Path
    name = f"{rows[0]['query']}-{rows[0]['batch']:012d}-{uuid.uuid4().hex}"
    filesystem = to_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    hidden, shown = to_path(f"{path}/_{name}"), to_path(f"{path}/{name}.json")
    stream = filesystem.create(hidden, True)
    try:
        stream.write(bytearray("".join(json.dumps(row) + "\n" for row in rows).encode()))
    finally:
        stream.close()
    filesystem.rename(hidden, shown)


def follow_progress(
    query: StreamingQuery, path: str, seconds: float = LOOK_SECONDS, until_end: bool = True
) -> None:
    """Append the units of a running query to a table of records at ``path`` until it ends.

    No session setting is changed and the driver holds at most ``UNITS_A_FILE`` units.  A query
    that is started again from its checkpoint keeps its id, so its units go on in the same table.
    Called once with ``until_end`` off, it records what Spark still remembers and returns.  Raises
    the query's error, as ``awaitTermination`` does.
    """
    spark = SparkSession.active()
    query_id = str(query.id)
    _RECORDED[query_id] = path
    held: list[dict] = []
    last = -1

    def look() -> None:
        nonlocal last
        for unit in query.recentProgress:
            if unit.batchId > last:
                last = unit.batchId
                rows, duration = unit.numInputRows, int(unit.batchDuration)
                held.append({"query": query_id, "batch": last, "rows": rows, "duration_ms": duration})

    def flush(least: int) -> None:
        if len(held) >= least:
            _append(spark, path, held)
            held.clear()

    try:
        ended = not until_end
        while not ended:
            ended = query.awaitTermination(seconds)
            look()
            flush(UNITS_A_FILE)
    finally:
        look()
        flush(1)


def recorded_progress(spark: SparkSession, path: str, query_id: str | None = None) -> DataFrame:
    """``query, batch, rows, duration_ms`` of all units recorded at ``path``, each once."""
    units = spark.read.schema(_RECORD).json(path)
    units = units if query_id is None else units.filter(F.col("query") == query_id)
    return units.dropDuplicates(["query", "batch"])


def stream_progress(query: StreamingQuery) -> DataFrame:
    """The units so far: one row per micro-batch that brought rows.

    All of them for a query of ``load_available`` or ``follow_progress``, over restarts too; of
    others Spark keeps the last ``spark.sql.streaming.numRecentProgressUpdates``.
    """
    spark = SparkSession.active()
    path = _RECORDED.get(str(query.id))
    if path is not None:
        units = recorded_progress(spark, path, str(query.id))
        return units.filter(F.col("rows") > 0).drop("query")
    rows = [
        (p.batchId, p.numInputRows, int(p.batchDuration))
        for p in query.recentProgress
        if p.numInputRows
    ]
    return spark.createDataFrame(rows, PROGRESS_SCHEMA)


def is_complete(query: StreamingQuery) -> bool:
    return not query.isActive and query.exception() is None
