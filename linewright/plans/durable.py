"""Written intermediate tables.

Iterative plans cut their lineage by writing a Parquet table to the shared folder the
cluster names in ``spark.checkpoint.dir`` and reading it back.  The files survive the
loss of executors, and their true size lets Catalyst and AQE choose broadcast joins by
measurement instead of by guess.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

WORK_KEY = "spark.linewright.workDir"
CHECKPOINT_KEY = "spark.checkpoint.dir"
# Temporary folders of applications in local mode that name none, by application.
_LOCAL: dict[str, str] = {}


def _is_local(master: str) -> bool:
    return master.startswith("local") and not master.startswith("local-cluster")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables.

    ``spark.linewright.workDir`` if it is set, else the cluster's ``spark.checkpoint.dir``;
    in local mode, where one machine does all the work, a temporary one without either.
    """
    context = spark.sparkContext
    folder = (
        spark.conf.get(WORK_KEY, None)
        or spark.conf.get(CHECKPOINT_KEY, None)
        or context.getCheckpointDir()
    )
    if folder:
        return folder.rstrip("/")
    if not _is_local(context.master):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="linewright-")
    return _LOCAL[context.applicationId]


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/linewright/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete one intermediate table that no later step reads."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    filesystem = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    filesystem.delete(folder, True)


def release(spark: SparkSession) -> None:
    """Delete every intermediate table of this application, once results are saved."""
    discard(spark, _own_folder(spark))


def drop_shuffles(spark: SparkSession) -> None:
    """Have Spark remove the shuffles of tables that are written.

    It removes them once the driver has collected the plans they belong to, which on a large heap
    may be long after.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(
    df: DataFrame, label: str, counted: Column | None = None, narrow: bool = False
) -> tuple[DataFrame, int]:
    """Write ``df`` once and return the table read back, with its row count.

    With ``counted``, only rows where it holds are counted.  The count is observed during
    the write, so it costs no extra job.  ``narrow`` is for few columns taken from a wide
    scan: its many partitions would each write a tiny file, so they are merged first.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    seen = Observation()
    rows = F.count(F.lit(1)) if counted is None else F.count_if(counted)
    source = df.hint("rebalance") if narrow else df
    source.observe(seen, rows.alias("rows")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["rows"]
