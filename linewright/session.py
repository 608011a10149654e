"""SparkSession factory with the settings the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    app_name: str = "linewright",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    driver_memory: str | None = None,
    work_dir: str | None = None,
) -> SparkSession:
    """Build (or fetch) a session.

    ``master`` and ``shuffle_partitions`` are left to ``spark-submit`` unless given.
    AQE with skew-join splitting is on: several plans rely on it as a second line of
    defence behind their own salting.  Arrow batches are bounded by rows and by bytes, so that
    long documents do not meet in one.  ``work_dir`` holds intermediate tables; on a cluster
    every executor must reach it.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
        .config("spark.ui.showConsoleProgress", "false")
    )
    if work_dir:
        builder = builder.config("spark.linewright.workDir", work_dir)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    return builder.getOrCreate()
