"""Dense global ranks without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.plans.durable import written

# ``monotonically_increasing_id`` keeps the partition above this bit and the row below it.
_ROW_BITS = 33


def with_global_rank(df: DataFrame, order: list[Column], label: str) -> tuple[DataFrame, int]:
    """Add ``rank`` (0-based, gapless, by ``order``) and return the row count too.

    Rows are range-partitioned and sorted once and written with their place; the only
    window runs over one row per partition.  Rows equal in all of ``order`` take adjacent
    ranks.  ``df`` should be narrow: it is shuffled whole.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed, total = written(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()),
        label,
    )
    part = F.shiftrightunsigned("_place", _ROW_BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base")
    )
    ranked = placed.withColumn("_part", part).join(F.broadcast(bases), "_part")
    rank = F.col("_base") + F.col("_place").bitwiseAND((1 << _ROW_BITS) - 1)
    return ranked.withColumn("rank", rank).drop("_part", "_base", "_place"), total
