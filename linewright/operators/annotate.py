"""Per-row status from lint issues and duplicate flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.plans.bitmaps import with_flags


def annotate(lines: DataFrame, issues: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Add ``status`` (``error`` before ``duplicate`` before ``ok``) and ``label``.

    Issues and copies become bitmaps of row ids, which are attached to the lines where they are.
    """
    errors = issues.select("row_id", F.lit(True).alias("_error"), F.lit(False).alias("_dup"))
    copies = duplicates.filter("is_duplicate").select(
        "row_id", F.lit(False).alias("_error"), F.lit(True).alias("_dup")
    )
    marked = with_flags(lines, errors.unionByName(copies), ["_error", "_dup"])
    status = F.when(F.col("_error"), "error").when(F.col("_dup"), "duplicate").otherwise("ok")
    return marked.select(
        "row_id",
        "line",
        status.alias("status"),
        F.when(status == "duplicate", "DUP").otherwise("").alias("label"),
    )
