"""Repair of record lines, with outcome reports and the policy for rejected lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.functions.json_values import fix_line


def fix(lines: DataFrame, canonicalize: bool = True) -> DataFrame:
    """``row_id``, ``line`` (original), ``outcome``, ``fixed``, ``fixes``, ``skip_reason``.

    ``outcome`` is ``fixed``, ``unchanged`` or ``skipped``.  Parsed lines are rewritten as
    compact JSON with sorted keys; ``canonicalize=False`` keeps unchanged lines as they
    are.  Lines that are not valid UTF-8 are left out, as they cannot be read.
    """
    readable = lines.filter(F.is_valid_utf8("line"))
    result = fix_line(F.col("line"), canonicalize)
    return readable.select("row_id", "line", result.alias("_result")).select(
        "row_id",
        "line",
        F.col("_result.outcome").alias("outcome"),
        F.col("_result.line").alias("fixed"),
        F.col("_result.fixes").alias("fixes"),
        F.col("_result.skip_reason").alias("skip_reason"),
    )


def fix_summary(fixed: DataFrame) -> DataFrame:
    outcome = F.col("outcome")
    return fixed.agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if(outcome == "fixed").alias("fixed_lines"),
        F.count_if(outcome == "unchanged").alias("unchanged_lines"),
        F.count_if(outcome == "skipped").alias("skipped_lines"),
    )


def fix_counts_by_type(fixed: DataFrame) -> DataFrame:
    """Rows touched by each kind of fix."""
    kinds = fixed.select(F.explode("fixes").alias("fix"))
    return kinds.groupBy("fix").agg(F.count(F.lit(1)).alias("lines"))


def skip_policy(fixed: DataFrame, skip_invalid: bool = False) -> DataFrame:
    """Lines to write: repaired ones, and rejected ones verbatim unless they are dropped."""
    kept = fixed.filter(F.col("outcome") != "skipped") if skip_invalid else fixed
    return kept.select("row_id", F.coalesce("fixed", "line").alias("line"))


def rejected_lines(fixed: DataFrame, skip_invalid: bool = False) -> DataFrame:
    """The log of rejected lines: 1-based number, reason, what was done."""
    done = "skipped" if skip_invalid else "kept as-is"
    number = F.col("row_id") + 1
    return fixed.filter(F.col("outcome") == "skipped").select(
        number.alias("line_number"),
        F.format_string(f"Line %d: %s ({done})", number, F.col("skip_reason")).alias("entry"),
        "skip_reason",
    )
