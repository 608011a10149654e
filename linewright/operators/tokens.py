"""Token statistics over groups of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.functions.tokens import Tokenizer, count_tokens, token_details


def token_counts(lines: DataFrame, tokenizer: Tokenizer, text_col: str = "line") -> DataFrame:
    return lines.select("row_id", count_tokens(F.col(text_col), tokenizer).alias("tokens"))


def token_rows(lines: DataFrame, tokenizer: Tokenizer, text_col: str = "line") -> DataFrame:
    """One row per token: ``row_id``, ``position``, id, byte span and text."""
    details = token_details(F.col(text_col), tokenizer)
    spread = lines.select("row_id", details.alias("tokens")).select(
        "row_id", F.posexplode("tokens").alias("position", "token")
    )
    return spread.select("row_id", "position", "token.*")


def token_budget(
    df: DataFrame, tokenizer: Tokenizer, text_col: str, group_by: Sequence[str] = ()
) -> DataFrame:
    """Rows and total, mean and largest token count per group, combined before the shuffle."""
    counted = df.select(*group_by, count_tokens(F.col(text_col), tokenizer).alias("_tokens"))
    return counted.groupBy(*group_by).agg(
        F.count(F.lit(1)).alias("texts"),
        F.sum("_tokens").cast("bigint").alias("total_tokens"),
        F.avg("_tokens").alias("mean_tokens"),
        F.max("_tokens").alias("max_tokens"),
    )
