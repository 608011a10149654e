"""Make the Python-backed functions callable from SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from linewright.functions.hashing import extract_content_udf, fnv1a64_udf, simhash64_udf
from linewright.functions.json_values import (
    canonical_json_udf,
    extract_text_udf,
    fix_line_udf,
    is_json_udf,
    line_facts_udf,
)
from linewright.functions.tokens import Tokenizer, count_tokens_udf, token_details_udf, token_ids_udf


def register_functions(spark: SparkSession, tokenizer: Tokenizer | None = None) -> list[str]:
    """Register every UDF under its SQL name; token counting needs a tokenizer."""
    functions = {
        "fnv1a64": fnv1a64_udf(),
        "simhash64": simhash64_udf(),
        "simhash64_json": simhash64_udf(json_lines=True),
        "json_content": extract_content_udf(),
        "is_strict_json": is_json_udf(),
        "json_text": extract_text_udf(),
        "canonical_json": canonical_json_udf(),
        "fix_line": fix_line_udf(),
        "line_facts": line_facts_udf(),
    }
    if tokenizer is not None:
        functions["count_tokens"] = count_tokens_udf(tokenizer)
        functions["token_ids"] = token_ids_udf(tokenizer)
        functions["token_details"] = token_details_udf(tokenizer)
    for name, udf in functions.items():
        spark.udf.register(name, udf)
    return list(functions)
