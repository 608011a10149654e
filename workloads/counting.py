"""Token functions.

The tokenizers used here have no training: one splits words from punctuation, the other
has one token per byte.  Both can be stated in SQL; any ``tokenizer.json`` works the same.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from linewright.functions import tokens as T
from linewright.operators.tokens import token_budget, token_rows
from linewright.streaming.lines import load_available
from workloads.base import documents, text_lines
from workloads.reading import _document_stream
from workloads.registry import query


def word_tokenizer(spark) -> T.Tokenizer:
    """Words and runs of punctuation; every token has the id 0."""
    definition = {
        "version": "1.0",
        "pre_tokenizer": {"type": "Whitespace"},
        "model": {"type": "WordLevel", "vocab": {"?": 0}, "unk_token": "?"},
    }
    return T.tokenizer_from_json(spark, json.dumps(definition), "words")


def byte_ranks() -> dict[bytes, int]:
    return {bytes([value]): value for value in range(256)}


def byte_tokenizer(spark) -> T.Tokenizer:
    """One token per byte; the id is the byte."""
    return T.tokenizer_from_ranks(spark, "bytes", byte_ranks(), r"[\s\S]", {})


WORDS = r"regexp_extract_all(text, '[\p{L}\p{M}\p{N}\p{Pc}]+|[^\p{L}\p{M}\p{N}\p{Pc}\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')"
BYTES = "octet_length(encode(text))"


@query("count_tokens", f"SELECT doc_id AS row_id, len({WORDS})::int AS tokens FROM documents")
def count_tokens(spark, sf_dir):
    lines = text_lines(spark, sf_dir)
    counted = T.count_tokens(F.col("line"), word_tokenizer(spark))
    return lines.select("row_id", counted.alias("tokens"))


@query(
    "token_budget",
    f"""SELECT lang, source, count(*) AS texts, sum(len({WORDS}))::bigint AS total_tokens,
  avg(len({WORDS})) AS mean_tokens, max(len({WORDS}))::int AS max_tokens
FROM documents GROUP BY lang, source""",
)
def token_budget_query(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return token_budget(docs, word_tokenizer(spark), "text", ["lang", "source"])


@query(
    "token_ids",
    """SELECT doc_id AS row_id, array_to_string(list_transform(
  regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::int), ' ') AS ids
FROM documents""",
)
def token_ids(spark, sf_dir):
    lines = text_lines(spark, sf_dir)
    ids = T.token_ids(F.col("line"), byte_tokenizer(spark))
    return lines.select("row_id", F.array_join(ids.cast("array<string>"), " ").alias("ids"))


@query(
    "token_details",
    f"""SELECT doc_id AS row_id, array_to_string({WORDS}, '|') AS pieces,
  len({WORDS})::int AS tokens, 0 AS id_sum, true AS lengths_agree FROM documents""",
)
def token_details(spark, sf_dir):
    details = T.token_details(F.col("line"), word_tokenizer(spark))
    found = text_lines(spark, sf_dir).select("row_id", "line", details.alias("d"))
    raw = F.col("line").cast("binary")
    cut = F.transform(
        "d",
        lambda t: F.decode(
            F.substring(raw, t["byte_start"] + 1, t["byte_end"] - t["byte_start"]), "UTF-8"
        ),
    )
    agree = F.forall("d", lambda t: t["byte_end"] > t["byte_start"])
    return found.select(
        "row_id",
        F.array_join(cut, "|").alias("pieces"),
        F.size("d").alias("tokens"),
        F.aggregate("d", F.lit(0), lambda a, t: a + t["token_id"]).alias("id_sum"),
        agree.alias("lengths_agree"),
    )


@query(
    "token_offsets",
    f"""SELECT doc_id AS row_id, {BYTES}::int AS spans, 0 AS first_start, {BYTES}::int AS last_end,
  true AS adjacent FROM documents""",
)
def token_offsets(spark, sf_dir):
    spans = T.token_offsets(F.col("line"), byte_tokenizer(spark))
    found = text_lines(spark, sf_dir).select("row_id", spans.alias("s"))
    adjacent = F.forall("s", lambda t: t["byte_end"] == t["byte_start"] + 1)
    return found.select(
        "row_id",
        F.size("s").alias("spans"),
        F.get("s", F.lit(0))["byte_start"].alias("first_start"),
        F.element_at("s", -1)["byte_end"].alias("last_end"),
        adjacent.alias("adjacent"),
    )


@query(
    "token_segments",
    f"""SELECT doc_id AS row_id, text AS rebuilt, len({WORDS})::int AS tokens FROM documents""",
)
def token_segments(spark, sf_dir):
    pieces = T.token_segments(F.col("line"), word_tokenizer(spark))
    found = text_lines(spark, sf_dir).select("row_id", pieces.alias("p"))
    return found.select(
        "row_id",
        F.array_join(F.col("p")["text"], "").alias("rebuilt"),
        F.size(F.filter("p", lambda x: x["is_token"])).alias("tokens"),
    )


@query(
    "token_rows",
    f"""SELECT piece AS text, count(*) AS uses FROM (
  SELECT unnest({WORDS}) AS piece FROM documents) GROUP BY piece""",
)
def token_rows_query(spark, sf_dir):
    lines = text_lines(spark, sf_dir)
    spread = token_rows(lines, word_tokenizer(spark))
    cut = F.substring(F.col("line").cast("binary"), F.col("byte_start") + 1, F.col("length"))
    spans = spread.withColumn("length", F.col("byte_end") - F.col("byte_start"))
    placed = spans.drop("text").join(lines, "row_id")
    return placed.groupBy(F.decode(cut, "UTF-8").alias("text")).agg(
        F.count(F.lit(1)).alias("uses")
    )


@query(
    "stream_count_tokens",
    f"""WITH d AS (SELECT *, to_json({{'doc_id': doc_id, 'text': text, 'lang': lang,
  'source': source, 'n_chars': n_chars}})::varchar AS line FROM documents)
SELECT doc_id AS row_id, octet_length(encode(line))::int AS tokens FROM d""",
)
def stream_count_tokens(spark, sf_dir):
    lines = _document_stream(spark, sf_dir)
    counted = T.count_tokens(F.col("line"), byte_tokenizer(spark))
    return load_available(lines.select("row_id", counted.alias("tokens")))[1]
