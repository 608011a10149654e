"""A corpus pipeline: quality rules, near copies, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's documents.  All but the last return the columns of ``documents``;
columns beyond those pass through them, whatever their names.

Defined results.  An empty table gives an empty table in every stage.  A NULL text has no words:
the quality rules reject it; where a later stage meets one it stays NULL, is linked to other texts
without words, loses nothing, and packs as an end mark alone.  A NULL source is a host of its own,
other NULLs are kept as they are.  Repeated rows are judged alike by the quality rules, and one of
them stays in the near-copy stage; of equal texts the one of the least doc_id stays.  Rows without
a doc_id stay if no row with one is their near copy, once for each fingerprint; passages in them are
not cut, as their order is not known.  Ties between equal passages go to the smaller doc_id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm.frequent_lines import clean_documents
from linewright.llm.packing import pack
from linewright.llm.private_data import masked
from linewright.llm.repeats import without_repeats
from linewright.llm.simhash_trees import one_of_each
from linewright.plans.durable import fresh_path

SEQUENCE_TOKENS = 4096
SHINGLE_WORDS = 4
LINK_BITS = 4


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; kept ones lose the lines that too many of their host share."""
    return _counted(clean_documents(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of the least doc_id.

    Near copies are SimHash components: 4-word shingles, links within 4 bits.
    """
    return one_of_each(docs, shingle=SHINGLE_WORDS, distance=LINK_BITS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier are cut out; the documents stay."""
    return _counted(without_repeats(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    return _counted(masked(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document, with its sequence and offset."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE_TOKENS)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_copies),
    ("substring_dedup", repeated_passages),
    ("private_data", personal_data),
    ("packing", packing),
]

# Fingerprints, the random field and the tokenizer are not SQL; tests hold stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        path = fresh_path(spark, f"pipeline-{name}")
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
