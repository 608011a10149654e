"""Hashes, fingerprints and duplicate removal."""

from __future__ import annotations

from pyspark.sql import functions as F

from linewright.functions import hashing
from linewright.operators import dedup as D
from linewright.plans.bitmaps import is_set
from linewright.sources.writers import dedup_report
from workloads.base import (
    DIRTY_DOCS_SQL,
    DOC_LINES_SQL,
    TEXT_LINES_SQL,
    dirty_lines,
    doc_lines,
    sql_extract_content,
    sql_first_fit,
    sql_fnv,
    sql_simhash,
    text_lines,
)
from workloads.registry import query

HEX = "lower(printf('%016x', {0}))"
TEXTS = f"WITH {TEXT_LINES_SQL}"


@query(
    "fnv1a64",
    f"{TEXTS} SELECT row_id, {HEX.format(sql_fnv('line'))} AS fnv FROM text_lines",
)
def fnv1a64(spark, sf_dir):
    lines = text_lines(spark, sf_dir)
    value = hashing.fingerprint_hex(hashing.fnv1a64(F.col("line")))
    return lines.select("row_id", value.alias("fnv"))


@query(
    "extract_content",
    f"WITH {DOC_LINES_SQL} SELECT row_id, {sql_extract_content('line')} AS content FROM doc_lines",
)
def extract_content_query(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    return lines.select("row_id", hashing.extract_content(F.col("line")).alias("content"))


PRINTS = f"WITH RECURSIVE {TEXT_LINES_SQL}, {sql_simhash('text_lines', 'line')}"


@query("simhash64", f"{PRINTS} SELECT row_id, {HEX.format('fp')} AS fingerprint FROM prints")
def simhash64(spark, sf_dir):
    prints = D.fingerprints(text_lines(spark, sf_dir), raw=True)
    return prints.withColumn("fingerprint", hashing.fingerprint_hex(F.col("fingerprint")))


@query(
    "simhash_shingle_size",
    f"""WITH {TEXT_LINES_SQL}, {sql_simhash('text_lines', 'line', shingle=6)}
SELECT row_id, {HEX.format('fp')} AS fingerprint FROM prints""",
)
def simhash_shingle_size(spark, sf_dir):
    prints = D.fingerprints(text_lines(spark, sf_dir), shingle=6, raw=True)
    return prints.withColumn("fingerprint", hashing.fingerprint_hex(F.col("fingerprint")))


CONTENT = f"""WITH RECURSIVE {DOC_LINES_SQL},
contents AS (SELECT row_id, {sql_extract_content('line')} AS content FROM doc_lines),
{sql_simhash('contents', 'content')}"""


@query(
    "simhash_json_lines",
    f"{CONTENT} SELECT row_id, {HEX.format('fp')} AS fingerprint FROM prints",
)
def simhash_json_lines(spark, sf_dir):
    prints = D.fingerprints(doc_lines(spark, sf_dir))
    return prints.withColumn("fingerprint", hashing.fingerprint_hex(F.col("fingerprint")))


@query(
    "hamming_distance",
    """SELECT l_orderkey, l_linenumber,
  bit_count(xor(l_orderkey * 1000003, l_partkey * 7919))::int AS distance FROM lineitem""",
)
def hamming_distance(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    a, b = F.col("l_orderkey") * F.lit(1000003), F.col("l_partkey") * F.lit(7919)
    distance = hashing.hamming_distance(a.cast("bigint"), b.cast("bigint"))
    return items.select("l_orderkey", "l_linenumber", distance.alias("distance"))


REPS = "reps AS MATERIALIZED (SELECT min(row_id) AS id, fp FROM prints GROUP BY fp)"
PAIRS = """SELECT a.id AS row_a, b.id AS row_b, bit_count(xor(a.fp, b.fp))::int AS distance
FROM reps a JOIN reps b ON a.id < b.id AND bit_count(xor(a.fp, b.fp)) <= {k}"""


@query("near_duplicate_pairs", f"{PRINTS}, {REPS} {PAIRS.format(k=3)}")
def near_duplicate_pairs(spark, sf_dir):
    return D.near_duplicate_pairs(D.fingerprints(text_lines(spark, sf_dir), raw=True), 3)


@query("near_duplicate_pairs_k6", f"{PRINTS}, {REPS} {PAIRS.format(k=6)}")
def near_duplicate_pairs_k6(spark, sf_dir):
    return D.near_duplicate_pairs(D.fingerprints(text_lines(spark, sf_dir), raw=True), 6)


EXACT = f"""{TEXTS}, flags AS (SELECT row_id, min(row_id) OVER (PARTITION BY line) AS canonical_id
FROM text_lines)"""
FLAGS = "row_id, row_id <> canonical_id AS is_duplicate, canonical_id"


def _exact(spark, sf_dir):
    return D.dedup(text_lines(spark, sf_dir), "exact")


@query("dedup_exact", f"{EXACT} SELECT {FLAGS} FROM flags")
def dedup_exact(spark, sf_dir):
    return _exact(spark, sf_dir).drop("fingerprint")


@query(
    "dedup_exact_fnv",
    f"""{EXACT} SELECT {FLAGS}, {HEX.format(sql_fnv('line'))} AS fingerprint
FROM flags JOIN text_lines USING (row_id)""",
)
def dedup_exact_fnv(spark, sf_dir):
    flags = D.dedup_exact(text_lines(spark, sf_dir), fnv_fingerprint=True)
    return flags.withColumn("fingerprint", hashing.fingerprint_hex(F.col("fingerprint")))


def _fit(k: int) -> str:
    return f"{PRINTS}, {sql_first_fit('prints', k)}"


FIT_ROWS = f"""SELECT row_id, {HEX.format('fp')} AS fingerprint,
  row_id <> canonical_id AS is_duplicate, canonical_id FROM fit"""


def _near(spark, sf_dir, k: int = 3, **options):
    return D.dedup(text_lines(spark, sf_dir), threshold=k, raw=True, **options)


def _with_hex(flags):
    return flags.withColumn("fingerprint", hashing.fingerprint_hex(F.col("fingerprint")))


@query("dedup_simhash", f"{_fit(3)} {FIT_ROWS}")
def dedup_simhash(spark, sf_dir):
    return _with_hex(_near(spark, sf_dir))


@query("dedup_simhash_k0", f"{_fit(0)} {FIT_ROWS}")
def dedup_simhash_k0(spark, sf_dir):
    return _with_hex(_near(spark, sf_dir, 0))


@query("dedup_simhash_k5", f"{_fit(5)} {FIT_ROWS}")
def dedup_simhash_k5(spark, sf_dir):
    return _with_hex(_near(spark, sf_dir, 5))


@query("dedup_simhash_k8", f"{_fit(8)} {FIT_ROWS}")
def dedup_simhash_k8(spark, sf_dir):
    return _with_hex(_near(spark, sf_dir, 8))


@query("dedup_simhash_k10", f"{_fit(10)} {FIT_ROWS}")
def dedup_simhash_k10(spark, sf_dir):
    return _with_hex(_near(spark, sf_dir, 10))


@query(
    "copy_pairs_k6",
    f"""{_fit(6)}, kept_prints AS (SELECT row_id, fp FROM fit WHERE row_id = canonical_id)
SELECT f.canonical_id, min(f.row_id) AS row_id, count(*) AS members,
  bit_count(xor(f.fp, k.fp))::int AS distance
FROM fit f JOIN kept_prints k ON k.row_id = f.canonical_id WHERE f.fp <> k.fp
GROUP BY f.canonical_id, f.fp, k.fp""",
)
def copy_pairs_k6(spark, sf_dir):
    return D.copy_pairs(_near(spark, sf_dir, 6))


@query(
    "dedup_json_lines",
    f"{CONTENT}, {sql_first_fit('prints', 3)} {FIT_ROWS}",
)
def dedup_json_lines(spark, sf_dir):
    return _with_hex(D.dedup(doc_lines(spark, sf_dir)))


@query(
    "dedup_dirty_lines",
    f"""WITH RECURSIVE {DIRTY_DOCS_SQL},
contents AS (SELECT row_id, {sql_extract_content('line')} AS content FROM dirty),
{sql_simhash('contents', 'content')}, {sql_first_fit('prints', 3)} {FIT_ROWS}""",
)
def dedup_dirty_lines(spark, sf_dir):
    """Blank and number-only lines share one fingerprint, the largest group there is."""
    return _with_hex(D.dedup(dirty_lines(spark, sf_dir)))


@query(
    "dedup_min_content",
    f"""WITH RECURSIVE {DIRTY_DOCS_SQL},
contents AS (SELECT row_id, {sql_extract_content('line')} AS content FROM dirty),
long AS (SELECT * FROM contents WHERE octet_length(encode(content)) >= 20),
{sql_simhash('long', 'content')}, {sql_first_fit('prints', 3)}
SELECT c.row_id, coalesce(f.canonical_id, c.row_id) AS canonical_id,
  coalesce(f.canonical_id <> c.row_id, false) AS is_duplicate
FROM contents c LEFT JOIN fit f USING (row_id)""",
)
def dedup_min_content(spark, sf_dir):
    flags = D.dedup(dirty_lines(spark, sf_dir), min_content_bytes=20)
    return flags.drop("fingerprint")


@query("canonical_map", f"{_fit(3)} SELECT row_id, canonical_id FROM fit")
def canonical_map(spark, sf_dir):
    return D.canonical_map(_near(spark, sf_dir))


@query("duplicate_flags", f"{EXACT} SELECT row_id, row_id <> canonical_id AS is_duplicate FROM flags")
def duplicate_flags(spark, sf_dir):
    return D.duplicate_flags(_exact(spark, sf_dir))


@query(
    "duplicate_bitmap",
    f"{EXACT} SELECT row_id, row_id <> canonical_id AS flagged FROM flags",
)
def duplicate_bitmap(spark, sf_dir):
    """The bit of every row, read from the bitmaps."""
    packed = D.duplicate_bitmap(_exact(spark, sf_dir)).withColumnRenamed("bucket", "_bucket")
    rows = text_lines(spark, sf_dir).select("row_id", F.bitmap_bucket_number("row_id").alias("_bucket"))
    return rows.join(packed, "_bucket", "left").select(
        "row_id", is_set(F.col("bitmap")).alias("flagged")
    )


STATS = """SELECT count(*) AS total_lines,
  count(*) FILTER (row_id = canonical_id) AS unique_count,
  count(*) FILTER (row_id <> canonical_id) AS duplicate_count,
  count(*) FILTER (row_id <> canonical_id)::double / count(*) AS dedup_ratio,
  '{label}' AS strategy FROM {flags}"""


@query("dedup_stats", f"{_fit(3)} {STATS.format(label='simhash(t=3)', flags='fit')}")
def dedup_stats(spark, sf_dir):
    return D.dedup_stats(_near(spark, sf_dir), "simhash", 3)


@query("dedup_stats_exact", f"{EXACT} {STATS.format(label='exact', flags='flags')}")
def dedup_stats_exact(spark, sf_dir):
    return D.dedup_stats(_exact(spark, sf_dir), "exact")


@query(
    "dedup_report",
    f"""{EXACT}, s AS ({STATS.format(label='exact', flags='flags')})
SELECT printf('%d total | %d unique | %d duplicates (%.1f%%) | strategy: %s', total_lines,
  unique_count, duplicate_count, dedup_ratio * 100, strategy) AS report FROM s""",
)
def dedup_report_query(spark, sf_dir):
    return dedup_report(D.dedup_stats(_exact(spark, sf_dir), "exact"))


@query(
    "duplicate_samples",
    f"""{_fit(3)}, copies AS (
  SELECT * FROM fit WHERE row_id <> canonical_id ORDER BY row_id LIMIT 5)
SELECT c.row_id + 1 AS duplicate_line, f.row_id + 1 AS original_line,
  bit_count(xor(c.fp, f.fp))::int AS hamming_distance
FROM copies c JOIN fit f ON f.row_id = c.canonical_id""",
)
def duplicate_samples(spark, sf_dir):
    return D.duplicate_samples(_near(spark, sf_dir))


@query(
    "duplicate_clusters",
    f"""{_fit(3)} SELECT canonical_id, count(*) AS size, min(row_id) AS first_row,
  max(row_id) AS last_row FROM fit GROUP BY canonical_id HAVING count(*) >= 2""",
)
def duplicate_clusters(spark, sf_dir):
    return D.duplicate_clusters(_near(spark, sf_dir))
