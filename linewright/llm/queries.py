"""Registered queries of this subpackage, each next to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from linewright.llm.chat_format import format_digests
from linewright.llm.frequent_lines import line_verdicts
from linewright.llm.hilbert import hilbert_shards
from linewright.llm.packing import pack
from linewright.llm.piece_sampling import sampling_digests
from linewright.llm.private_data import private_spans
from linewright.llm.repeats import repeat_digests
from linewright.llm.shared_lines import shared_line_digests
from linewright.llm.simhash_trees import simhash_components
from linewright.llm.source_divergence import source_divergence
from linewright.llm.suffix_tree import suffix_tree_scores
from linewright.llm.top_k import top_k
from linewright.llm.vector_codes import vector_codes

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert_shards(table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


def op2_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS i FROM d WHERE len(w) >= 20),
wins AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 20], ' ') AS s FROM starts),
ranked AS (
  SELECT doc_id, i, rank() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM wins),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM ranked WHERE r > 1),
places AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE
    list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(ps, k - 1)),
      lambda k: w[k]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN places USING (doc_id)
"""


def op3_simhash_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op4_skip_chain_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_spans(table(spark, sf_dir, "documents"))


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_scores(table(spark, sf_dir, "documents"))


def op6_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling_digests(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )


def op7_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096
    )


def op8_relational_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return format_digests(rows.unionByName(extra))


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]'
  FROM range(2) t(i)),
b AS (
  SELECT *,
    coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) <> role, true) AS opens,
    length(text) + len(regexp_extract_all(text,
      '\|<\|im_(?:start|sep|end)\|>|</?s>|\[/?INST\]')) AS size
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
    AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  (sum(size) + sum(CASE WHEN opens THEN 24 + length(role) ELSE 10 END))::BIGINT
    AS formatted_chars
FROM b GROUP BY conv_id
"""


def op9_frequent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_verdicts(table(spark, sf_dir, "documents")).drop("digest", "keys")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
starts AS (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS i FROM d WHERE len(w) >= 5),
wins AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 5], ' ') AS s FROM starts),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM wins),
places AS (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS p FROM again WHERE n > 1),
repeated AS (SELECT doc_id, count(*) AS n FROM places GROUP BY doc_id),
l AS (SELECT doc_id, source, unnest(lines) AS line FROM d),
n AS (
  SELECT doc_id, source, line, translate(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' '),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM l),
k AS (
  SELECT doc_id, source, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
    substr(md5(norm), 1, 15) AS key
  FROM n),
sets AS (
  SELECT doc_id, array_to_string(list_sort(list(DISTINCT key)), '+') AS whole, sum(words) AS words
  FROM k GROUP BY doc_id),
held AS (SELECT doc_id, source, key, sum(words) AS words FROM k GROUP BY doc_id, source, key),
candidates AS (
  SELECT source, key FROM held JOIN sets USING (doc_id)
  GROUP BY source, key HAVING count(DISTINCT whole) > 10),
known AS (
  SELECT doc_id, source, list(key) AS keys,
    CASE WHEN sum(h.words) * 100 > any_value(s.words) * 80
      THEN 'near ' || array_to_string(list_sort(list(key))[1:2], '+') ELSE any_value(whole) END
      AS document
  FROM held h JOIN candidates USING (source, key) JOIN sets s USING (doc_id)
  GROUP BY doc_id, source),
frequent AS (
  SELECT source, key FROM (SELECT source, document, unnest(keys) AS key FROM known)
  GROUP BY source, key HAVING count(DISTINCT document) > 10),
removed AS (
  SELECT doc_id, sum(words) AS n FROM k JOIN frequent USING (source, key) GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, len(w) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, len(w) - coalesce(x.n, 0) AS n_left
  FROM d LEFT JOIN repeated r USING (doc_id) LEFT JOIN removed x USING (doc_id)),
base AS (
  SELECT *, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  n_left::BIGINT AS n_left,
  NOT base_failed AND n_left * 100 >= n_words * 30 AS kept
FROM base
"""

def op10_term_at_a_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

def op11_active_entry_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _lloyd_sql(rounds: int) -> str:
    """A full scan of every codebook in every round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT id, j, arg_min(e, d * 16 + e) AS e, min(d) AS d FROM (
    SELECT p.id, p.j, b.e,
      list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM p JOIN b{r} b USING (j))
  GROUP BY id, j)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (
  SELECT j, e, i, sum(x) AS s, count(*) AS n FROM (
    SELECT a.j, a.e, unnest(p.v) AS x, unnest(range(len(p.v))) AS i
    FROM a{r} a JOIN p USING (id, j))
  GROUP BY j, e, i),
b{r + 1} AS MATERIALIZED (
  SELECT b.j, b.e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN (
    SELECT j, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v
    FROM m{r} GROUP BY j, e) m USING (j, e))""")
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label,
    list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT id, j, w[j * (len(w) // 8) + 1 : (j + 1) * (len(w) // 8)] AS v
  FROM k, range(8) t(j)),
b0 AS MATERIALIZED (SELECT j, id - 1 AS e, v FROM p WHERE id <= 16),
{",".join(steps)},
c AS (
  SELECT id, string_agg(printf('%02x', e), '' ORDER BY j) AS code, sum(d)::BIGINT AS error
  FROM a{rounds} GROUP BY id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY j, e)) FROM b{rounds})
    AS codebooks_sha256
FROM c JOIN k USING (id)
"""


def op12_shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_line_digests(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM d),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
shared AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.*, first IS NOT NULL AND first <> doc_id AS gone FROM k LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op13_chunk_factorization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
o AS (SELECT doc_id, lang, source, unnest(terms) AS term FROM d),
kept AS MATERIALIZED (
  SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 30),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
totals AS MATERIALIZED (
  SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS n FROM groups g
  LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
p AS MATERIALIZED (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
    (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (t.n + 5 * v.v))::BIGINT AS p
  FROM totals t JOIN v USING (lang) JOIN kept k USING (lang)
  LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
q AS (
  SELECT lang, term,
    (1 + (1000000000::HUGEINT * (sum(p.n) + 5)) // (any_value(t.n) + 5 * any_value(v.v)))::BIGINT AS q
  FROM p JOIN (SELECT lang, sum(n)::HUGEINT AS n FROM totals GROUP BY lang) t USING (lang)
  JOIN v USING (lang) GROUP BY lang, term),
far AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL),
pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN far f ON f.lang = g.lang AND f.source = g.source AND f.item = h.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT
    AS rank
  FROM (FROM pairs UNION ALL FROM terms))
FROM ranked WHERE part = 'pair' OR rank <= 50
"""

QUERIES: dict[str, Query] = {
    "op1_hilbert_shards": op1_hilbert_shards,
    "op2_block_anchors": op2_block_anchors,
    "op3_simhash_trees": op3_simhash_trees,
    "op4_skip_chain_field": op4_skip_chain_field,
    "op5_suffix_tree": op5_suffix_tree,
    "op6_piece_sampling": op6_piece_sampling,
    "op7_shortest_pack_first": op7_shortest_pack_first,
    "op8_relational_chat": op8_relational_chat,
    "op9_frequent_lines": op9_frequent_lines,
    "op10_term_at_a_time": op10_term_at_a_time,
    "op11_active_entry_lloyd": op11_active_entry_lloyd,
    "op12_shared_lines": op12_shared_lines,
    "op13_chunk_factorization": op13_chunk_factorization,
}

ORACLES: dict[str, str] = {
    "op2_block_anchors": OP2_SQL,
    "op8_relational_chat": OP8_SQL,
    "op9_frequent_lines": OP9_SQL,
    "op10_term_at_a_time": OP10_SQL,
    "op11_active_entry_lloyd": _lloyd_sql(6),
    "op12_shared_lines": OP12_SQL,
    "op13_chunk_factorization": OP13_SQL,
}
