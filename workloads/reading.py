"""Sources, sinks, formats, Parquet metadata, catalog and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from linewright.functions.json_values import canonical_json
from linewright.functions.text import format_size, size_human
from linewright.operators import catalog
from linewright.operators.dedup import dedup_exact
from linewright.operators.fix import fix
from linewright.operators.lint import lint
from linewright.plans.durable import fresh_path
from linewright.sources import addresses, formats, manifest, parquet_meta, readers, writers
from linewright.streaming import lines as streams
from workloads.base import (
    DIRTY_DOCS_SQL,
    DOC_LINES_SQL,
    dirty_lines,
    doc_lines,
    exported,
    table,
)
from workloads.registry import query

NUMBERED_DOCS = f"""WITH {DOC_LINES_SQL}
SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, line FROM doc_lines"""


@query("read_jsonl", NUMBERED_DOCS)
def read_jsonl(spark, sf_dir):
    return readers.read_jsonl(spark, exported(spark, sf_dir, "jsonl"))


@query(
    "with_row_id",
    """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, doc_id, sha256(text) AS text_sha256
FROM documents""",
)
def with_row_id(spark, sf_dir):
    lines = readers.read_jsonl(spark, exported(spark, sf_dir, "jsonl"))
    record = F.from_json("line", "doc_id bigint, text string")
    return lines.select(
        "row_id",
        record["doc_id"].alias("doc_id"),
        F.sha2(record["text"], 256).alias("text_sha256"),
    )


@query(
    "read_parquet_lines",
    r"""SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_id,
  '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
  case when microsecond(ts) % 1000000 = 0 then ''
    when microsecond(ts) % 1000 = 0 then strftime(ts, '.%g') else strftime(ts, '.%f') end ||
  '","user_id":' || user_id || ',"event_type":' || to_json(event_type) || ',"value":' ||
  to_json(value) || ',"props":' || to_json(props) || '}' AS line FROM events""",
)
def read_parquet_lines(spark, sf_dir):
    return readers.read_parquet_lines(spark, exported(spark, sf_dir, "events"))


@query(
    "read_parquet_drift",
    """SELECT row_number() OVER (ORDER BY doc_id % 2, doc_id) - 1 AS row_id,
  case when doc_id % 2 = 0 then
    to_json({'doc_id': doc_id, 'text': text, 'lang': lang, 'source': source, 'n_chars': n_chars,
      'part': 0})::varchar
  else to_json({'doc_id': doc_id, 'text': text, 'lang': lang, 'source': source, 'n_chars': n_chars,
    'extra': length(text), 'part': 1})::varchar
  end AS line FROM documents""",
)
def read_parquet_drift(spark, sf_dir):
    return readers.read_parquet_lines(spark, exported(spark, sf_dir, "drift"))


@query(
    "read_parquet_documents",
    """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id,
  to_json({'doc_id': doc_id, 'text': text, 'lang': lang, 'source': source, 'n_chars': n_chars})::varchar
    AS line
FROM documents""",
)
def read_parquet_documents(spark, sf_dir):
    return readers.read_parquet_lines(spark, exported(spark, sf_dir, "parquet"))


CSV_SQL = """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id,
  to_json({'doc_id': doc_id::varchar, 'lang': lang, 'n_chars': n_chars::varchar, 'source': source,
    'text': text})::varchar AS line
FROM documents"""


@query("read_csv_lines", CSV_SQL)
def read_csv_lines(spark, sf_dir):
    return readers.read_csv_lines(spark, exported(spark, sf_dir, "csv"))


@query(
    "read_tsv_lines",
    """SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_id,
  to_json({'event_id': event_id::varchar, 'event_type': event_type, 'props': props,
    'ts': strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), 'user_id': user_id::varchar,
    'value': value::varchar})::varchar AS line
FROM events""",
)
def read_tsv_lines(spark, sf_dir):
    return readers.read_tsv_lines(spark, exported(spark, sf_dir, "tsv"))


@query(
    "read_csv_orders",
    CSV_SQL.replace("ORDER BY doc_id", "ORDER BY doc_id % 2, doc_id"),
)
def read_csv_orders(spark, sf_dir):
    path = exported(spark, sf_dir, "csv_orders")
    return readers.read_csv_lines(spark, [f"{path}/0", f"{path}/1"])


@query("read_dataset", CSV_SQL)
def read_dataset(spark, sf_dir):
    return readers.read_dataset(spark, exported(spark, sf_dir, "csv"), "CSV")


@query(
    "read_dataset_auto",
    """SELECT doc_id AS row_id,
  to_json({'doc_id': doc_id, 'text': text, 'lang': lang, 'source': source, 'n_chars': n_chars})::varchar
    AS line
FROM documents""",
)
def read_dataset_auto(spark, sf_dir):
    return readers.read_dataset(spark, f"{sf_dir}/documents.parquet", "auto")


@query(
    "read_nonblank_lines",
    f"""WITH {DIRTY_DOCS_SQL}
SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, line FROM dirty WHERE line <> ''""",
)
def read_nonblank_lines(spark, sf_dir):
    return readers.read_nonblank_lines(spark, exported(spark, sf_dir, "dirty"))


@query("lines_from_dataframe", f"WITH {DOC_LINES_SQL} SELECT row_id, line FROM doc_lines")
def lines_from_dataframe(spark, sf_dir):
    return doc_lines(spark, sf_dir)


EXTENSION = """case doc_id % 9 when 0 then '.jsonl' when 1 then '.parquet' when 2 then '.pq'
  when 3 then '.csv' when 4 then '.tsv' when 5 then '' when 6 then '.CSV' when 7 then '.json.gz'
  else '.d/part' end"""
PATH = f"concat('/data/', source, '/', lang, {EXTENSION})"


@query(
    "detect_format",
    f"""WITH p AS (SELECT doc_id, {PATH} AS path FROM documents)
SELECT doc_id, path, case when path like '%.parquet' or path like '%.pq' then 'parquet'
  when path like '%.csv' then 'csv' when path like '%.tsv' then 'tsv' else 'jsonl' end AS format
FROM p""",
)
def detect_format(spark, sf_dir):
    paths = table(spark, sf_dir, "documents").select("doc_id", F.expr(PATH).alias("path"))
    return paths.withColumn("format", formats.detect_format_col(F.col("path")))


OPTION = """case doc_id % 8 when 0 then 'auto' when 1 then 'JSONL' when 2 then 'pq'
  when 3 then 'Csv' when 4 then 'ndjson' when 5 then 'excel' when 6 then 'parquet' else 'json' end"""


@query(
    "parse_format",
    f"""WITH p AS (SELECT doc_id, {OPTION} AS option, {PATH} AS path FROM documents)
SELECT doc_id, case when lower(option) in ('jsonl', 'json', 'ndjson') then 'jsonl'
  when lower(option) in ('pq', 'parquet') then 'parquet' when lower(option) = 'csv' then 'csv'
  when path like '%.parquet' or path like '%.pq' then 'parquet' when path like '%.csv' then 'csv'
  when path like '%.tsv' then 'tsv' else 'jsonl' end AS format FROM p""",
)
def parse_format(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chosen = formats.parse_format_col(F.expr(OPTION), F.expr(PATH))
    return docs.select("doc_id", chosen.alias("format"))


@query(
    "fixed_output_path",
    f"""WITH p AS (SELECT doc_id, doc_id % 9 AS m, source, lang, {PATH} AS path FROM documents)
SELECT doc_id, '/data/' || source || '/' || lang || case m when 0 then '_fixed.jsonl'
  when 1 then '_fixed.parquet' when 2 then '_fixed.pq' when 3 then '_fixed.csv'
  when 4 then '_fixed.tsv' when 5 then '_fixed' when 6 then '_fixed.CSV'
  when 7 then '.json_fixed.gz' else '.d/part_fixed' end AS target FROM p""",
)
def fixed_output_path(spark, sf_dir):
    paths = table(spark, sf_dir, "documents").select("doc_id", F.expr(PATH).alias("path"))
    return paths.select("doc_id", writers.fixed_output_path_col(F.col("path")).alias("target"))


ADDRESS = """concat(case when doc_id % 7 = 0 then 'file://' else 'hf://' end, source,
  case doc_id % 6 when 0 then '' when 1 then concat('/', lang)
    when 2 then concat('/', lang, '/test') when 3 then concat('/', lang, '/en/train')
    when 4 then concat('/', lang, '/en/a/b') else concat('/', lang) end)"""


@query(
    "resolve_split_address",
    f"""WITH a AS (SELECT doc_id, {ADDRESS} AS address, source, lang, doc_id % 6 AS m,
  doc_id % 7 = 0 OR doc_id % 6 = 0 AS bad FROM documents)
SELECT doc_id, address, case when not bad then source end AS org,
  case when not bad then lang end AS dataset,
  case when bad then null when m in (3, 4) then 'en' else 'default' end AS config,
  case when bad then null when m = 2 then 'test' when m = 4 then 'a/b' else 'train' end AS split,
  case when not bad then source || '/' || lang || ' [' ||
    (case when m in (3, 4) then 'en' else 'default' end) || ':' ||
    (case when m = 2 then 'test' when m = 4 then 'a/b' else 'train' end) || ']' end AS name
FROM a""",
)
def resolve_split_address(spark, sf_dir):
    listed = table(spark, sf_dir, "documents").select("doc_id", F.expr(ADDRESS).alias("address"))
    target = addresses.resolve_split_address(F.col("address"))
    resolved = listed.withColumn("t", target)
    name = F.when(F.col("t").isNotNull(), addresses.display_name(F.col("t")))
    return resolved.select("doc_id", "address", "t.*", name.alias("name"))


def _split_listing(spark, sf_dir):
    listing = parquet_meta.list_files(spark, exported(spark, sf_dir, "splits"))
    return listing.select(
        F.regexp_extract("path", "config=([^/]*)/", 1).alias("config"),
        F.regexp_extract("path", "split=([^/]*)/", 1).alias("split"),
        "path",
        "file_size",
    )


@query(
    "select_split_files",
    """SELECT lang AS config, 'train' AS split, count(*) AS n_rows FROM documents
WHERE doc_id % 10 <> 0 GROUP BY lang""",
)
def select_split_files(spark, sf_dir):
    listing = _split_listing(spark, sf_dir)
    chosen = addresses.select_split_files(listing, "default", "train")
    groups = parquet_meta.parquet_file_meta(spark, exported(spark, sf_dir, "splits"))
    rows = chosen.join(groups.select("path", "total_rows"), "path")
    return rows.groupBy("config", "split").agg(F.sum("total_rows").alias("n_rows"))


@query(
    "select_split_files_config",
    """SELECT 'fr' AS config, 'test' AS split, count(*) AS n_rows FROM documents
WHERE doc_id % 10 = 0 AND lang = 'fr'""",
)
def select_split_files_config(spark, sf_dir):
    listing = _split_listing(spark, sf_dir)
    chosen = addresses.select_split_files(listing, "fr", "test")
    groups = parquet_meta.parquet_row_groups(spark, exported(spark, sf_dir, "splits"))
    rows = chosen.join(groups.groupBy("path").agg(F.sum("num_rows").alias("n")), "path")
    return rows.groupBy("config", "split").agg(F.sum("n").alias("n_rows"))


@query("parquet_row_groups", "SELECT count(*) AS num_rows, true AS all_placed FROM documents")
def parquet_row_groups(spark, sf_dir):
    groups = parquet_meta.parquet_row_groups(spark, exported(spark, sf_dir, "parquet"))
    placed = (F.col("offset") >= 4) & (F.col("compressed_size") > 0) & (F.col("row_group") >= 0)
    return groups.agg(
        F.sum("num_rows").alias("num_rows"), F.bool_and(placed).alias("all_placed")
    )


@query(
    "parquet_file_meta",
    """SELECT 4::bigint AS files, count(*) AS total_rows, true AS sized,
  'doc_id,text,lang,source,n_chars' AS columns FROM documents""",
)
def parquet_file_meta(spark, sf_dir):
    meta = parquet_meta.parquet_file_meta(spark, exported(spark, sf_dir, "parquet_wide"))
    return meta.agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("total_rows").alias("total_rows"),
        F.bool_and((F.col("file_size") > 0) & (F.col("num_row_groups") > 0)).alias("sized"),
        F.max(F.array_join("columns", ",")).alias("columns"),
    )


@query(
    "read_row_groups",
    """SELECT to_json({'doc_id': doc_id, 'text': text, 'lang': lang, 'source': source,
  'n_chars': n_chars})::varchar AS line FROM documents""",
)
def read_row_groups(spark, sf_dir):
    path = exported(spark, sf_dir, "parquet")
    groups = parquet_meta.parquet_row_groups(spark, path)
    return parquet_meta.read_row_groups(spark, groups, path).select("line")


@query(
    "export_unique",
    f"""WITH {DOC_LINES_SQL}, first AS (SELECT min(doc_id) AS row_id FROM documents GROUP BY text)
SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, line
FROM doc_lines WHERE row_id IN (SELECT row_id FROM first)""",
)
def export_unique(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    flags = dedup_exact(readers.lines_from_dataframe(docs, "doc_id", "text"))
    target = fresh_path(spark, "export-unique")
    writers.export_unique(doc_lines(spark, sf_dir), flags, target)
    return readers.read_jsonl(spark, target)


@query(
    "write_fixed",
    f"""WITH {DIRTY_DOCS_SQL}
SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id,
  case when row_id % 23 in (0, 1, 2) then line else to_json({{'doc_id': row_id, 'lang': lang,
    'source': source, 'text': regexp_replace(rtrim(t), ' +\\n', chr(10), 'g')}})::varchar end AS line
FROM dirty""",
)
def write_fixed(spark, sf_dir):
    target = fresh_path(spark, "write-fixed")
    writers.write_fixed(fix(dirty_lines(spark, sf_dir)), target)
    return readers.read_jsonl(spark, target)


@query(
    "overwrite_in_place",
    f"""WITH {DOC_LINES_SQL}
SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, line FROM doc_lines WHERE row_id >= 10""",
)
def overwrite_in_place(spark, sf_dir):
    target = fresh_path(spark, "in-place")
    writers.write_lines(doc_lines(spark, sf_dir), target)
    key = F.get_json_object("line", "$.doc_id").cast("bigint")
    current = readers.read_jsonl(spark, target)
    writers.overwrite_in_place(current.filter(key >= 10), target)
    return readers.read_jsonl(spark, target)


SIZE_CASE = """case when {s} >= 1073741824 then printf('%.{d}f GB', {s} / 1073741824.0::double)
  when {s} >= 1048576 then printf('%.{d}f MB', {s} / 1048576.0::double)
  when {s} >= 1024 then printf('%.{d}f KB', {s} / 1024.0::double) else {s} || ' B' end"""


@query(
    "dataset_info",
    f"""WITH {DOC_LINES_SQL}, s AS (
  SELECT count(*) AS line_count, sum(octet_length(encode(line)) + 1)::bigint AS b FROM doc_lines)
SELECT 'JSONL' AS format, line_count, b AS size_bytes, {SIZE_CASE.format(s="b", d=2)} AS size_human
FROM s""",
)
def dataset_info(spark, sf_dir):
    return catalog.dataset_info(spark, exported(spark, sf_dir, "jsonl")).drop("path")


@query(
    "dataset_catalog",
    f"""WITH {DOC_LINES_SQL}, {DIRTY_DOCS_SQL}, s AS (
  SELECT 'jsonl' AS kind, count(*) AS n, sum(octet_length(encode(line)) + 1)::bigint AS b
  FROM doc_lines
  UNION ALL SELECT 'dirty', count(*), sum(octet_length(encode(line)) + 1)::bigint FROM dirty)
SELECT 'JSONL file with ' || n || ' lines (' || {SIZE_CASE.format(s="b", d=2)} || ')' AS description,
  'application/jsonl' AS mime_type, 'dataset/' || kind AS uri, 'Dataset: ' || kind AS name FROM s""",
)
def dataset_catalog(spark, sf_dir):
    paths = [exported(spark, sf_dir, kind) for kind in ("jsonl", "dirty")]
    entries = catalog.dataset_catalog(spark, paths)
    # Exported folders have a random tail.
    for column in ("uri", "name"):
        tail = "^(dataset/|Dataset: ).*/export-([a-z]+)-[0-9a-f]+$"
        entries = entries.withColumn(column, F.regexp_replace(column, tail, "$1$2"))
    return entries.select("description", "mime_type", "uri", "name")


SCALED = "(o_orderkey * o_custkey * (o_orderkey % 13 + 1) * (o_custkey % 7 + 1))"


@query(
    "size_human",
    f"SELECT o_orderkey, {SIZE_CASE.format(s=SCALED, d=2)} AS size_human FROM orders",
)
def size_human_query(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", size_human(F.expr(SCALED)).alias("size_human"))


@query(
    "format_size",
    f"SELECT o_orderkey, {SIZE_CASE.format(s=SCALED, d=1)} AS format_size FROM orders",
)
def format_size_query(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", format_size(F.expr(SCALED)).alias("format_size"))


# --- streams -------------------------------------------------------------------------------------


def _document_stream(spark, sf_dir, kind="parquet"):
    schema = table(spark, sf_dir, "documents").schema
    path = exported(spark, sf_dir, kind)
    return streams.stream_record_lines(spark, path, schema, "doc_id", files=1)


@query(
    "stream_lines",
    f"WITH {DOC_LINES_SQL} SELECT line FROM doc_lines",
)
def stream_lines(spark, sf_dir):
    stream = streams.stream_lines(spark, exported(spark, sf_dir, "jsonl"), files=2)
    return streams.load_available(stream.select("line"))[1]


@query(
    "stream_progress",
    "SELECT 4::bigint AS units, count(*)::bigint AS loaded, true AS complete FROM documents",
)
def stream_progress(spark, sf_dir):
    stream = _document_stream(spark, sf_dir, "parquet_wide")
    query_run, _ = streams.load_available(stream)
    progress = streams.stream_progress(query_run)
    return progress.agg(
        F.count(F.lit(1)).alias("units"),
        F.sum("rows").alias("loaded"),
        F.lit(streams.is_complete(query_run)).alias("complete"),
    )


@query(
    "stream_lint",
    """SELECT doc_id AS row_id, 'missing_key' AS rule, 'title' AS key FROM documents
UNION ALL
SELECT doc_id, 'trailing_whitespace', NULL FROM documents WHERE text LIKE '% ' OR
  contains(text, ' ' || chr(10))""",
)
def stream_lint(spark, sf_dir):
    lines = _document_stream(spark, sf_dir)
    issues = lint(lines, ["title"]).select("row_id", "rule", "key")
    return streams.load_available(issues)[1]


@query(
    "stream_fix",
    """SELECT doc_id AS row_id, 'unchanged' AS outcome, to_json({'doc_id': doc_id, 'lang': lang,
  'n_chars': n_chars, 'source': source, 'text': text})::varchar AS fixed FROM documents""",
)
def stream_fix(spark, sf_dir):
    fixed = fix(_document_stream(spark, sf_dir)).select("row_id", "outcome", "fixed")
    return streams.load_available(fixed)[1]


@query(
    "canonical_json",
    f"""WITH {DIRTY_DOCS_SQL}
SELECT row_id, case when row_id % 23 not in (0, 1) then line end AS canonical FROM dirty""",
)
def canonical(spark, sf_dir):
    lines = dirty_lines(spark, sf_dir)
    return lines.select("row_id", canonical_json(F.col("line")).alias("canonical"))


@query(
    "canonical_json_order",
    """SELECT doc_id AS row_id,
  to_json({'a': {'x': lang, 'y': [1, 2]}, 'doc_id': doc_id, 'source': source})::varchar AS canonical
FROM documents""",
)
def canonical_order(spark, sf_dir):
    """Keys out of order at two depths, and white space between tokens."""
    shape = '{ "source" : "%s" ,\t"doc_id": %d, "a" : {"y":[ 1,2 ] , "x":"%s"} }'
    line = F.format_string(shape, "source", "doc_id", "lang")
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("row_id"), canonical_json(line).alias("canonical"))


# --- row ranges by a written manifest -------------------------------------------------------


def _manifest(spark, sf_dir, kind="jsonl", fmt="auto"):
    path = exported(spark, sf_dir, kind)
    return manifest.write_manifest(spark, path, fresh_path(spark, "manifest"), fmt)


@query("manifest_lines", NUMBERED_DOCS)
def manifest_lines(spark, sf_dir):
    return _manifest(spark, sf_dir).lines()


@query("manifest_csv_lines", CSV_SQL)
def manifest_csv_lines(spark, sf_dir):
    return _manifest(spark, sf_dir, "csv", "csv").lines()


@query(
    "manifest_splits",
    """SELECT count(*) AS line_count, min(row_id) AS first_row, max(row_id) + 1 AS next_row
FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents)""",
)
def manifest_splits(spark, sf_dir):
    return _manifest(spark, sf_dir, "parquet", "parquet").entries().agg(
        F.sum("rows").alias("line_count"),
        F.min("first_row").alias("first_row"),
        F.max(F.col("first_row") + F.col("rows")).alias("next_row"),
    )


def _range(low: str, high: str) -> str:
    return f"""WITH {DOC_LINES_SQL}, n AS (
  SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, line FROM doc_lines),
t AS (SELECT count(*) AS total FROM n)
SELECT row_id, line FROM n, t WHERE row_id BETWEEN {low} AND {high}"""


@query("manifest_get_lines", _range("100", "10099"))
def manifest_get_lines(spark, sf_dir):
    return _manifest(spark, sf_dir).get_lines(100, 10_000)


@query("manifest_rows_around", _range("total - 20", "total - 1"))
def manifest_rows_around(spark, sf_dir):
    rows = _manifest(spark, sf_dir)
    return rows.rows_around(rows.total() - 9, 20)


@query("manifest_tail", _range("total - 25", "total - 1"))
def manifest_tail(spark, sf_dir):
    return _manifest(spark, sf_dir).tail(25)


@query("manifest_page", _range("75", "99"))
def manifest_page(spark, sf_dir):
    return _manifest(spark, sf_dir).page(3, 25)
