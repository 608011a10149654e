"""Shared inputs of the registered queries: Spark frames and the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.plans.durable import fresh_path
from linewright.sources.readers import lines_from_dataframe

DOC_COLUMNS = ["doc_id", "lang", "source", "text", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON record lines."""
    return lines_from_dataframe(documents(spark, sf_dir), "doc_id", columns=DOC_COLUMNS)


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as plain text lines."""
    return lines_from_dataframe(documents(spark, sf_dir), "doc_id", "text")


DIRTY_TEXT = """case doc_id % 10
  when 0 then concat(text, '  ')
  when 1 then replace(text, chr(10), concat(' ', chr(10)))
  when 2 then concat('<think>', text)
  when 3 then concat('<think>plan', chr(10), chr(10), text)
  when 4 then concat(text, '</think>')
  when 5 then concat('<think>', text, '</think>')
  else text end"""

DIRTY_LINE = """case doc_id % 23
  when 0 then substr(j, 1, length(j) - 1)
  when 1 then ''
  when 2 then concat('{"doc_id":', cast(doc_id as string), '}')
  else j end"""


def dirty_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with defects placed by rule: ``doc_id``, ``t``, ``line``."""
    docs = documents(spark, sf_dir).withColumn("t", F.expr(DIRTY_TEXT))
    record = F.to_json(F.struct("doc_id", "lang", "source", F.col("t").alias("text")))
    return docs.withColumn("j", record).withColumn("line", F.expr(DIRTY_LINE))


def dirty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty_docs(spark, sf_dir).select(F.col("doc_id").alias("row_id"), "line")


DIRTY_DOCS_SQL = f"""
dirty_text AS (SELECT doc_id, lang, source, text, {DIRTY_TEXT} AS t FROM documents),
dirty_json AS (
  SELECT *, to_json({{'doc_id': doc_id, 'lang': lang, 'source': source, 'text': t}})::varchar AS j
  FROM dirty_text),
dirty AS (SELECT doc_id AS row_id, lang, source, t, j,
  {DIRTY_LINE.replace("as string", "as varchar")} AS line FROM dirty_json)"""

DIRTY_TURN = """case when role = 'assistant' and turn <= 2 then
  case conv_id % 5
    when 0 then concat('<think>plan', chr(10), chr(10), text)
    when 1 then concat('<think>', text)
    when 2 then concat(text, '</think>')
    when 3 then concat('<think><think>', text)
    else concat(text, ' ') end
else text end"""


def dirty_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("t", F.expr(DIRTY_TURN))


def dirty_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON line per conversation, with tag defects in assistant turns."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "t")))
    messages = F.transform(
        turns, lambda x: F.struct(x["role"].alias("role"), x["t"].alias("content"))
    )
    grouped = dirty_turns(spark, sf_dir).groupBy("conv_id").agg(messages.alias("messages"))
    return grouped.select(
        F.col("conv_id").alias("row_id"), F.to_json(F.struct("conv_id", "messages")).alias("line")
    )


DIRTY_TURNS_SQL = (
    f"turns AS (SELECT conv_id, turn, role, text, {DIRTY_TURN} AS t FROM conversations)"
)

DOC_LINES_SQL = """doc_lines AS (
  SELECT doc_id AS row_id,
    to_json({'doc_id': doc_id, 'lang': lang, 'source': source, 'text': text,
      'n_chars': n_chars})::varchar AS line
  FROM documents)"""
TEXT_LINES_SQL = "text_lines AS (SELECT doc_id AS row_id, text AS line FROM documents)"


# --- files written from the tables, once per session and scale ---------------------------

_WRITTEN: dict[tuple[str, str, str], str] = {}


def exported(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """A folder of files that Spark writes from the given tables, in key order."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _WRITTEN:
        path = fresh_path(spark, f"export-{kind}")
        _EXPORTS[kind](spark, sf_dir, path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


# Rows of one exported file, about.  One task writes it, so this bounds what a task reads.
FILE_ROWS = 25_000
# The same where SQL names the number of files, which is four up to a million rows.
WIDE_FILE_ROWS = 250_000


def _files(df: DataFrame, least: int, rows: int = FILE_ROWS) -> int:
    """How many files the rows are written to."""
    return max(least, -(-df.count() // rows))


def _in_order(df: DataFrame, key: str, least: int = 4, rows: int = FILE_ROWS) -> DataFrame:
    return df.repartitionByRange(_files(df, least, rows), key).sortWithinPartitions(key)


def _export_jsonl(spark: SparkSession, sf_dir: str, path: str) -> None:
    _in_order(doc_lines(spark, sf_dir), "row_id").select("line").write.text(path)


def _export_dirty(spark: SparkSession, sf_dir: str, path: str) -> None:
    _in_order(dirty_lines(spark, sf_dir), "row_id").select("line").write.text(path)


def _export_csv(spark: SparkSession, sf_dir: str, path: str) -> None:
    docs = table(spark, sf_dir, "documents")
    _in_order(docs, "doc_id").write.csv(path, header=True, escape='"')


def _export_tsv(spark: SparkSession, sf_dir: str, path: str) -> None:
    events = table(spark, sf_dir, "events")
    written = events.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    _in_order(written, "event_id").write.csv(path, header=True, sep="\t", escape='"')


def _export_csv_orders(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Two folders whose files repeat a name and have their columns in different orders."""
    docs = table(spark, sf_dir, "documents")
    orders = (
        ["lang", "doc_id", "source", "text", "n_chars"],
        ["text", "source", "lang", "n_chars", "doc_id"],
    )
    for number, columns in enumerate(orders):
        rows = docs.filter(F.col("doc_id") % 2 == number)
        files = _files(rows, 1)
        extent = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
        low, wide = extent["low"] or 0, (extent["high"] or 0) - (extent["low"] or 0) + 1
        # The name "lang" comes twice; the last of the two counts.
        names = ["lang", *columns]
        values = rows.select(
            F.floor((F.col("doc_id") - low) * files / F.lit(float(wide))).cast("int").alias("file"),
            F.col("doc_id").alias("at"),
            F.lit("no").alias("_0"),
            *[F.col(c).cast("string").alias(f"_{i + 1}") for i, c in enumerate(columns)],
        )
        header = spark.range(files).select(
            F.col("id").cast("int").alias("file"),
            F.lit(low - 1).cast("long").alias("at"),
            *[F.lit(name).alias(f"_{i}") for i, name in enumerate(names)],
        )
        placed = header.unionByName(values).repartitionById(files, F.col("file"))
        ordered = placed.sortWithinPartitions("at").drop("file", "at")
        ordered.write.csv(f"{path}/{number}", escape='"')


def _export_drift(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Shards of which only some have a column."""
    docs = table(spark, sf_dir, "documents")
    for part in range(2):
        rows = docs.filter(F.col("doc_id") % 2 == part)
        shard = rows.withColumn("extra", F.length("text")) if part else rows
        _in_order(shard, "doc_id", 1).write.parquet(f"{path}/part={part}")


def _export_parquet(
    spark: SparkSession, sf_dir: str, path: str, rows: int = FILE_ROWS
) -> None:
    docs = _in_order(table(spark, sf_dir, "documents"), "doc_id", rows=rows)
    docs.write.option("parquet.block.size", 64 * 1024).parquet(path)


def _export_parquet_wide(spark: SparkSession, sf_dir: str, path: str) -> None:
    _export_parquet(spark, sf_dir, path, WIDE_FILE_ROWS)


def _export_events(spark: SparkSession, sf_dir: str, path: str) -> None:
    _in_order(table(spark, sf_dir, "events"), "event_id", 3).write.parquet(path)


def _export_splits(spark: SparkSession, sf_dir: str, path: str) -> None:
    docs = table(spark, sf_dir, "documents").withColumn("config", F.col("lang"))
    split = F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train")
    docs.withColumn("split", split).repartition(_files(docs, 2), "doc_id").write.partitionBy(
        "config", "split"
    ).parquet(path)


_EXPORTS = {
    "jsonl": _export_jsonl,
    "dirty": _export_dirty,
    "csv": _export_csv,
    "tsv": _export_tsv,
    "parquet": _export_parquet,
    "parquet_wide": _export_parquet_wide,
    "events": _export_events,
    "splits": _export_splits,
    "csv_orders": _export_csv_orders,
    "drift": _export_drift,
}


# --- SQL for the byte-level functions --------------------------------------------------------

WHITE_SPACE_CLASS = r"[\t\n\x0b\x0c\r \x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip_end(column: str) -> str:
    return f"regexp_replace({column}, '{WHITE_SPACE_CLASS}+$', '')"


def sql_spaces_before_newline(column: str) -> str:
    return f"regexp_replace({column}, ' +\\n', chr(10), 'g')"


def sql_tag_count(column: str, tag: str) -> str:
    return f"((length({column}) - length(replace({column}, '{tag}', ''))) // {len(tag)})"


def sql_close_tag(column: str) -> str:
    """One closing tag for text that ends in an unclosed opener."""
    start = f"(length({column}) - strpos(reverse({column}), '>kniht<') + 2)"
    rest = f"substr({column}, {start})"
    gap = f"strpos({rest}, chr(10) || chr(10))"
    closed = (
        f"case when {gap} = 0 then {column} || '</think>' else "
        f"substr({column}, 1, {start} - 1) || substr({rest}, 1, {gap} - 1) || '</think>' || "
        f"substr({rest}, {gap}) end"
    )
    opens, closes = sql_tag_count(column, "<think>"), sql_tag_count(column, "</think>")
    return (
        f"case when {opens} > {closes} and not contains({rest}, '</think>') "
        f"then {closed} else {column} end"
    )


def sql_open_tag(column: str) -> str:
    opens, closes = sql_tag_count(column, "<think>"), sql_tag_count(column, "</think>")
    return f"repeat('<think>', greatest({closes} - {opens}, 0)::bigint) || {column}"


_STRING = r'"(?:[^"\\]|\\.)*'


def sql_extract_content(column: str) -> str:
    segment = r'[:,}\]]?(?:[^":,}\]]|' + _STRING + r'(?:"|\\?$))*'
    body = r'"((?:[^"\\]|\\.)*)"'
    return (
        f"array_to_string(list_transform(flatten(list_transform(list_filter("
        f"regexp_extract_all({column}, '{segment}', 0, 's'), lambda s: s[1] = ':'), "
        f"lambda s: regexp_extract_all(s, '{body}', 1, 's'))), "
        rf"lambda v: regexp_replace(v, '\\(.)', '\1', 'gs') || ' '), '')"
    )


# The start and factor of 64-bit FNV-1a.
FNV_START, FNV_FACTOR = 14695981039346656037, 1099511628211


def _sql_fnv_step(state: str, byte: str) -> str:
    return f"((xor({state}, {byte})::uhugeint * {FNV_FACTOR}) % 18446744073709551616)::ubigint"


def sql_bytes(column: str) -> str:
    return (
        f"list_transform(regexp_extract_all(hex(encode({column})), '..'), "
        "lambda x: ('0x' || x)::ubigint)"
    )


def sql_fnv(column: str) -> str:
    """FNV-1a of a text column by folding over its bytes."""
    step = _sql_fnv_step("h", "b")
    return f"list_reduce(list_prepend({FNV_START}::ubigint, {sql_bytes(column)}), lambda h, b: {step})"


def sql_simhash(source: str, column: str, name: str = "prints", shingle: int = 4) -> str:
    """CTEs ending in ``{name}(row_id, fp ubigint)`` over ``source(row_id, {column})``."""
    parts = " + ".join(
        f"(b[i + {i}] << {8 * (shingle - 1 - i)})" for i in range(shingle)
    )
    state = f"{FNV_START}::ubigint"
    for i in range(shingle):
        state = _sql_fnv_step(state, f"((gram >> {8 * (shingle - 1 - i)}) & 255)")
    sums = ", ".join(f"sum(uses * ((h >> {i}) & 1)::int)::bigint AS s{i}" for i in range(64))
    bits = " + ".join(
        f"(case when 2 * s{i} > n then {1 << i}::uhugeint else 0::uhugeint end)" for i in range(64)
    )
    return f"""
{name}_bytes AS MATERIALIZED (
  SELECT row_id, {column} AS content, {sql_bytes(column)} AS b,
    octet_length(encode({column})) AS n FROM {source}),
{name}_grams AS MATERIALIZED (
  SELECT row_id, gram, count(*)::int AS uses FROM (
    SELECT row_id, unnest(list_transform(range(1, n - {shingle - 2}), lambda i: {parts})) AS gram
    FROM {name}_bytes WHERE n >= {shingle})
  GROUP BY row_id, gram),
{name}_hashes AS MATERIALIZED (
  SELECT gram, {state} AS h FROM (SELECT DISTINCT gram FROM {name}_grams)),
{name}_sums AS (
  SELECT row_id, sum(uses)::bigint AS n, {sums}
  FROM {name}_grams JOIN {name}_hashes USING (gram) GROUP BY row_id),
{name} AS MATERIALIZED (
  SELECT row_id, ({bits})::ubigint AS fp FROM {name}_sums
  UNION ALL
  SELECT row_id, {sql_fnv("content")} AS fp FROM {name}_bytes WHERE n < {shingle})"""


def sql_first_fit(prints: str, k: int, name: str = "fit") -> str:
    """CTEs ending in ``{name}(row_id, fp, canonical_id)`` by the sequential definition."""
    close = f"bit_count(xor(x.fp, r.fp)) <= {k}"
    return f"""
{name}_reps AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY id) AS rn, id, fp
  FROM (SELECT min(row_id) AS id, fp FROM {prints} GROUP BY fp)),
{name}_walk(rn, kept) AS (
  SELECT 0::bigint, []::struct(id bigint, fp ubigint)[]
  UNION ALL
  SELECT r.rn, CASE WHEN len(list_filter(w.kept, lambda x: {close})) = 0
    THEN list_append(w.kept, {{'id': r.id, 'fp': r.fp}}) ELSE w.kept END
  FROM {name}_walk w JOIN {name}_reps r ON r.rn = w.rn + 1),
{name}_kept AS MATERIALIZED (
  SELECT unnest(kept, recursive := true)
  FROM (SELECT kept FROM {name}_walk ORDER BY rn DESC LIMIT 1)),
{name} AS MATERIALIZED (
  SELECT p.row_id, p.fp, min(k.id) AS canonical_id
  FROM {prints} p JOIN {name}_kept k ON bit_count(xor(p.fp, k.fp)) <= {k}
  GROUP BY p.row_id, p.fp)"""


