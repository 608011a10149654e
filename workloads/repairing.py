"""Repair of lines and of single text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from linewright.functions import text
from linewright.operators import fix as fixing
from linewright.sources.writers import fix_report
from workloads.base import (
    DIRTY_DOCS_SQL,
    DIRTY_TURNS_SQL,
    dirty_chat,
    dirty_docs,
    dirty_lines,
    dirty_turns,
    sql_close_tag,
    sql_open_tag,
    sql_spaces_before_newline,
    sql_strip_end,
)
from workloads.registry import query


@query(
    "fix_trailing_whitespace",
    f"WITH {DIRTY_DOCS_SQL} SELECT row_id, {sql_strip_end('t')} AS fixed FROM dirty",
)
def fix_trailing_whitespace(spark, sf_dir):
    docs = dirty_docs(spark, sf_dir)
    fixed = text.strip_trailing_whitespace(F.col("t"))
    return docs.select(F.col("doc_id").alias("row_id"), fixed.alias("fixed"))


@query(
    "fix_space_before_newline",
    f"WITH {DIRTY_DOCS_SQL} SELECT row_id, {sql_spaces_before_newline('t')} AS fixed FROM dirty",
)
def fix_space_before_newline(spark, sf_dir):
    docs = dirty_docs(spark, sf_dir)
    fixed = text.strip_space_before_newline(F.col("t"))
    return docs.select(F.col("doc_id").alias("row_id"), fixed.alias("fixed"))


@query(
    "fix_unclosed_think",
    f"WITH {DIRTY_TURNS_SQL} SELECT conv_id, turn, {sql_close_tag('t')} AS fixed FROM turns",
)
def fix_unclosed_think(spark, sf_dir):
    turns = dirty_turns(spark, sf_dir)
    return turns.select("conv_id", "turn", text.close_think_tag(F.col("t")).alias("fixed"))


@query(
    "fix_unopened_think",
    f"WITH {DIRTY_TURNS_SQL} SELECT conv_id, turn, {sql_open_tag('t')} AS fixed FROM turns",
)
def fix_unopened_think(spark, sf_dir):
    turns = dirty_turns(spark, sf_dir)
    return turns.select("conv_id", "turn", text.open_think_tag(F.col("t")).alias("fixed"))


FIXED_DOCS = f"""WITH {DIRTY_DOCS_SQL},
stripped AS (SELECT *, {sql_strip_end("t")} AS s, row_id % 23 AS m FROM dirty),
cleaned AS (SELECT *, {sql_spaces_before_newline("s")} AS f FROM stripped),
kinds AS (SELECT row_id, m, line, lang, source, f,
  concat_ws(',', case when s <> t then 'Removed trailing whitespace' end,
    case when f <> s then 'Trimmed whitespace before newlines' end) AS fixes FROM cleaned),
fixed AS (SELECT row_id, line,
  case when m in (0, 1) then 'skipped' when m = 2 or fixes = '' then 'unchanged' else 'fixed' end
    AS outcome,
  case when m in (0, 1) then null when m = 2 then line else to_json({{'doc_id': row_id,
    'lang': lang, 'source': source, 'text': f}})::varchar end AS fixed,
  case when m in (0, 1, 2) then '' else fixes end AS fixes,
  case when m = 0 then 'Invalid JSON' when m = 1 then 'Empty line' end AS skip_reason
FROM kinds)"""


def _fixed(spark, sf_dir):
    return fixing.fix(dirty_lines(spark, sf_dir))


def _comparable(fixed):
    """Fixes as text, and parser messages cut to their heading."""
    reason = F.split("skip_reason", ":")[0]
    return fixed.withColumn("fixes", F.array_join("fixes", ",")).withColumn("skip_reason", reason)


@query("fix", f"{FIXED_DOCS} SELECT * FROM fixed")
def fix(spark, sf_dir):
    return _comparable(_fixed(spark, sf_dir))


CHAT_CTE = f"""WITH {DIRTY_TURNS_SQL},
stripped AS (SELECT *, {sql_strip_end("t")} AS s FROM turns),
cleaned AS (SELECT *, {sql_spaces_before_newline("s")} AS c FROM stripped),
closed AS (SELECT *, case when role = 'assistant' then {sql_close_tag("c")} else c end AS d FROM cleaned),
opened AS (SELECT *, case when role = 'assistant' then {sql_open_tag("d")} else d end AS f FROM closed),
chat AS (SELECT conv_id AS row_id,
  to_json({{'conv_id': conv_id, 'messages': list({{'content': f, 'role': role}} ORDER BY turn)}})::varchar
    AS fixed,
  bool_or(s <> t) AS stripped_any, bool_or(c <> s) AS cleaned_any,
  bool_or(d <> c) AS closed_any, bool_or(f <> d) AS opened_any
FROM opened GROUP BY conv_id)"""


@query(
    "fix_chat",
    f"""{CHAT_CTE} SELECT row_id, fixed,
  case when stripped_any or cleaned_any or closed_any or opened_any then 'fixed' else 'unchanged' end
    AS outcome, closed_any AS closed, opened_any AS opened, stripped_any AS stripped FROM chat""",
)
def fix_chat(spark, sf_dir):
    fixed = fixing.fix(dirty_chat(spark, sf_dir))
    return fixed.select(
        "row_id",
        "fixed",
        "outcome",
        F.array_contains("fixes", "Added missing </think> tag").alias("closed"),
        F.array_contains("fixes", "Added missing <think> tag").alias("opened"),
        F.array_contains("fixes", "Removed trailing whitespace").alias("stripped"),
    )


SUMMARY = """SELECT count(*) AS total_lines, count(*) FILTER (outcome = 'fixed') AS fixed_lines,
  count(*) FILTER (outcome = 'unchanged') AS unchanged_lines,
  count(*) FILTER (outcome = 'skipped') AS skipped_lines FROM fixed"""


@query("fix_summary", f"{FIXED_DOCS} {SUMMARY}")
def fix_summary(spark, sf_dir):
    return fixing.fix_summary(_fixed(spark, sf_dir))


@query(
    "fix_report",
    f"""{FIXED_DOCS}, s AS ({SUMMARY}) SELECT 'Total lines: ' || total_lines || ' | Fixed lines: ' ||
  fixed_lines || ' | Unchanged lines: ' || unchanged_lines || ' | Skipped lines: ' || skipped_lines
  AS report FROM s""",
)
def fix_report_query(spark, sf_dir):
    return fix_report(fixing.fix_summary(_fixed(spark, sf_dir)))


@query(
    "fix_counts_by_type",
    f"""{CHAT_CTE} SELECT * FROM (
  SELECT 'Added missing </think> tag' AS fix, count(*) FILTER (closed_any) AS lines FROM chat
  UNION ALL SELECT 'Added missing <think> tag', count(*) FILTER (opened_any) FROM chat
  UNION ALL SELECT 'Removed trailing whitespace', count(*) FILTER (stripped_any) FROM chat
  UNION ALL SELECT 'Trimmed whitespace before newlines', count(*) FILTER (cleaned_any) FROM chat)
WHERE lines > 0""",
)
def fix_counts_by_type(spark, sf_dir):
    return fixing.fix_counts_by_type(fixing.fix(dirty_chat(spark, sf_dir)))


@query("skip_policy", f"{FIXED_DOCS} SELECT row_id, coalesce(fixed, line) AS line FROM fixed")
def skip_policy(spark, sf_dir):
    return fixing.skip_policy(_fixed(spark, sf_dir))


@query(
    "skip_policy_drop",
    f"{FIXED_DOCS} SELECT row_id, fixed AS line FROM fixed WHERE outcome <> 'skipped'",
)
def skip_policy_drop(spark, sf_dir):
    return fixing.skip_policy(_fixed(spark, sf_dir), skip_invalid=True)


@query(
    "rejected_lines",
    f"""{FIXED_DOCS} SELECT row_id + 1 AS line_number, skip_reason FROM fixed
WHERE outcome = 'skipped'""",
)
def rejected_lines(spark, sf_dir):
    rejected = fixing.rejected_lines(_fixed(spark, sf_dir))
    return rejected.select("line_number", F.split("skip_reason", ":")[0].alias("skip_reason"))
