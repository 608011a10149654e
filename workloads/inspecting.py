"""Row access, search, text predicates, lint and annotation."""

from __future__ import annotations

from pyspark.sql import functions as F

from linewright.functions import json_values, text
from linewright.operators import annotate as annotation
from linewright.operators import lint as linting
from linewright.operators import rows, search
from linewright.operators.dedup import dedup_exact
from linewright.sources.readers import lines_from_dataframe
from linewright.sources.writers import lint_report
from workloads.base import (
    DIRTY_DOCS_SQL,
    DOC_LINES_SQL,
    TEXT_LINES_SQL,
    dirty_lines,
    doc_lines,
    table,
    text_lines,
)
from workloads.registry import query

LINES = f"WITH {DOC_LINES_SQL}"
TEXTS = f"WITH {TEXT_LINES_SQL}"
DIRTY = f"WITH {DIRTY_DOCS_SQL}"


@query("line_count", f"{LINES} SELECT count(*) AS line_count FROM doc_lines")
def line_count(spark, sf_dir):
    return rows.line_count(doc_lines(spark, sf_dir))


@query("get_line", f"{LINES} SELECT row_id, line FROM doc_lines WHERE row_id = 42")
def get_line(spark, sf_dir):
    return rows.get_line(doc_lines(spark, sf_dir), 42)


@query("get_lines", f"{LINES} SELECT row_id, line FROM doc_lines WHERE row_id BETWEEN 20 AND 49")
def get_lines(spark, sf_dir):
    return rows.get_lines(doc_lines(spark, sf_dir), 20, 30)


@query(
    "get_lines_long",
    f"{LINES} SELECT row_id, line FROM doc_lines WHERE row_id BETWEEN 100 AND 10099",
)
def get_lines_long(spark, sf_dir):
    return rows.get_lines(doc_lines(spark, sf_dir), 100, 10_000)


@query(
    "format_numbered",
    f"{LINES} SELECT row_id, 'L' || (row_id + 1) || ': ' || line AS text FROM doc_lines",
)
def format_numbered(spark, sf_dir):
    return rows.format_numbered(doc_lines(spark, sf_dir))


@query(
    "range_header",
    """SELECT 'Lines 21-' || least(50, count(*)) || ' of ' || count(*) || ':' AS header
FROM documents""",
)
def range_header(spark, sf_dir):
    return rows.range_header(doc_lines(spark, sf_dir), 20, 30)


@query("preview", f"{LINES} SELECT row_id, line FROM doc_lines ORDER BY row_id LIMIT 100")
def preview(spark, sf_dir):
    return rows.preview(doc_lines(spark, sf_dir))


@query(
    "rows_around",
    f"{LINES} SELECT row_id, line FROM doc_lines WHERE row_id BETWEEN 89 AND 108",
)
def rows_around(spark, sf_dir):
    return rows.rows_around(doc_lines(spark, sf_dir), 100, 20)


@query("page", f"{LINES} SELECT row_id, line FROM doc_lines WHERE row_id BETWEEN 75 AND 99")
def page(spark, sf_dir):
    return rows.page(doc_lines(spark, sf_dir), 3, 25)


@query(
    "tail",
    f"{LINES} SELECT row_id, line FROM doc_lines ORDER BY row_id DESC LIMIT 25",
)
def tail(spark, sf_dir):
    return rows.tail(doc_lines(spark, sf_dir), 25)


@query(
    "first_n_matches",
    f"""{TEXTS} SELECT row_id, line FROM text_lines WHERE contains(line, 'tion')
ORDER BY row_id LIMIT 20""",
)
def first_n_matches(spark, sf_dir):
    found = search.search(text_lines(spark, sf_dir), "tion")
    return rows.first_n_matches(found, 20)


@query(
    "search",
    rf"""{TEXTS} SELECT row_id, line FROM text_lines
WHERE regexp_matches(line, '(?i)\b(license|copyright)\b|[0-9]{{3}}-[0-9]{{4}}')""",
)
def search_query(spark, sf_dir):
    pattern = r"(?i)\b(license|copyright)\b|[0-9]{3}-[0-9]{4}"
    return search.search(text_lines(spark, sf_dir), pattern)


CONTEXT_SQL = """
, hits AS (SELECT row_id FROM text_lines WHERE regexp_matches(line, '{pattern}'){limit})
SELECT h.row_id, string_agg((case when t.row_id = h.row_id then '>>> L' else '    L' end) ||
  (t.row_id + 1) || ': ' || t.line || chr(10), '' ORDER BY t.row_id) AS context
FROM hits h JOIN text_lines t ON t.row_id BETWEEN h.row_id - 2 AND h.row_id + 2
GROUP BY h.row_id"""


@query(
    "search_with_context",
    TEXTS + CONTEXT_SQL.format(pattern="[0-9]{4}", limit=" ORDER BY row_id LIMIT 50"),
)
def search_with_context(spark, sf_dir):
    return search.search_with_context(text_lines(spark, sf_dir), "[0-9]{4}", 2, limit=50)


@query(
    "search_all_with_context",
    TEXTS + CONTEXT_SQL.format(pattern="[0-9]{4}", limit=""),
)
def search_all_with_context(spark, sf_dir):
    return search.search_with_context(text_lines(spark, sf_dir), "[0-9]{4}", 2)


@query(
    "search_pages",
    """SELECT page_id AS row_id, html AS line FROM pages
WHERE regexp_matches(html, '<a href="/[a-z]{2,3}"')""",
)
def search_pages(spark, sf_dir):
    pages = lines_from_dataframe(table(spark, sf_dir, "pages"), "page_id", "html")
    return search.search(pages, '<a href="/[a-z]{2,3}"')


@query(
    "search_summary",
    f"""{TEXTS}, n AS (SELECT count(*) FILTER (contains(line, 'tion')) AS matches,
  count(*) AS total FROM text_lines)
SELECT 'Found ' || matches || ' match(es) for `tion` in ' || total || ' lines' AS summary, matches
FROM n""",
)
def search_summary(spark, sf_dir):
    return search.search_summary(text_lines(spark, sf_dir), "tion")


@query(
    "search_summary_none",
    "SELECT 'No matches found for pattern: `zzqqzz`' AS summary, 0::bigint AS matches",
)
def search_summary_none(spark, sf_dir):
    return search.search_summary(text_lines(spark, sf_dir), "zzqqzz")


BLANKED = """case doc_id % 5 when 0 then concat(' ', chr(9), chr(10)) when 1 then ''
  when 2 then concat(chr(160), chr(8195)) when 3 then concat(' ', lang) else text end"""


@query(
    "is_blank",
    "SELECT doc_id, doc_id % 5 in (0, 1, 2) AS blank FROM documents",
)
def is_blank(spark, sf_dir):
    wide = BLANKED.replace("chr(160)", "' '").replace("chr(8195)", "' '")
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.is_blank(F.expr(wide)).alias("blank"))


@query("is_valid_utf8_line", "SELECT doc_id, doc_id % 3 <> 0 AS valid FROM documents")
def is_valid_utf8_line(spark, sf_dir):
    broken = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF"))).cast("string")
    line = F.when(F.col("doc_id") % 3 == 0, broken).otherwise(F.col("text"))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.is_valid_utf8_line(line).alias("valid"))


@query(
    "pretty_json",
    f"""{DIRTY} SELECT row_id, case when row_id % 23 in (0, 1) then line
  when row_id % 23 = 2 then '{{' || chr(10) || '  "doc_id": ' || row_id || chr(10) || '}}'
  else '{{' || chr(10) || '  "doc_id": ' || row_id || ',' || chr(10) || '  "lang": ' || to_json(lang)
    || ',' || chr(10) || '  "source": ' || to_json(source) || ',' || chr(10) || '  "text": ' ||
    to_json(t) || chr(10) || '}}' end AS pretty FROM dirty""",
)
def pretty_json(spark, sf_dir):
    lines = dirty_lines(spark, sf_dir)
    return lines.select("row_id", json_values.pretty_json(F.col("line")).alias("pretty"))


@query(
    "truncate_preview",
    f"""{TEXTS} SELECT row_id, case when length(line) > 80 then substr(line, 1, 77) || '...'
  else line end AS shown FROM text_lines""",
)
def truncate_preview(spark, sf_dir):
    lines = text_lines(spark, sf_dir)
    return lines.select("row_id", text.truncate_preview(F.col("line"), 80).alias("shown"))


# --- lint --------------------------------------------------------------------------------------

LINT_CTE = (
    DIRTY
    + """,
kinds AS (SELECT *, row_id % 23 in (0, 1, 2) AS odd,
  (length(t) - length(replace(t, '<think>', ''))) // 7 AS opens,
  (length(t) - length(replace(t, '</think>', ''))) // 8 AS closes FROM dirty),
found AS (
  SELECT row_id, 0 AS rank, 'invalid_json' AS rule, 'ERROR' AS severity, 'Invalid JSON' AS message,
    NULL::varchar AS key, NULL::int AS open_count, NULL::int AS close_count
  FROM kinds WHERE row_id % 23 = 0
  UNION ALL
  SELECT row_id, 1, 'missing_key', 'WARNING', 'Missing required key: text', 'text', NULL, NULL
  FROM kinds WHERE row_id % 23 = 2
  UNION ALL
  SELECT row_id, 2, 'think_tags', 'ERROR', 'Unbalanced <think> tags: ' || opens || ' open, ' ||
    closes || ' close', NULL, opens::int, closes::int
  FROM kinds WHERE NOT odd AND opens <> closes
  UNION ALL
  SELECT row_id, 3, 'trailing_whitespace', 'WARNING', 'Trailing whitespace detected', NULL, NULL, NULL
  FROM kinds WHERE NOT odd AND (contains(t, ' ' || chr(10)) OR t LIKE '% ')),
issues AS (
  SELECT row_id, (row_number() OVER (PARTITION BY row_id ORDER BY rank) - 1)::int AS ordinal,
    rule, severity, message, key, open_count, close_count FROM found)"""
)


def _issues(spark, sf_dir):
    return linting.lint(dirty_lines(spark, sf_dir), ["text"])


def _plain_message(issues):
    """Parser messages differ between engines, so only their heading is compared."""
    heading = F.when(F.col("rule") == linting.INVALID_JSON, "Invalid JSON")
    return issues.withColumn("message", heading.otherwise(F.col("message")))


@query("lint", f"{LINT_CTE} SELECT * FROM issues")
def lint(spark, sf_dir):
    return _plain_message(_issues(spark, sf_dir))


@query("lint_invalid_json", f"{LINT_CTE} SELECT * FROM issues WHERE rule = 'invalid_json'")
def lint_invalid_json(spark, sf_dir):
    return _plain_message(linting.lint_invalid_json(dirty_lines(spark, sf_dir)))


@query("lint_missing_keys", f"{LINT_CTE} SELECT * FROM issues WHERE rule = 'missing_key'")
def lint_missing_keys(spark, sf_dir):
    return linting.lint_missing_keys(dirty_lines(spark, sf_dir), ["text"])


@query("lint_think_tags", f"{LINT_CTE} SELECT * FROM issues WHERE rule = 'think_tags'")
def lint_think_tags(spark, sf_dir):
    return linting.lint_think_tags(dirty_lines(spark, sf_dir))


@query(
    "lint_trailing_whitespace",
    f"{LINT_CTE} SELECT * FROM issues WHERE rule = 'trailing_whitespace'",
)
def lint_trailing_whitespace(spark, sf_dir):
    return linting.lint_trailing_whitespace(dirty_lines(spark, sf_dir))


BLANK_MESSAGE = "case conv_id % 4 when 0 then ' ' when 1 then '' else text end"


@query(
    "lint_empty_content",
    """SELECT conv_id * 1000 + turn AS row_id, 'empty_content' AS rule, 'WARNING' AS severity,
  'Empty content field' AS message FROM conversations WHERE conv_id % 4 in (0, 1)""",
)
def lint_empty_content(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"),
        F.to_json(F.struct("role", F.expr(BLANK_MESSAGE).alias("content"))).alias("line"),
    )
    issues = linting.lint_empty_content(turns)
    return issues.select("row_id", "rule", "severity", "message")


@query("lint_summary", f"{LINT_CTE} SELECT count(*) AS issues FROM issues")
def lint_summary(spark, sf_dir):
    return linting.lint_summary(_issues(spark, sf_dir))


@query(
    "lint_counts",
    f"{LINT_CTE} SELECT rule, severity, count(*) AS issues FROM issues GROUP BY rule, severity",
)
def lint_counts(spark, sf_dir):
    return linting.lint_counts(_issues(spark, sf_dir))


@query("lint_report", f"{LINT_CTE} SELECT 'Found ' || count(*) || ' issues' AS report FROM issues")
def lint_report_query(spark, sf_dir):
    return lint_report(linting.lint_summary(_issues(spark, sf_dir)))


@query("first_issue", f"{LINT_CTE} SELECT * FROM issues WHERE ordinal = 0")
def first_issue(spark, sf_dir):
    return linting.first_issue(_plain_message(_issues(spark, sf_dir)))


@query(
    "rows_with_issues",
    f"{LINT_CTE} SELECT row_id, line FROM dirty WHERE row_id IN (SELECT row_id FROM issues)",
)
def rows_with_issues(spark, sf_dir):
    return linting.rows_with_issues(dirty_lines(spark, sf_dir), _issues(spark, sf_dir))


@query(
    "failing_rows",
    f"{LINT_CTE} SELECT row_id, line FROM dirty WHERE row_id IN (SELECT row_id FROM issues)",
)
def failing_rows(spark, sf_dir):
    return linting.failing_rows(dirty_lines(spark, sf_dir), ["text"])


@query(
    "extract_text",
    f"""{DIRTY} SELECT row_id, case when row_id % 23 in (0, 1) then null
  when row_id % 23 = 2 then '' else ' ' || lang || ' ' || source || ' ' || t end AS text FROM dirty""",
)
def extract_text(spark, sf_dir):
    lines = dirty_lines(spark, sf_dir)
    return lines.select("row_id", json_values.extract_text(F.col("line")).alias("text"))


@query(
    "annotate",
    f"""{LINT_CTE}, firsts AS (SELECT min(row_id) AS row_id FROM dirty GROUP BY line),
marked AS (SELECT row_id, line, case when row_id IN (SELECT row_id FROM issues) then 'error'
  when row_id NOT IN (SELECT row_id FROM firsts) then 'duplicate' else 'ok' end AS status FROM dirty)
SELECT row_id, line, status, case when status = 'duplicate' then 'DUP' else '' end AS label
FROM marked""",
)
def annotate(spark, sf_dir):
    lines = dirty_lines(spark, sf_dir)
    return annotation.annotate(lines, _issues(spark, sf_dir), dedup_exact(lines))
