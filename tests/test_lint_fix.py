from pyspark.sql import functions as F

from linewright.operators import annotate as annotation
from linewright.operators import dedup, fix, lint
from linewright.sources import writers


def rules(frame):
    return sorted((r.row_id, r.rule) for r in frame.collect())


def test_rules(lines_of):
    lines = lines_of(
        '{"a":"x","b":1}',
        '{"a":1,"b":"x"}',
        '{"a":"x","b":"\\ny"}',
        '{"a":"tab\\t"}',
        '{"text":"<think>a"}',
        '{"t":"</think>a<think>"}',
        "[]",
        "5",
        "not json {",
        "   ",
        '{"a":1} trailing',
    )
    assert rules(lint.lint(lines)) == [
        (0, "trailing_whitespace"),
        (2, "trailing_whitespace"),
        (4, "think_tags"),
        (8, "invalid_json"),
        (10, "invalid_json"),
    ]
    assert rules(lint.lint(lines, per_leaf=True)) == [
        (4, "think_tags"),
        (8, "invalid_json"),
        (10, "invalid_json"),
    ]


def test_order_and_messages(lines_of):
    issues = lint.lint(lines_of('{"text":"<think>a "}'), ["id", "text", "name"]).orderBy("ordinal")
    found = [(r.ordinal, r.severity, r.message) for r in issues.collect()]
    assert found == [
        (0, "WARNING", "Missing required key: id"),
        (1, "WARNING", "Missing required key: name"),
        (2, "ERROR", "Unbalanced <think> tags: 1 open, 0 close"),
        (3, "WARNING", "Trailing whitespace detected"),
    ]
    first = lint.first_issue(issues).collect()
    assert [(r.row_id, r.key) for r in first] == [(0, "id")]


def test_required_keys_only_for_objects(lines_of):
    issues = lint.lint(lines_of('[{"a":1}]', "3", '{"a":1}'), lint.parse_required_keys(" b , ,a"))
    assert [(r.row_id, r.key) for r in issues.collect()] == [(2, "b")]


def test_empty_content_is_optional(lines_of):
    lines = lines_of('{"m":[{"content":" "}]}', '{"text":""}', '{"title":""}')
    assert rules(lint.lint(lines)) == [(0, "trailing_whitespace")]
    assert rules(lint.lint_empty_content(lines)) == [(0, "empty_content"), (1, "empty_content")]


def test_invalid_utf8_is_skipped(spark):
    raw = spark.createDataFrame([(0, bytearray(b'{"a":"\xff"}')), (1, bytearray(b"{"))], "row_id bigint, b binary")
    lines = raw.select("row_id", F.col("b").cast("string").alias("line"))
    assert rules(lint.lint(lines)) == [(1, "invalid_json")]
    assert [r.row_id for r in fix.fix(lines).collect()] == [1]
    assert fix.fix(lines).count() == 1


def fixed(lines_of, line, **options):
    return fix.fix(lines_of(line), **options).first()


def chat(content):
    return '{"messages":[{"role":"assistant","content":' + content + "}]}"


def test_fix_outcomes(lines_of):
    row = fixed(lines_of, '{"content": "hello world   "}')
    assert (row.outcome, row.fixed, row.fixes) == (
        "fixed",
        '{"content":"hello world"}',
        ["Removed trailing whitespace"],
    )
    row = fixed(lines_of, chat('"<think>thinking here"'))
    assert row.fixed == '{"messages":[{"content":"<think>thinking here</think>","role":"assistant"}]}'
    assert row.fixes == ["Added missing </think> tag"]
    row = fixed(lines_of, chat('"<think>ok</think>answer"'))
    assert row.outcome == "unchanged" and row.fixes == []
    row = fixed(lines_of, '{"broken json')
    assert row.outcome == "skipped" and row.skip_reason.startswith("Invalid JSON: ")
    row = fixed(lines_of, " ")
    assert (row.outcome, row.skip_reason, row.fixed) == ("skipped", "Empty line", None)


def test_fix_scope(lines_of):
    """Tags are only repaired in assistant content that is a string; keys never change."""
    row = fixed(lines_of, '{"role":"user","content":"<think>a"}')
    assert row.outcome == "unchanged"
    row = fixed(lines_of, '{"role":"assistant","content":["x "]}')
    assert row.outcome == "unchanged"
    row = fixed(lines_of, '{"k ":["x \\ny  "]}')
    assert row.fixed == '{"k ":["x\\ny"]}'
    assert row.fixes == ["Removed trailing whitespace", "Trimmed whitespace before newlines"]


def test_fix_keeps_original_bytes_on_request(lines_of):
    line = '{"b": 1, "a": 2}'
    assert fixed(lines_of, line).fixed == '{"a":2,"b":1}'
    assert fixed(lines_of, line, canonicalize=False).fixed == line


def test_summaries_and_policy(lines_of):
    result = fix.fix(lines_of('{"a":"x "}', '{"a":"y "}', "{}", "bad", ""))
    assert fix.fix_summary(result).first().asDict() == {
        "total_lines": 5,
        "fixed_lines": 2,
        "unchanged_lines": 1,
        "skipped_lines": 2,
    }
    assert [tuple(r) for r in fix.fix_counts_by_type(result).collect()] == [
        ("Removed trailing whitespace", 2)
    ]
    kept = fix.skip_policy(result).orderBy("row_id").collect()
    assert [r.line for r in kept] == ['{"a":"x"}', '{"a":"y"}', "{}", "bad", ""]
    assert fix.skip_policy(result, skip_invalid=True).count() == 3
    log = [r.entry for r in fix.rejected_lines(result).orderBy("line_number").collect()]
    assert log[1] == "Line 5: Empty line (kept as-is)"
    report = writers.fix_report(fix.fix_summary(result)).first().report
    assert report == "Total lines: 5 | Fixed lines: 2 | Unchanged lines: 1 | Skipped lines: 2"


def test_annotate(lines_of):
    lines = lines_of('{"a":1}', '{"a":1}', "bad", "bad", '{"a":2}')
    marked = annotation.annotate(lines, lint.lint(lines), dedup.dedup_exact(lines))
    found = [(r.row_id, r.status, r.label) for r in marked.orderBy("row_id").collect()]
    assert found == [
        (0, "ok", ""),
        (1, "duplicate", "DUP"),
        (2, "error", ""),
        (3, "error", ""),
        (4, "ok", ""),
    ]
