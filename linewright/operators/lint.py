"""Lint rules over record lines: one output row per issue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.functions.json_values import line_facts
from linewright.functions.text import is_blank
from linewright.plans.bitmaps import with_flags

INVALID_JSON = "invalid_json"
MISSING_KEY = "missing_key"
THINK_TAGS = "think_tags"
TRAILING_WHITESPACE = "trailing_whitespace"
EMPTY_CONTENT = "empty_content"

# Severity per rule.
SEVERITIES = {
    INVALID_JSON: "ERROR",
    MISSING_KEY: "WARNING",
    THINK_TAGS: "ERROR",
    TRAILING_WHITESPACE: "WARNING",
    EMPTY_CONTENT: "WARNING",
}


def parse_required_keys(option: str | None) -> list[str]:
    """Comma-separated key list, trimmed; empty entries are dropped."""
    return [key for key in (part.strip() for part in (option or "").split(",")) if key]


def lint_severity(rule: Column) -> Column:
    errors = [name for name, level in SEVERITIES.items() if level == "ERROR"]
    return F.when(rule.isin(errors), "ERROR").otherwise("WARNING")


def lint_message(
    rule: Column, key: Column, opens: Column, closes: Column, error: Column
) -> Column:
    # The messages of issues.
    return (
        F.when(rule == INVALID_JSON, F.concat(F.lit("Invalid JSON: "), error))
        .when(rule == MISSING_KEY, F.concat(F.lit("Missing required key: "), key))
        .when(
            rule == THINK_TAGS,
            F.format_string("Unbalanced <think> tags: %d open, %d close", opens, closes),
        )
        .when(rule == TRAILING_WHITESPACE, F.lit("Trailing whitespace detected"))
        .otherwise(F.lit("Empty content field"))
    )


def _issue(rule: str, **fields: Column) -> Column:
    def part(name: str, kind: str) -> Column:
        return fields.get(name, F.lit(None)).cast(kind).alias(name)

    return F.struct(
        F.lit(rule).alias("rule"),
        part("key", "string"),
        part("open_count", "int"),
        part("close_count", "int"),
        part("error", "string"),
    )


def _facts(required_keys: Sequence[str], per_leaf: bool, check_empty: bool) -> Column:
    """Parse facts of ``line``; NULL for blank lines and lines that are not valid UTF-8.

    Such lines are masked rather than filtered out: a filter on a computed line would
    compute the line again.
    """
    line = F.when(~is_blank(F.col("line")), F.col("line"))
    return line_facts(line, tuple(required_keys), per_leaf, check_empty)


def _issues_of(facts: Column, check_empty: bool) -> Column:
    """The issues of a line in rule order, as an array; NULL facts give NULL."""
    kind = "array<struct<rule:string,key:string,open_count:int,close_count:int,error:string>>"
    none = F.array().cast(kind)

    def when(hit: Column, issue: Column) -> Column:
        return F.when(hit, F.array(issue).cast(kind)).otherwise(none)

    opens, closes = facts["opens"], facts["closes"]
    missing = F.transform(facts["missing"], lambda key: _issue(MISSING_KEY, key=key))
    parts = [
        when(~facts["valid"], _issue(INVALID_JSON, error=facts["error"])),
        F.coalesce(missing, none),
        when(opens != closes, _issue(THINK_TAGS, open_count=opens, close_count=closes)),
        when(facts["trailing"], _issue(TRAILING_WHITESPACE)),
    ]
    if check_empty:
        parts.append(when(facts["blank_content"], _issue(EMPTY_CONTENT)))
    return F.when(facts.isNotNull(), F.concat(*parts))


def lint(
    lines: DataFrame,
    required_keys: Sequence[str] = (),
    per_leaf: bool = False,
    check_empty: bool = False,
) -> DataFrame:
    """All rules over all non-blank lines, one row per issue.

    The text rules look at all string leaves joined by one space, where other leaves
    count as empty strings; ``per_leaf`` checks white space in each string by itself.
    ``check_empty`` adds the rule for blank ``content``/``text`` strings.  The plan is one
    narrow stage: a single parse per line, then native columns.
    """
    # The outer form keeps Spark from filtering on the array before building it.
    issues = (
        lines.select("row_id", _facts(required_keys, per_leaf, check_empty).alias("facts"))
        .select("row_id", _issues_of(F.col("facts"), check_empty).alias("found"))
        .select("row_id", F.posexplode_outer("found").alias("ordinal", "issue"))
        .filter(F.col("ordinal").isNotNull())
    )
    issue = F.col("issue")
    return issues.select(
        "row_id",
        "ordinal",
        issue["rule"].alias("rule"),
        lint_severity(issue["rule"]).alias("severity"),
        lint_message(
            issue["rule"], issue["key"], issue["open_count"], issue["close_count"], issue["error"]
        ).alias("message"),
        issue["key"].alias("key"),
        issue["open_count"].alias("open_count"),
        issue["close_count"].alias("close_count"),
    )


def lint_rule(lines: DataFrame, rule: str, required_keys: Sequence[str] = ()) -> DataFrame:
    """The issues of one rule."""
    found = lint(lines, required_keys, check_empty=rule == EMPTY_CONTENT)
    return found.filter(F.col("rule") == rule)


def lint_invalid_json(lines: DataFrame) -> DataFrame:
    return lint_rule(lines, INVALID_JSON)


def lint_missing_keys(lines: DataFrame, required_keys: Sequence[str]) -> DataFrame:
    return lint_rule(lines, MISSING_KEY, required_keys)


def lint_think_tags(lines: DataFrame) -> DataFrame:
    return lint_rule(lines, THINK_TAGS)


def lint_trailing_whitespace(lines: DataFrame) -> DataFrame:
    return lint_rule(lines, TRAILING_WHITESPACE)


def lint_empty_content(lines: DataFrame) -> DataFrame:
    return lint_rule(lines, EMPTY_CONTENT)


def lint_summary(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count(F.lit(1)).alias("issues"))


def lint_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("issues"))


def first_issue(issues: DataFrame) -> DataFrame:
    """The first issue of each row that has one."""
    rest = [c for c in issues.columns if c not in ("row_id", "ordinal")]
    first = F.min_by(F.struct("ordinal", *rest), "ordinal")
    return issues.groupBy("row_id").agg(first.alias("_first")).select("row_id", "_first.*")


def rows_with_issues(lines: DataFrame, issues: DataFrame) -> DataFrame:
    """Lines that appear in a table of issues, found by bitmaps: the lines are not shuffled."""
    marks = issues.select("row_id", F.lit(True).alias("_issue"))
    return with_flags(lines, marks, ["_issue"]).filter("_issue").select(*lines.columns)


def failing_rows(
    lines: DataFrame, required_keys: Sequence[str] = (), per_leaf: bool = False
) -> DataFrame:
    """Lines with at least one issue, found while reading them: no join, no shuffle."""
    checked = lines.select("*", _facts(required_keys, per_leaf, False).alias("_facts"))
    found = F.size(_issues_of(F.col("_facts"), False)) > 0
    return checked.filter(F.coalesce(found, F.lit(False))).select(*lines.columns)
