"""Regular-expression search over raw lines, with surrounding lines on request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.functions.text import UNICODE_FLAGS, numbered
from linewright.operators.halo import hit_contexts
from linewright.operators.rows import first_n_matches, line_count

# With this many wanted rows or fewer, their ids are sent to the lines.
MAX_BROADCAST_ROWS = 1_000_000


def _is_hit(pattern: str) -> Column:
    return F.col("line").rlike(UNICODE_FLAGS + pattern) & F.is_valid_utf8("line")


def search(lines: DataFrame, pattern: str, limit: int | None = None) -> DataFrame:
    """Lines the pattern matches anywhere; the first ``limit`` in row order if given.

    Java syntax with Unicode classes; a malformed pattern fails the query.  Lines that
    are not valid UTF-8 never match.
    """
    found = lines.filter(_is_hit(pattern))
    return found if limit is None else first_n_matches(found, limit)


def search_with_context(
    lines: DataFrame, pattern: str, context: int, limit: int | None = None
) -> DataFrame:
    """Each hit with ``context`` lines on either side, as ``row_id``, ``context``.

    The hit is marked ``>>>``; overlapping contexts repeat their lines.  Without a limit the lines
    are scanned once, and contexts inside a run of consecutive rows are finished there; only the
    first and last rows of runs are joined.  With a limit the few wanted row ids are sent to the
    lines.
    """
    if limit is None:
        found = hit_contexts(lines, _is_hit(pattern), context, MAX_BROADCAST_ROWS)
    else:
        hits = search(lines, pattern, limit).select(F.col("row_id").alias("_hit"))
        around = F.sequence(F.greatest(F.col("_hit") - context, F.lit(0)), F.col("_hit") + context)
        wanted = hits.select("_hit", F.explode(around).alias("row_id"))
        if limit * (2 * context + 1) <= MAX_BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        pieces = lines.filter(F.is_valid_utf8("line")).join(wanted, "row_id")
        ordered = F.array_sort(F.collect_list(F.struct("row_id", "line")))
        found = pieces.groupBy(F.col("_hit")).agg(ordered.alias("rows"))
        found = found.withColumnRenamed("_hit", "row_id")
    return found.select("row_id", _context_text().alias("context"))


def _context_text() -> Column:
    def text(row: Column) -> Column:
        marker = F.when(row["row_id"] == F.col("row_id"), ">>> ").otherwise("    ")
        return F.concat(marker, numbered(row["row_id"], row["line"]), F.lit("\n"))

    return F.array_join(F.transform("rows", text), "")


def search_summary(lines: DataFrame, pattern: str, limit: int | None = None) -> DataFrame:
    """One row: ``Found n match(es) for `p` in N lines`` or a note that there are none.

    With a limit, a count that reaches it is called that of the first matches.
    """
    found = search(lines, pattern, limit).agg(F.count(F.lit(1)).alias("matches"))
    total = line_count(lines).scalar()
    some = F.format_string(
        "Found %d match(es) for `%s` in %d lines", F.col("matches"), F.lit(pattern), total
    )
    if limit is not None:
        first = F.format_string(
            "Found the first %d match(es) for `%s` in %d lines", F.col("matches"), F.lit(pattern), total
        )
        some = F.when(F.col("matches") == limit, first).otherwise(some)
    none = F.lit(f"No matches found for pattern: `{pattern}`")
    return found.select(
        F.when(F.col("matches") == 0, none).otherwise(some).alias("summary"), "matches"
    )
