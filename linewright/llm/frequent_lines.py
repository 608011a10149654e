"""Quality rules: word and line counts, and lines that too many documents of a host share.

Lines are normalised (A-Z lower-cased, white space collapsed), hashed, and counted per host by
the distinct documents that hold them.  Lines above the limit are removed; a document that
keeps too little of itself is rejected.

Copies of one document are not distinct documents.  Documents with the same set of normalised
lines are one, exactly.  A line that more than ``max_documents`` of them hold is a candidate.
Documents that are candidate lines for more than 80 % of their words are near copies where these
lines are the same, and count once; they are known by the two least hashes of these lines, as one
near copy may lack a line of the other.  All others count each.  A candidate that still has more
than ``max_documents`` documents is removed.

Everything is built from DataFrame functions.  The text is read once; a narrow table of line
hashes is written and all counting runs on it.

Defined results: a NULL text has no words and fails the base rules; a NULL host is a host of
its own; repeated rows each get the same result; a NULL doc_id is kept as it is; an empty table
gives no rows; extra columns are ignored by ``line_verdicts`` and kept by ``without_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.plans.durable import written

WHITE = r"[\x20\x09-\x0D]+"
NOT_WHITE = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
# A line of more distinct documents than this, in one host, is removed.
MAX_DOCUMENTS = 10
# A document with less than this share of its words left is rejected.
MIN_LEFT_PERCENT = 30
# Documents with more than this share of their words in the same shared lines are near copies.
NEAR_COPY_PERCENT = 80
# At most this many frequent lines (about 50 bytes each) are broadcast.
MAX_BROADCAST_LINES = 500_000
# Rows of one line that a salt stands for, where frequent lines are too many to broadcast.
SALT_ROWS = 200_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def lines_of(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_WHITE))


def normalised(line: Column) -> Column:
    return F.translate(F.trim(F.regexp_replace(line, WHITE, " ")), _UPPER, _UPPER.lower())


def line_key(line: Column) -> Column:
    """60 bits of the MD5 of the normalised line."""
    return F.conv(F.substring(F.md5(normalised(line)), 1, 15), 16, 10).cast("long")


def _covered(positions: Column) -> Column:
    """Number of places in windows that start at the sorted ``positions``."""
    following = F.concat(F.slice(positions, 2, F.size(positions)), F.array(F.lit(1 << 30)))
    gaps = F.zip_with(following, positions, lambda b, a: F.least(b - a, F.lit(WINDOW)))
    total = F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)
    return F.when(F.size(positions) > 0, total).otherwise(F.lit(0).cast("long"))


def text_statistics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and ``_lines``.

    Windows are compared by a 64-bit hash of their words.  Each step is a projection of its
    own, so that arrays used more than once are computed once.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    one = docs.withColumns({"_text": text, "_split": words_of(text), "_lines": lines_of(text)})
    two = one.withColumns(
        {
            "n_words": F.size("_split").cast("long"),
            "word_chars": F.length(F.translate("_text", " \t\n\v\f\r", "")).cast("long"),
            "n_symbols": (
                F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))
            ).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_hashes": F.transform("_split", lambda w: F.xxhash64(w)),
        }
    ).drop("_split", "_text")
    starts = F.sequence(F.lit(0), F.size("_hashes") - WINDOW)
    windows = F.when(
        F.size("_hashes") >= WINDOW,
        F.transform(
            starts, lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)])
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    three = two.withColumn("_windows", windows).drop("_hashes")
    # Sorted by hash, equal windows are neighbours; most texts have none and sort nothing.
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    pairs = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    four = three.withColumn(
        "_sorted", F.when(some, F.array_sort(pairs)).otherwise(F.slice(pairs, 1, 0))
    ).drop("_windows")
    equal = F.filter(
        "_sorted",
        lambda x, k: (x["h"] == F.get("_sorted", k - 1)["h"])
        | (x["h"] == F.get("_sorted", k + 1)["h"]),
    )
    found = F.array_sort(F.transform(equal, lambda x: x["i"]))
    five = four.withColumn("_found", found).drop("_sorted")
    return five.withColumn("n_repeat_words", _covered(F.col("_found"))).drop("_found")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )


def _marked(lines: DataFrame, frequent: DataFrame, n_frequent: int) -> DataFrame:
    """``lines`` (``row, host, key, ...``) with ``marked``: whether the line is in ``frequent``.

    A table of checked size is broadcast; beyond it hot lines are salted by their measured rows.
    """
    wanted = frequent.select(
        F.col("host").alias("_host"), F.col("key").alias("_key"), F.lit(True).alias("_mark")
    )
    same = F.col("host").eqNullSafe(F.col("_host")) & (F.col("key") == F.col("_key"))
    if n_frequent <= MAX_BROADCAST_LINES:
        joined = lines.join(F.broadcast(wanted), same, "left")
    else:
        largest = frequent.agg(F.max("n_rows")).first()[0] or 1
        salts = -(-largest // SALT_ROWS)
        salted = lines.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
        spread = wanted.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = salted.join(spread, same & (F.col("_salt") == F.col("_slot")), "left")
    marked = F.coalesce(F.col("_mark"), F.lit(False)).alias("marked")
    return joined.select(*lines.columns, marked)


def _candidates(keyed: DataFrame, max_documents: int) -> DataFrame:
    """``host, key, n_rows`` of the lines of more than ``max_documents`` different line sets.

    The first aggregation spreads a line over the documents that hold it, so a line of every
    document meets in no single task.
    """
    held = keyed.select("host", "whole", F.explode(F.array_distinct(F.col("lines.key"))).alias("key"))
    by_document = held.groupBy("host", "key", "whole").agg(F.count(F.lit(1)).alias("_rows"))
    by_line = by_document.groupBy("host", "key").agg(
        F.count(F.lit(1)).alias("_documents"), F.sum("_rows").alias("n_rows")
    )
    return by_line.filter(F.col("_documents") > max_documents).drop("_documents")


def frequent_lines(keyed: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """``host, key, n_rows`` of the lines above the limit.

    ``keyed`` has ``row``, ``host``, ``whole`` (hash of the line set) and ``lines``.
    """
    candidates, n_candidates = written(
        _candidates(keyed, max_documents), "candidate-lines", narrow=True
    )
    lines = keyed.select("row", "host", "whole", F.inline("lines"))
    # One row per document again: its lines are in one task, so little is shuffled.
    known = (
        _marked(lines, candidates, n_candidates)
        .groupBy("row", "host", "whole")
        .agg(
            F.collect_set(F.when(F.col("marked"), F.col("key"))).alias("keys"),
            F.sum(F.when(F.col("marked"), F.col("words")).otherwise(0)).alias("shared"),
            F.sum("words").alias("words"),
        )
        .filter(F.size("keys") > 0)
    )
    near = F.col("shared") * 100 > F.col("words") * NEAR_COPY_PERCENT
    least = F.slice(F.array_sort("keys"), 1, 2)
    document = F.struct(near.alias("near"), F.when(near, F.xxhash64(least)).otherwise(F.col("whole")))
    counted = (
        known.select("host", document.alias("document"), F.explode("keys").alias("key"))
        .groupBy("host", "key")
        .agg(F.countDistinct("document").alias("_documents"), F.count(F.lit(1)).alias("n_rows"))
    )
    return counted.filter(F.col("_documents") > max_documents).drop("_documents")


def line_verdicts(
    docs: DataFrame,
    max_documents: int = MAX_DOCUMENTS,
    min_left_percent: int = MIN_LEFT_PERCENT,
    id_column: str = "doc_id",
    text_column: str = "text",
    host_column: str = "source",
) -> DataFrame:
    """Verdict per row: counts, ``base_failed``, ``n_left`` (words left), ``keys``, ``kept``.

    ``keys`` are the hashes of the lines to remove (NULL: none); ``digest``, a 64-bit hash of
    host and text, tells rows of one doc_id apart.
    """
    source = docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(host_column).alias("host"),
        F.col(text_column).alias("text"),
        document_digest(F.col(host_column), F.col(text_column)).alias("digest"),
    )
    lines = F.transform(
        "_lines",
        lambda line: F.struct(
            line_key(line).alias("key"),
            F.size(words_of(line)).cast("long").alias("words"),
        ),
    )
    counted = text_statistics(source).withColumn("lines", lines).drop("text", "_lines")
    whole = F.xxhash64(F.array_sort(F.array_distinct(F.col("lines.key"))))
    keyed, _ = written(
        counted.withColumns({"whole": whole, "row": F.monotonically_increasing_id()}),
        "line-keys",
    )
    frequent, n_frequent = written(
        frequent_lines(keyed, max_documents), "frequent-lines", narrow=True
    )
    # A common line stays hot here only as rows on the far side of a broadcast or salted join.
    removed = (
        _marked(keyed.select("row", "host", F.inline("lines")), frequent, n_frequent)
        .filter("marked")
        .groupBy("row")
        .agg(F.sum("words").alias("n_removed"), F.collect_set("key").alias("keys"))
    )
    left = F.col("n_words") - F.coalesce(F.col("n_removed"), F.lit(0))
    depleted = left * 100 < F.col("n_words") * min_left_percent
    return keyed.join(removed, "row", "left").select(
        "doc_id",
        "digest",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        left.alias("n_left"),
        "keys",
        (~base_failed() & ~depleted).alias("kept"),
    )


def document_digest(host: Column, text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), host)


def clean_documents(
    docs: DataFrame,
    max_documents: int = MAX_DOCUMENTS,
    min_left_percent: int = MIN_LEFT_PERCENT,
    id_column: str = "doc_id",
    text_column: str = "text",
    host_column: str = "source",
) -> DataFrame:
    """The documents that are kept, without their frequent lines; columns as in ``docs``."""
    verdicts = line_verdicts(
        docs, max_documents, min_left_percent, id_column, text_column, host_column
    )
    kept = (
        verdicts.filter("kept")
        .select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "keys")
        .withColumnRenamed("keys", "_keys")
        .dropDuplicates(["_id", "_digest"])
    )
    others = [F.col(c) for c in docs.columns if c != text_column]
    packed = docs.select(
        F.struct(*others).alias("row"),
        F.col(id_column).alias("key"),
        document_digest(F.col(host_column), F.col(text_column)).alias("digest"),
        F.col(text_column).alias("text"),
    )
    same = F.col("key").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    cleaned = without_lines(F.col("text"), F.col("_keys")).alias(text_column)
    return packed.join(kept, same).select("row.*", cleaned).select(*docs.columns)


def without_lines(text: Column, keys: Column) -> Column:
    """The text without the lines whose hash is in ``keys``; other lines stay as they are."""
    left = F.filter(F.split(text, "\n"), lambda line: ~F.array_contains(keys, line_key(line)))
    return F.when(F.size(keys) > 0, F.array_join(left, "\n")).otherwise(text)
