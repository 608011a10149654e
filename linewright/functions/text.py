"""Native column expressions on line text and byte sizes.

All of these stay inside Catalyst; none needs Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rust-style regular expressions treat classes as Unicode and only ``\n`` as a line
# terminator; ``(?Ud)`` gives Java's engine the same reading.
UNICODE_FLAGS = "(?Ud)"


def is_blank(line: Column) -> Column:
    """True where the line holds nothing but Unicode white space.

    Looking for one non-space character stops at the first hit, so long lines cost
    no more than short ones.
    """
    return ~line.rlike(r"(?U)\S")


def is_valid_utf8_line(line: Column) -> Column:
    return F.is_valid_utf8(line)


def trim_line(line: Column) -> Column:
    """Strip Unicode white space at both ends (``trim`` strips spaces only)."""
    return F.regexp_replace(line, r"(?U)^\s++|\s++\z", "")


def strip_trailing_whitespace(text: Column) -> Column:
    """Drop Unicode white space, including newlines and tabs, at the end."""
    return F.regexp_replace(text, r"(?U)(?<!\s)\s++\z", "")


def strip_space_before_newline(text: Column) -> Column:
    """Drop the run of spaces that ends a line inside the text."""
    return F.regexp_replace(text, r"(?<! ) ++\n", "\n")


def count_literal(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal string."""
    removed = F.length(F.replace(text, F.lit(needle), F.lit("")))
    return F.floor((F.length(text) - removed) / F.lit(len(needle))).cast("int")


def truncate_preview(line: Column, width: int) -> Column:
    """Cut to ``width`` characters, the last three being ``...``."""
    if width < 3:
        raise ValueError("width must be at least 3")
    return F.when(
        F.length(line) > width, F.concat(F.left(line, F.lit(width - 3)), F.lit("..."))
    ).otherwise(line)


def numbered(row_id: Column, line: Column) -> Column:
    """``L{n}: {line}`` with 1-based ``n``."""
    return F.concat(F.lit("L"), (row_id + 1).cast("string"), F.lit(": "), line)


def size_human(size: Column, decimals: int = 2) -> Column:
    """Bytes as ``B``/``KB``/``MB``/``GB`` in powers of 1024; plain bytes have no decimals."""
    kb, mb, gb = 1024, 1024**2, 1024**3

    def scaled(unit: int, name: str) -> Column:
        value = F.bround(size.cast("double") / F.lit(float(unit)), decimals)  # ties to even
        return F.format_string(f"%.{decimals}f {name}", value)

    return (
        F.when(size >= gb, scaled(gb, "GB"))
        .when(size >= mb, scaled(mb, "MB"))
        .when(size >= kb, scaled(kb, "KB"))
        .otherwise(F.concat(size.cast("string"), F.lit(" B")))
    )


def format_size(size: Column) -> Column:
    """The one-decimal variant of :func:`size_human`."""
    return size_human(size, decimals=1)


# --- reasoning tags on one text column ------------------------------------------------

# The tags of reasoning.
OPEN_TAG = "<think>"
CLOSE_TAG = "</think>"


def close_think_tag(text: Column) -> Column:
    """Add one ``</think>`` when tags are short of closers and the last opener has none.

    The closer goes before the first blank line after that opener, or at the end.
    """
    last_open = (
        F.length(text) - F.instr(F.reverse(text), OPEN_TAG[::-1]) - F.lit(len(OPEN_TAG)) + 2
    )
    head = F.left(text, last_open + F.lit(len(OPEN_TAG) - 1))
    rest = F.substring(text, last_open + F.lit(len(OPEN_TAG)), F.length(text))
    gap = F.instr(rest, "\n\n")
    closed = F.when(gap == 0, F.concat(rest, F.lit(CLOSE_TAG))).otherwise(
        F.concat(F.left(rest, gap - 1), F.lit(CLOSE_TAG), F.substring(rest, gap, F.length(rest)))
    )
    unbalanced = count_literal(text, OPEN_TAG) > count_literal(text, CLOSE_TAG)
    dangling = ~F.contains(rest, F.lit(CLOSE_TAG))
    return F.when(unbalanced & dangling, F.concat(head, closed)).otherwise(text)


def open_think_tag(text: Column) -> Column:
    """Prepend ``<think>`` once per closer that has no opener."""
    missing = count_literal(text, CLOSE_TAG) - count_literal(text, OPEN_TAG)
    return F.when(missing > 0, F.concat(F.repeat(F.lit(OPEN_TAG), missing), text)).otherwise(text)
