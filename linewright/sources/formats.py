"""File formats: detection by extension and parsing of the user's choice."""

from __future__ import annotations

import logging
import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

JSONL, PARQUET, CSV, TSV = "jsonl", "parquet", "csv", "tsv"

# Display names and accepted option spellings.
FORMAT_NAMES = {JSONL: "JSONL", PARQUET: "Parquet", CSV: "CSV", TSV: "TSV"}
EXTENSIONS = {"parquet": PARQUET, "pq": PARQUET, "csv": CSV, "tsv": TSV}
OPTIONS = {
    "jsonl": JSONL,
    "json": JSONL,
    "ndjson": JSONL,
    "parquet": PARQUET,
    "pq": PARQUET,
    "csv": CSV,
    "tsv": TSV,
}


def detect_format(path: str) -> str:
    """Format by file extension, case-sensitive; anything unknown is JSONL."""
    _, extension = posixpath.splitext(posixpath.basename(path.rstrip("/")))
    return EXTENSIONS.get(extension[1:], JSONL)


def detect_format_col(path: Column) -> Column:
    """:func:`detect_format` for a column of paths."""
    extension = F.regexp_extract(path, r"[^/]\.([^./]*)/*$", 1)
    choice = F.when(extension.isin("parquet", "pq"), PARQUET)
    return choice.when(extension == "csv", CSV).when(extension == "tsv", TSV).otherwise(JSONL)


def parse_format(option: str | None, path: str) -> str:
    """Format the user asked for; ``auto`` or an unknown word falls back to detection."""
    word = (option or "auto").lower()
    if word in OPTIONS:
        return OPTIONS[word]
    if word != "auto":
        log.warning("unknown format %r, detecting it from the path", option)
    return detect_format(path)


def parse_format_col(option: Column, path: Column) -> Column:
    """:func:`parse_format` for columns of options and paths."""
    words = F.create_map(*[F.lit(x) for pair in OPTIONS.items() for x in pair])
    return F.coalesce(F.element_at(words, F.lower(option)), detect_format_col(path))


def format_name_col(fmt: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in FORMAT_NAMES.items() for x in pair])
    return F.coalesce(F.element_at(names, fmt), fmt)
