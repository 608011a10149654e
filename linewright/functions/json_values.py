"""Strict JSON per line, as Arrow UDFs.

Spark's JSON functions are lenient (trailing text, single quotes, raw control
characters), so validity is decided by Python's parser plus the checks below.  One
UDF call parses a line once; everything derived from the parse leaves in one struct.
"""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from linewright.functions.batches import by_runs

# The code points Unicode calls White_Space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
MAX_DEPTH = 127

OPEN_TAG = "<think>"
CLOSE_TAG = "</think>"
# How repairs are called in reports.
FIX_CLOSED = "Added missing </think> tag"
FIX_OPENED = "Added missing <think> tag"
FIX_TRAILING = "Removed trailing whitespace"
FIX_NEWLINE = "Trimmed whitespace before newlines"

_SURROGATE_ESCAPE = re.compile(r"\\u[dD][89a-fA-F]")
_SURROGATE = re.compile("[\ud800-\udfff]")
_SPACES_BEFORE_NEWLINE = re.compile(r"(?<! ) +\n")


class Number(float):
    """A float that remembers how it should be written."""

    def __new__(cls, value: float, text: str):
        self = super().__new__(cls, value)
        self.text = text
        return self


def _reject_constant(name: str):
    raise ValueError(f"not a JSON value: {name}")


def number_text(value: float) -> str:
    """Shortest digits; plain notation from 1e-5 up to 1e16, ``1e16``/``1.5e-7`` outside it."""
    if value == 0:
        return "-0.0" if math.copysign(1, value) < 0 else "0.0"
    mantissa, _, exponent = f"{value!r}".partition("e")
    sign = "-" if mantissa.startswith("-") else ""
    whole, _, fraction = mantissa.lstrip("-").partition(".")
    fraction = "" if fraction == "0" else fraction
    digits = (whole + fraction).lstrip("0")
    point = len(whole) + int(exponent or 0) - (len(whole + fraction) - len(digits))
    digits = digits.rstrip("0") or "0"
    if -5 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    if 0 < point <= 16:
        return f"{sign}{digits[:point].ljust(point, '0')}.{digits[point:] or '0'}"
    tail = f".{digits[1:]}" if len(digits) > 1 else ""
    return f"{sign}{digits[0]}{tail}e{point - 1}"


def _depth_ok(value) -> bool:
    level = [value]
    for _ in range(MAX_DEPTH + 1):
        inner = []
        for item in level:
            if isinstance(item, dict):
                inner.append(item.values())
            elif isinstance(item, list):
                inner.append(item)
        if not inner:
            return True
        level = [child for group in inner for child in group]
    return False


def string_leaves(value, out: list[str]) -> list[str]:
    """Leaves depth-first with object keys sorted; other leaves give empty strings."""
    if isinstance(value, str):
        out.append(value)
    elif isinstance(value, dict) and value:
        for key in sorted(value):
            string_leaves(value[key], out)
    elif isinstance(value, list) and value:
        for item in value:
            string_leaves(item, out)
    else:
        out.append("")
    return out


def _has_surrogate(value) -> bool:
    if isinstance(value, str):
        return bool(_SURROGATE.search(value))
    if isinstance(value, dict):
        return any(_has_surrogate(k) or _has_surrogate(v) for k, v in value.items())
    return isinstance(value, list) and any(_has_surrogate(v) for v in value)


class StrictParser:
    """Strict JSON parsing; after each call ``delicate`` tells whether a number needs care.

    Delicate numbers are those Python would write differently: exponents, integers beyond
    64 bits and negative zero.  They are kept as :class:`Number`.
    """

    def __init__(self):
        self.delicate = False
        self._decode = json.JSONDecoder(
            parse_constant=_reject_constant, parse_float=self._float, parse_int=self._int
        ).decode

    def _float(self, text: str) -> float:
        value = float(text)
        if 1e-4 <= abs(value) < 1e16 or (value == 0 and text[0] != "-"):
            return value
        if math.isinf(value):
            raise ValueError("number out of range")
        self.delicate = True
        return Number(value, number_text(value))

    def _int(self, text: str):
        if len(text) < 19 and text != "-0":
            return int(text)
        value = int(text)
        if value and -(1 << 63) <= value < (1 << 64):
            return value
        return self._float(text)

    def parse(self, text: str):
        """The parsed value, or ``ValueError`` for anything that is not strict JSON."""
        self.delicate = False
        try:
            value = self._decode(text)
        except RecursionError:
            raise ValueError("recursion limit exceeded") from None
        if text.count("[") + text.count("{") > MAX_DEPTH and not _depth_ok(value):
            raise ValueError("recursion limit exceeded")
        if "\\u" in text and _SURROGATE_ESCAPE.search(text) and _has_surrogate(value):
            raise ValueError("lone surrogate in string")
        return value

    def attempt(self, text: str | None):
        """Whether the text parses, and its value."""
        if text is None:
            return False, None
        try:
            return True, self.parse(text)
        except ValueError:
            return False, None

    def canonical(self, value) -> str:
        """Compact JSON with sorted keys, for a value just parsed."""
        return _dump_careful(value) if self.delicate else _COMPACT.encode(value)

    def pretty(self, value) -> str:
        """JSON with sorted keys indented by two spaces, for a value just parsed."""
        return _dump_careful(value, 2) if self.delicate else _PRETTY.encode(value)


def _dump_careful(value, indent: int = 0, level: int = 1) -> str:
    if isinstance(value, Number):
        return value.text
    if not isinstance(value, (dict, list)) or not value:
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, dict):
        colon = ": " if indent else ":"
        parts = [
            json.dumps(k, ensure_ascii=False) + colon + _dump_careful(value[k], indent, level + 1)
            for k in sorted(value)
        ]
    else:
        parts = [_dump_careful(item, indent, level + 1) for item in value]
    start, end = "{}" if isinstance(value, dict) else "[]"
    if not indent:
        return start + ",".join(parts) + end
    inner, outer = "\n" + " " * indent * level, "\n" + " " * indent * (level - 1)
    return start + inner + ("," + inner).join(parts) + outer + end


_COMPACT = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), sort_keys=True)
_PRETTY = json.JSONEncoder(ensure_ascii=False, indent=2, sort_keys=True)


def fix_text(text: str, fixes: list[str]) -> str:
    """White-space repairs of one string value; new kinds are appended to ``fixes``."""
    stripped = text.rstrip(WHITE_SPACE)
    if stripped != text and FIX_TRAILING not in fixes:
        fixes.append(FIX_TRAILING)
    if " \n" in stripped:
        stripped = _SPACES_BEFORE_NEWLINE.sub("\n", stripped)
        if FIX_NEWLINE not in fixes:
            fixes.append(FIX_NEWLINE)
    return stripped


def fix_tags(text: str, fixes: list[str]) -> str:
    """Tag repairs of an assistant message: at most one closer, as many openers as missing."""
    surplus = text.count(OPEN_TAG) - text.count(CLOSE_TAG)
    if surplus < 0:
        if FIX_OPENED not in fixes:
            fixes.append(FIX_OPENED)
        return OPEN_TAG * -surplus + text
    body_at = text.rfind(OPEN_TAG) + len(OPEN_TAG)
    if surplus == 0 or CLOSE_TAG in text[body_at:]:
        return text
    gap = text.find("\n\n", body_at)
    cut = len(text) if gap < 0 else gap
    if FIX_CLOSED not in fixes:
        fixes.append(FIX_CLOSED)
    return text[:cut] + CLOSE_TAG + text[cut:]


def fix_parsed(value, fixes: list[str]):
    """Repair every string value, objects in key order so that fixes are listed in that order."""
    if isinstance(value, str):
        return fix_text(value, fixes)
    if isinstance(value, list):
        return [fix_parsed(item, fixes) for item in value]
    if not isinstance(value, dict):
        return value
    assistant = value.get("role") == "assistant"
    repaired = {}
    for key in sorted(value):
        item = value[key]
        if assistant and key == "content":
            repaired[key] = (
                fix_tags(fix_text(item, fixes), fixes) if isinstance(item, str) else item
            )
        else:
            repaired[key] = fix_parsed(item, fixes)
    return repaired


def _leaf_blank(value) -> bool:
    """True when a ``content``/``text`` string anywhere inside is blank."""
    if isinstance(value, list):
        return any(_leaf_blank(item) for item in value)
    if not isinstance(value, dict):
        return False
    for key, item in value.items():
        if key in ("content", "text") and isinstance(item, str) and not item.strip(WHITE_SPACE):
            return True
        if _leaf_blank(item):
            return True
    return False


FACTS_TYPE = (
    "struct<valid:boolean,error:string,missing:array<string>,opens:int,closes:int,"
    "trailing:boolean,blank_content:boolean>"
)


@lru_cache(maxsize=64)
def line_facts_udf(required: tuple[str, ...] = (), per_leaf: bool = False, blanks: bool = False):
    """What the lint rules need to know about a line, from a single parse.

    Only verdicts and counts travel back to the JVM, not the text.
    """
    arrow_type = pa.struct(
        [
            ("valid", pa.bool_()),
            ("error", pa.string()),
            ("missing", pa.list_(pa.string())),
            ("opens", pa.int32()),
            ("closes", pa.int32()),
            ("trailing", pa.bool_()),
            ("blank_content", pa.bool_()),
        ]
    )

    def facts(parser: StrictParser, text: str | None):
        if text is None:
            return None
        try:
            value = parser.parse(text)
        except ValueError as error:
            return {"valid": False, "error": str(error)}
        leaves = string_leaves(value, [])
        if per_leaf:
            trailing = any(" \n" in leaf or leaf.endswith(" ") for leaf in leaves)
        joined = " ".join(leaves)
        if not per_leaf:
            trailing = " \n" in joined or joined.endswith(" ")
        return {
            "valid": True,
            "missing": [k for k in required if k not in value] if isinstance(value, dict) else [],
            "opens": joined.count(OPEN_TAG),
            "closes": joined.count(CLOSE_TAG),
            "trailing": trailing,
            "blank_content": blanks and _leaf_blank(value),
        }

    def facts_batch(lines: pa.Array) -> pa.Array:
        parser = StrictParser()
        return by_runs(lines, arrow_type, lambda texts: [facts(parser, text) for text in texts])

    return F.arrow_udf(facts_batch, FACTS_TYPE).asNondeterministic()


@lru_cache(maxsize=None)
def extract_text_udf():
    def text_batch(lines: pa.Array) -> pa.Array:
        parser = StrictParser()

        def joined(texts: list) -> list:
            parsed = map(parser.attempt, texts)
            return [" ".join(string_leaves(v, [])) if ok else None for ok, v in parsed]

        return by_runs(lines, pa.string(), joined)

    return F.arrow_udf(text_batch, "string").asNondeterministic()


@lru_cache(maxsize=None)
def is_json_udf():
    def valid_batch(lines: pa.Array) -> pa.Array:
        parser = StrictParser()

        def flags(texts: list) -> list:
            return [None if t is None else parser.attempt(t)[0] for t in texts]

        return by_runs(lines, pa.bool_(), flags)

    return F.arrow_udf(valid_batch, "boolean").asNondeterministic()


@lru_cache(maxsize=None)
def canonical_json_udf(pretty: bool = False):
    def render_batch(lines: pa.Array) -> pa.Array:
        parser = StrictParser()
        render = parser.pretty if pretty else parser.canonical

        def rendered(texts: list) -> list:
            return [render(value) if ok else None for ok, value in map(parser.attempt, texts)]

        return by_runs(lines, pa.string(), rendered)

    return F.arrow_udf(render_batch, "string").asNondeterministic()


FIX_TYPE = "struct<outcome:string,line:string,fixes:array<string>,skip_reason:string>"


@lru_cache(maxsize=None)
def fix_line_udf(canonicalize: bool = True):
    arrow_type = pa.struct(
        [
            ("outcome", pa.string()),
            ("line", pa.string()),
            ("fixes", pa.list_(pa.string())),
            ("skip_reason", pa.string()),
        ]
    )

    def fix_one(parser: StrictParser, text: str | None):
        if text is None:
            return None
        trimmed = text.strip(WHITE_SPACE)
        if not trimmed:
            return {"outcome": "skipped", "fixes": [], "skip_reason": "Empty line"}
        try:
            value = parser.parse(trimmed)
        except ValueError as error:
            return {"outcome": "skipped", "fixes": [], "skip_reason": f"Invalid JSON: {error}"}
        fixes: list[str] = []
        repaired = fix_parsed(value, fixes)
        if fixes:
            return {"outcome": "fixed", "line": parser.canonical(repaired), "fixes": fixes}
        same = parser.canonical(value) if canonicalize else text
        return {"outcome": "unchanged", "line": same, "fixes": []}

    def fix_batch(lines: pa.Array) -> pa.Array:
        parser = StrictParser()
        return by_runs(lines, arrow_type, lambda texts: [fix_one(parser, text) for text in texts])

    return F.arrow_udf(fix_batch, FIX_TYPE).asNondeterministic()


def _readable(line: Column) -> Column:
    """NULL in place of bytes that are not UTF-8, which Python could not decode."""
    return F.when(F.is_valid_utf8(line), line)


def line_facts(
    line: Column, required: tuple[str, ...] = (), per_leaf: bool = False, blanks: bool = False
) -> Column:
    return line_facts_udf(tuple(required), per_leaf, blanks)(_readable(line))


def extract_text(line: Column) -> Column:
    """All string leaves joined by one space; NULL where the line is not strict JSON."""
    return extract_text_udf()(_readable(line))


def is_json(line: Column) -> Column:
    return F.coalesce(is_json_udf()(_readable(line)), F.lit(False))


def canonical_json(line: Column) -> Column:
    """Compact JSON with sorted keys; NULL where the line is not strict JSON."""
    return canonical_json_udf()(_readable(line))


def pretty_json(line: Column) -> Column:
    """Two-space indented JSON, or the line itself where it does not parse."""
    return F.coalesce(canonical_json_udf(True)(_readable(line)), line)


def fix_line(line: Column, canonicalize: bool = True) -> Column:
    return fix_line_udf(canonicalize)(_readable(line))
