"""String values of JSON lines, found by quoting alone, for a whole Arrow batch at once.

The text of a batch is one byte buffer.  Only the few bytes that matter are looked at one by one, as
arrays of positions: backslashes, quotes and separators.  Runs of backslashes tell which bytes are
escaped, the rank of a quote among the quotes of its line tells whether it opens or closes, and the
last separator before an opening quote tells whether its string is a value.  What is kept is then
one mask over the buffer.

Outside strings a backslash escapes nothing.  Valid JSON has none there; lines that do are read by
``content_bytes``, the definition, one at a time.
"""

from __future__ import annotations

import re

import numpy as np

_QUOTE, _BACKSLASH, _COLON, _SPACE = 0x22, 0x5C, 0x3A, 0x20
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x3A, 0x2C, 0x7D, 0x5D]] = True
# Bytes of text taken at once, or one line if it is longer.
CHUNK_BYTES = 4 << 20

# A separator or a string of a JSON line; the quantifiers never give back what they took.
_TOKEN = re.compile(rb'[:,}\]]|"((?:[^"\\]++|\\.)*+)("?)', re.DOTALL)


def content_bytes(line: bytes) -> bytes:
    """String values of a JSON line, each followed by a space, read by quoting alone.

    A string is a value when the nearest separator before it, outside strings, is a colon.
    So an array of strings yields its first element, and the first key of a nested object
    counts as a value.  An escape keeps what follows the backslash (``\\n`` gives ``n``).
    """
    values, after_colon = [], False
    for token in _TOKEN.finditer(line):
        body = token.group(1)
        if body is None:
            after_colon = token.group() == b":"
        elif after_colon:
            if b"\\" in body:
                body = b"\\".join(part.replace(b"\\", b"") for part in body.split(b"\\\\"))
            values += (body, b" ") if token.group(2) else (body,)
    return b"".join(values)


def _escapes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backslashes that escape, and the starts of backslash runs.

    A run ends with its line; in it every other backslash escapes, from the first on.
    """
    slashes = np.flatnonzero(data == _BACKSLASH)
    if not len(slashes):
        return slashes, slashes
    opens = np.ones(len(slashes), bool)
    opens[1:] = np.diff(slashes) > 1
    line = np.searchsorted(bounds, slashes, "right")
    opens[1:] |= line[1:] != line[:-1]
    first = np.flatnonzero(opens)
    place = np.arange(len(slashes)) - np.repeat(first, np.diff(np.append(first, len(slashes))))
    return slashes[place % 2 == 0], slashes[first]


def _spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of the spans, in order."""
    sizes = ends - starts
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _chunk(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Content bytes of the lines of one buffer, and the offsets of their ends."""
    escapes, runs = _escapes(data, bounds)
    quotes = np.flatnonzero(data == _QUOTE)
    if len(escapes):
        # An escape reaches no further than its line.
        reached = escapes + 1
        reached = reached[~np.isin(reached, bounds)]
        quotes = quotes[~np.isin(quotes, reached)]
    first_quote = np.searchsorted(quotes, bounds[:-1])
    line_of = np.searchsorted(bounds, quotes, "right") - 1
    opening = np.flatnonzero((np.arange(len(quotes)) - first_quote[line_of]) % 2 == 0)
    starts, line = quotes[opening], line_of[opening]
    # A string ends at the next quote of its line, or with the line.
    stop = bounds[line + 1]
    ends = np.append(quotes, len(data))[opening + 1]
    closed = ends < stop
    ends = np.where(closed, ends, stop)
    # What lies between strings; the first gap of a line starts with the line.
    before = np.append(0, (ends + closed)[:-1])
    gaps = np.maximum(before, bounds[line])
    outside = _spans(gaps, starts)
    separators = outside[_SEPARATOR[data[outside]]]
    found = np.append(separators, -1)[np.searchsorted(separators, starts) - 1]
    is_value = (found >= bounds[line]) & (data[found] == _COLON)
    first, last, closed = starts[is_value] + 1, ends[is_value], closed[is_value]
    out = data.copy()
    out[last[closed]] = _SPACE
    edges = np.empty(2 * len(first) + 2, np.int64)
    edges[0], edges[1:-1:2], edges[2:-1:2], edges[-1] = 0, first, last + closed, len(data)
    kept = np.repeat(np.arange(len(edges) - 1) % 2 == 1, np.diff(edges))
    kept[escapes] = False
    sizes = np.zeros(len(bounds) - 1, np.int64)
    np.add.at(sizes, line[is_value], last + closed - first)
    if len(escapes):
        # Escapes inside values are not written.
        place = np.searchsorted(edges, escapes, "right") - 1
        lost = escapes[place % 2 == 1]
        np.subtract.at(sizes, np.searchsorted(bounds, lost, "right") - 1, 1)
    if len(runs):
        run_line = np.searchsorted(bounds, runs, "right") - 1
        inside = (np.searchsorted(quotes, runs) - first_quote[run_line]) % 2 == 1
        odd = np.unique(run_line[~inside])
        if len(odd):
            return _patched(data, bounds, out, kept, sizes, odd.tolist())
    return out[kept], np.cumsum(sizes)


def _patched(
    data: np.ndarray,
    bounds: np.ndarray,
    out: np.ndarray,
    kept: np.ndarray,
    sizes: np.ndarray,
    odd: list[int],
) -> tuple[np.ndarray, np.ndarray]:
    """The content with the lines in ``odd`` read one at a time."""
    parts, done = [], 0
    for line in odd:
        start, stop = bounds[line], bounds[line + 1]
        parts.append(out[done:start][kept[done:start]])
        body = np.frombuffer(content_bytes(data[start:stop].tobytes()), np.uint8)
        parts.append(body)
        sizes[line] = len(body)
        done = stop
    parts.append(out[done:][kept[done:]])
    return np.concatenate(parts), np.cumsum(sizes)


def content_rows(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Content of every line ``raw[bounds[i]:bounds[i + 1]]``: the bytes and the row offsets."""
    parts, offsets, size, row = [], [np.zeros(1, np.int64)], 0, 0
    lines = len(bounds) - 1
    while row < lines:
        last = int(np.searchsorted(bounds, bounds[row] + CHUNK_BYTES, "right")) - 1
        last = min(max(last, row + 1), lines)
        data = raw[bounds[row] : bounds[last]]
        body, ends = _chunk(data, bounds[row : last + 1] - bounds[row])
        parts.append(body)
        offsets.append(ends + size)
        size += len(body)
        row = last
    joined = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    return joined, np.concatenate(offsets)
