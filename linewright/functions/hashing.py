"""64-bit FNV-1a and SimHash as Arrow UDFs over NumPy, plus Hamming distance.

Fingerprints are unsigned 64-bit values stored in a BIGINT with the same bits.
The kernels work on a whole Arrow batch at once: its text is one byte buffer with row
offsets, and a batch costs a fixed number of NumPy calls, not one per row.

UDFs here are declared nondeterministic so that Spark evaluates them once per row.
Otherwise a filter or a generator above one makes the optimizer repeat it below.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from linewright.functions.quoting import content_rows

# The FNV-1a parameters for 64 bits.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3

DEFAULT_SHINGLE = 4
MIN_SHINGLE = 2

_MASK64 = (1 << 64) - 1
_BLOCK = 1 << 17  # windows hashed at a time; keeps the work arrays inside the CPU cache
_LANE_MAX = 255  # windows summed into one byte lane before it could overflow
_LANES = np.uint64(0x0101010101010101)

def _byte_view(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The data bytes of a string/binary array and its row offsets (nulls read as empty)."""
    if array.null_count:
        text = pa.types.is_string(array.type) or pa.types.is_large_string(array.type)
        array = array.fill_null("" if text else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    kind = np.int64 if wide else np.int32
    bounds = np.frombuffer(offsets, dtype=kind)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, bounds.astype(np.int64)


def fnv_rows(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """FNV-1a of each byte range.

    Rows are ordered by length and hashed one byte position at a time across all rows
    still active; the few longest rows are finished with plain integers.
    """
    lengths = ends - starts
    out = np.full(len(starts), FNV_OFFSET, dtype=np.uint64)
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths = lengths[order]
    state = out[order]
    first = starts[order]
    prime = np.uint64(FNV_PRIME)
    position = 0
    active = int(np.count_nonzero(sorted_lengths > 0))
    while active > 48:
        until = int(sorted_lengths[active - 1])
        head = state[:active]
        for position in range(position, until):
            head ^= raw[first[:active] + position]
            head *= prime
        position = until
        active = int(np.count_nonzero(sorted_lengths > position))
    for i in range(active):
        value = int(state[i])
        for byte in raw[first[i] + position : first[i] + sorted_lengths[i]].tobytes():
            value = ((value ^ byte) * FNV_PRIME) & _MASK64
        state[i] = value
    out[order] = state
    return out


def _window_hashes(raw: np.ndarray, begin: int, end: int, shingle: int) -> np.ndarray:
    """FNV-1a of the ``shingle`` bytes starting at each position in ``[begin, end)``."""
    prime = np.uint64(FNV_PRIME)
    wide = raw[begin : end + shingle - 1].astype(np.uint64)
    hashes = np.full(end - begin + 1, FNV_OFFSET, dtype=np.uint64)
    body = hashes[:-1]
    for step in range(shingle):
        body ^= wide[step : step + end - begin]
        body *= prime
    hashes[-1] = 0
    return hashes


def simhash_rows(
    raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, shingle: int
) -> np.ndarray:
    """SimHash of each byte range: bit ``i`` is set iff more windows have it than lack it.

    Bit counts are kept eight to a machine word: ``(hash >> j) & 0x0101...`` puts bits
    ``j, j+8, ...`` into separate byte lanes, and up to 255 windows add without carry.
    """
    rows = len(starts)
    windows = ends - starts - shingle + 1
    short = windows < 1
    counts = np.zeros((rows, 8, 8), dtype=np.int64)  # [row, byte of the hash, bit]
    long_rows = np.flatnonzero(~short)
    begin = starts[long_rows]
    stop = begin + windows[long_rows]
    if len(long_rows):
        position, last = int(begin[0]), int(stop[-1])
        while position < last:
            edge = min(position + _BLOCK, last)
            lo = int(np.searchsorted(stop, position, side="right"))
            hi = int(np.searchsorted(begin, edge, side="left"))
            if lo >= hi:
                position = int(begin[lo]) if lo < len(begin) else last
                continue
            seg_begin = np.maximum(begin[lo:hi], position) - position
            seg_end = np.minimum(stop[lo:hi], edge) - position
            pieces = -(-(seg_end - seg_begin) // _LANE_MAX)
            owner_start = np.cumsum(pieces) - pieces
            rank = np.arange(int(pieces.sum())) - np.repeat(owner_start, pieces)
            piece_begin = np.repeat(seg_begin, pieces) + rank * _LANE_MAX
            piece_end = np.minimum(piece_begin + _LANE_MAX, np.repeat(seg_end, pieces))
            bounds = np.stack([piece_begin, piece_end], axis=1).ravel()
            hashes = _window_hashes(raw, position, edge, shingle)
            lanes = np.empty_like(hashes)
            for bit in range(8):
                np.right_shift(hashes, np.uint64(bit), out=lanes)
                lanes &= _LANES
                sums = np.add.reduceat(lanes, bounds)[::2]
                per_byte = np.ascontiguousarray(sums).astype("<u8").view(np.uint8).reshape(-1, 8)
                counts[long_rows[lo:hi], :, bit] += np.add.reduceat(
                    per_byte, owner_start, axis=0, dtype=np.int64
                )
            position = edge
    majority = 2 * counts > np.maximum(windows, 0)[:, None, None]
    bits = np.packbits(majority.reshape(rows, 64), axis=1, bitorder="little")
    prints = np.ascontiguousarray(bits).view("<u8").ravel().astype(np.uint64)
    if short.any():
        prints[short] = fnv_rows(raw, starts[short], ends[short])
    return prints


def _as_bigint(values: np.ndarray, array: pa.Array) -> pa.Array:
    signed = pa.array(values.view(np.int64))
    if array.null_count:
        return pc.if_else(array.is_valid(), signed, pa.scalar(None, pa.int64()))
    return signed


def _contents(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return content_rows(*_byte_view(lines))


@lru_cache(maxsize=None)
def fnv1a64_udf():
    def fnv1a64_batch(texts: pa.Array) -> pa.Array:
        raw, bounds = _byte_view(texts)
        return _as_bigint(fnv_rows(raw, bounds[:-1], bounds[1:]), texts)

    return F.arrow_udf(fnv1a64_batch, "bigint").asNondeterministic()


@lru_cache(maxsize=None)
def simhash64_udf(shingle: int = DEFAULT_SHINGLE, json_lines: bool = False, min_bytes: int = 0):
    size = max(shingle, MIN_SHINGLE)

    def simhash64_batch(lines: pa.Array) -> pa.Array:
        raw, bounds = _contents(lines) if json_lines else _byte_view(lines)
        starts, ends = bounds[:-1], bounds[1:]
        prints = _as_bigint(simhash_rows(raw, starts, ends, size), lines)
        if min_bytes > 0:
            enough = pa.array(ends - starts >= min_bytes)
            prints = pc.if_else(enough, prints, pa.scalar(None, pa.int64()))
        return prints

    return F.arrow_udf(simhash64_batch, "bigint").asNondeterministic()


@lru_cache(maxsize=None)
def extract_content_udf():
    def extract_batch(lines: pa.Array) -> pa.Array:
        body, offsets = _contents(lines)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(body)]
        found = pa.Array.from_buffers(pa.large_string(), len(lines), buffers).cast(pa.string())
        return pc.if_else(lines.is_valid(), found, pa.scalar(None, pa.string()))

    return F.arrow_udf(extract_batch, "string").asNondeterministic()


def readable(line: Column) -> Column:
    """Bytes that are not valid UTF-8 count as the empty line."""
    return F.when(line.isNull() | F.is_valid_utf8(line), line).otherwise(F.lit(""))


def fnv1a64(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes."""
    return fnv1a64_udf()(readable(text))


def simhash64(text: Column, shingle: int = DEFAULT_SHINGLE, min_bytes: int = 0) -> Column:
    """SimHash over byte shingles; text shorter than a shingle gets its FNV-1a.

    Text of fewer than ``min_bytes`` bytes gets NULL.
    """
    return simhash64_udf(shingle, False, min_bytes)(readable(text))


def simhash64_json(line: Column, shingle: int = DEFAULT_SHINGLE, min_bytes: int = 0) -> Column:
    """SimHash of :func:`extract_content`, without the content leaving the Python worker."""
    return simhash64_udf(shingle, True, min_bytes)(readable(line))


def extract_content(line: Column) -> Column:
    """String values of a JSON line, by quoting; see :mod:`linewright.functions.quoting`."""
    return extract_content_udf()(readable(line))


def hamming_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def fingerprint_hex(fingerprint: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
