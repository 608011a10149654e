"""Dealing hashed places of texts to partitions, as packed blocks.

An entry is a key (hash bits), a document and a position.  Entries travel as blocks of many,
one row per block, so that a shuffle moves a few bytes per entry instead of a row each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

# ``part`` is the partition key, ``kind`` tells questions from answers.
BLOCKS = "part int, kind int, first long, size int, keys binary, docs binary, places binary"
_SCHEMA = pa.schema(
    [
        ("part", pa.int32()),
        ("kind", pa.int32()),
        ("first", pa.int64()),
        ("size", pa.int32()),
        ("keys", pa.binary()),
        ("docs", pa.binary()),
        ("places", pa.binary()),
    ]
)
# Entries gathered before they are dealt; more partitions need more, to fill their blocks.
FLUSH = 1 << 19


def planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: small numbers become runs of zeros."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def from_planes(data: bytes, dtype: type, size: int) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.frombuffer(data, np.uint8).reshape(width, size).T.copy().view(dtype).ravel()


def parts_for(shuffle_partitions: int) -> int:
    """A power of two, at least the number of shuffle partitions."""
    return max(64, 1 << (shuffle_partitions - 1).bit_length())


def blocks(
    part: np.ndarray, kind: int, keys: np.ndarray | None, docs: np.ndarray, places: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """One row per partition key; ``keys`` are rows of bytes, or None."""
    if not len(docs):
        return
    order = np.argsort(part, kind="stable")
    part, docs, places = part[order], docs[order], places[order].astype(np.int64)
    keys = keys[order] if keys is not None else None
    cuts = np.flatnonzero(np.diff(part)) + 1
    starts, ends = np.append(0, cuts), np.append(cuts, len(part))
    steps = np.diff(docs, prepend=docs[:1])
    turns = steps != 0
    turns[starts] = True
    firsts = docs[starts]
    steps[starts] = 0
    moves = np.diff(places, prepend=0)
    moves[turns] = places[turns]
    columns: list[list] = [[] for _ in _SCHEMA]
    for s, e, first in zip(starts.tolist(), ends.tolist(), firsts.tolist(), strict=True):
        row = (
            int(part[s]),
            kind,
            first,
            e - s,
            keys[s:e].T.tobytes() if keys is not None else b"",
            planes(steps[s:e]),
            planes(moves[s:e]),
        )
        for column, value in zip(columns, row, strict=True):
            column.append(value)
    yield pa.record_batch(
        [pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA
    )


def unpacked(
    batches: Iterable[pa.RecordBatch], key_bytes: int
) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], int]:
    """All entries of a partition by kind: (part, keys, docs, places)."""
    found: dict[int, list] = {}
    total = 0
    for batch in batches:
        for row in batch.to_pylist():
            n = row["size"]
            total += n
            steps = from_planes(row["docs"], np.int64, n)
            moves = from_planes(row["places"], np.int64, n)
            docs = np.cumsum(steps) + row["first"]
            run = np.cumsum(moves)
            turns = np.flatnonzero(np.append(True, steps[1:] != 0))
            base = run[turns] - moves[turns]
            places = run - np.repeat(base, np.diff(np.append(turns, n)))
            keys = np.frombuffer(row["keys"], np.uint8)
            keys = keys.reshape(key_bytes, n).T if len(keys) else np.zeros((n, 0), np.uint8)
            part = np.full(n, row["part"], np.int64)
            found.setdefault(row["kind"], []).append((part, keys, docs, places))
    return {k: tuple(np.concatenate(x) for x in zip(*v, strict=True)) for k, v in found.items()}, total


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal keys together, and where each group starts in it."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    changed = np.zeros(len(order), bool)
    changed[:1] = True
    for key in keys:
        ordered = key[order]
        changed[1:] |= ordered[1:] != ordered[:-1]
    return order, np.flatnonzero(changed)


def part_of_docs(docs: np.ndarray, parts: int) -> np.ndarray:
    spread = docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (spread >> np.uint64(64 - (parts - 1).bit_length())).astype(np.int64)
