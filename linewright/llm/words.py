"""Words of Arrow text columns and hashes over them, vectorised over bytes.

A word is a run of bytes other than space and 0x09-0x0D, as everywhere in this subpackage.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

# Texts are taken in chunks of about this many bytes, or one text if it is longer.
CHUNK_BYTES = 2 << 20
# Longer words are hashed one by one.
_LONG_WORD = 1024

IN_WORD = np.ones(256, dtype=bool)
IN_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """Words of several texts: byte spans in ``data``, and the words of each text."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def place_of(self) -> np.ndarray:
        """Position of each word in its text."""
        first = np.cumsum(self.counts) - self.counts
        return np.arange(len(self.starts)) - np.repeat(first, self.counts)

    @property
    def left_of(self) -> np.ndarray:
        """Words of the text from each word to the end, itself included."""
        return np.repeat(np.cumsum(self.counts), self.counts) - np.arange(len(self.starts))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def split_words(
    data: np.ndarray, offsets: np.ndarray, lower: bool = False, in_word: np.ndarray = IN_WORD
) -> Words:
    """Words, or the runs of the bytes that ``in_word`` marks."""
    if lower:
        data = _LOWER[data]
    inside = in_word[data]
    # A word also ends where its text ends.
    follows, precedes = np.zeros(len(data), bool), np.zeros(len(data), bool)
    follows[1:] = inside[:-1]
    precedes[:-1] = inside[1:]
    filled = offsets[1:] > offsets[:-1]
    follows[offsets[:-1][filled]] = False
    precedes[offsets[1:][filled] - 1] = False
    starts = np.flatnonzero(inside & ~follows)
    ends = np.flatnonzero(inside & ~precedes) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return Words(data, offsets, starts, ends, counts)


def word_array(words: Words) -> pa.BinaryArray:
    """The words as a column."""
    edges = np.zeros(len(words.data) + 1, np.int8)
    edges[words.starts] += 1
    edges[words.ends] -= 1
    inside = np.cumsum(edges[:-1], dtype=np.int8).view(bool)
    bounds = np.zeros(len(words.starts) + 1, np.int32)
    np.cumsum(words.ends - words.starts, out=bounds[1:])
    # 32-bit offsets do, as the bytes are those of a slice of texts or of one text.
    buffers = [None, pa.py_buffer(bounds), pa.py_buffer(words.data[inside])]
    return pa.Array.from_buffers(pa.binary(), len(words.starts), buffers)


def numbered(words: Words) -> tuple[np.ndarray, pa.BinaryArray]:
    """The number of each word among the different ones, and these."""
    coded = word_array(words).dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary


def text_chunks(
    batches: Iterable[pa.RecordBatch], text: str = "text"
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of record batches of about CHUNK_BYTES of text: the bytes and the row offsets."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(text))
        row = 0
        while row < len(batch):
            last = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1
            last = min(max(last, row + 1), len(batch))
            part = data[offsets[row] : offsets[last]]
            yield batch.slice(row, last - row), part, offsets[row : last + 1] - offsets[row]
            row = last


def chunks(
    batches: Iterable[pa.RecordBatch], lower: bool = False, text: str = "text"
) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """The slices of ``text_chunks`` with their words."""
    for batch, data, offsets in text_chunks(batches, text):
        yield batch, split_words(data, offsets, lower)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Hasher:
    """64-bit hashes of words and of runs of words, different for each seed."""

    def __init__(self, seed: int) -> None:
        draw = np.random.default_rng(seed)
        self.table = draw.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.table[~IN_WORD] = 0
        self.factor = np.uint64(int(draw.integers(0, 1 << 63)) * 2 + 1)
        self.seed = seed
        powers = np.ones(_LONG_WORD, np.uint64)
        step = np.uint64(int(draw.integers(0, 1 << 61)) * 8 + 3)
        with np.errstate(over="ignore"):
            for i in range(1, _LONG_WORD):
                powers[i] = powers[i - 1] * step
        self.powers = powers

    def of_words(self, words: Words) -> np.ndarray:
        if not len(words.starts):
            return np.zeros(0, np.uint64)
        first = words.starts[0]
        data = words.data[first:]
        spans = np.diff(np.append(words.starts, len(words.data)))
        place = np.arange(len(data), dtype=np.int64) - np.repeat(words.starts - first, spans)
        np.minimum(place, _LONG_WORD - 1, out=place)
        values = self.table[data] * self.powers[place]
        lengths = (words.ends - words.starts).astype(np.uint64)
        hashes = mix(np.add.reduceat(values, words.starts - first) + lengths)
        for i in np.flatnonzero(lengths > _LONG_WORD):
            word = words.data[words.starts[i] : words.ends[i]].tobytes()
            hashes[i] = xxhash.xxh64_intdigest(word, self.seed)
        return hashes

    def of_runs(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """Hash of each run of ``length`` consecutive entries; fewer than ``hashes`` of them."""
        with np.errstate(over="ignore"):
            return mix(self._runs(hashes, length))

    def _runs(self, hashes: np.ndarray, length: int) -> np.ndarray:
        if length == 1:
            return hashes
        half = length // 2
        runs = self._runs(hashes, half)
        count = max(0, len(hashes) - 2 * half + 1)
        shift = np.uint64(pow(int(self.factor), half, 1 << 64))
        double = runs[:count] * shift + runs[half : half + count]
        if length % 2 == 0:
            return double
        count = max(0, len(hashes) - length + 1)
        return double[:count] * self.factor + hashes[length - 1 : length - 1 + count]
