"""Packing token sequences: shortest-pack-first over the histogram of lengths.

Documents are tokenised once into pieces of at most one sequence.  Only the histogram of piece
lengths (one count per possible length) reaches the driver.  Lengths are placed from the longest
down: of the open packs that have room, the one with the least tokens in it takes the piece, and
equal packs move together as one pattern with a count.  What results is a bounded table of
patterns; pieces join it by their length and their rank among pieces of that length.

Defined results: a NULL text is empty, and an empty text is its end token alone; repeated rows and
rows that share a doc_id are packed each for itself; a NULL doc_id is kept; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.ranking import with_global_rank
from linewright.llm.words import numbered, split_words, text_chunks
from linewright.plans.durable import written

MAX_TOKENS = 4096
END_TOKEN = 2
# Words kept with their ids in a Python worker.
CACHED_WORDS = 1_000_000
# Letters that are themselves in normal form, each with its lower case: one run is one word of
# the tokenizer, whatever stands around it.
_LETTERS = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[0x21:0x7F] = True
_MARK[48:58] = _MARK[65:91] = _MARK[97:123] = False


# The settings of tokenizers whose ids of a text are those of its words in order.
WORD_NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_MARK = "<|"


def _goes_by_words(path: str) -> bool:
    """Whether the file's normaliser, splitter and special tokens are those above."""
    with open(path, encoding="utf-8") as file:
        settings = json.load(file)
    normalizer = settings.get("normalizer") or {}
    splits = (settings.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    split = {"type": "Split", "pattern": {"Regex": WORD_SPLIT}, "behavior": "Removed", "invert": True}
    return (
        settings["model"].get("type") == "BPE"
        and normalizer.get("normalizers") == WORD_NORMALIZERS
        and len(splits) == 2
        and splits[0] == split
        and byte_level.items() <= splits[1].items()
        and all(t["content"].startswith(WORD_MARK) for t in settings.get("added_tokens", []))
    )


def _byte_letters() -> dict[int, int]:
    """How byte-level vocabularies write bytes: printable Latin-1 as is, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class WordEncoder:
    """Encodes texts word by word, remembering the ids of words.

    Only for byte-level tokenizers that lower-case, drop white space, and split at it and
    between letters and marks, so that the ids of a text are those of its words in order;
    ``TextEncoder`` takes any.
    """

    def __init__(self, path: str) -> None:
        # One task has one core; the library would start a thread for each core of the machine.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.starts = np.zeros(CACHED_WORDS + 1, np.int64)

    def _ids(self, word: bytes) -> list[int]:
        text = word.decode()
        if word.isascii() and word.isalpha() and word.islower():
            return [token.id for token in self.model.tokenize(text)]
        if _LETTERS.fullmatch(text):
            written = text.lower().encode().decode("latin-1").translate(self.letters)
            return [token.id for token in self.model.tokenize(written)]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, words: list[bytes]) -> None:
        start = self.starts[len(self.index)]
        ids = [self._ids(word) for word in words]
        sizes = np.array([len(x) for x in ids], np.int64)
        known, end = len(self.index), start + int(sizes.sum())
        while end > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        while known + len(words) + 1 > len(self.starts):
            self.starts = np.append(self.starts, np.zeros_like(self.starts))
        self.flat[start:end] = [i for x in ids for i in x]
        self.starts[known + 1 : known + len(words) + 1] = start + np.cumsum(sizes)
        self.index.update(zip(words, range(known, known + len(words)), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each text's."""
        # Special tokens are found in a text as it is, so such chunks are left alone.
        plain = b"<|" not in data.tobytes()
        if plain:
            data, offsets = _set_apart(data, offsets)
        words = split_words(data, offsets, lower=plain)
        # Words are looked up once for all the texts at hand.
        numbers, different = numbered(words)
        split = different.to_pylist()
        if len(self.index) > CACHED_WORDS:
            self._clear()
        self._learn([w for w in split if w not in self.index])
        places = np.fromiter(map(self.index.__getitem__, split), np.int64, len(split))[numbers]
        sizes = self.starts[places + 1] - self.starts[places]
        ends = np.cumsum(sizes)
        within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
        ids = self.flat[within + np.repeat(self.starts[places], sizes)]
        totals = np.append(0, ends)[np.append(0, np.cumsum(words.counts))]
        return ids, np.diff(totals)


class TextEncoder:
    """Encodes whole texts, for any tokenizer."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each text's."""
        raw, bounds = data.tobytes(), offsets.tolist()
        found = [
            self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids
            for a, b in zip(bounds[:-1], bounds[1:], strict=True)
        ]
        counts = np.array([len(ids) for ids in found], np.int64)
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum()))
        return flat, counts


def _set_apart(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each mark that follows a letter.

    The tokenizer cuts there anyway, and words are met more often without what follows them.
    Latin-1 letters are lower-cased too, as the tokenizer would.
    """
    accented = np.zeros(len(data), bool)
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    data = np.where(accented & (data < 0x9F), data + np.uint8(0x20), data)
    marks = np.flatnonzero(_MARK[data])
    marks = marks[marks > 0]
    marks = marks[_LETTER[data[marks - 1]] | accented[marks - 1]]
    # A mark that begins a text has no word before it.
    marks = np.setdiff1d(marks, offsets, assume_unique=False)
    moved = offsets + np.searchsorted(marks, offsets)
    return np.insert(data, marks, np.uint8(0x20)), moved


_PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"
_ENCODERS: dict[str, WordEncoder | TextEncoder] = {}


def _encoder(path: str) -> WordEncoder | TextEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path) if _goes_by_words(path) else TextEncoder(path)
    return _ENCODERS[path]


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    max_tokens: int = MAX_TOKENS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per piece: whole sequences from the start of a document, then what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch, data, offsets in text_chunks(batches):
            ids, lengths = encoder.encode(data, offsets)
            doc_ids = batch.column("doc_id").to_pylist()
            rows: list[tuple] = []
            at = 0
            for doc_id, length in zip(doc_ids, lengths.tolist(), strict=True):
                own = np.append(ids[at : at + length], np.uint32(END_TOKEN)).astype("<u4")
                at += length
                for start in range(0, length + 1, max_tokens):
                    piece = own[start : start + max_tokens]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece), length + 1))
            columns = zip(*rows, strict=True)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
            )

    slim = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")
    )
    return slim.mapInArrow(run, _PIECES)


def shortest_pack_first(
    histogram: dict[int, int], max_tokens: int
) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of piece lengths, longest first, and how many sequences follow each.

    Work and memory go with the number of lengths, not of pieces.
    """
    # Open patterns by the tokens in them: used -> {lengths: count}, and the used sums as a heap.
    open_packs: dict[int, dict[tuple[int, ...], int]] = {}
    heap: list[int] = []

    def put(lengths: tuple[int, ...], count: int) -> None:
        used = sum(lengths)
        if used not in open_packs:
            open_packs[used] = {}
            heapq.heappush(heap, used)
        packs = open_packs[used]
        packs[lengths] = packs.get(lengths, 0) + count

    done: dict[tuple[int, ...], int] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if length > max_tokens:
            raise ValueError("a piece is longer than a sequence")
        while left:
            while heap and not open_packs[heap[0]]:
                del open_packs[heapq.heappop(heap)]
            if heap and heap[0] + length <= max_tokens:
                packs = open_packs[heap[0]]
                lengths, count = packs.popitem()
                taken = min(count, left)
                if count > taken:
                    packs[lengths] = count - taken
                put((*lengths, length), taken)
            else:
                # No open pack has room.  As many new ones as pieces remain, since a pack
                # that would take two of this length counts as used once it is opened.
                fits = max_tokens // length
                taken = -(-left // fits)
                full = left // fits
                if full:
                    put((length,) * fits, full)
                if left > full * fits:
                    put((length,) * (left - full * fits), 1)
                left = 0
                continue
            left -= taken
    for packs in open_packs.values():
        for lengths, count in packs.items():
            done[lengths] = done.get(lengths, 0) + count
    return sorted(done.items(), reverse=True)


class Places:
    """For each length, the ranks at which patterns begin to take pieces of it."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]], max_tokens: int) -> None:
        by_length: list[list[tuple[int, int, int, int]]] = [[] for _ in range(max_tokens + 1)]
        taken = [0] * (max_tokens + 1)
        sequence = 0
        for lengths, count in patterns:
            offset, i = 0, 0
            while i < len(lengths):
                length = lengths[i]
                same = i
                while same < len(lengths) and lengths[same] == length:
                    same += 1
                # A sequence of the pattern takes this many neighbouring ranks.
                by_length[length].append((taken[length], sequence, offset, same - i))
                taken[length] += count * (same - i)
                offset += length * (same - i)
                i = same
            sequence += count
        self.sequences = sequence
        rows = [(length, *row) for length, found in enumerate(by_length) for row in found]
        table = np.array(rows, np.int64).reshape(-1, 5)
        self.first = np.searchsorted(table[:, 0], np.arange(max_tokens + 2))
        self.table = table

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces given by length and rank."""
        # Ranks of one length rise with the row, so one search over both finds the row.
        top = int(rank.max(initial=0)) + 1
        top = max(top, int(self.table[:, 1].max(initial=0)) + 1)
        keys = self.table[:, 0] * top + self.table[:, 1]
        row = np.searchsorted(keys, length * top + rank, "right") - 1
        _, start, sequence, offset, times = self.table[row].T
        turn = rank - start
        return sequence + turn // times, offset + turn % times * length


def pack(
    docs: DataFrame,
    tokenizer: str,
    max_tokens: int = MAX_TOKENS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; every token of every document is in one."""
    pieces = token_pieces(docs, tokenizer, max_tokens, id_column, text_column)
    order = [
        F.col("length"),
        F.col("doc_id").asc_nulls_first(),
        F.col("start"),
        F.col("ids_crc32"),
    ]
    # Ranking looks at its input twice; the tokenizer should run once.
    pieces, _ = written(pieces, "pieces", narrow=True)
    ranked, _ = with_global_rank(pieces, order, "ranked-pieces")
    counts = ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    histogram = {r["length"]: r["n"] for r in counts}
    before = np.zeros(max_tokens + 2, np.int64)
    for length, n in histogram.items():
        before[length + 1] = n
    before = np.cumsum(before)
    places = Places(shortest_pack_first(histogram, max_tokens), max_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.asarray(batch.column("length")).astype(np.int64)
            rank = np.asarray(batch.column("rank")) - before[length]
            sequence, offset = places.of(length, rank)
            kept = [batch.column(c) for c in ("doc_id", "start")]
            more = [batch.column(c) for c in ("ids_crc32", "doc_tokens")]
            yield pa.record_batch(
                [*kept, pa.array(length), *more, pa.array(sequence), pa.array(offset)],
                names=_PACKED_NAMES,
            )

    return ranked.mapInArrow(run, ", ".join(f"{c} long" for c in _PACKED_NAMES))


_PACKED_NAMES = [
    "doc_id",
    "start",
    "length",
    "ids_crc32",
    "doc_tokens",
    "sequence_id",
    "offset",
]
