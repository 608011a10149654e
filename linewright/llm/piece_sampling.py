"""Sampled segmentations of a SentencePiece vocabulary, by forward filtering and backward sampling.

A text is taken with one space before it, as the vocabulary expects, and cut into units: a run of
spaces with the word after it.  No piece of the vocabulary reaches over such a border.  Over each
unit lies the lattice of all pieces that match its bytes; single bytes always match, through
the byte pieces, so any text can be encoded.  Forward filtering sums the weights of all ways to each
byte; backward sampling draws the last piece in proportion, then the one before it, to the start.
The draws are hashes of the row's key, the unit's place and the step, so a row gives the same
pieces on any cluster, while two occurrences of one word may be cut differently.

A piece weighs 1 / (2 + its rank) ** ``sharpness``; the vocabulary only has ranks, no
probabilities.  The lattice of a word is built once per chunk of texts, for all words of the chunk
together.  Units beyond UNIT_BYTES, such as text without spaces, are taken one by one: their sums
are kept as logarithms, so that a unit of any length has one lattice, and pieces are looked up
again on the way back instead of being stored.

Decoding joins the bytes of the pieces and drops the first space: it restores every text exactly,
white space, control characters and U+2581 included.

Defined results: a NULL text is empty, and an empty text has no pieces; rows that share a key
and text share their pieces; a NULL key is a key of its own; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.words import mix, text_chunks

UNIT_BYTES = 64
SHARPNESS = 1.0
# Weight per byte that keeps sums of long units within floating range.
_LIFT = float(np.exp(2.5))
_FACTOR = np.uint64(0x9E3779B97F4A7C15 | 1)
_MAYBE_BITS = 20


def _table() -> np.ndarray:
    return np.random.default_rng(17).integers(0, 1 << 64, 256, dtype=np.uint64)


class Vocabulary:
    """The pieces of a model as bytes, with their weights and a lookup by length."""

    def __init__(self, path: str, sharpness: float = SHARPNESS) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.byte_ids = np.zeros(256, np.int64)
        self.pieces: list[bytes] = []
        by_length: dict[int, list[tuple[bytes, int, float]]] = {}
        rank = 0
        ranked: list[tuple[bytes, int, int]] = []
        for i in range(size):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(text[3:5], 16)
                self.byte_ids[value] = i
                self.pieces.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.pieces.append(b"")
            else:
                raw = text.replace("▁", " ").encode()
                if b"\n" in raw or b" " in raw.lstrip(b" "):
                    raise ValueError("a piece reaches over the border of a unit")
                self.pieces.append(raw)
                weight = (2.0 + rank) ** -sharpness * _LIFT ** len(raw)
                by_length.setdefault(len(raw), []).append((raw, i, weight))
                ranked.append((raw, i, rank))
                rank += 1
        # Logarithms of the weights as they are, for units of any length.
        self.logs = {raw: (i, -sharpness * float(np.log(2.0 + rank))) for raw, i, rank in ranked}
        self.byte_log = -sharpness * float(np.log(size))
        self.byte_weight = float(size) ** -sharpness * _LIFT
        self.longest = max(by_length)
        table = _table()
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * (self.longest + 1)
        for length, rows in by_length.items():
            data = np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(-1, length)
            hashes = np.zeros(len(rows), np.uint64)
            for column in range(length):
                hashes = hashes * _FACTOR + table[data[:, column]]
            order = np.argsort(hashes)
            ids = np.array([r[1] for r in rows])[order]
            self.tables[length] = hashes[order], ids, np.array([r[2] for r in rows])[order]
        # Which leading bits any piece's hash has: most byte runs are no piece, and end here.
        self.maybe = np.zeros(1 << _MAYBE_BITS, bool)
        for rows in self.tables:
            if rows is not None:
                self.maybe[rows[0] >> np.uint64(64 - _MAYBE_BITS)] = True
        flat = b"".join(self.pieces)
        self.flat = np.frombuffer(flat, np.uint8)
        self.ends = np.cumsum([len(p) for p in self.pieces])
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)


@dataclass
class Lattices:
    """For each byte of each unit, the pieces that end with it.

    ``keys`` cumulate their probabilities, from ``first`` of the byte to ``first`` of the next.
    """

    first: np.ndarray
    keys: np.ndarray
    lengths: np.ndarray
    ids: np.ndarray


def units_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units start: at a text, at a space after none, and around a line end."""
    start = np.zeros(len(data), bool)
    start[offsets[:-1][offsets[:-1] < len(data)]] = True
    space, line = data == 0x20, data == 0x0A
    start[1:] |= (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    return np.flatnonzero(start)


def _pieces_before(vocabulary: Vocabulary, unit: bytes, end: int) -> list[tuple[int, int, float]]:
    """(length, id, log weight) of the pieces that end at a border, long ones first."""
    known = vocabulary.logs
    found = []
    for size in range(min(vocabulary.longest, end), 0, -1):
        piece = known.get(unit[end - size : end])
        if piece is not None:
            found.append((size, *piece))
    found.append((1, int(vocabulary.byte_ids[unit[end - 1]]), vocabulary.byte_log))
    return found


def unit_logs(vocabulary: Vocabulary, unit: bytes) -> np.ndarray:
    """The log of the sum of the weights of all ways to each border of one unit."""
    logs = np.zeros(len(unit) + 1)
    for end in range(1, len(unit) + 1):
        ways = [logs[end - size] + log for size, _, log in _pieces_before(vocabulary, unit, end)]
        most = max(ways)
        logs[end] = most + math.log(sum(math.exp(way - most) for way in ways))
    return logs


def sample_unit(vocabulary: Vocabulary, unit: bytes, stream: np.uint64) -> list[int]:
    """Piece ids of a unit of any length, drawn backwards from its end."""
    logs = unit_logs(vocabulary, unit)
    ids, end, step = [], len(unit), 0
    while end:
        uniform = float(_uniform(np.array([stream]), step)[0])
        pieces = _pieces_before(vocabulary, unit, end)
        for size, piece, log in pieces:
            uniform -= math.exp(logs[end - size] + log - logs[end])
            if uniform < 0:
                break
        # What rounding leaves goes to the last piece.
        ids.append(piece)
        end -= size
        step += 1
    return ids[::-1]


def _uniform(streams: np.ndarray, step: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        draw = mix(mix(streams) + np.uint64(step)) >> np.uint64(11)
    return draw.astype(np.float64) / float(1 << 53)


def build_lattices(vocabulary: Vocabulary, data: np.ndarray, starts: np.ndarray) -> Lattices:
    """Forward filtering over all units at once; ``starts`` cut ``data`` into units."""
    sizes = np.diff(np.append(starts, len(data)))
    # Border p of a unit is row first + p - 1 for p from 1 to its size: one row per byte.
    place = np.arange(len(data)) - np.repeat(starts, sizes) + 1
    table = _table()[data]
    rows, hashes = np.arange(len(data)), np.zeros(len(data), np.uint64)
    at, length = [rows], [np.ones(len(data), np.int64)]
    piece, weight = [vocabulary.byte_ids[data]], [np.full(len(data), vocabulary.byte_weight)]
    shift = np.uint64(64 - _MAYBE_BITS)
    for size in range(1, vocabulary.longest + 1):
        reach = place[rows] >= size
        rows, hashes = rows[reach], hashes[reach]
        if not len(rows):
            break
        # The hash of the last ``size`` bytes: that of one byte less, and the byte before them.
        hashes = hashes + table[rows - (size - 1)] * np.uint64(pow(int(_FACTOR), size - 1, 1 << 64))
        known = vocabulary.tables[size]
        if known is None:
            continue
        values, ids, weights = known
        maybe = np.flatnonzero(vocabulary.maybe[hashes >> shift])
        found = np.minimum(np.searchsorted(values, hashes[maybe]), len(values) - 1)
        hit = values[found] == hashes[maybe]
        at.append(rows[maybe[hit]])
        length.append(np.full(int(hit.sum()), size))
        piece.append(ids[found[hit]])
        weight.append(weights[found[hit]])
    # Long pieces first: they are the likely ones, and drawing looks through them in this order.
    at, length = np.concatenate(at[::-1]), np.concatenate(length[::-1])
    piece, weight = np.concatenate(piece[::-1]), np.concatenate(weight[::-1])
    by_place = place[at].astype(np.uint8)
    order = np.argsort(by_place, kind="stable")
    sums = np.zeros(len(data))
    share = np.zeros(len(at))
    cuts = np.append(0, np.cumsum(np.bincount(by_place, minlength=2)[1:]))
    for p in range(1, len(cuts)):
        edges = order[cuts[p - 1] : cuts[p]]
        rows, back = at[edges], length[edges]
        before = np.where(back == p, 1.0, sums[rows - np.minimum(back, p - 1)])
        share[edges] = before * weight[edges]
        np.add.at(sums, rows, share[edges])
    order = np.argsort(at, kind="stable")
    at, share = at[order], share[order] / sums[at[order]]
    total = np.cumsum(share)
    first = np.append(0, np.cumsum(np.bincount(at, minlength=len(data))))
    keys = total - np.append(0.0, total)[first[:-1]][at]
    # The last piece of each border takes what rounding leaves.
    keys[first[1:] - 1] = 2.0
    return Lattices(first, keys, length[order], piece[order])


def _sampled(
    vocabulary: Vocabulary,
    data: np.ndarray,
    starts: np.ndarray,
    sizes: np.ndarray,
    streams: np.ndarray,
) -> list[tuple[np.ndarray, np.ndarray]]:
    """(units, ids) of the pieces drawn at each step backwards, for units of up to UNIT_BYTES."""
    # One lattice for all units of the same bytes.
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    bytes_ = data[place + np.repeat(starts, sizes)]
    powers = np.cumprod(np.append(np.uint64(1), np.full(UNIT_BYTES, _FACTOR)))
    marks = mix(np.add.reduceat(_table()[bytes_] * powers[place], first) + sizes.astype(np.uint64))
    _, chosen, unit = np.unique(marks, return_index=True, return_inverse=True)
    own_sizes = sizes[chosen]
    own_starts = np.cumsum(own_sizes) - own_sizes
    within = np.arange(int(own_sizes.sum())) - np.repeat(own_starts, own_sizes)
    lattices = build_lattices(
        vocabulary, data[within + np.repeat(starts[chosen], own_sizes)], own_starts
    )
    active = np.arange(len(starts))
    end = own_starts[unit] + sizes - 1
    taken: list[tuple[np.ndarray, np.ndarray]] = []
    left = sizes.copy()
    while len(active):
        uniform = _uniform(streams[active], len(taken))
        edge = lattices.first[end[active]]
        beyond = np.flatnonzero(lattices.keys[edge] <= uniform)
        while len(beyond):
            edge[beyond] += 1
            beyond = beyond[lattices.keys[edge[beyond]] <= uniform[beyond]]
        taken.append((active, lattices.ids[edge]))
        end[active] -= lattices.lengths[edge]
        left[active] -= lattices.lengths[edge]
        active = active[left[active] > 0]
    return taken


def sample(
    vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray, row_keys: np.ndarray, seed: int
) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts in a row, and the number of each text's."""
    texts = len(offsets) - 1
    starts = units_of(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(texts, np.int64)
    sizes = np.diff(np.append(starts, len(data)))
    owner = np.searchsorted(offsets, starts, "right") - 1
    first_unit = np.searchsorted(owner, np.arange(texts))
    turn = (np.arange(len(starts)) - first_unit[owner]).astype(np.uint64)
    streams = mix(row_keys.astype(np.uint64)[owner] + np.uint64(seed)) + turn * _FACTOR
    steps = np.zeros(len(starts), np.int64)
    taken: list[tuple[np.ndarray, np.ndarray]] = []
    short = np.flatnonzero(sizes <= UNIT_BYTES)
    if len(short):
        taken = _sampled(vocabulary, data, starts[short], sizes[short], streams[short])
        taken = [(short[rows], pieces) for rows, pieces in taken]
        for rows, _ in taken:
            steps[rows] += 1
    longer = {}
    for row in np.flatnonzero(sizes > UNIT_BYTES).tolist():
        unit = data[starts[row] : starts[row] + sizes[row]].tobytes()
        longer[row] = sample_unit(vocabulary, unit, streams[row])
        steps[row] = len(longer[row])
    base = np.cumsum(steps)
    ids = np.zeros(int(base[-1]), np.int64)
    for back, (rows, pieces) in enumerate(taken):
        ids[base[rows] - 1 - back] = pieces
    for row, pieces in longer.items():
        ids[base[row] - len(pieces) : base[row]] = pieces
    counts = np.bincount(owner, weights=steps, minlength=texts).astype(np.int64)
    return ids, counts


def decode(vocabulary: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The texts back from their pieces."""
    sizes = vocabulary.sizes[ids]
    ends = np.cumsum(sizes)
    within = np.arange(int(sizes.sum())) - np.repeat(ends - sizes, sizes)
    raw = vocabulary.flat[within + np.repeat(vocabulary.ends[ids] - sizes, sizes)].tobytes()
    borders = np.append(0, ends)[np.append(0, np.cumsum(counts))].tolist()
    return [raw[s + 1 : e] for s, e in zip(borders[:-1], borders[1:], strict=True)]


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text that is not empty with a space before it."""
    filled = offsets[1:] > offsets[:-1]
    moved = np.insert(data, offsets[:-1][filled], np.uint8(0x20))
    return moved, offsets + np.append(0, np.cumsum(filled))


_LOADED: dict[tuple[str, float], Vocabulary] = {}


def _vocabulary(path: str, sharpness: float) -> Vocabulary:
    key = (path, sharpness)
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(path, sharpness)
    return _LOADED[key]


def _encoded(batches, path: str, seed: int, sharpness: float):
    with np.errstate(over="ignore"):
        vocabulary = _vocabulary(path, sharpness)
        for batch, data, offsets in text_chunks(batches):
            keys = np.asarray(batch.column("row_key")).view(np.uint64)
            ids, counts = sample(vocabulary, *spaced(data, offsets), keys, seed)
            yield batch, (data, offsets), vocabulary, ids, counts


def _slim(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.xxhash64(id_column).alias("row_key"),
        F.col(text_column).alias("text"),
    )


def encode_sampled(
    docs: DataFrame,
    model: str,
    seed: int = 0,
    sharpness: float = SHARPNESS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, ids``: one sampled segmentation per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _, ids, counts in _encoded(batches, model, seed, sharpness):
            borders = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
            lists = pa.ListArray.from_arrays(borders, pa.array(ids.astype(np.int32)))
            yield pa.record_batch([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    return _slim(docs, id_column, text_column).mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; a NULL list of ids gives a NULL text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(model, SHARPNESS)
        for batch in batches:
            lists = batch.column("ids")
            counts = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            texts = decode(vocabulary, np.asarray(lists.flatten()).astype(np.int64), counts)
            known = np.asarray(lists.is_valid())
            text = pa.array([t.decode() if k else None for t, k in zip(texts, known, strict=True)], pa.string())
            yield pa.record_batch([batch.column("doc_id"), text], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def sampling_digests(
    docs: DataFrame,
    model: str,
    seed: int = 0,
    sharpness: float = SHARPNESS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Number and checksum of the sampled pieces, and the digest of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, source, vocabulary, ids, counts in _encoded(batches, model, seed, sharpness):
            texts = decode(vocabulary, ids, counts)
            raw, bounds = source[0].tobytes(), source[1].tolist()
            flat, borders = ids.astype("<u4").tobytes(), np.append(0, np.cumsum(counts)) * 4
            spans = list(zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True))
            same = [t == raw[s:e] for t, s, e in zip(texts, bounds[:-1], bounds[1:], strict=True)]
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(counts),
                    pa.array([zlib.crc32(flat[s:e]) for s, e in spans], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                    pa.array(same),
                ],
                names=["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"],
            )

    return _slim(docs, id_column, text_column).mapInArrow(
        run,
        "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean",
    )
