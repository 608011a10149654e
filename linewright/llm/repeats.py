"""Removing passages that occur earlier in the corpus, by fixed-block anchors.

Each text is cut into non-overlapping blocks of half a window.  The blocks are the index; every
rolling run of that many words probes it.  A window repeated elsewhere holds a whole block, so
the probes that hit mark all places where repeats can be.  Around the hits, whole windows are
compared by 96 bits of their hash, the earliest place of each keeps its words, and every other
place is extended, window by window, to maximal repeats.

Three passes over the texts; what is shuffled is packed hashes with their places (6 to 8 bytes
per word in the first pass, hits and their windows in the second).  Inside one task equal keys
are merged before the shuffle, so a passage in a third of all texts sends one entry per flush,
not one per text.  Nothing is capped: a wrong hit only costs a comparison.

Defined results: a NULL text has no words; rows that share a doc_id count as one document, so
equal windows at the same place do not remove each other; a row with a NULL doc_id is compared
with nothing and keeps its words; texts shorter than a window keep theirs; an empty table gives
no rows; extra columns are kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm import dealing
from linewright.llm.words import Hasher, Words, chunks
from linewright.plans.durable import written

WINDOW = 20
# Spans are broadcast if they take no more than this; a document about 120 bytes, a span 8.
MAX_BROADCAST_BYTES = 128 << 20
# Packed entries of a partition are unpacked in memory, so there are more partitions than usual.
_FINER = 2

_SPANS = "doc_id long, span_starts array<int>, span_ends array<int>"
_QUESTION, _ANSWER = 0, 1
# Bits of a probe's hash beside the partition, above its two flags.
_PROBE_BYTES = 5
_BLOCK, _KNOWN = np.uint64(1), np.uint64(2)


def _low_bytes(values: np.ndarray, count: int) -> np.ndarray:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :count]


def _widened(keys: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(keys), 8), np.uint8)
    wide[:, : keys.shape[1]] = keys
    return wide.view("<u8").ravel()


class _Pending:
    """Arrays gathered until there are enough to deal."""

    def __init__(self, limit: int) -> None:
        self.limit, self.rows, self.size = limit, [], 0

    def add(self, *arrays: np.ndarray) -> bool:
        self.rows.append(arrays)
        self.size += len(arrays[0])
        return self.size >= self.limit

    def take(self) -> list[np.ndarray]:
        rows, self.rows, self.size = self.rows, [], 0
        return [np.concatenate(x) for x in zip(*rows, strict=True)] if rows else []


def _probes(window: int, parts: int):
    length = window // 2
    bits = (parts - 1).bit_length()
    hasher = Hasher(1)

    def deal(pending: _Pending) -> Iterator[pa.RecordBatch]:
        if not pending.size:
            return
        keys, docs, places, anchors = pending.take()
        order, starts = dealing.groups(keys)
        sizes = np.diff(np.append(starts, len(order)))
        anchored = np.logical_or.reduceat(anchors[order], starts)
        alone = sizes == 1
        # Equal runs met in one task are hits at once; one entry tells the others of them.
        if not alone.all():
            met = order[np.repeat(~alone, sizes)]
            part = dealing.part_of_docs(docs[met], parts)
            yield from dealing.blocks(part, _ANSWER, None, docs[met], places[met])
        one = order[starts]
        one_keys, flags = keys[one], anchored * _BLOCK + ~alone * _KNOWN
        part = (one_keys >> np.uint64(64 - bits)).astype(np.int64)
        rest = (one_keys << np.uint64(bits)) >> np.uint64(64 - 8 * _PROBE_BYTES + 2)
        packed = _low_bytes((rest << np.uint64(2)) | flags, _PROBE_BYTES)
        yield from dealing.blocks(part, _QUESTION, packed, docs[one], places[one])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = _Pending(max(dealing.FLUSH, 64 * parts))
        for batch, words in chunks(batches):
            if len(words.starts) < length:
                continue
            hashes = hasher.of_runs(hasher.of_words(words), length)
            whole = np.flatnonzero(words.left_of[: len(hashes)] >= length)
            docs = np.repeat(np.asarray(batch.column("doc_id")), words.counts)[whole]
            places = words.place_of[whole]
            if pending.add(hashes[whole], docs, places, places % length == 0):
                yield from deal(pending)
        yield from deal(pending)

    return run


def _hits(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, _ = dealing.unpacked(batches, _PROBE_BYTES)
        if _ANSWER in found:
            part, _, docs, places = found[_ANSWER]
            yield from dealing.blocks(part, _ANSWER, None, docs, places)
        if _QUESTION not in found:
            return
        part, keys, docs, places = found[_QUESTION]
        wide = _widened(keys)
        flags = (wide & np.uint64(3)).astype(np.uint8)
        # The partition goes above the 38 bits of the hash.
        order, starts = dealing.groups((wide >> np.uint64(2)) | (part.astype(np.uint64) << np.uint64(38)))
        sizes = np.diff(np.append(starts, len(order)))
        hit = (sizes > 1) & (np.bitwise_or.reduceat(flags[order], starts) > 0)
        asked = order[np.repeat(hit, sizes)]
        asked = asked[(flags[asked] & 2) == 0]
        to = dealing.part_of_docs(docs[asked], parts)
        yield from dealing.blocks(to, _ANSWER, None, docs[asked], places[asked])

    return run


def _gathered(reach: int):
    """Spans of consecutive places per document, each place reaching over ``reach`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, _ = dealing.unpacked(batches, 0)
        if _ANSWER not in found:
            return
        _, _, docs, places = found[_ANSWER]
        order = np.lexsort((places, docs))
        docs, places = docs[order], places[order]
        new = np.ones(len(docs), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (places[1:] > places[:-1] + reach)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(docs)) - 1
        starts, ends, owners = places[first], places[last] + reach, docs[first]
        cuts = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
        offsets = pa.array(np.append(cuts, len(owners)).astype(np.int32))
        yield pa.record_batch(
            [
                pa.array(owners[cuts]),
                pa.ListArray.from_arrays(offsets, pa.array(starts.astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(ends.astype(np.int32))),
            ],
            names=["doc_id", "span_starts", "span_ends"],
        )

    return run


def _inside(batch: pa.RecordBatch, words: Words, before: int) -> np.ndarray:
    """True for each word in a span of its text, or up to ``before`` words ahead of one."""
    edges = np.zeros(len(words.starts) + 1, np.int32)
    first = np.cumsum(words.counts) - words.counts
    starts, ends = batch.column("span_starts"), batch.column("span_ends")
    held = np.asarray(starts.value_lengths().fill_null(0)).astype(np.int64)
    base, top = np.repeat(first, held), np.repeat(words.counts, held)
    at = np.clip(np.asarray(starts.flatten()).astype(np.int64) - before, 0, top)
    to = np.clip(np.asarray(ends.flatten()).astype(np.int64), 0, top)
    np.add.at(edges, base + at, 1)
    np.add.at(edges, base + to, -1)
    return np.cumsum(edges[:-1]) > 0


def _windows(window: int, parts: int):
    length = window // 2
    bits = (parts - 1).bit_length()
    hashers = Hasher(2), Hasher(3)

    def deal(pending: _Pending) -> Iterator[pa.RecordBatch]:
        if not pending.size:
            return
        keys, checks, docs, places = pending.take()
        # The checks have 32 bits; ties go by document and place, so the first of each is kept.
        order = np.lexsort((places, docs, checks, keys))
        same = np.zeros(len(order), bool)
        same[1:] = (keys[order][1:] == keys[order][:-1]) & (checks[order][1:] == checks[order][:-1])
        starts = np.flatnonzero(~same)
        one = order[starts]
        sizes = np.diff(np.append(starts, len(order)))
        later = (docs[order] != np.repeat(docs[one], sizes)) | (
            places[order] != np.repeat(places[one], sizes)
        )
        gone = order[later]
        part = dealing.part_of_docs(docs[gone], parts)
        yield from dealing.blocks(part, _ANSWER, None, docs[gone], places[gone])
        packed = np.hstack([_low_bytes(keys[one], 8), _low_bytes(checks[one], 4)])
        part = (keys[one] >> np.uint64(64 - bits)).astype(np.int64)
        yield from dealing.blocks(part, _QUESTION, packed, docs[one], places[one])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = _Pending(max(dealing.FLUSH // 2, 64 * parts))
        for batch, words in chunks(batches):
            if len(words.starts) < window:
                continue
            near = _inside(batch, words, length)
            near &= words.left_of >= window
            chosen = np.flatnonzero(near[: len(near) - window + 1])
            both = [h.of_runs(h.of_words(words), window)[chosen] for h in hashers]
            docs = np.repeat(np.asarray(batch.column("doc_id")), words.counts)[chosen]
            checks = both[1] >> np.uint64(32)
            if pending.add(both[0], checks, docs, words.place_of[chosen]):
                yield from deal(pending)
        yield from deal(pending)

    return run


def _later(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, _ = dealing.unpacked(batches, 12)
        if _ANSWER in found:
            part, _, docs, places = found[_ANSWER]
            yield from dealing.blocks(part, _ANSWER, None, docs, places)
        if _QUESTION not in found:
            return
        _, keys, docs, places = found[_QUESTION]
        main, checks = _widened(keys[:, :8]), _widened(keys[:, 8:])
        order = np.lexsort((places, docs, checks, main))
        main, checks, docs, places = main[order], checks[order], docs[order], places[order]
        new = np.ones(len(order), bool)
        new[1:] = (main[1:] != main[:-1]) | (checks[1:] != checks[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(order)))
        later = (docs != np.repeat(docs[starts], sizes)) | (places != np.repeat(places[starts], sizes))
        to = dealing.part_of_docs(docs[later], parts)
        yield from dealing.blocks(to, _ANSWER, None, docs[later], places[later])

    return run


def _dealt(blocks: DataFrame, reduce, gather, label: str) -> tuple[DataFrame, int]:
    """Two shuffles of blocks, to the keys and back to the documents; spans and their bytes."""
    parts = _FINER * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    answers = blocks.repartition(parts, "part").mapInArrow(reduce, dealing.BLOCKS)
    spans = answers.repartition(parts, "part").mapInArrow(gather, _SPANS)
    table, documents = written(spans, label)
    held = table.agg(F.sum(F.size("span_starts"))).first()[0] or 0
    return table, 120 * documents + 8 * held


def _with_spans(docs: DataFrame, spans: DataFrame, size: int, how: str) -> DataFrame:
    """Join the spans by broadcast if their measured size allows, else by a shuffle."""
    side = spans.withColumnRenamed("doc_id", "_doc_id")
    side = F.broadcast(side) if size <= MAX_BROADCAST_BYTES else side
    return docs.join(side, F.col("doc_id") == F.col("_doc_id"), how).drop("_doc_id")


def repeated_spans(
    docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text"
) -> tuple[DataFrame, int]:
    """Word spans to remove per document, ``doc_id, span_starts, span_ends``, and their bytes.

    Only documents with something to remove have a row.
    """
    if window < 2 or window % 2:
        raise ValueError("the window must be an even number of words")
    parts = dealing.parts_for(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slim = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")
    ).filter(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    probes = slim.mapInArrow(_probes(window, parts), dealing.BLOCKS)
    hits, size = _dealt(probes, _hits(parts), _gathered(1), "repeat-hits")
    near = _with_spans(slim, hits, size, "inner")
    windows = near.mapInArrow(_windows(window, parts), dealing.BLOCKS)
    return _dealt(windows, _later(parts), _gathered(window), "repeat-spans")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, words in chunks(batches):
        gone = _inside(batch, words, 0)
        removed = np.add.reduceat(np.append(gone, False), np.cumsum(words.counts) - words.counts)
        removed = np.where(words.counts > 0, removed, 0).astype(np.int64)
        raw, row, first = words.data.tobytes(), [], 0
        bounds = words.offsets.tolist()
        for i, (count, minus) in enumerate(zip(words.counts.tolist(), removed.tolist(), strict=True)):
            kept = raw[bounds[i] : bounds[i + 1]].split()
            if minus:
                stay = ~gone[first : first + count]
                kept = [w for w, s in zip(kept, stay.tolist(), strict=True) if s]
            row.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            first += count
        yield pa.record_batch(
            [
                batch.column("doc_id"),
                pa.array(words.counts.astype(np.int64)),
                pa.array(removed),
                pa.array(row, pa.string()),
            ],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def repeat_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed`` and the SHA-256 of the kept words."""
    spans, size = repeated_spans(docs, window)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_spans(slim, spans, size, "left").mapInArrow(
        _digests, "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, words in chunks(batches):
        gone = _inside(batch, words, 0)
        # A removed word takes the white space after it along; kept words keep their own.
        until = np.append(words.starts[1:], len(words.data))
        until = np.minimum(until, words.offsets[1:][words.text_of])
        edges = np.zeros(len(words.data) + 1, np.int32)
        np.add.at(edges, words.starts[gone], 1)
        np.add.at(edges, until[gone], -1)
        stay = np.cumsum(edges[:-1]) == 0
        kept = np.append(0, np.cumsum(stay))[words.offsets]
        buffers = [None, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(words.data[stay])]
        left = pa.Array.from_buffers(pa.large_string(), len(batch), buffers).cast(pa.string())
        left = pc.if_else(pc.is_null(batch.column("text")), pa.scalar(None, pa.string()), left)
        yield pa.record_batch([batch.column("row"), left], names=["row", "text"])


def without_repeats(
    docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``docs`` with repeated passages cut out of the text; all columns and rows stay.

    A text that loses nothing stays as it is, NULL included.
    """
    spans, size = repeated_spans(docs, window, id_column, text_column)
    others = [F.col(c) for c in docs.columns if c != text_column]
    packed = docs.select(
        F.struct(*others).alias("row"),
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(text_column).alias("text"),
    )
    cut = _with_spans(packed, spans, size, "left").mapInArrow(
        _cut, packed.select("row", "text").schema
    )
    return cut.select("row.*", F.col("text").alias(text_column)).select(*docs.columns)
