"""Line dedup over the corpus: lines that several documents share stay in the first of them.

Every line of every text is normalised (white space at both ends goes, A-Z becomes lower case) and
hashed to 128 bits.  Distinct (document, hash) pairs are counted per hash; a hash of enough
documents is taken from all of them but the one of the least id.  What a document loses goes back
to it as a list of hashes, and the lines that are left are put together in their places.

Hashes of common lines are joined by broadcast (there are few of them), and texts move only if the
lists of what to drop are too large to broadcast, which is measured.  A text is one task's work, a
document list no longer than its lines.

Defined results: NULL and empty texts are one empty line; keys shorter than ``least_chars`` are left
alone; rows that share a doc_id are one document, and each of them loses the same lines; rows
without a doc_id take no part and lose nothing; an empty table gives no rows; other columns are
ignored, or returned as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.plans.attach import attach_groups
from linewright.plans.durable import written

LEAST_CHARS = 10
DOCUMENTS = 2
MAX_BROADCAST_BYTES = 64 << 20
# Lines of more documents than this, and of more than one pair in 10,000, are joined by broadcast.
HOT_HOLDERS = 2_000
# Hashes a task holds before it hands them on, beside those of one text.
_EMIT_ROWS = 200_000


def line_key(line: bytes, least_chars: int) -> bytes | None:
    """The normalised line, if it is long enough; bytes methods know ASCII only."""
    key = line.strip(b" \t\n\v\f\r").lower()
    if len(key) < least_chars:
        return None
    if len(key) < 4 * least_chars and len(key.decode()) < least_chars:
        return None
    return key


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text, one at a time; NULL is empty."""
    for text in pc.fill_null(column, "").cast(pa.binary()):
        yield text.as_py()


def _halves(digests: list[bytes]) -> np.ndarray:
    """Two signed 64-bit halves of each digest."""
    return np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)


def _hashed(least_chars: int):
    def rows(ids: list[int], sizes: list[int], digests: list[bytes]) -> pa.RecordBatch:
        halves = _halves(digests)
        held = np.repeat(np.array(ids, np.int64), np.array(sizes, np.int64))
        columns = [pa.array(held), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
        return pa.record_batch(columns, names=["doc_id", "high", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, digests = [], [], []
            for row, text in enumerate(_texts(batch.column("text"))):
                keys = {line_key(line, least_chars) for line in text.split(b"\n")}
                keys.discard(None)
                ids.append(batch.column("doc_id")[row].as_py())
                sizes.append(len(keys))
                digests += map(_digest, keys)
                if len(digests) >= _EMIT_ROWS:
                    yield rows(ids, sizes, digests)
                    ids, sizes, digests = [], [], []
            yield rows(ids, sizes, digests)

    return run


def lines_to_drop(
    docs: DataFrame,
    documents: int = DOCUMENTS,
    least_chars: int = LEAST_CHARS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> tuple[DataFrame, int]:
    """``doc_id, lost`` (hashes of the lines it loses) of the documents that lose any; its bytes."""
    slim = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")
    ).filter(F.col("doc_id").isNotNull() & (F.length("text") >= least_chars))
    hashed = slim.mapInArrow(_hashed(least_chars), "doc_id long, high long, low long")
    # Rows of one doc_id are one document.
    held, pairs = written(
        hashed.select("doc_id", F.struct("high", "low").alias("line")).distinct(), "line-holders"
    )
    shared = (
        held.groupBy("line")
        .agg(F.count(F.lit(1)).alias("members"), F.min("doc_id").alias("first"))
        .filter(F.col("members") >= documents)
    )
    hot = attach_groups(held, shared, "line", pairs, cold_members=HOT_HOLDERS)
    lost = hot.filter("doc_id <> first")
    lists, losers = written(
        lost.groupBy("doc_id").agg(F.collect_list("line.low").alias("lost")), "lost-lines"
    )
    hashes = lists.agg(F.sum(F.size("lost"))).first()[0] or 0
    return lists, 64 * losers + 8 * hashes


def _with_lost(docs: DataFrame, lost: DataFrame, size: int) -> DataFrame:
    side = lost.withColumnRenamed("doc_id", "_doc_id")
    side = F.broadcast(side) if size <= MAX_BROADCAST_BYTES else side
    return docs.join(side, F.col("doc_id") == F.col("_doc_id"), "left").drop("_doc_id")


def _split(text: bytes, lost: list[int] | None, least_chars: int) -> tuple[list[bytes], int]:
    """The lines that stay, in their places, and how many there were."""
    lines = text.split(b"\n")
    if not lost:
        return lines, len(lines)
    gone = set(lost)
    kept = []
    for line in lines:
        key = line_key(line, least_chars)
        # Within one document half of the hash tells its lines apart.
        if key is None or int.from_bytes(_digest(key)[8:], "big", signed=True) not in gone:
            kept.append(line)
    return kept, len(lines)


def _digests(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, dropped, digests = [], [], []
            lost = batch.column("lost")
            for row, text in enumerate(_texts(batch.column("text"))):
                kept, count = _split(text, lost[row].as_py(), least_chars)
                counts.append(count)
                dropped.append(count - len(kept))
                digests.append(hashlib.sha256(b"\n".join(kept)).hexdigest())
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(dropped, pa.int64()),
                    pa.array(digests, pa.string()),
                ],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    return run


def shared_line_digests(
    docs: DataFrame, documents: int = DOCUMENTS, least_chars: int = LEAST_CHARS
) -> DataFrame:
    """Per row: ``doc_id, n_lines, n_dropped`` and the SHA-256 of the lines that stay."""
    lost, size = lines_to_drop(docs, documents, least_chars)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_lost(slim, lost, size).mapInArrow(
        _digests(least_chars), "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
    )


def _cut(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lost = batch.column("lost")
            texts = batch.column("text")
            left = [
                b"\n".join(_split(text, lost[row].as_py(), least_chars)[0]).decode()
                for row, text in enumerate(_texts(texts))
            ]
            left = pc.if_else(
                pc.is_null(texts), pa.scalar(None, pa.string()), pa.array(left, pa.string())
            )
            yield pa.record_batch([batch.column("row"), left], names=["row", "text"])

    return run


def without_shared_lines(
    docs: DataFrame,
    documents: int = DOCUMENTS,
    least_chars: int = LEAST_CHARS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``docs`` without the lines they lose; all columns and rows stay, NULL texts as they are."""
    lost, size = lines_to_drop(docs, documents, least_chars, id_column, text_column)
    others = [F.col(c) for c in docs.columns if c != text_column]
    packed = docs.select(
        F.struct(*others).alias("row"),
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(text_column).alias("text"),
    )
    cut = _with_lost(packed, lost, size).mapInArrow(
        _cut(least_chars), packed.select("row", "text").schema
    )
    return cut.select("row.*", F.col("text").alias(text_column)).select(*docs.columns)
