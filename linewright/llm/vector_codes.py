"""Product codes of vectors: one codebook for each part position, fitted by active-entry Lloyd rounds.

Components become integers, so every distance and mean is exact.  A round reads the table of the
round before, which holds each vector with its codes and their exact distances.  A part whose
assigned entry did not move keeps its stored distance and is compared with the moved entries only;
the other parts look at the whole codebook.  Ties go to the lower index in both cases, so the
result is that of a full scan.  Each task adds up its parts by entry on the way, so one pass makes
both the codes and the sums of the next codebooks.  Only codebooks reach the driver, entries x
dimensions numbers.  Rounds are written tables; the one before is deleted.

Defined results: a NULL vector, or one that holds a NULL or non-finite component, is dropped.
Seeds are the kept rows of the smallest ids; rows without an id come last, equal ids are ordered by
their vectors, and fewer rows than entries make a smaller codebook.  Repeated rows count each.
Vectors are cut by the longest one (its length divided by the parts, rounded up); shorter vectors
read as zero beyond their end.  Labels are compared by value, NULL labels are one label.  An empty
table gives no rows.  Other columns are ignored.  Components of 32,768 or more in size raise an
error, as their distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.plans.attach import attach_groups
from linewright.plans.durable import discard, fresh_path

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
# Integers up to this size have distances within a long for up to 64 x 8 dimensions and more.
_LARGEST = 1 << 27

_STATE = (
    "vec_id long, label_key string, weights array<int>, codes array<int>, errors array<long>, "
    "totals array<struct<part:int, entry:int, members:long, sums:array<long>>>"
)
_ARROW = pa.schema(
    [
        ("vec_id", pa.int64()),
        ("label_key", pa.string()),
        ("weights", pa.list_(pa.int32())),
        ("codes", pa.list_(pa.int32())),
        ("errors", pa.list_(pa.int64())),
        (
            "totals",
            pa.list_(
                pa.struct(
                    [
                        ("part", pa.int32()),
                        ("entry", pa.int32()),
                        ("members", pa.int64()),
                        ("sums", pa.list_(pa.int64())),
                    ]
                )
            ),
        ),
    ]
)


def scaled_vectors(
    vectors: DataFrame, id_column: str, vector_column: str, label_column: str, scale: int
) -> DataFrame:
    """``vec_id, label_key, weights`` of the vectors with finite components only."""
    vector = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    fits = F.when(
        F.forall(vector, lambda x: F.abs(x * scale) < _LARGEST), F.lit(True)
    ).otherwise(F.raise_error(F.lit(f"components must be below {_LARGEST // scale} in size")))
    return vectors.filter(F.col(vector_column).isNotNull() & finite).select(
        F.col(id_column).cast("long").alias("vec_id"),
        # A value and its absence never look alike in JSON.
        F.to_json(F.struct(F.col(label_column).alias("l"))).alias("label_key"),
        F.when(fits, F.transform(vector, lambda x: F.floor(x * scale).cast("int"))).alias("weights"),
    )


def _distances(parts: np.ndarray, book: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``parts`` to the chosen entries."""
    out = np.empty((len(parts), len(entries)), np.int64)
    for place, entry in enumerate(entries.tolist()):
        apart = parts - book[entry]
        out[:, place] = np.einsum("ij,ij->i", apart, apart)
    return out


def _nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = _distances(parts, book, np.arange(len(book)))
    codes = found.argmin(axis=1)
    return codes, found[np.arange(len(parts)), codes]


def assign(
    parts: np.ndarray,
    book: np.ndarray,
    moved: np.ndarray | None,
    codes: np.ndarray | None,
    errors: np.ndarray | None,
) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances of one position's parts, given those under the book before.

    ``moved`` marks the entries that changed since; None looks at everything.
    """
    if moved is None:
        return _nearest(parts, book)
    codes, errors = codes.copy(), errors.copy()
    lost = moved[codes]
    if lost.any():
        codes[lost], errors[lost] = _nearest(parts[lost], book)
    active = np.flatnonzero(moved)
    stayed = np.flatnonzero(~lost)
    if len(active) and len(stayed):
        found = _distances(parts[stayed], book, active)
        best = found.argmin(axis=1)
        distance, entry = found[np.arange(len(stayed)), best], active[best]
        old, code = errors[stayed], codes[stayed]
        won = (distance < old) | ((distance == old) & (entry < code))
        codes[stayed[won]], errors[stayed[won]] = entry[won], distance[won]
    return codes, errors


def _matrix(weights: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` integers; shorter lists end in zeros."""
    lengths = np.asarray(weights.value_lengths()).astype(np.int64)
    flat = np.asarray(weights.flatten()).astype(np.int64)
    out = np.zeros((len(weights), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, place] = flat
    return out


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind))


def _round(
    books: np.ndarray, moved: np.ndarray | None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Assign every part; after its rows, a task adds one row with its sums by part and entry."""
    parts, entries, wide = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, wide), np.int64)
        members = np.zeros((parts, entries), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            rows = _matrix(batch.column("weights"), parts * wide).reshape(len(batch), parts, wide)
            codes = np.zeros((len(rows), parts), np.int64)
            errors = np.zeros((len(rows), parts), np.int64)
            if moved is not None:
                codes = np.asarray(batch.column("codes").flatten()).astype(np.int64).reshape(-1, parts)
                errors = np.asarray(batch.column("errors").flatten()).reshape(-1, parts)
                codes, errors = codes.copy(), errors.copy()
            for part in range(parts):
                codes[:, part], errors[:, part] = assign(
                    rows[:, part],
                    books[part],
                    None if moved is None else moved[part],
                    codes[:, part],
                    errors[:, part],
                )
                for entry in range(entries):
                    own = rows[codes[:, part] == entry, part]
                    members[part, entry] += len(own)
                    sums[part, entry] += own.sum(axis=0)
            yield pa.record_batch(
                [
                    batch.column("vec_id"),
                    batch.column("label_key"),
                    batch.column("weights"),
                    _lists(codes, pa.int32()),
                    _lists(errors, pa.int64()),
                    pa.nulls(len(batch), _ARROW.field("totals").type),
                ],
                schema=_ARROW,
            )
        totals = [
            {"part": p, "entry": e, "members": int(members[p, e]), "sums": sums[p, e].tolist()}
            for p, e in np.argwhere(members)
        ]
        yield pa.RecordBatch.from_pylist([{"totals": totals}], schema=_ARROW)

    return run


def _moved_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks of floored means; entries without parts stay."""
    one = state.filter("totals IS NOT NULL").select(F.inline("totals"))
    means = (
        one.select("part", "entry", "members", F.posexplode("sums").alias("place", "value"))
        .groupBy("part", "entry", "place")
        .agg(
            F.sum("members").alias("members"),
            F.sum(F.col("value").cast("decimal(38,0)")).alias("total"),
        )
        .collect()
    )
    after = books.copy()
    for mean in means:
        after[mean["part"], mean["entry"], mean["place"]] = int(mean["total"]) // mean["members"]
    return after


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def fit_codes(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> tuple[DataFrame, np.ndarray, int]:
    """Codes under the final codebooks, the codebooks [part, entry, component], and the rows.

    The codes are ``vec_id, label_key, weights, codes, errors``, an error per part.
    """
    spark = vectors.sparkSession
    source = scaled_vectors(vectors, id_column, vector_column, label_column, scale)
    longest, count = source.agg(F.max(F.size("weights")), F.count(F.lit(1))).first()
    wide = -(-(longest or 0) // parts)
    seeds = (
        source.select("vec_id", "weights")
        .orderBy(F.col("vec_id").asc_nulls_last(), "weights")
        .limit(entries)
        .collect()
    )
    books = np.zeros((parts, len(seeds), wide), np.int64)
    for entry, seed in enumerate(seeds):
        padded = np.zeros(parts * wide, np.int64)
        padded[: len(seed["weights"])] = seed["weights"]
        books[:, entry] = padded.reshape(parts, wide)
    moved, state, before = None, source, None
    for step in range(rounds + 1):
        path = fresh_path(spark, "vector-codes")
        state.mapInArrow(_round(books, moved), _STATE).write.parquet(path)
        if before:
            discard(spark, before)
        before, table = path, spark.read.schema(_STATE).parquet(path)
        state = table.filter("totals IS NULL").drop("totals")
        if step == rounds:
            break
        after = _moved_books(table, books)
        moved = (after != books).any(axis=2)
        books = after
        if not moved.any():
            # The codes and distances already are those of the final codebooks.
            break
    return state, books, count


def vector_codes(vectors: DataFrame, **options: object) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``; options are those of ``fit_codes``."""
    state, books, count = fit_codes(vectors, **options)
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    coded = state.select(
        "vec_id",
        "label_key",
        code.alias("code"),
        F.aggregate("errors", F.lit(0).cast("long"), lambda a, x: a + x).alias("error"),
    )
    by_label = coded.groupBy("label_key").agg(
        F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("members")
    )
    return attach_groups(coded, by_label, "label_key", count).select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )
