"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is cut at its quantiles into ``2**bits`` cells (strings by their whole values, ranked
by the rows before them), the cells of a row give its
index on the curve, and the rows, sorted by that index, are cut into runs of equal length.
Rows that are close in all dimensions fall into the same few shards, so a filter on any of
them skips most shards by their minima and maxima (``shard_bounds``).

Defined results: a NULL in a dimension counts as its lowest cell; a NULL text has no bytes;
rows that tie on the curve follow ``doc_id`` (NULL first), then the checksum of the text, and
identical rows take adjacent slots.  An empty table gives no rows.  Extra columns of the input
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from linewright.llm.ranking import with_global_rank
from linewright.plans.attach import attach_groups
from linewright.plans.durable import written

DIMENSIONS = ("lang", "source", "n_chars")
BITS = 6
# Values of more rows than this, and of more than one row in 10,000, are joined by broadcast.
HOT_ROWS = 10_000

def _gray(i: int) -> int:
    return i ^ (i >> 1)


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """Digit and next state for each (state, sub-cell) of the ``dims``-dimensional curve.

    A state is an entry corner and a direction.  The sub-cell with Gray rank ``w`` is visited
    ``w``-th; the sub-curve inside it enters and leaves through the corners that join it to
    its neighbours.
    """
    size, mask = 1 << dims, (1 << dims) - 1

    def turn_left(x: int, by: int) -> int:
        by %= dims
        return ((x << by) | (x >> (dims - by))) & mask

    def entry(w: int) -> int:
        return 0 if w == 0 else _gray(2 * ((w - 1) // 2))

    def direction(w: int) -> int:
        if w == 0:
            return 0
        odd = w if w & 1 else w - 1
        trailing_ones = (~odd & (odd + 1)).bit_length() - 1
        return trailing_ones % dims

    rank_of = {_gray(w): w for w in range(size)}
    digits, nexts = [], []
    for state in range(size * dims):
        corner, along = divmod(state, dims)
        for cell in range(size):
            w = rank_of[turn_left(cell ^ corner, dims - (along + 1) % dims)]
            digits.append(w)
            then = corner ^ turn_left(entry(w), along + 1)
            nexts.append(then * dims + (along + direction(w) + 1) % dims)
    return digits, nexts


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a point given as integer cells of ``bits`` bits each."""
    dims = len(cells)
    digits, nexts = curve_tables(dims)
    digit_of = F.array(*[F.lit(x) for x in digits])
    next_of = F.array(*[F.lit(x) for x in nexts])

    def corner(level: int) -> Column:
        total = F.lit(0)
        for i, cell in enumerate(cells):
            bit = F.shiftright(cell, level).bitwiseAND(1)
            total = total + F.shiftleft(bit, i)
        return total

    levels = F.array(*[corner(level) for level in range(bits - 1, -1, -1)])
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index"))

    def step(at: Column, sub: Column) -> Column:
        key = at["state"] * (1 << dims) + sub
        return F.struct(
            F.get(next_of, key).alias("state"),
            (at["index"] * (1 << dims) + F.get(digit_of, key)).alias("index"),
        )

    return F.aggregate(levels, start, step, lambda at: at["index"])


def value_ranks(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``value, members, ordinal`` of each distinct value, and all their rows; NULL is left out.

    The ordinal is the number of rows with smaller values, so it orders whole values, whatever
    they begin with.  Values are sorted in ranges; only one row per range meets in a window.
    """
    counts, _ = written(
        df.filter(F.col(name).isNotNull())
        .groupBy(F.col(name).alias("value"))
        .agg(F.count(F.lit(1)).alias("members")),
        "values",
    )
    ranges, _ = written(
        counts.orderBy("value").withColumn("range", F.spark_partition_id()), "value-ranges"
    )
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.groupBy("range").agg(F.sum("members").alias("rows")).select(
        "range", F.coalesce(F.sum("rows").over(earlier.orderBy("range")), F.lit(0)).alias("base")
    )
    inside = F.coalesce(
        F.sum("members").over(earlier.partitionBy("range").orderBy("value")), F.lit(0)
    )
    ranked, _ = written(
        ranges.withColumn("inside", inside)
        .join(F.broadcast(bases), "range")
        .select("value", "members", (F.col("base") + F.col("inside")).alias("ordinal")),
        "value-ranks",
    )
    return ranked, ranked.agg(F.sum("members")).first()[0] or 0


def _fractions(bits: int) -> list[float]:
    return [i / (1 << bits) for i in range(1, 1 << bits)]


def _rank_cuts(ranked: DataFrame, rows: int, bits: int) -> list[int]:
    """The ordinals of the values that hold each quantile of the rows."""
    held = [
        F.max(F.when(F.col("ordinal") <= int(f * rows), F.col("ordinal"))) for f in _fractions(bits)
    ]
    return [cut for cut in ranked.agg(*held).first() if cut is not None]


def quantile_cuts(df: DataFrame, name: str, bits: int) -> list[int]:
    """The cuts of a numeric dimension into ``2**bits`` cells, by a sketch of bounded size."""
    number = F.col(name).cast("long")
    return df.agg(F.percentile_approx(number, _fractions(bits), 10_000)).first()[0] or []


def _cell(value: str, cuts: list[int]) -> Column:
    """Number of cuts below the value; none for NULL.

    ``value`` is a column of the step before, and it is named twice here so that it is not
    computed anew for every cut.
    """
    known = F.array(*[F.lit(x).cast("long") for x in cuts]).cast("array<bigint>")
    below = F.size(F.filter(known, lambda cut: cut < F.col(value)))
    return F.when(F.col(value).isNull(), F.lit(0)).otherwise(below)


def with_curve(df: DataFrame, cuts: list[list[int]], bits: int) -> DataFrame:
    """Add ``curve`` from the ordinals ``_o0``, ``_o1``, ...; one projection for each step."""
    names = range(len(cuts))
    cells = df.withColumns({f"_c{i}": _cell(f"_o{i}", cuts[i]) for i in names})
    index = hilbert_index([F.col(f"_c{i}") for i in names], bits)
    return cells.withColumn("curve", index).drop(*[f"_{k}{i}" for i in names for k in "oc"])


def hilbert_shards(
    docs: DataFrame,
    shards: int,
    dimensions: list[str] | None = None,
    bits: int = BITS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Shard and slot of every row: ``doc_id, size, text_crc32, curve, shard, slot``.

    Counts differ by one at most between shards.  Only these narrow columns are shuffled.
    """
    dimensions = list(dimensions or DIMENSIONS)
    text = F.coalesce(F.col(text_column), F.lit(""))
    plain = docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        *[F.col(d).alias(f"_o{i}") for i, d in enumerate(dimensions)],
    )
    cuts: list[list[int]] = []
    for i, name in enumerate(dimensions):
        at = f"_o{i}"
        if not isinstance(docs.schema[name].dataType, StringType):
            plain = plain.withColumn(at, F.col(at).cast("long"))
            cuts.append(quantile_cuts(docs, name, bits))
            continue
        ranked, rows = value_ranks(docs, name)
        cuts.append(_rank_cuts(ranked, rows, bits))
        groups = ranked.withColumnRenamed("value", at)
        # A few values may hold most rows, and NULL may, too.
        joined = attach_groups(plain, groups, at, rows, "left", cold_members=HOT_ROWS, null_keys=True)
        plain = joined.drop(at, "members").withColumnRenamed("ordinal", at)
    slim = with_curve(plain, cuts, bits)
    order = [F.col("curve"), F.col("doc_id").asc_nulls_first(), F.col("text_crc32")]
    ranked, total = with_global_rank(slim, order, "hilbert")
    # Whole-number division, exact at any size.
    shard = F.expr(f"rank * {shards}L div {max(total, 1)}L")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return (
        ranked.withColumn("shard", shard)
        .withColumn("slot", F.col("rank") - first)
        .select("doc_id", "size", "text_crc32", "curve", F.col("shard").cast("int"), "slot")
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_column: str = "doc_id") -> None:
    """Write the rows of ``docs`` into one folder per shard, in slot order."""
    places = placed.select(F.col("doc_id").alias("_id"), "shard", "slot")
    packed = docs.select(F.struct(*[c for c in docs.columns if c != "shard"]).alias("row"))
    rows = packed.join(places, F.col(f"row.{id_column}").eqNullSafe(F.col("_id")))
    (
        rows.repartition("shard")
        .sortWithinPartitions("shard", "slot")
        .select("row.*", "shard")
        .write.partitionBy("shard")
        .parquet(path)
    )


def shard_bounds(sharded: DataFrame, dimensions: list[str]) -> DataFrame:
    """Minimum and maximum of each dimension per shard: what a reader prunes shards by."""
    ends = [f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *ends)
