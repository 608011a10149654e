"""First-fit selection over distinct fingerprints.

Going through the fingerprints in id order, one is kept unless an earlier kept one lies
within the distance; a fingerprint that is not kept maps to the smallest such id.  The
kept ones are the lexicographically first maximal independent set of the closeness graph,
which can be found in few parallel rounds (Blelloch, Fineman and Shun, SPAA 2012).

The graph itself can be quadratic in the number of fingerprints, so it is never built as
a whole.  Ids are taken in growing prefixes: pairs are listed only inside a prefix, its
kept ids are settled, and everything later that is close to one of them is dropped before
the next prefix is taken.  Kept fingerprints are pairwise far apart, so a later one is
close to few of them.  Early prefixes keep few enough ids to be broadcast against the
rest; the number of prefixes grows with the logarithm of the input.

Inputs small enough for their distance are settled by dense tiles instead, which list no pairs.
So are the first ids of larger ones, as long as few are kept and many dropped: at wide distances the
few kept ids are compared with all rows at a fraction of what keys of all rows would cost, and move.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.plans.durable import written
from linewright.plans.hamming import BITS, BlockScheme, bit_balance, pairs_within
from linewright.plans.tiles import tile_rounds

FIRST_PREFIX = 50_000
GROWTH = 8
FEW_EDGES = 1_000_000


def _prefix_bounds(prints: DataFrame, rows: int, first: int, growth: int) -> list[int]:
    """Ids that end each prefix but the last."""
    shares, size = [], float(first)
    while size < rows:
        shares.append(size / rows)
        size *= growth
    if not shares:
        return []
    ids = prints.agg(F.percentile_approx("id", shares, 1_000_000).alias("ids")).first()["ids"]
    return sorted(set(ids))


def _sized(ids: DataFrame, rows: int) -> DataFrame:
    """A join side of at most ``rows`` ids: broadcast if few, shuffled without repeats if not.

    Left to itself, Catalyst would go by the size of the file, which ids compress well in.
    """
    return F.broadcast(ids) if rows <= FEW_EDGES else ids.distinct().hint("merge")


def _later_copies(edges: DataFrame, count: int) -> DataFrame | None:
    """The ``b`` of every edge whose fate is to be dropped, from edges ``a < b``.

    Each round, an ``a`` with no edge into it is kept and what it points to is dropped,
    with all edges of the dropped ids.  The edges left over shrink geometrically.
    """
    dropped = []
    while count:
        targets = _sized(edges.select(F.col("b").alias("a")), count)
        losers = edges.join(targets, "a", "left_anti").select("b").distinct()
        marks = _sized(losers.withColumn("lost", F.lit(True)), count)
        labelled = (
            edges.join(marks, "b", "left")
            .withColumnRenamed("lost", "b_lost")
            .join(marks.withColumnRenamed("b", "a"), "a", "left")
            .select(
                "a",
                "b",
                F.coalesce("b_lost", F.lit(False)).alias("b_lost"),
                F.coalesce("lost", F.lit(False)).alias("a_lost"),
            )
        )
        open_edge = ~F.col("a_lost") & ~F.col("b_lost")
        decided, count = written(labelled.filter("b_lost or not a_lost"), "round", open_edge)
        dropped.append(decided.filter("b_lost").select("b"))
        edges = decided.filter(open_edge).select("a", "b")
    return reduce(DataFrame.unionAll, dropped).distinct() if dropped else None


def _settle(prefix: DataFrame, rows: int, scheme: BlockScheme, **limits) -> DataFrame:
    """``id``, ``fp``, ``canonical`` for a prefix none of whose ids is close to a kept one."""
    pairs = pairs_within(prefix, prefix, scheme, rows, rows, **limits).select("a", "b")
    edges, count = written(pairs, "edges")
    lost = _later_copies(edges, count)
    if lost is None:
        return prefix.withColumn("canonical", F.col("id"))
    from_kept = edges.join(_sized(lost.withColumnRenamed("b", "a"), count), "a", "left_anti")
    nearest = from_kept.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("canonical"))
    return prefix.join(nearest, "id", "left").select(
        "id", "fp", F.coalesce("canonical", "id").alias("canonical")
    )


def first_fit(
    prints: DataFrame,
    rows: int,
    k: int,
    blocks: int | None = None,
    first_prefix: int = FIRST_PREFIX,
    growth: int = GROWTH,
    tiles: bool = True,
    **limits,
) -> DataFrame:
    """``id``, ``canonical`` for written rows ``id``, ``fp`` with distinct fingerprints.

    Kept ids are their own canonical.  ``tiles`` off never compares all rows with all.
    """
    if k <= 0 or rows == 0:
        return prints.select("id", F.col("id").alias("canonical"))
    if k >= BITS:
        return prints.select("id", prints.agg(F.min("id")).scalar().alias("canonical"))
    parts, remaining, left_over = [], prints.select("id", "fp"), rows
    if tiles:
        parts, remaining, left_over = tile_rounds(prints, rows, k, BlockScheme.build(k).key_count)
    if not left_over:
        return reduce(DataFrame.unionAll, [part.select("id", "canonical") for part in parts])
    scheme = BlockScheme.build(k, bit_balance(remaining, left_over), blocks)
    limits["tiles"] = tiles
    for bound in [*_prefix_bounds(remaining, left_over, first_prefix, growth), None]:
        if bound is None:
            parts.append(_settle(remaining, left_over, scheme, **limits))
            break
        prefix, size = written(remaining.filter(F.col("id") <= bound), "prefix")
        settled, _ = written(_settle(prefix, size, scheme, **limits), "settled")
        parts.append(settled)
        kept = settled.filter(F.col("id") == F.col("canonical")).select("id", "fp")
        later = remaining.filter(F.col("id") > bound)
        close = pairs_within(kept, later, scheme, size, left_over - size, **limits)
        nearest = close.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("canonical"))
        free = F.col("canonical").isNull()
        swept, left_over = written(later.join(nearest, "id", "left"), "swept", free)
        parts.append(swept.filter(~free))
        remaining = swept.filter(free).select("id", "fp")
        if not left_over:
            break
    return reduce(DataFrame.unionAll, [part.select("id", "canonical") for part in parts])
