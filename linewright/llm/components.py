"""Connected components of a link table, in rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.plans.durable import written

_MAX_ROUNDS = 64


def _stars(links: DataFrame, smaller: bool) -> DataFrame:
    """Link neighbours of each node to the least node among them.

    ``smaller`` takes a node's smaller neighbours and itself; otherwise its larger ones are
    linked to the least of all.  Minima are pre-aggregated before they are shuffled, and the
    join on a node of very many links is one that adaptive execution splits.
    """
    forward = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    backward = forward.select(F.col("b").alias("a"), F.col("a").alias("b"))
    sides = forward if smaller else forward.unionByName(backward)
    least = sides.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select(F.col("a").alias("node"), F.least("a", "least").alias("least"))
    joined = sides.join(least, F.col("a") == F.col("node"))
    if smaller:
        made = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select(F.col("node").alias("a"), F.col("least").alias("b"))
        )
    else:
        made = joined.filter(F.col("b") > F.col("a")).select(
            F.col("b").alias("a"), F.col("least").alias("b")
        )
    return made.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a``, ``b``: BIGINT).

    The component is its least node.  Large-star and small-star rounds alternate until the
    links no longer change; the number of rounds grows with the logarithm of the longest chain.
    """
    current, _ = written(
        links.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "links"
    )
    before = None
    for _ in range(_MAX_ROUNDS):
        marks = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 30)), F.sum(F.col("b") % (1 << 30))
        ).first()
        if tuple(marks) == before:
            break
        before = tuple(marks)
        current, _ = written(_stars(_stars(current, False), True), "links")
    else:
        raise RuntimeError("the links did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
