"""Joining per-group results back to rows when one group may hold most of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Groups of at most this many rows always take the plain join.
COLD_MEMBERS = 1_000_000
# A group is hot when it holds more than one row in this many, so there are at most this
# many hot groups, whatever the size of the data.
HOT_GROUPS = 10_000


def attach_groups(
    rows: DataFrame,
    groups: DataFrame,
    key: str,
    row_count: int,
    how: str = "inner",
    cold_members: int = COLD_MEMBERS,
    null_keys: bool = False,
) -> DataFrame:
    """Join ``groups`` (``key``, ``members``, ...) to ``rows`` on ``key``.

    ``members`` is the size of each group among ``rows``.  Rows of hot groups meet a
    broadcast table and are not shuffled; the others are joined by key.  With
    ``null_keys``, rows without a key pass by the join instead of meeting in one task.
    """
    if null_keys:
        bare = rows.filter(F.col(key).isNull())
        keyed = rows.filter(F.col(key).isNotNull())
        joined = attach_groups(keyed, groups, key, row_count, how, cold_members)
        return joined.unionByName(bare, allowMissingColumns=True)
    limit = max(cold_members, row_count // HOT_GROUPS)
    if row_count <= limit:
        return rows.join(groups, key, how)
    hot_groups = groups.filter(F.col("members") > limit).withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(hot_groups), key, "left")
    extra = [c for c in groups.columns if c != key]
    hot = marked.filter(F.col("_hot")).drop("_hot")
    rest = marked.filter(F.col("_hot").isNull()).drop("_hot", *extra)
    cold = rest.join(groups.filter(F.col("members") <= limit), key, how)
    return hot.unionByName(cold)
