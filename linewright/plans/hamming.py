"""Exact join of 64-bit fingerprints within a Hamming distance.

The 64 bits are dealt into blocks.  Two fingerprints at distance ``k`` or less differ in
at most ``k`` blocks, so they agree on some choice of ``blocks - k`` blocks (Manku, Jain
and Das Sarma, WWW 2007).  Each fingerprint is emitted once per choice under the bits of
the chosen blocks, and an equality join finds every pair; a pair is reported only under
its first matching choice, so nothing needs de-duplicating.

Bucket sizes are measured wherever a bucket could be large, and large ones are split:

* Where flipping bits is cheaper than testing pairs, the bucket is joined on *variants*: the
  left rows with up to ``k - k // 2`` of their free bits flipped against the right rows with
  up to ``k // 2`` flipped.  Only true pairs meet, and since fingerprints are distinct, no
  variant is shared by more rows than a ball of that radius holds.
* Otherwise the bucket is laid over a grid: its left rows are dealt into rows of cells and its
  right rows into columns, as many as its measured product asks for, so that no task tests
  more than CELL_TESTS pairs of it, at any distance.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.functions.hashing import hamming_distance
from linewright.plans.durable import written
from linewright.plans.tiles import cheaper, tile_pairs

BITS = 64
_SIGN = 1 << 63

# Fingerprints looked at to deal bits into blocks.
BALANCE_ROWS = 100_000
# Pairs of one bucket that one task tests; a bucket with more is split.
CELL_TESTS = 20_000_000
# Keys of the left side that may be broadcast: about 64 bytes each in memory.
BROADCAST_KEYS = 2_000_000


def signed(value: int) -> int:
    """A 64-bit pattern as the BIGINT that holds it."""
    return value - (1 << 64) if value & _SIGN else value


def ball(bits: int, radius: int) -> int:
    """How many patterns lie within ``radius`` flips of one."""
    return sum(comb(bits, flips) for flips in range(radius + 1))


def bit_balance(prints: DataFrame, rows: int, column: str = "fp") -> list[float]:
    """For each bit, how far its share of ones is from one half.

    The shares only steer which bits share a block; any choice gives the same pairs.  So
    a sample is enough, and it keeps this step small on large inputs.
    """
    if rows > BALANCE_ROWS:
        prints = prints.sample(BALANCE_ROWS / rows, seed=0)
    bits = prints.select(column, F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("bit"))
    one = F.getbit(F.col(column), F.col("bit")).cast("bigint")
    shares = bits.groupBy("bit").agg(F.avg(one).alias("share")).collect()
    balance = [0.0] * BITS
    for row in shares:
        balance[row["bit"]] = abs(row["share"] - 0.5)
    return balance


@dataclass(frozen=True)
class BlockScheme:
    """The blocks of a distance ``k`` and the choices of blocks used as join keys."""

    k: int
    blocks: tuple[int, ...]

    @classmethod
    def build(
        cls, k: int, balance: list[float] | None = None, blocks: int | None = None
    ) -> BlockScheme:
        """Deal bits into ``k + 3`` blocks (or ``blocks``).

        With ``balance`` the most evenly split bits are dealt first, back and forth, so
        that no block is left with bits that hardly ever differ.
        """
        if not 1 <= k < BITS:
            raise ValueError("k must lie between 1 and 63")
        count = min(blocks or k + 3, BITS)
        if count <= k:
            raise ValueError("there must be more blocks than k")
        order = sorted(range(BITS), key=lambda i: (balance[i], i)) if balance else range(BITS)
        masks = [0] * count
        for rank, bit in enumerate(order):
            lap, place = divmod(rank, count)
            masks[place if lap % 2 == 0 else count - 1 - place] |= 1 << bit
        return cls(k, tuple(masks))

    @property
    def key_count(self) -> int:
        return comb(len(self.blocks), self.k)

    @property
    def choices(self) -> list[tuple[int, ...]]:
        return list(combinations(range(len(self.blocks)), len(self.blocks) - self.k))

    @property
    def masks(self) -> list[int]:
        return [sum(self.blocks[b] for b in choice) for choice in self.choices]

    def skipped(self) -> list[list[int]]:
        """Per choice, ``k`` masks that must all differ for it to be the pair's first.

        These are the blocks passed over before the choice's last one, padded with
        all ones, which any two distinct fingerprints satisfy.
        """
        result = []
        for choice in self.choices:
            passed = [self.blocks[b] for b in range(choice[-1]) if b not in choice]
            result.append(passed + [(1 << BITS) - 1] * (self.k - len(passed)))
        return result

    @property
    def radii(self) -> tuple[int, int]:
        """Flips on the left and on the right; the right side, often longer, has fewer."""
        return self.k - self.k // 2, self.k // 2

    def variants(self) -> int:
        """Rows per fingerprint, both sides together, when a bucket is joined on variants."""
        free = max(BITS - mask.bit_count() for mask in self.masks)
        return sum(ball(free, radius) for radius in self.radii)


def _bigints(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(f"{signed(v)}L" for v in values) + ")")


def _keyed(prints: DataFrame, scheme: BlockScheme, side: str) -> DataFrame:
    """One row per fingerprint and choice: ``{side}``, ``fp_{side}``, ``choice``, ``key``."""
    masked = prints.select(
        F.col("id").alias(side),
        F.col("fp").alias(f"fp_{side}"),
        F.posexplode(_bigints(scheme.masks)).alias("choice", "_mask"),
    )
    key = F.col(f"fp_{side}").bitwiseAND(F.col("_mask"))
    return masked.select(side, f"fp_{side}", "choice", key.alias("key"))


def _is_pair(scheme: BlockScheme) -> Column:
    """Left before right, close enough, and met under the first choice that matches."""
    delta = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    test = (F.col("a") < F.col("b")) & (F.bit_count(delta) <= scheme.k)
    skipped = scheme.skipped()
    for place in range(scheme.k):
        masks = _bigints([row[place] for row in skipped])
        test = test & (delta.bitwiseAND(F.get(masks, F.col("choice"))) != 0)
    return test


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select("a", "b", hamming_distance(F.col("fp_a"), F.col("fp_b")).alias("distance"))


def _lowest_bits(delta: Column, count: int) -> Column:
    """The ``count`` lowest set bits of a pattern."""
    rest = delta
    smallest = F.lit(-(1 << 63)).cast("bigint")
    for _ in range(count):
        cleared = rest.bitwiseAND(rest - F.lit(1).cast("bigint"))
        rest = F.when(rest == smallest, F.lit(0).cast("bigint")).otherwise(cleared)
    return delta.bitwiseXOR(rest)


def _flips(spark: SparkSession, scheme: BlockScheme, radius: int) -> DataFrame:
    """``choice, flip``: per choice, every way to flip up to ``radius`` bits outside its mask.

    Spark builds them bit by bit: each round adds one bit above the highest so far.
    """
    free = [(number, mask) for number, mask in enumerate(scheme.masks)]
    masks = spark.createDataFrame([(n, signed(m)) for n, m in free], "choice int, mask bigint")
    single = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))
    none = masks.select("choice", "mask", F.lit(0).cast("bigint").alias("flip"), F.lit(-1).alias("top"))
    rounds = [none]
    for _ in range(radius):
        grown = rounds[-1].filter(F.col("top") < BITS - 1).select(
            "choice", "mask", "flip", F.explode(F.sequence(F.col("top") + 1, F.lit(BITS - 1))).alias("bit")
        )
        unset = grown.filter(F.col("mask").bitwiseAND(single) == 0)
        rounds.append(
            unset.select("choice", "mask", F.col("flip").bitwiseOR(single).alias("flip"), F.col("bit").alias("top"))
        )
    return reduce(DataFrame.unionAll, rounds).select("choice", "flip")


def _variant_pairs(left: DataFrame, right: DataFrame, scheme: BlockScheme) -> DataFrame:
    """Pairs of large buckets: rows meet on a common variant of their fingerprints.

    The flip tables depend on the distance alone and are small where variants pay.
    A pair shares several variants; it counts only where the left side flipped the lowest
    differing bits.
    """
    spark = left.sparkSession
    flips_left, flips_right = scheme.radii
    left_flips = F.broadcast(_flips(spark, scheme, flips_left))
    right_flips = F.broadcast(_flips(spark, scheme, flips_right))
    spread_left = left.join(left_flips, "choice").select(
        "choice", "a", "fp_a", "flip", F.col("fp_a").bitwiseXOR(F.col("flip")).alias("variant")
    )
    spread_right = right.join(right_flips, "choice").select(
        "choice", "b", "fp_b", F.col("fp_b").bitwiseXOR(F.col("flip")).alias("variant")
    )
    delta = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    joined = spread_left.join(spread_right, ["choice", "variant"])
    lowest = _lowest_bits(delta, flips_left)
    return _pairs(joined.filter(_is_pair(scheme) & (F.col("flip") == lowest)))


def _grid_pairs(left: DataFrame, right: DataFrame, sizes: DataFrame, scheme: BlockScheme) -> DataFrame:
    """Pairs of large buckets, each over a grid of ``across`` by ``down`` cells.

    ``sizes`` has ``choice, key, across, down``.  A left row goes to one row of cells and is
    copied along it, a right row to one column.
    """
    bucket = ["choice", "key"]
    placed_left = left.join(sizes, bucket).select(
        *bucket, "a", "fp_a",
        F.pmod(F.xxhash64("a"), F.col("down")).cast("int").alias("y"),
        F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("x"),
    )
    placed_right = right.join(sizes, bucket).select(
        *bucket, "b", "fp_b",
        F.pmod(F.xxhash64("b"), F.col("across")).cast("int").alias("x"),
        F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("y"),
    )
    joined = placed_left.hint("merge").join(placed_right, [*bucket, "x", "y"])
    return _pairs(joined.filter(_is_pair(scheme)))


def _large_buckets(
    keyed_left: DataFrame, keyed_right: DataFrame, scheme: BlockScheme, limit: int, tests: int
) -> DataFrame:
    """``choice, key, wide, across, down`` of buckets of more than ``tests`` pairs.

    Wide ones have more than ``limit`` left rows and go by variants.  The cells of a grid are as
    square as the bucket allows, since each side is copied once per cell of the other.
    """
    lefts = keyed_left.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n"))
    rights = keyed_right.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("m"))
    side = F.lit(float(tests) ** 0.5)
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    # A side shorter than the square's takes one cell, and the other side the rest.
    down = F.greatest(F.ceil(n / F.greatest(side, tests / m)), F.lit(1)).cast("int")
    across = F.greatest(F.ceil(m / F.greatest(side, tests / n)), F.lit(1)).cast("int")
    large = lefts.join(rights, ["choice", "key"]).filter(n * m > tests)
    return large.select(
        "choice", "key", (F.col("n") > limit).alias("wide"), across.alias("across"), down.alias("down")
    )


def pairs_within(
    left: DataFrame,
    right: DataFrame,
    scheme: BlockScheme,
    left_rows: int,
    right_rows: int,
    bucket_limit: int | None = None,
    cell_tests: int = CELL_TESTS,
    broadcast_keys: int = BROADCAST_KEYS,
    tiles: bool = True,
) -> DataFrame:
    """All pairs ``a < b``, ``a`` on the left and ``b`` on the right, within ``scheme.k``.

    Both sides are ``id BIGINT, fp BIGINT`` with distinct fingerprints per side, written
    or otherwise cheap to read again.  A left side of at most ``broadcast_keys`` keys is
    broadcast, so the right side is not shuffled; a larger one never is.
    Buckets of more than ``cell_tests`` pairs are split.  Of these, the ones with more than
    ``bucket_limit`` left rows go by variants; by default that is where variants, which are so
    many per row, become cheaper than pairs, and at larger distances that is never.
    Where comparing all rows is cheaper than making their keys, dense tiles do it, unless
    ``tiles`` is off.
    """
    if tiles and cheaper(left_rows, right_rows, scheme.key_count):
        return tile_pairs(left, right, scheme.k, left_rows, right_rows)
    limit = bucket_limit if bucket_limit is not None else scheme.variants()
    small_left = left_rows * len(scheme.masks) <= broadcast_keys
    keyed_left, keyed_right = _keyed(left, scheme, "a"), _keyed(right, scheme, "b")
    bucket = ["choice", "key"]

    def plain(one: DataFrame, other: DataFrame) -> DataFrame:
        placed = F.broadcast(one) if small_left else one.hint("merge")
        return _pairs(placed.join(other, bucket).filter(_is_pair(scheme)))

    if left_rows * right_rows <= cell_tests:
        # No bucket can hold more pairs than there are.
        return plain(keyed_left, keyed_right)
    large = _large_buckets(keyed_left, keyed_right, scheme, limit, cell_tests)
    hot, hot_count = written(large, "buckets")
    if not hot_count:
        return plain(keyed_left, keyed_right)
    keys = hot.select(*bucket)
    result = plain(
        keyed_left.join(keys, bucket, "left_anti"), keyed_right.join(keys, bucket, "left_anti")
    )
    wide = hot.filter("wide").select(*bucket)
    if hot.filter("wide").limit(1).count():
        result = result.unionAll(
            _variant_pairs(
                keyed_left.join(wide, bucket, "left_semi"),
                keyed_right.join(wide, bucket, "left_semi"),
                scheme,
            )
        )
    sizes = hot.filter(~F.col("wide")).select(*bucket, "across", "down")
    return result.unionAll(_grid_pairs(keyed_left, keyed_right, sizes, scheme))
