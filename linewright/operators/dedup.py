"""Exact and near-duplicate removal that keeps the first of each group of copies.

``dedup`` runs jobs: hashing the text is the expensive part, so its narrow result is
written once to the shared folder and everything after it works on ids and hashes.  The
DataFrame returned is lazy over those written tables.

Result columns: ``row_id``, ``fingerprint``, ``is_duplicate``, ``canonical_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.functions.hashing import (
    DEFAULT_SHINGLE,
    fnv1a64,
    hamming_distance,
    readable,
    simhash64,
    simhash64_json,
)
from linewright.plans.attach import COLD_MEMBERS, attach_groups
from linewright.plans.durable import written
from linewright.plans.first_fit import first_fit
from linewright.plans.hamming import BlockScheme, bit_balance, pairs_within
from linewright.plans.tiles import own_pairs, own_tiles_pay

DEFAULT_THRESHOLD = 3
EXACT, SIMHASH = "exact", "simhash"
SAMPLE_SIZE = 5


def strategy_label(strategy: str, threshold: int = DEFAULT_THRESHOLD) -> str:
    return EXACT if strategy == EXACT else f"simhash(t={threshold})"


def fingerprints(
    lines: DataFrame,
    shingle: int = DEFAULT_SHINGLE,
    raw: bool = False,
    min_content_bytes: int = 0,
) -> DataFrame:
    """``row_id``, ``fingerprint``: SimHash of each line's JSON string values.

    ``raw`` hashes the line itself.  Contents shorter than ``min_content_bytes`` get NULL:
    such rows stay out of dedup.
    """
    simhash = simhash64 if raw else simhash64_json
    value = simhash(F.coalesce("line", F.lit("")), shingle, min_content_bytes)
    return lines.select("row_id", value.alias("fingerprint"))


def _decided(rows: DataFrame) -> DataFrame:
    canonical = F.coalesce("canonical", "row_id")
    return rows.select(
        "row_id",
        "fingerprint",
        (canonical != F.col("row_id")).alias("is_duplicate"),
        canonical.alias("canonical_id"),
    )


def dedup_exact(
    lines: DataFrame, fnv_fingerprint: bool = False, cold_members: int = COLD_MEMBERS
) -> DataFrame:
    """Flag rows whose whole line equals an earlier one.

    Lines are compared by a 256-bit digest, so only digests travel; groups are reduced
    before the shuffle, and only lines that do repeat are looked up again.  The
    fingerprint is the digest's first 64 bits, or the line's FNV-1a on request.
    """
    line = readable(F.coalesce("line", F.lit("")))
    digest = F.unhex(F.sha2(line, 256))
    columns = [F.col("row_id"), digest.alias("digest")]
    if fnv_fingerprint:
        columns.append(fnv1a64(line).alias("fnv"))
    hashed, count = written(lines.select(*columns), "digests", narrow=True)
    groups = (
        hashed.groupBy("digest")
        .agg(F.min("row_id").alias("canonical"), F.count(F.lit(1)).alias("members"))
        .filter(F.col("members") > 1)
    )
    if count > cold_members:  # used twice below; its true size also guides the join
        groups, _ = written(groups, "groups")
    joined = attach_groups(hashed, groups, "digest", count, "left", cold_members)
    if fnv_fingerprint:
        fingerprint = F.col("fnv")
    else:
        high = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint")
        low = F.conv(F.hex(F.substring("digest", 5, 4)), 16, 10).cast("bigint")
        fingerprint = F.shiftleft(high, 32).bitwiseOR(low)
    return _decided(joined.withColumn("fingerprint", fingerprint))


def dedup_fingerprints(
    prints: DataFrame,
    threshold: int = DEFAULT_THRESHOLD,
    blocks: int | None = None,
    cold_members: int = COLD_MEMBERS,
    **limits,
) -> DataFrame:
    """First-seen near-duplicate removal over ``row_id``, ``fingerprint``.

    A row is a duplicate iff an earlier row that was itself kept lies within
    ``threshold``; it maps to the smallest such row.  Equal fingerprints share the fate of
    their first row, so only distinct ones enter the search.
    """
    hashed, count = written(
        prints.select("row_id", "fingerprint"), "fingerprints", narrow=True
    )
    groups = (
        hashed.filter(F.col("fingerprint").isNotNull())
        .groupBy("fingerprint")
        .agg(F.min("row_id").alias("id"), F.count(F.lit(1)).alias("members"))
    )
    distinct, distinct_count = written(groups, "distinct")
    nodes = distinct.select("id", F.col("fingerprint").alias("fp"))
    chosen = first_fit(nodes, distinct_count, threshold, blocks, **limits)
    decided = distinct.join(chosen, "id").select("fingerprint", "members", "canonical")
    return _decided(
        attach_groups(
            hashed, decided, "fingerprint", count, "left", cold_members, null_keys=True
        )
    )


def dedup_simhash(
    lines: DataFrame,
    threshold: int = DEFAULT_THRESHOLD,
    shingle: int = DEFAULT_SHINGLE,
    raw: bool = False,
    min_content_bytes: int = 0,
    **options,
) -> DataFrame:
    """Near-duplicate removal over lines; see :func:`dedup_fingerprints`."""
    prints = fingerprints(lines, shingle, raw, min_content_bytes)
    return dedup_fingerprints(prints, threshold, **options)


def dedup(
    lines: DataFrame,
    strategy: str = SIMHASH,
    threshold: int = DEFAULT_THRESHOLD,
    **options,
) -> DataFrame:
    """``exact``, or near-duplicate removal for any other strategy name."""
    if strategy == EXACT:
        return dedup_exact(lines, **options)
    return dedup_simhash(lines, threshold, **options)


def near_duplicate_pairs(
    prints: DataFrame, threshold: int = DEFAULT_THRESHOLD, blocks: int | None = None, **limits
) -> DataFrame:
    """Pairs of distinct fingerprints within ``threshold``: ``row_a < row_b``, ``distance``.

    Each fingerprint is represented by its first row.  Rows with equal fingerprints are
    not paired with each other, since a group of ``n`` copies would give ``n * n`` rows.
    Where many rows would meet on keys, all are compared with all in tiles instead.
    """
    first = prints.filter(F.col("fingerprint").isNotNull()).groupBy("fingerprint")
    nodes = first.agg(F.min("row_id").alias("id")).select("id", F.col("fingerprint").alias("fp"))
    table, count = written(nodes, "distinct")
    scheme = BlockScheme.build(threshold, bit_balance(table, count), blocks)
    if limits.get("tiles", True) and own_tiles_pay(table, count, scheme.masks):
        pairs = own_pairs(table, count, threshold)
    else:
        pairs = pairs_within(table, table, scheme, count, count, **limits)
    return pairs.select(F.col("a").alias("row_a"), F.col("b").alias("row_b"), "distance")


def copy_pairs(flags: DataFrame) -> DataFrame:
    """Each distinct duplicate fingerprint with the kept row it copies: one row per link.

    ``row_id`` is the first row of the fingerprint, ``members`` its rows, ``distance`` how far it is
    from the kept row.  Every duplicate is in one link, however many rows are close to it, so
    the result has at most a row per distinct fingerprint.
    """
    prints = (
        flags.filter(F.col("fingerprint").isNotNull())
        .groupBy("fingerprint", "canonical_id")
        .agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("members"))
    )
    kept = prints.filter("row_id = canonical_id").select(
        "canonical_id", F.col("fingerprint").alias("_kept")
    )
    # A kept row may have very many copies; adaptive execution splits its side.
    linked = prints.filter("row_id <> canonical_id").join(kept, "canonical_id")
    distance = hamming_distance(F.col("fingerprint"), F.col("_kept"))
    return linked.select("canonical_id", "row_id", "members", distance.alias("distance"))


def canonical_map(flags: DataFrame) -> DataFrame:
    return flags.select("row_id", "canonical_id")


def duplicate_flags(flags: DataFrame) -> DataFrame:
    return flags.select("row_id", "is_duplicate")


def duplicate_bitmap(flags: DataFrame) -> DataFrame:
    """Flags packed 32,768 to a row: ``bucket``, ``bitmap``, ``duplicates``."""
    row = F.col("row_id")
    packed = flags.filter("is_duplicate").groupBy(F.bitmap_bucket_number(row).alias("bucket"))
    bitmap = F.bitmap_construct_agg(F.bitmap_bit_position(row))
    return packed.agg(bitmap.alias("bitmap")).select(
        "bucket", "bitmap", F.bitmap_count("bitmap").alias("duplicates")
    )


def dedup_stats(
    flags: DataFrame, strategy: str = SIMHASH, threshold: int = DEFAULT_THRESHOLD
) -> DataFrame:
    """One row: total, unique and duplicate lines, their ratio, and the strategy label."""
    counted = flags.agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if(~F.col("is_duplicate")).alias("unique_count"),
        F.count_if(F.col("is_duplicate")).alias("duplicate_count"),
    )
    ratio = F.when(F.col("total_lines") == 0, F.lit(0.0)).otherwise(
        F.col("duplicate_count") / F.col("total_lines")
    )
    label = F.lit(strategy_label(strategy, threshold))
    return counted.select("*", ratio.alias("dedup_ratio"), label.alias("strategy"))


def duplicate_samples(flags: DataFrame, count: int = SAMPLE_SIZE) -> DataFrame:
    """The first duplicates in row order with their originals (1-based) and distance.

    The sample is a few rows, so it is sent to the table instead of the reverse.
    """
    copies = flags.filter("is_duplicate").orderBy("row_id").limit(count)
    sample = copies.select(
        F.col("row_id").alias("_copy"),
        F.col("fingerprint").alias("_copy_print"),
        F.col("canonical_id").alias("row_id"),
    )
    found = flags.select("row_id", "fingerprint").join(F.broadcast(sample), "row_id")
    return found.select(
        (F.col("_copy") + 1).alias("duplicate_line"),
        (F.col("row_id") + 1).alias("original_line"),
        hamming_distance(F.col("_copy_print"), F.col("fingerprint")).alias("hamming_distance"),
    ).orderBy("duplicate_line")


def duplicate_clusters(flags: DataFrame, min_size: int = 2) -> DataFrame:
    """Size and extent of each group of rows that share a canonical row.

    Members are rows of ``canonical_map``; they are not gathered into one value, as a
    group may hold a large part of the data.
    """
    return (
        flags.groupBy("canonical_id")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.min("row_id").alias("first_row"),
            F.max("row_id").alias("last_row"),
        )
        .filter(F.col("size") >= min_size)
    )
