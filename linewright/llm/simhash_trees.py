"""SimHash near-duplicates, found with vantage-point trees over the fingerprints.

Two fingerprints that differ in at most ``distance`` bits differ in at most
``distance // BANDS`` bits of one of BANDS bands, and a band's Hamming distance is a metric with
few values to tell apart.  So each band has a vantage-point tree: a node holds a vantage point
and a radius, and splits fingerprints by their distance to the point.  By the triangle bound a
neighbour can only be on the other side where a fingerprint lies within the search radius of
the boundary.  The leaves are the shards.  A fingerprint lives in one leaf of each tree and is
also sent, as a query, to the leaves its ball overlaps; inside a leaf the tree goes on in memory
and the last few candidates are compared over all 64 bits.

The trees are built from a bounded sample of fingerprints (TREE_SAMPLE); every fingerprint is
placed and searched.  Equal fingerprints are one node, so copies never meet as pairs, and a leaf
emits spanning links, not pairs.  Leaves above LEAF_ROWS rows are cut into parts by their own
rows.  Components come from rounds of joins.

Defined results: a NULL or empty text has fingerprint zero, linked like any other; rows that
share a doc_id keep their own fingerprints; a NULL doc_id gets the component of its fingerprint,
NULL if no row with an id reaches it; an empty table gives no rows; extra columns are ignored by
``simhash_components`` and kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.components import components
from linewright.llm.words import Words, chunks
from linewright.plans.durable import written

SHINGLE = 4
DISTANCE = 4
BANDS = 3
TREE_SAMPLE = 65_536
# Fingerprints that live in a leaf, about; the sample bounds the number of leaves.
LEAF_HOMES = 2_048
_LEAST_SAMPLE = 8
LEAF_ROWS = 200_000
# Comparisons made at once.
_BLOCK = 1 << 20
_SEED = 42


def _joined(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one space after each, and where each starts and ends there."""
    sizes = words.ends - words.starts
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    out = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[within + np.repeat(starts, sizes)] = words.data[within + np.repeat(words.starts, sizes)]
    return out.tobytes(), starts, starts + sizes


def fingerprints_of(words: Words, shingle: int) -> np.ndarray:
    """One SimHash per text; zero for a text without words."""
    raw, starts, ends = _joined(words)
    last = np.cumsum(words.counts)
    # A text with fewer words than a shingle is one shingle.
    tail = np.minimum(np.arange(len(starts)) + shingle, np.repeat(last, words.counts)) - 1
    place = words.place_of
    used = (words.left_of >= shingle) | (place == 0)
    first, final = starts[used].tolist(), ends[tail[used]].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(raw[s:e], _SEED) for s, e in zip(first, final, strict=True)], np.uint64
    )
    sizes = np.bincount(words.text_of[used], minlength=len(words.counts))
    prints = np.zeros(len(words.counts), np.uint64)
    filled = np.flatnonzero(sizes)
    if len(filled):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(sizes) - sizes)[filled], axis=0, dtype=np.int64)
        major = ones * 2 > sizes[filled][:, None]
        prints[filled] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return prints


def simhash_fingerprints(
    docs: DataFrame,
    shingle: int = SHINGLE,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, print``: the fingerprint as a BIGINT of the same bits, one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in chunks(batches, lower=True):
            prints = pa.array(fingerprints_of(words, shingle).view(np.int64))
            yield pa.record_batch([batch.column("doc_id"), prints], names=["doc_id", "print"])

    slim = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")
    )
    return slim.mapInArrow(run, "doc_id long, print long")


class VantageTree:
    """A tree over one band: arrays of points, radii and children; leaves are numbered."""

    def __init__(self, prints: np.ndarray, shift: int, mask: int, reach: int, least: int) -> None:
        self.shift, self.mask, self.reach = np.uint64(shift), np.uint64(mask), reach
        self.points: list[int] = []
        self.radii: list[int] = []
        self.children: list[tuple[int, int]] = []
        self.leaves = 0
        draw = np.random.default_rng(7)
        self.root = self._build(self.band(prints), least, draw)

    def band(self, prints: np.ndarray) -> np.ndarray:
        return (prints >> self.shift) & self.mask

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _build(self, values: np.ndarray, least: int, draw: np.random.Generator) -> int:
        """Index of the node, or minus one minus the number of the leaf."""
        if len(values) < 2 * least:
            return self._leaf()
        point = values[draw.integers(len(values))]
        away = np.bitwise_count(values ^ point)
        radius = split_radius(away)
        near = away <= radius
        if near.all() or not near.any():
            return self._leaf()
        node = len(self.points)
        self.points.append(int(point))
        self.radii.append(radius)
        self.children.append((0, 0))
        left = self._build(values[near], least, draw)
        self.children[node] = (left, self._build(values[~near], least, draw))
        return node

    def route(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home): each print's own leaf, and later leaves its ball overlaps.

        Of two prints the one in the earlier leaf asks, so leaves before its own are left out.
        """
        if self.root < 0:
            n = len(prints)
            return np.arange(n), np.zeros(n, np.int64), np.ones(n, bool)
        points = np.array(self.points, np.uint64)
        radii, children = np.array(self.radii), np.array(self.children)
        values = self.band(prints)
        row, node = np.arange(len(prints)), np.full(len(prints), self.root)
        home = np.ones(len(prints), bool)
        done: list[tuple[np.ndarray, ...]] = []
        while len(row):
            away = np.bitwise_count(values[row] ^ points[node]).astype(np.int64)
            inner = away <= radii[node]
            left = away - self.reach <= radii[node]
            right = away + self.reach > radii[node]
            # Left leaves come first: a home on the right does not ask the left.
            left &= inner | ~home
            row_ = np.concatenate([row[left], row[right]])
            home_ = np.concatenate([(home & inner)[left], (home & ~inner)[right]])
            node_ = np.concatenate([children[node[left], 0], children[node[right], 1]])
            ended = node_ < 0
            done.append((row_[ended], -node_[ended] - 1, home_[ended]))
            row, node, home = row_[~ended], node_[~ended], home_[~ended]
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))


def split_radius(away: np.ndarray) -> int:
    """The radius that halves the distances best and leaves something outside, if any does."""
    counts = np.cumsum(np.bincount(away))
    best = int(np.argmin(np.abs(counts * 2 - counts[-1])))
    return best if counts[best] < counts[-1] or best == 0 else best - 1


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the groups of each pair; ``label`` maps a row to the least row of its group."""
    while True:
        one, two = label[a], label[b]
        apart = one != two
        if not apart.any():
            return label
        one, two = one[apart], two[apart]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further


def linked(
    prints: np.ndarray, home: np.ndarray, band: np.ndarray, reach: int, distance: int
) -> np.ndarray:
    """Group label of each row of a leaf, from all links between a home and any row."""
    label = np.arange(len(prints))
    draw = np.random.default_rng(11)
    todo = [(np.flatnonzero(home), np.arange(len(prints)))]
    while todo:
        homes, asking = todo.pop()
        if not len(homes) or not len(asking):
            continue
        if len(homes) * len(asking) > _BLOCK:
            point = band[homes[draw.integers(len(homes))]]
            own = np.bitwise_count(band[homes] ^ point).astype(np.int64)
            radius = split_radius(own)
            near = own <= radius
            if near.any() and not near.all():
                away = np.bitwise_count(band[asking] ^ point).astype(np.int64)
                todo.append((homes[near], asking[away - reach <= radius]))
                todo.append((homes[~near], asking[away + reach > radius]))
                continue
        step = max(1, _BLOCK // len(asking))
        for start in range(0, len(homes), step):
            some = homes[start : start + step]
            close = np.bitwise_count(prints[some][:, None] ^ prints[asking][None, :]) <= distance
            i, j = np.nonzero(close)
            label = _merge(label, some[i], asking[j])
    return label


def _trees(sample: np.ndarray, total: int, distance: int) -> list[VantageTree]:
    scale = max(1.0, total / max(1, len(sample)))
    least = max(_LEAST_SAMPLE, int(LEAF_HOMES / scale))
    edges = np.linspace(0, 64, BANDS + 1).astype(int)
    return [
        VantageTree(sample, lo, (1 << (hi - lo)) - 1, distance // BANDS, least)
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)
    ]


_ROUTED = "leaf int, band int, print long, node long, home boolean"


def _router(trees: list[VantageTree]):
    firsts = np.cumsum([0] + [t.leaves for t in trees])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.asarray(batch.column("print"))
            nodes = np.asarray(batch.column("node"))
            for band, tree in enumerate(trees):
                row, leaf, home = tree.route(prints.view(np.uint64))
                columns = [
                    pa.array((leaf + firsts[band]).astype(np.int32)),
                    pa.array(np.full(len(row), band, np.int32)),
                    pa.array(prints[row]),
                    pa.array(nodes[row]),
                    pa.array(home),
                ]
                yield pa.record_batch(columns, names=["leaf", "band", "print", "node", "home"])

    return run


def _leaf_links(trees: list[VantageTree], distance: int):
    bands = [(t.shift, t.mask, t.reach) for t in trees]

    def links(part: pa.Table) -> pa.RecordBatch:
        nodes = np.asarray(part.column("node"))
        order = np.argsort(nodes, kind="stable")
        nodes = nodes[order]
        prints = np.asarray(part.column("print"))[order].view(np.uint64)
        home = np.asarray(part.column("home"))[order]
        shift, mask, reach = bands[part.column("band")[0].as_py()]
        label = linked(prints, home, (prints >> shift) & mask, reach, distance)
        rows = np.flatnonzero(label != np.arange(len(label)))
        return pa.record_batch(
            [pa.array(nodes[rows]), pa.array(nodes[label[rows]])], names=["a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by leaf and part: one of them is held at a time.
        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            keys = np.asarray(batch.column("leaf")).astype(np.int64) << 32
            keys |= np.asarray(batch.column("part"))
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e == s:
                    continue
                if held and keys[s] != current:
                    yield links(pa.Table.from_batches(held))
                    held = []
                current = keys[s]
                held.append(batch.slice(s, e - s))
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def near_links(nodes: DataFrame, total: int, distance: int = DISTANCE) -> DataFrame:
    """Links ``a, b`` that span every group of nodes (``print``, ``node``) within ``distance``."""
    spark = nodes.sparkSession
    sampled = nodes.select("print")
    if total > TREE_SAMPLE:
        # Prints are distinct, so the share of them below a hash is as good as exact.
        share = int(0.98 * TREE_SAMPLE / total * (1 << 40))
        sampled = sampled.filter(F.pmod(F.xxhash64("print"), F.lit(1 << 40)) < share)
    sample = np.sort(np.asarray(sampled.toArrow().column("print").combine_chunks()).view(np.uint64))
    trees = _trees(sample, total, distance)
    routed, _ = written(nodes.mapInArrow(_router(trees), _ROUTED), "routed")
    sizes = routed.groupBy("leaf").agg(
        F.ceil(F.count(F.lit(1)) / LEAF_ROWS).cast("int").alias("parts")
    )
    # At most one row per leaf, and the sample bounds the leaves.
    routed = routed.join(F.broadcast(sizes), "leaf")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = routed.withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    ).withColumn("home", F.col("home") & (F.col("part") == own))
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_leaves = dealt.drop("parts").repartition(shuffle, "leaf", "part")
    return sorted_leaves.sortWithinPartitions("leaf", "part").mapInArrow(
        _leaf_links(trees, distance), "a long, b long"
    )


def simhash_components(
    docs: DataFrame,
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row; the component is its least doc_id."""
    prints, _ = written(
        simhash_fingerprints(docs, shingle, id_column, text_column), "prints", narrow=True
    )
    nodes, total = written(
        prints.groupBy("print").agg(F.min("doc_id").alias("node")).filter("node IS NOT NULL"),
        "print-nodes",
    )
    found = components(near_links(nodes, total, distance)).withColumnRenamed("node", "_node")
    placed = nodes.join(found, F.col("node") == F.col("_node"), "left").select(
        F.col("print").alias("_print"), F.coalesce("component", "node").alias("component_id")
    )
    return prints.join(placed, F.col("print") == F.col("_print"), "left").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(
    docs: DataFrame,
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row of ``docs`` for each component: a row of its least doc_id.

    Rows decide, not ids: where several rows share a doc_id, only those stay whose own component
    it names, once for each fingerprint.  Rows without an id stay only where no row with an id is
    in their component, once for each fingerprint.
    """
    found, _ = written(simhash_components(docs, shingle, distance, id_column, text_column), "placed")
    named = (
        found.filter("doc_id = component_id")
        .select(F.col("doc_id").alias("_id"), F.col("fingerprint").alias("_print"))
        .distinct()
    )
    doubtful, n_doubtful = written(
        found.filter("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").alias("_shared"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter("_rows > 1")
        .select("_shared"),
        "shared-ids",
    )
    packed = docs.select(
        F.struct("*").alias("row"),
        F.col(id_column).cast("long").alias("key"),
        F.col(text_column).alias("text"),
    )
    names = F.col("key") == F.col("_id")
    if not n_doubtful:
        clear = packed.filter("key IS NOT NULL").join(named, names, "left_semi")
        kept = clear.select("row")
    else:
        shared = F.col("key") == F.col("_shared")
        clear = packed.filter("key IS NOT NULL").join(doubtful, shared, "left_anti")
        printed = _with_prints(packed.join(doubtful, shared, "left_semi"), shingle)
        own = printed.join(named, names & (F.col("print") == F.col("_print")), "left_semi")
        kept = clear.join(named, names, "left_semi").select("row")
        kept = kept.unionByName(own.dropDuplicates(["key", "print"]).select("row"))
    bare = found.filter("doc_id IS NULL AND component_id IS NULL").select(
        F.col("fingerprint").alias("_print")
    )
    strays = _with_prints(packed.filter("key IS NULL"), shingle).dropDuplicates(["print"])
    strays = strays.join(bare.distinct(), F.col("print") == F.col("_print"), "left_semi")
    return kept.unionByName(strays.select("row")).select("row.*")


def _with_prints(packed: DataFrame, shingle: int) -> DataFrame:
    """``row, key`` and the hexadecimal ``print`` of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in chunks(batches, lower=True):
            prints = [f"{p:016x}" for p in fingerprints_of(words, shingle).tolist()]
            columns = [batch.column("row"), batch.column("key"), pa.array(prints, pa.string())]
            yield pa.record_batch(columns, names=["row", "key", "print"])

    schema = packed.select("row", "key", F.lit("").cast("string").alias("print")).schema
    return packed.mapInArrow(run, schema)
