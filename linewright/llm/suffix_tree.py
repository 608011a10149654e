"""Scoring texts with a probabilistic suffix tree over words.

The tree's contexts are runs of one to DEPTH words, read backwards from the word to predict.  A run
that occurs EVIDENCE times in the training texts is a candidate, and is kept if what follows it
diverges enough from what follows its own suffix; suffixes of kept contexts are kept.  Words seen
NEXT_COUNT times after a context have a probability of their own there, drawn towards the
suffix's; all others take the suffix's probabilities, scaled so that the whole sums to one.  A word
is scored in the state of the longest kept suffix of what stands before it.

The counts needed are fixed, over all words, so the tree grows with the corpus.  Counts, contexts
and next words are written tables, and contexts are judged by joins: a next word listed after a
context is always listed after its suffix, so one join finds the probability to compare with.
Before a longer run is counted, a bitmap of fixed size tells which shorter runs are frequent; what
it lets through by chance is only counted in vain.  After single words nearly every word is listed,
so a pass before tells by four bytes a pair which pairs may be often enough, and only these are
counted whole; the same holds for longer runs in a large corpus.  Texts are scored with the tree at
hand where it has at most MODEL_ENTRIES states and next words.  A larger one is cut by the last word
of its contexts, which all that is asked about a word share, and each slice scores the words that
follow its own, in a pass over the texts; beyond SLICES of them positions meet the tree in joins.
All ways have the same results.  Words and runs are known by 64-bit hashes.

Defined results: a NULL text is its end token alone; a NULL doc_id belongs to the training rows
(its text form is empty); repeated rows count and are scored each; with no training rows the
end token is unknown and N is 0; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.llm.words import Hasher, Words, chunks, mix
from linewright.plans.durable import drop_shuffles, written

DEPTH = 3
# Occurrences that make a run of words a candidate, and a next word one of its own.
EVIDENCE = 128
NEXT_COUNT = 8
# Words of at least this share of all tokens are scored where the text is read, and so are the next
# most frequent ones up to this number, 16 bytes each, if they occur often enough to be worth it.
COMMON_SHARE = 1e-6
COMMON_WORDS = 2_000_000
COMMON_COUNT = 8
# Nats of divergence from the suffix, in all its occurrences, that keep a context.
KEEP_DIVERGENCE = 20.0
# Weight of the suffix's distribution, in occurrences.
SMOOTHING = 16.0
FLUSH_WORDS = 3 << 20
# States and next words, about 16 bytes each, that are sent to where texts are read.
MODEL_ENTRIES = 4_000_000
# Slices of a larger tree, each a pass over the texts.
SLICES = 48
# Bits of the bitmaps that tell frequent runs, as a power of two: 32 for each run, 32 MB at most.
BITMAP_BITS = 28
_BITS_A_RUN = 32
# Tokens of the training texts for each part in which pairs of words are looked over at once.
PART_TOKENS = 1 << 20
# Tokens of the training texts beyond which longer runs, too, are looked over before they are counted.
WHOLE_TOKENS = 1 << 28

END = np.uint64(0x0E)
_HASHER_SEED = 5
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_LOG10 = np.log(10.0)
_BUCKET = 1 << 15


def held_out(id_column: str) -> Column:
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % 5 == 1


def _tokens(words: Words, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, then END, and the number of tokens of each text."""
    ends = np.cumsum(words.counts)
    return np.insert(hasher.of_words(words), ends, END), words.counts + 1


def _places(counts: np.ndarray) -> np.ndarray:
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def longer(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a run of words and one word more; the empty run is zero."""
    with np.errstate(over="ignore"):
        return context * _FACTOR + word


def contexts_before(tokens: np.ndarray, depth: int) -> np.ndarray:
    """The key of the ``depth`` tokens before each token, whatever texts they are of."""
    key = np.zeros(len(tokens), np.uint64)
    for back in range(depth, 0, -1):
        before = np.zeros(len(tokens), np.uint64)
        before[back:] = tokens[:-back]
        key = longer(key, before)
    return key


def _pair_keys(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(contexts) ^ words)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _tallies(batches: Iterator[pa.RecordBatch], keys_of: Callable) -> Iterator[pa.RecordBatch]:
    """``context, word, n`` of the keys of many chunks, merged before they leave the task."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> pa.RecordBatch:
        context, word = (np.concatenate(part) for part in zip(*held, strict=True))
        _, first, n = np.unique(_pair_keys(context, word), return_index=True, return_counts=True)
        columns = [_signed(context[first]), _signed(word[first]), pa.array(n)]
        return pa.record_batch(columns, names=["context", "word", "n"])

    for _, words in chunks(batches, lower=True):
        keys = keys_of(words)
        held.append(keys)
        size += len(keys[0])
        if size >= FLUSH_WORDS:
            yield merged()
            held, size = [], 0
    if size:
        yield merged()


def _counted(texts: DataFrame, keys_of: Callable) -> DataFrame:
    tallies = texts.mapInArrow(
        lambda batches: _tallies(batches, keys_of), "context long, word long, n long"
    )
    # Tasks have merged what they hold, so rows are dealt before they are added up.
    return tallies.repartition("context", "word").groupBy("context", "word").agg(F.sum("n").alias("n"))


def word_counts(texts: DataFrame) -> DataFrame:
    """``key`` (word hash) and ``n`` over all texts, END included."""
    hasher = Hasher(_HASHER_SEED)

    def keys_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
        tokens = _tokens(words, hasher)[0]
        return np.zeros(len(tokens), np.uint64), tokens

    return _counted(texts, keys_of).select(F.col("word").alias("key"), "n")


class Bitmap:
    """A set of keys as bits of fixed number: never misses one, may take others for it."""

    def __init__(self, bits: np.ndarray, power: int) -> None:
        self.bits, self.power = bits, power

    def holds(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            place = mix(keys) >> np.uint64(64 - self.power)
        return (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _power(rows: int) -> int:
    return min(BITMAP_BITS, max(3, (_BITS_A_RUN * rows).bit_length()))


def _bitmap(keys: DataFrame, rows: int) -> Bitmap:
    """Bits of runs (one column) or of runs and next words (two), set by Spark bucket by bucket."""
    power = _power(rows)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.asarray(column).view(np.uint64) for column in batch.columns]
            found = parts[0] if len(parts) == 1 else _pair_keys(*parts)
            with np.errstate(over="ignore"):
                place = (mix(found) >> np.uint64(64 - power)).astype(np.int64)
            yield pa.record_batch([pa.array(place)], names=["place"])

    return _bits_at(keys.mapInArrow(placed, "place long"), power)


def _bits_at(places: DataFrame, power: int) -> Bitmap:
    packed = places.groupBy(F.floor(F.col("place") / _BUCKET).alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("place") % _BUCKET).alias("bits")
    )
    bits = np.zeros((1 << power) // 8, np.uint8)
    # At most 8,192 rows of 4 KB.
    for row in packed.collect():
        start = row["bucket"] * (_BUCKET // 8)
        part = np.frombuffer(row["bits"], np.uint8)[: len(bits) - start]
        bits[start : start + len(part)] = part
    return Bitmap(bits, power)


def _hits(known, depth: int) -> Callable:
    """Runs of ``depth`` words and what follows them, where all the bitmaps let them through."""
    hasher = Hasher(_HASHER_SEED)

    def keys_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
        runs, after_suffix, *often = (Bitmap(*part) for part in known.value)
        tokens, counts = _tokens(words, hasher)
        chosen = np.flatnonzero(_places(counts) >= depth)
        suffix = contexts_before(tokens, depth - 1)[chosen]
        chosen = chosen[after_suffix.holds(_pair_keys(suffix, tokens[chosen]))]
        context = contexts_before(tokens, depth)[chosen]
        hit = runs.holds(context)
        context, word = context[hit], tokens[chosen[hit]]
        for bitmap in often:
            hit = bitmap.holds(_pair_keys(context, word))
            context, word = context[hit], word[hit]
        return context, word

    return keys_of


def _often(texts: DataFrame, keys_of: Callable, tokens: int) -> Bitmap:
    """Bits of the pairs that may occur NEXT_COUNT times.

    A task sends four bytes of a pair's hash as often as it met the pair, or NEXT_COUNT times, to
    the part that the bits above them name.  Pairs alike in all these bits are taken for one.
    """
    power = (tokens // PART_TOKENS).bit_length()
    enough = NEXT_COUNT

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def merged() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held))
            more = np.zeros(len(keys), bool)
            more[enough:] = keys[enough:] == keys[:-enough]
            keys = keys[~more]
            parts, first = np.unique((keys >> np.uint64(32)).astype(np.int32), return_index=True)
            offsets = pa.py_buffer(np.append(first, len(keys)).astype(np.int32) * np.int32(4))
            low = pa.py_buffer(keys.astype(np.uint32))
            column = pa.Array.from_buffers(pa.binary(), len(parts), [None, offsets, low])
            return pa.record_batch([pa.array(parts), column], names=["part", "keys"])

        for _, words in chunks(batches, lower=True):
            keys = mix(_pair_keys(*keys_of(words))) >> np.uint64(32 - power)
            held.append(keys)
            size += len(keys)
            if size >= FLUSH_WORDS:
                yield merged()
                held, size = [], 0
        if size:
            yield merged()

    def frequent(rows: pa.Table) -> pa.Table:
        found = [np.frombuffer(keys.as_buffer(), np.uint32) for keys in rows.column("keys")]
        keys = np.sort(np.concatenate(found))
        keys = np.unique(keys[enough - 1 :][keys[enough - 1 :] == keys[: len(keys) - enough + 1]])
        part = rows.column("part")[0].as_py()
        return pa.table({"hash": keys.astype(np.int64) + (part << 32)})

    parts = texts.mapInArrow(packed, "part int, keys binary").groupBy("part")
    hashes, n_hashes = written(parts.applyInArrow(frequent, "hash long"), "frequent-pairs")
    bits = _power(n_hashes)
    return _bits_at(hashes.select(F.shiftright("hash", 32 + power - bits).alias("place")), bits)


def next_counts(
    texts: DataFrame, depth: int, contexts: Bitmap, listed: Bitmap, tokens: int
) -> DataFrame:
    """``context, word, n`` of runs of ``depth`` words and what follows them.

    Only frequent runs are counted, and only words that are listed after the run's suffix: no other
    word can be often enough after the run itself.  After single words, which nearly every word
    follows somewhere, pairs that are not often enough are told apart before; after longer runs
    once there are more than WHOLE_TOKENS, as ever more of them are frequent.
    """
    broadcast = texts.sparkSession.sparkContext.broadcast
    # Plain arrays: a worker reads them before it knows any class.
    sent = [(part.bits, part.power) for part in (contexts, listed)]
    known = broadcast(sent)
    if depth == 1 or tokens > WHOLE_TOKENS:
        often = _often(texts, _hits(known, depth), tokens)
        drop_shuffles(texts.sparkSession)
        known = broadcast([*sent, (often.bits, often.power)])
    return _counted(texts, _hits(known, depth))


def _longer_contexts(pairs: DataFrame) -> DataFrame:
    """``context, suffix, total`` one word longer, from ``context, suffix, word, n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            context, suffix, word = (
                np.asarray(batch.column(name)).view(np.uint64) for name in ("context", "suffix", "word")
            )
            columns = [_signed(longer(context, word)), _signed(longer(suffix, word)), batch.column("n")]
            yield pa.record_batch(columns, names=["context", "suffix", "total"])

    frequent = pairs.filter((F.col("n") >= EVIDENCE) & (F.col("word") != int(END)))
    return frequent.select("context", "suffix", "word", "n").mapInArrow(
        run, "context long, suffix long, total long"
    )


@dataclass
class Level:
    """Written tables of one depth: ``context, suffix, scale`` and ``context, word, log``."""

    states: DataFrame
    pairs: DataFrame
    n_states: int = 0
    n_pairs: int = 0


def _judged(
    counted: DataFrame, contexts: DataFrame, before: DataFrame, depth: int
) -> tuple[DataFrame, int, DataFrame]:
    """Own probabilities of the next words, their number, and scale and divergence of their contexts.

    ``before`` has ``suffix, word, parent``: the probability of a word after the suffix.
    """
    joined = counted.join(contexts, "context").join(before, ["suffix", "word"])
    own = (F.col("n") + SMOOTHING * F.col("parent")) / (F.col("total") + SMOOTHING)
    pairs, n_pairs = written(joined.withColumn("own", own), f"next-words-{depth}")
    told = F.sum(F.col("own") * F.log(F.col("own") / F.col("parent")))
    summed = pairs.groupBy("context", "suffix", "total").agg(
        F.sum("own").alias("given"), F.sum("parent").alias("taken"), told.alias("told")
    )
    rest = F.greatest(1 - F.col("given"), F.lit(1e-12))
    scale = F.log(rest / F.greatest(1 - F.col("taken"), F.lit(1e-12)))
    judged, _ = written(
        summed.select(
            "context",
            "suffix",
            scale.alias("scale"),
            ((F.col("told") + rest * scale) * F.col("total")).alias("divergence"),
        ),
        f"contexts-{depth}",
    )
    return pairs, n_pairs, judged


def fit(texts: DataFrame, counts: DataFrame, tokens: int, distinct: int) -> list[Level]:
    """The tree of the training texts, by depth; a pass over them for each, two for the first.

    A large corpus takes two for each.
    """
    drop_shuffles(texts.sparkSession)
    smoothed = float(tokens + 0.5 * (distinct + 1))
    frequent = counts.filter(F.col("n") >= NEXT_COUNT)
    n_before = frequent.count()
    root = F.lit(0).cast("long")
    contexts, n_contexts = written(
        counts.filter((F.col("n") >= EVIDENCE) & (F.col("key") != int(END))).select(
            F.col("key").alias("context"), root.alias("suffix"), F.col("n").alias("total")
        ),
        "candidates",
    )
    before = frequent.select(
        root.alias("suffix"),
        F.col("key").alias("word"),
        ((F.col("n") + 0.5) / F.lit(smoothed)).alias("parent"),
    )
    judged: list[tuple[DataFrame, DataFrame]] = []
    for depth in range(1, DEPTH + 1):
        if not n_contexts:
            break
        runs = _bitmap(contexts.select("context"), n_contexts)
        listed = _bitmap(before.select("suffix", "word"), n_before)
        counted = next_counts(texts, depth, runs, listed, tokens).filter(
            F.col("n") >= NEXT_COUNT
        )
        pairs, n_before, found = _judged(counted, contexts, before, depth)
        judged.append((pairs, found))
        before = pairs.select(
            F.col("context").alias("suffix"), "word", F.col("own").alias("parent")
        )
        contexts, n_contexts = written(_longer_contexts(pairs), "candidates")
        drop_shuffles(texts.sparkSession)
    levels: list[Level] = []
    wanted: DataFrame | None = None
    for pairs, found in reversed(judged):
        kept = found.filter(F.col("divergence") >= KEEP_DIVERGENCE).select("context")
        kept = kept if wanted is None else kept.unionByName(wanted).distinct()
        states, n_states = written(found.join(kept, "context").drop("divergence"), "states")
        own, n_pairs = written(
            pairs.join(states.select("context"), "context").select(
                "context", "word", F.log("own").alias("log")
            ),
            "state-words",
        )
        levels.insert(0, Level(states, own, n_states, n_pairs))
        wanted = states.select(F.col("suffix").alias("context")).distinct()
    return levels


def _columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    table = df.select(*names).toArrow()
    return [np.asarray(table.column(name).combine_chunks()) for name in names]


def _found(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each key in the sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


@dataclass
class SuffixTree:
    """The levels as sorted arrays: (contexts, scales, pair keys, logs) for each depth."""

    levels: list[tuple[np.ndarray, ...]] = field(default_factory=list)

    @classmethod
    def collected(cls, levels: list[Level], number: int = 0, slices: int = 1) -> SuffixTree:
        """The whole tree, or a slice of one whose tables have an ``owner``."""
        tree = cls()
        mine = F.pmod(F.shiftrightunsigned("owner", 1), F.lit(slices)) == number if slices > 1 else F.lit(True)
        for level in levels:
            contexts, scales = _columns(level.states.filter(mine), "context", "scale")
            owners, words, logs = _columns(level.pairs.filter(mine), "context", "word", "log")
            contexts = contexts.view(np.uint64)
            keys = _pair_keys(owners.view(np.uint64), words.view(np.uint64))
            order, by_key = np.argsort(contexts), np.argsort(keys)
            tree.levels.append((contexts[order], scales[order], keys[by_key], logs[by_key]))
        return tree

    def after_contexts(
        self, tokens: np.ndarray, places: np.ndarray, rows: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """What the longest kept suffix says of each token of ``rows``, in natural logs, and if it is
        the whole.

        Where the flag is off, the base log probability of the token is to be added.
        """
        logs, whole = np.zeros(len(tokens)), np.zeros(len(tokens), bool)
        for depth, (contexts, scales, keys, own) in enumerate(self.levels, 1):
            # A context is only kept if its suffix is.
            rows = rows[places[rows] >= depth]
            before = contexts_before(tokens, depth)[rows]
            state, kept = _found(before, contexts)
            rows, before, state = rows[kept], before[kept], state[kept]
            if not len(rows):
                break
            pair, listed = _found(_pair_keys(before, tokens[rows]), keys)
            logs[rows] += scales[state]
            if len(own):
                logs[rows[listed]] = own[pair[listed]]
                whole[rows[listed]] = True
        return logs, whole


_PARTS = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, "
    "rare array<struct<key:long,times:int,open:int>>"
)


def _owned(levels: list[Level]) -> list[Level]:
    """The levels with the ``owner`` of each state: the last word of its context."""
    owned: list[Level] = []
    for level in levels:
        if owned:
            known = owned[-1].states.select(F.col("context").alias("suffix"), "owner")
            states = level.states.join(known, "suffix")
        else:
            states = level.states.withColumn("owner", F.col("context"))
        states, n_states = written(states, "slice-states")
        pairs, n_pairs = written(
            level.pairs.join(states.select("context", "owner"), "context"), "slice-words"
        )
        owned.append(Level(states, pairs, n_states, n_pairs))
    return owned


def _scorer(shared, number: int = 0, slices: int = 1):
    """Parts of the scores: of the words whose word before belongs to the slice ``number``."""
    hasher = Hasher(_HASHER_SEED)

    def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, np.cumsum(counts) - counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, common_logs, levels = shared.value
        tree = SuffixTree(levels)
        for batch, words in chunks(batches, lower=True):
            tokens, counts = _tokens(words, hasher)
            places = _places(counts)
            mine = np.ones(len(tokens), bool)
            if slices > 1:
                owner = contexts_before(tokens, 1) >> np.uint64(1)
                mine = np.where(places > 0, owner % np.uint64(slices) == number, number == 0)
            rows = np.flatnonzero(mine)
            at, found = _found(tokens[rows], common)
            known, logs = np.zeros(len(tokens), bool), np.zeros(len(tokens))
            known[rows[found]] = True
            logs[rows[found]] = common_logs[at[found]]
            score, whole = tree.after_contexts(tokens, places, rows)
            score = np.where(whole, score, score + logs)
            rare = rows[~found]
            owner = np.repeat(np.arange(len(counts)), counts)[rare]
            order = np.lexsort((tokens[rare], owner))
            keys, owner, open_ = tokens[rare][order], owner[order], ~whole[rare][order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(keys)))
            left = np.add.reduceat(open_.astype(np.int32), first) if len(first) else times
            held = np.bincount(owner[first], minlength=len(counts))
            offsets = np.append(0, np.cumsum(held)).astype(np.int32)
            pairs = pa.StructArray.from_arrays(
                [_signed(keys[first]), pa.array(times.astype(np.int32)), pa.array(left.astype(np.int32))],
                ["key", "times", "open"],
            )
            yield pa.record_batch(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(sums(mine.astype(np.int64), counts)),
                    pa.array(sums(known.astype(np.int64), counts)),
                    pa.array(sums(logs, counts) / _LOG10),
                    pa.array(sums(score, counts) / _LOG10),
                    pa.ListArray.from_arrays(pa.array(offsets), pairs),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"],
            )

    return run


def _common_count(counts: DataFrame, tokens: int) -> float:
    """The occurrences that make a word common."""
    least = max(1, COMMON_SHARE * tokens)
    # Rows of counts up to the share, which are few: the frequent words are one of them.
    sizes = counts.groupBy(F.least("n", F.lit(int(least))).alias("n")).agg(F.count(F.lit(1)).alias("words"))
    words = 0
    for row in sizes.orderBy(F.desc("n")).collect():
        words += row["words"]
        if words > COMMON_WORDS or row["n"] < COMMON_COUNT:
            break
        least = min(least, row["n"])
    return least


def _scores_at_hand(
    texts: DataFrame,
    counts: DataFrame,
    tokens: int,
    smoothed: float,
    levels: list[Level],
    slices: int = 1,
) -> DataFrame:
    """Scores where the texts are read; the words that are not common meet their counts in a join.

    Every slice of the tree takes a pass over the texts, which are written with their row numbers then.
    """
    spark = texts.sparkSession
    is_common = F.col("n") >= _common_count(counts, tokens)
    keys, n = _columns(counts.filter(is_common), "key", "n")
    order = np.argsort(keys.view(np.uint64))
    logs = np.log((n[order] + 0.5) / smoothed)
    common = keys.view(np.uint64)[order]
    rows = texts.withColumn("row", F.monotonically_increasing_id())
    if slices > 1:
        rows, _ = written(rows, "score-texts")
        levels = _owned(levels)
        drop_shuffles(spark)
    passes = []
    for number in range(slices):
        tree = SuffixTree.collected(levels, number, slices)
        shared = spark.sparkContext.broadcast((common, logs, tree.levels))
        scored = rows.mapInArrow(_scorer(shared, number, slices), _PARTS)
        passes.append(written(scored, "score-parts")[0])
        shared.destroy()
    parts = reduce(DataFrame.unionAll, passes)
    rare = parts.select("row", F.inline("rare"))
    seen = counts.filter(~is_common).select(F.col("key").alias("_key"), "n")
    log = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(smoothed))
    added = (
        rare.join(seen, F.col("key") == F.col("_key"), "left")
        .groupBy("row")
        .agg(
            F.sum(log * F.col("times")).alias("more"),
            F.sum(log * F.col("open")).alias("more_open"),
            F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("more_known"),
        )
    )
    whole = parts.drop("rare")
    if slices > 1:
        sums = [F.sum(name).alias(name) for name in ("n_tokens", "n_known", "base", "score")]
        whole = whole.groupBy("row", "doc_id", "held_out").agg(*sums)
    return (
        whole.join(added, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
            (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
            (F.col("score") + F.coalesce("more_open", F.lit(0.0))).alias("score"),
        )
    )


def _positions(depths: int):
    hasher = Hasher(_HASHER_SEED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in chunks(batches, lower=True):
            tokens, counts = _tokens(words, hasher)
            places = _places(counts)
            owner = np.repeat(np.asarray(batch.column("row")), counts)
            columns = [pa.array(owner), _signed(tokens)]
            for depth in range(1, depths + 1):
                key = contexts_before(tokens, depth).view(np.int64)
                columns.append(pa.array(key, mask=places < depth))
            names = ["row", "word", *[f"context_{d}" for d in range(1, depths + 1)]]
            yield pa.record_batch(columns, names=names)

    return run


def _scores_by_joins(
    texts: DataFrame, counts: DataFrame, smoothed: float, levels: list[Level]
) -> DataFrame:
    """The same scores, each position meeting its counts, states and next words in joins."""
    rows, _ = written(texts.withColumn("row", F.monotonically_increasing_id()), "score-texts")
    shape = "row long, word long" + "".join(f", context_{d + 1} long" for d in range(len(levels)))
    at = rows.select("row", "text").mapInArrow(_positions(len(levels)), shape)
    seen = counts.select(F.col("key").alias("word"), "n")
    base = F.log((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(smoothed))
    at = at.join(seen, "word", "left").withColumns({"base": base, "value": base})
    for depth, level in enumerate(levels, 1):
        key = f"context_{depth}"
        states = level.states.select(F.col("context").alias(key), "scale")
        own = level.pairs.withColumnRenamed("context", key)
        # Positions without a context pass by the joins instead of meeting in one task.
        bare = at.filter(F.col(key).isNull())
        at = at.filter(F.col(key).isNotNull()).join(states, key, "left").join(own, [key, "word"], "left")
        value = F.coalesce("log", F.col("value") + F.coalesce("scale", F.lit(0.0)))
        at = at.withColumn("value", value).drop("scale", "log")
        at = at.unionByName(bare)
    summed = at.groupBy("row").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.count("n").alias("n_known"),
        (F.sum("base") / F.lit(_LOG10)).alias("base_score"),
        (F.sum("value") / F.lit(_LOG10)).alias("score"),
    )
    return rows.select("row", "doc_id", "held_out").join(summed, "row").drop("row")


def suffix_tree_scores(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Token counts, ``base_score`` and ``score`` (log10 probability) of every row."""
    texts = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(text_column).alias("text"),
        held_out(id_column).alias("held_out"),
    )
    training = texts.filter(~F.col("held_out")).select("text")
    counts, distinct = written(word_counts(training), "word-counts", narrow=True)
    tokens = counts.agg(F.sum("n")).first()[0] or 0
    smoothed = float(tokens + 0.5 * (distinct + 1))
    levels = fit(training, counts, tokens, distinct)
    drop_shuffles(docs.sparkSession)
    entries = sum(level.n_states + level.n_pairs for level in levels)
    if entries <= MODEL_ENTRIES * SLICES:
        slices = max(1, -(-entries // max(1, MODEL_ENTRIES)))
        scores = _scores_at_hand(texts, counts, tokens, smoothed, levels, slices)
    else:
        scores = _scores_by_joins(texts, counts, smoothed, levels)
    total = F.lit(int(tokens)).cast("long")
    return scores.withColumn("train_tokens", total).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
