"""How far the word use of each source of a language lies from the other sources and the language.

Texts are factored into chunks: each document's white-space chunks, lower-cased and from their first
term to their last, are counted, the counts are added up per language, source and chunk, every
distinct chunk of the corpus is tokenised once, and its terms are joined back.  Occurrences of a term are sums over its chunks.  Its distinct documents are
no such sum, as a document may hold "word" and "word-list"; but a chunk found in enough documents
settles its terms, and terms whose chunks do not add up to enough are settled too.  Documents are
read again only for the terms in between, whose chunks all are rare, and counted one by one.

Distances between sources are sums over tiles: blocks of terms x blocks of sources, with dense arrays
inside a task.  A term that no source of a tile holds adds the same to each pair; such terms are
counted, not listed.  All arithmetic is in integers and decimals.

A very long chunk is cut where no term is, so a chunk is at most ``CHUNK_BYTES`` long or one term.

Defined results: NULL text, language and source are empty strings; each row is a document, repeated
rows count each; a group without kept terms has distance 0 to groups like it; a language of one
source has no pairs; an empty table gives no rows; ties go to the smaller item in UTF-8 order;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewright.llm.words import IN_WORD, Words, numbered, split_words, text_chunks, word_array
from linewright.plans.attach import attach_groups
from linewright.plans.durable import written

LEAST_DOCUMENTS = 30
TERM_RANKS = 50
# Share and prior of the smoothed frequencies.
SCALE = 1_000_000_000
PRIOR = 5
CHUNK_BYTES = 64
TERM_PATTERN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_IN_TERM = np.zeros(256, bool)
_IN_TERM[0x41:0x5B] = _IN_TERM[0x61:0x7B] = _IN_TERM[0x80:] = True

# A tile holds at most about this many terms, and sources of one or two blocks.
TILE_TERMS = 4_096
TILE_SOURCES = 64
# Tables of at most this many rows, by count, are broadcast.
BROADCAST_ROWS = 500_000
# Wanted chunks sent to where texts are read, at most so many bytes of them.
_WANTED_BYTES = 16 << 20
# Rows, and bytes of chunks, that a task holds to add them up before it hands them on.
_HELD_CHUNKS = 500_000
_HELD_BYTES = 128 << 20
_EMIT_ROWS = 50_000


def term_chunks(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The chunks of texts that stand side by side; very long ones are cut between terms."""
    terms = split_words(data, offsets, lower=True, in_word=_IN_TERM)
    if not len(terms.starts):
        return terms
    gaps = np.cumsum(~IN_WORD[terms.data], dtype=np.int32)
    text_of = terms.text_of
    begins = np.ones(len(terms.starts), bool)
    # A term goes on with the chunk of the one before it if no white space parts them.
    begins[1:] = (gaps[terms.starts[1:]] > gaps[terms.ends[:-1] - 1]) | np.diff(text_of).astype(bool)
    first = np.flatnonzero(begins)
    sizes = terms.ends[np.append(first[1:], len(begins)) - 1] - terms.starts[first]
    if sizes.max() > CHUNK_BYTES:
        begins |= (sizes > CHUNK_BYTES)[np.cumsum(begins) - 1]
        first = np.flatnonzero(begins)
    starts = terms.starts[first]
    ends = terms.ends[np.append(first[1:], len(begins)) - 1]
    return Words(terms.data, offsets, starts, ends, np.diff(np.searchsorted(starts, offsets)))


def chunks_of(text: bytes) -> tuple[list[bytes], set[bytes]]:
    """The chunks of one text in order, and the different ones."""
    numbers, different = numbered(term_chunks(np.frombuffer(text, np.uint8), np.array([0, len(text)])))
    found = different.take(pa.array(numbers)).to_pylist()
    return found, set(found)


def _rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(batch), _EMIT_ROWS):
        yield batch.slice(start, _EMIT_ROWS)


def _run_counts(groups: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> pa.Table:
    """``group, chunk, times, documents`` of some texts."""
    words = term_chunks(data, offsets)
    numbers, different = numbered(words)
    # Texts of a group stand together, so a chunk's texts in a group are neighbours once sorted.
    order = np.argsort(groups, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    met = np.sort(numbers * np.int64(len(order)) + place[words.text_of])
    first = np.flatnonzero(np.diff(met, prepend=-1))
    times = np.diff(np.append(first, len(met)))
    number, at = np.divmod(met[first], len(order))
    group = groups[order][at]
    heads = np.ones(len(number), bool)
    heads[1:] = (number[1:] != number[:-1]) | (group[1:] != group[:-1])
    heads = np.flatnonzero(heads)
    return pa.table(
        {
            "group": group[heads],
            "chunk": different.cast(pa.string()).take(pa.array(number[heads])),
            "times": np.add.reduceat(times, heads) if len(heads) else times,
            "documents": np.diff(np.append(heads, len(number))),
        }
    )


def _add_up(held: list[pa.Table]) -> pa.Table:
    """One table for those held, which are given up."""
    whole = pa.concat_tables(held).group_by(["group", "chunk"], use_threads=False)
    held.clear()
    added = whole.aggregate([("times", "sum"), ("documents", "sum")])
    return added.rename_columns({"times_sum": "times", "documents_sum": "documents"})


def _count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk counts of each document, added up over the documents of a group the task holds."""
    langs: dict[int, str] = {}
    held: list[pa.Table] = []
    size = rows = 0

    def emitted() -> Iterator[pa.RecordBatch]:
        whole = _add_up(held) if len(held) > 1 else held.pop()
        for batch in whole.to_batches(_EMIT_ROWS):
            groups = pc.dictionary_encode(batch.column("group"))
            names = pa.array([langs[g] for g in groups.dictionary.to_pylist()], pa.string())
            columns = [batch.column(c) for c in ("group", "chunk", "times", "documents")]
            yield pa.record_batch([names.take(groups.indices), *columns], names=_COUNTED)
        langs.clear()

    for batch, data, offsets in text_chunks(batches):
        groups = np.asarray(batch.column("group"))
        for row in np.unique(groups, return_index=True)[1].tolist():
            langs[int(groups[row])] = batch.column("lang")[row].as_py()
        held.append(_run_counts(groups, data, offsets))
        rows += len(held[-1])
        size += held[-1].column("chunk").nbytes
        if rows > 2 * _HELD_CHUNKS or size > _HELD_BYTES:
            held.append(_add_up(held))
            rows, size = len(held[0]), held[0].column("chunk").nbytes
            if rows > _HELD_CHUNKS or size > _HELD_BYTES // 2:
                yield from emitted()
                rows = size = 0
    if held:
        yield from emitted()


_COUNTED = ["lang", "group", "chunk", "times", "documents"]


def _slim(docs: DataFrame, lang_column: str, source_column: str, text_column: str) -> DataFrame:
    """``lang, source, group, text`` without NULLs; ``group`` is a hash of language and source."""
    named = docs.select(
        F.coalesce(F.col(lang_column).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_column).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    return named.withColumn("group", F.xxhash64("lang", "source"))


def chunk_counts(slim: DataFrame) -> DataFrame:
    """``lang, group, chunk, times, documents`` over all documents."""
    counted = slim.select("lang", "group", "text").mapInArrow(
        _count_chunks, "lang string, group long, chunk string, times long, documents long"
    )
    # The tasks have added up what they hold, so rows are dealt before they are grouped.
    keys = ("lang", "group", "chunk")
    return (
        counted.repartition(*keys)
        .groupBy(*keys)
        .agg(F.sum("times").alias("times"), F.sum("documents").alias("documents"))
    )


def _open_rows(wanted: dict[str, frozenset[bytes]] | None):
    """``lang, document, chunk``: the distinct chunks of each document, or the wanted ones."""

    anywhere = None
    if wanted is not None:
        anywhere = pa.array(frozenset().union(*wanted.values()), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_chunks(batches):
            words = term_chunks(data, offsets)
            found, rows = word_array(words), words.text_of
            if anywhere is not None:
                hit = np.flatnonzero(pc.is_in(found, value_set=anywhere))
                found, rows = found.take(pa.array(hit)), rows[hit]
                langs = batch.column("lang").to_pylist()
                pairs = zip(found.to_pylist(), rows.tolist(), strict=True)
                own = np.array([chunk in wanted.get(langs[r], ()) for chunk, r in pairs], bool)
                found, rows = found.filter(pa.array(own)), rows[own]
            coded = found.dictionary_encode()
            met = np.sort(np.asarray(coded.indices) * np.int64(len(batch)) + rows)
            number, row = np.divmod(met[np.flatnonzero(np.diff(met, prepend=-1))], len(batch))
            taken = batch.select(["lang", "document"]).take(pa.array(row))
            chunks = coded.dictionary.cast(pa.string()).take(pa.array(number))
            yield from _rows(
                pa.record_batch([*taken.columns, chunks], names=["lang", "document", "chunk"])
            )

    return run


def document_chunks(slim: DataFrame, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """``lang, document, chunk`` of the wanted ``lang, chunk``, once per document.

    ``document`` tells the rows of one job apart; another job may number them otherwise.  Up to
    a measured size the wanted chunks are looked up where the text is read.  Beyond it the
    commonest chunks that are not wanted are dropped first, so that they do not meet in one task.
    """
    marked = slim.select("lang", "text").withColumn("document", F.monotonically_increasing_id())
    shape = "lang string, document long, chunk string"
    pairs = wanted.select("lang", "chunk").distinct()
    size = wanted.agg(F.sum(F.octet_length("chunk"))).first()[0] or 0
    if n_wanted <= BROADCAST_ROWS and size <= _WANTED_BYTES:
        sets: dict[str, set[bytes]] = {}
        for row in pairs.toLocalIterator():
            sets.setdefault(row["lang"], set()).add(row["chunk"].encode())
        return marked.mapInArrow(_open_rows({k: frozenset(v) for k, v in sets.items()}), shape)
    return marked.mapInArrow(_open_rows(None), shape)


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def lang_terms(counts: DataFrame) -> DataFrame:
    """``lang, chunk, documents, term``: the documents and terms of each chunk, by language.

    Chunks are dealt once; then each distinct chunk is one row with its languages, is tokenised once,
    and gives a row for each language and each time it holds a term.
    """
    by_chunk = (
        counts.repartition("chunk")
        .groupBy("chunk", "lang")
        .agg(F.sum("documents").alias("documents"))
        .groupBy("chunk")
        .agg(F.collect_list(F.struct("lang", "documents")).alias("langs"))
    )
    terms = F.regexp_extract_all("chunk", F.lit(TERM_PATTERN), F.lit(0))
    tokenised = by_chunk.select("chunk", "langs", F.explode(terms).alias("term"))
    return tokenised.select("chunk", "term", F.inline("langs"))


def kept_terms(slim: DataFrame, counts: DataFrame, least: int) -> tuple[DataFrame, int, DataFrame]:
    """``lang, term`` found in ``least`` documents of the language, their number, and their chunks.

    The chunks are ``lang, chunk, term`` of the kept terms.
    """
    found, links = written(lang_terms(counts), "lang-terms")
    bounds = (
        found.groupBy("lang", "term")
        .agg(
            F.max("documents").alias("some"),
            F.sum("documents").alias("most"),
            F.count(F.lit(1)).alias("members"),
        )
        .filter(F.col("most") >= least)
        .select(F.struct("lang", "term").alias("word"), "members", (F.col("some") >= least).alias("sure"))
    )
    worded = found.select("lang", "chunk", "term", F.struct("lang", "term").alias("word"))
    likely, _ = written(
        attach_groups(worded, written(bounds, "term-bounds")[0], "word", links).select(
            "lang", "chunk", "term", "sure"
        ),
        "likely-chunks",
    )
    sure = likely.filter("sure").drop("sure")
    open_chunks, n_open = written(likely.filter("NOT sure").drop("sure"), "open-chunks")
    chunks = sure
    if n_open:
        rows = document_chunks(slim, open_chunks, n_open)
        if n_open > BROADCAST_ROWS:
            common = counts.groupBy("lang", "chunk").agg(F.sum("documents").alias("documents"))
            common = common.filter(F.col("documents") >= least).orderBy(F.col("documents").desc())
            common = common.limit(BROADCAST_ROWS).select("lang", "chunk")
            rows = rows.join(F.broadcast(common), ["lang", "chunk"], "left_anti")
        exact, n_exact = written(
            rows.join(_small(open_chunks, n_open), ["lang", "chunk"])
            .select("lang", "term", "document")
            .distinct()
            .groupBy("lang", "term")
            .agg(F.count(F.lit(1)).alias("exact"))
            .filter(F.col("exact") >= least)
            .select("lang", "term"),
            "exact-terms",
        )
        chunks = sure.unionByName(open_chunks.join(_small(exact, n_exact), ["lang", "term"]))
    chunks, _ = written(chunks.select("lang", "chunk", "term"), "kept-chunks")
    words, n_words = written(chunks.select("lang", "term").distinct(), "kept-terms")
    return words, n_words, chunks


# A smoothed frequency of ``count`` among ``total`` over ``terms`` terms, exact in decimals.
_SHARE = (
    f"1 + CASE WHEN terms = 0 THEN 0 ELSE "
    f"((cast(count AS decimal(20,0)) + {PRIOR}) * cast({SCALE} AS decimal(10,0))) div "
    f"(cast(total AS decimal(20,0)) + {PRIOR} * cast(terms AS decimal(15,0))) END"
)


def _tile(key: tuple, shares: pa.Table, groups: pa.Table) -> pa.Table:
    """Partial distances of the tile's pairs: over the terms some source of the tile holds."""
    left, right = key[2].as_py(), key[3].as_py()
    names = groups.column("source").to_pylist()
    place = {name: i for i, name in enumerate(names)}
    base = np.asarray(groups.column("base")).astype(np.int64)
    block = np.asarray(groups.column("block"))
    coded = pc.dictionary_encode(shares.column("term").combine_chunks())
    n_terms = len(coded.dictionary)
    dense = np.repeat(base[:, None], n_terms, axis=1)
    row = np.array([place[s] for s in shares.column("source").to_pylist()], np.int64)
    dense[row, np.asarray(coded.indices)] = np.asarray(shares.column("p"))
    one, two = np.flatnonzero(block == left), np.flatnonzero(block == right)
    out: list[tuple[int, int, int]] = []
    for i in one.tolist():
        others = two[two > i] if left == right else two
        apart = np.abs(dense[others] - dense[i]).sum(axis=1)
        out += zip([i] * len(others), others.tolist(), apart.tolist(), strict=True)
    lang = key[0].as_py()
    return pa.table(
        {
            "lang": pa.array([lang] * len(out), pa.string()),
            "source": pa.array([names[i] for i, _, _ in out], pa.string()),
            "item": pa.array([names[j] for _, j, _ in out], pa.string()),
            "part_value": pa.array([v for _, _, v in out], pa.int64()),
            "seen": pa.array([n_terms] * len(out), pa.int64()),
        }
    )


def _pairs(shares: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """``lang, source, item, value`` for both orders of two sources of a language."""
    blocks = F.ceil(F.col("sources") / TILE_SOURCES).cast("int")
    term_blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") / TILE_TERMS)).cast("int")

    def tiled(rows: DataFrame) -> DataFrame:
        return (
            rows.withColumn("block", F.pmod(F.xxhash64("source"), blocks).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .withColumn("left", F.least("block", "other"))
            .withColumn("right", F.greatest("block", "other"))
        )

    held = tiled(
        shares.withColumn("term_block", F.pmod(F.xxhash64("term"), term_blocks).cast("int"))
    )
    listed = tiled(
        groups.withColumn("term_block", F.explode(F.sequence(F.lit(0), term_blocks - 1)))
    )
    keys = ("lang", "term_block", "left", "right")
    partial = (
        held.select(*keys, "source", "term", "p")
        .groupBy(*keys)
        .cogroup(listed.select(*keys, "source", "block", "base").groupBy(*keys))
        .applyInArrow(_tile, "lang string, source string, item string, part_value long, seen long")
        .groupBy("lang", "source", "item")
        .agg(F.sum("part_value").alias("held_value"), F.sum("seen").alias("seen"))
    )
    ends = groups.select("lang", "source", "base", "terms")
    others = groups.select(
        "lang", F.col("source").alias("item"), F.col("base").alias("item_base")
    )
    unseen = F.col("terms") - F.col("seen")
    value = F.col("held_value") + unseen * F.abs(F.col("base") - F.col("item_base"))
    whole = (
        partial.join(_small(ends, n_groups), ["lang", "source"])
        .join(_small(others, n_groups), ["lang", "item"])
        .select("lang", "source", "item", value.alias("value"))
    )
    both = F.array(
        F.struct("source", "item", "value"),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), "value"),
    )
    return whole.select("lang", F.inline(both))


def source_divergence(
    docs: DataFrame,
    least_documents: int = LEAST_DOCUMENTS,
    term_ranks: int = TERM_RANKS,
    lang_column: str = "lang",
    source_column: str = "source",
    text_column: str = "text",
) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair``: the distance to each other source of the language, all ranks.  Part ``term``: the
    terms the source uses more than its language does, with the excess, up to ``term_ranks``.
    """
    slim = _slim(docs, lang_column, source_column, text_column)
    counts, _ = written(chunk_counts(slim), "chunk-counts")
    words, n_words, chunks = kept_terms(slim, counts, least_documents)
    held, _ = written(
        counts.select("lang", "group", "chunk", "times")
        .join(chunks.hint("shuffle_hash"), ["lang", "chunk"])
        .groupBy("lang", "group", "term")
        .agg(F.sum("times").alias("count")),
        "term-counts",
    )
    totals = held.groupBy("group").agg(F.sum("count").alias("total"))
    summed, n_groups = written(
        slim.select("lang", "source", "group").distinct().join(totals, "group", "left").fillna(
            0, ["total"]
        ),
        "source-totals",
    )
    if summed.select("group").distinct().count() != n_groups:
        raise RuntimeError("two sources have one hash")
    langs = summed.groupBy("lang").agg(
        F.count(F.lit(1)).alias("sources"), F.sum("total").alias("lang_total")
    )
    langs = langs.join(
        words.groupBy("lang").agg(F.count(F.lit(1)).alias("terms")), "lang", "left"
    ).fillna(0, ["terms"])
    langs, n_langs = written(langs, "lang-totals")
    groups, _ = written(
        summed.join(_small(langs, n_langs), "lang")
        .withColumn("count", F.lit(0).cast("long"))
        .withColumn("base", F.expr(_SHARE)),
        "source-groups",
    )
    sized = groups.select("lang", "group", "source", "total", "terms", "sources")
    shares, _ = written(
        held.join(_small(sized, n_groups), ["lang", "group"]).withColumn("p", F.expr(_SHARE)),
        "shares",
    )
    in_lang = held.groupBy("lang", "term").agg(F.sum("count").alias("count"))
    usual = in_lang.join(
        _small(langs.select("lang", F.col("lang_total").alias("total"), "terms"), n_langs), "lang"
    ).select("lang", "term", F.expr(_SHARE).alias("q"))
    above = (
        shares.join(_small(usual, n_words), ["lang", "term"])
        .filter(F.col("p") > F.col("q"))
        .select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    )
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    rank = F.row_number().over(order)
    terms = above.withColumn("rank", rank).filter(F.col("rank") <= term_ranks)
    pairs = _pairs(shares, groups, n_groups).withColumn("rank", rank)
    shape = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*shape).unionByName(
        terms.withColumn("part", F.lit("term")).select(*shape)
    )
