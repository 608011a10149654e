"""Exact top-k search by inner product, term at a time over blocks.

Vectors are turned into integers and kept sparse.  Queries and candidates are cut into blocks; a
task takes one block of each.  There every query is a sparse row: term by term, the weights of
the term's postings are scattered into a dense array of scores, one per query and candidate, and
a partial selection keeps the k best of each query.  The best of all blocks are merged.  Nothing
is approximated or pruned, and a task's memory is that of its two blocks and their scores.

Defined results: a NULL vector, or one that holds a NULL or non-finite component, is neither query
nor candidate, nor is a row with a NULL id; vectors of different lengths meet on their common
dimensions; a candidate with the query's own id is its own row; repeated rows are candidates
each; ties go to the smaller id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.plans.durable import written

SCALE = 256
# A task holds scores of QUERY_BLOCK x STRIPE, for one candidate block after the other.
QUERY_BLOCK = 512
CANDIDATE_BLOCK = 8_192
STRIPE = 2_048


def integer_vectors(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id`` and ``weights``, whole vectors of finite components only."""
    vector = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return vectors.filter(
        F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & finite
    ).select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.transform(vector, lambda x: F.floor(x * SCALE).cast("long")).alias("weights"),
    )


def _block(blocks: int) -> Column:
    """Blocks by a hash of the row: near equal in size, even if many rows share an id."""
    return F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")


def _numbered(vectors: DataFrame, label: str) -> tuple[DataFrame, int]:
    return written(vectors.withColumn("row", F.monotonically_increasing_id()), label)


def _postings(weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, row, weight) of the components other than zero, ordered by term."""
    sizes = np.array([len(w) for w in weights], np.int64)
    row = np.repeat(np.arange(len(weights)), sizes)
    term = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat = np.concatenate(weights) if weights else np.zeros(0, np.int64)
    kept = np.flatnonzero(flat)
    order = kept[np.argsort(term[kept], kind="stable")]
    return term[order], row[order], flat[order]


def best_of_block(
    query_ids: np.ndarray,
    queries: list[np.ndarray],
    ids: np.ndarray,
    candidates: list[np.ndarray],
    k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of the k best candidates of each query in the block."""
    order = np.argsort(ids, kind="stable")
    ids, candidates = ids[order], [candidates[i] for i in order]
    q_term, q_row, q_weight = _postings(queries)
    c_term, c_row, c_weight = _postings(candidates)
    scores = np.zeros((len(queries), len(candidates)), np.int64)
    for term in np.intersect1d(q_term, c_term):
        q = slice(*np.searchsorted(q_term, [term, term + 1]))
        c = slice(*np.searchsorted(c_term, [term, term + 1]))
        rows, columns = q_row[q], c_row[c]
        scattered = q_weight[q][:, None] * c_weight[c][None, :]
        if len(columns) == scores.shape[1]:
            scores[rows] += scattered
        else:
            scores[np.ix_(rows, columns)] += scattered
    found: list[tuple[np.ndarray, ...]] = []
    for i, query in enumerate(query_ids.tolist()):
        others = np.flatnonzero(ids != query)
        own = scores[i, others]
        if len(own) > k:
            least = np.partition(own, len(own) - k)[len(own) - k]
            above = np.flatnonzero(own > least)
            # Ties at the last place go to the smaller ids, which come first.
            level = np.flatnonzero(own == least)[: k - len(above)]
            chosen = np.append(above, level)
        else:
            chosen = np.arange(len(own))
        found.append((np.full(len(chosen), query), ids[others[chosen]], own[chosen]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_FOUND = "query_id long, vec_id long, score long"


def _search(k: int):
    def best(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
        q_ids = np.asarray(queries.column("vec_id"))
        q_weights = [np.asarray(w.values) for w in queries.column("weights")]
        kept = [np.zeros(0, np.int64)] * 3
        for start in range(0, rows.num_rows, STRIPE):
            part = rows.slice(start, STRIPE)
            weights = [np.asarray(w.values) for w in part.column("weights")]
            found = best_of_block(q_ids, q_weights, np.asarray(part.column("vec_id")), weights, k)
            kept = _merged([np.append(a, b) for a, b in zip(kept, found, strict=True)], k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), kept, strict=True)))

    return best


def _merged(rows: list[np.ndarray], k: int) -> list[np.ndarray]:
    query, vec, score = rows
    order = np.lexsort((vec, -score, query))
    query = query[order]
    first = np.searchsorted(query, query, "left")
    chosen = order[np.arange(len(query)) - first < k]
    return [rows[0][chosen], vec[chosen], score[chosen]]


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows of ``vectors`` for each query row."""
    rows, n_rows = _numbered(integer_vectors(vectors, id_column, vector_column), "vectors")
    asked, n_asked = _numbered(integer_vectors(queries, id_column, vector_column), "queries")
    query_blocks = max(1, -(-n_asked // QUERY_BLOCK))
    blocks = max(1, -(-n_rows // CANDIDATE_BLOCK))
    # Each block of queries meets each block of candidates once.
    left = asked.withColumn("query_block", _block(query_blocks)).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    right = rows.withColumn("block", _block(blocks)).withColumn(
        "query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    )
    keys = ("query_block", "block")
    found = (
        left.drop("row")
        .groupBy(*keys)
        .cogroup(right.drop("row").groupBy(*keys))
        .applyInArrow(_search(k), _FOUND)
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
