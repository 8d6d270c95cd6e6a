"""Exact top-k search by inner product: columnar branch and bound.

Vectors become integers and are stored by dimension: a block of candidates is one matrix per block of
dimensions. For a query, products are summed up one block of dimensions at a time. What the dimensions left can
still add is bounded by the lengths of both remainders; candidates that can no longer reach the k-th best score
are dropped, and the others are moved together before the next block.

Blocks of candidates meet blocks of queries, each of bounded size, and only the k best of each meeting go on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.session import durable

SCALE = 256
CANDIDATES = 8192  # vectors in a block of candidates, about
QUERIES = 2048  # queries in a block, about
DIMENSIONS = 16  # dimensions summed up between two prunings
_EXACT = 2.0**52  # sums of integers below this are exact in a double


def _integers(values: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(values.astype(np.float64) * scale)


def _remainders(vertical: list[np.ndarray]) -> np.ndarray:
    """Per block of dimensions, an upper bound of the length of what comes after it, for each vector."""
    squares = np.array([(block**2).sum(axis=0) for block in vertical])
    after = np.cumsum(squares[::-1], axis=0)[::-1]
    after = np.vstack([after[1:], np.zeros((1, squares.shape[1]))])
    return np.sqrt(after) * (1 + 1e-9) + 1e-9


def search(
    query_ids: np.ndarray, queries: np.ndarray, vec_ids: np.ndarray, vectors: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query with another id: (query_id, vec_id, score) rows.

    Ties go to the smaller id. Both matrices hold integers as doubles, one row per vector.
    """
    edges = range(0, max(1, queries.shape[1]), DIMENSIONS)
    vertical = [np.ascontiguousarray(vectors[:, a : a + DIMENSIONS].T) for a in edges]
    own = [np.ascontiguousarray(queries[:, a : a + DIMENSIONS].T) for a in edges]
    rest, own_rest = _remainders(vertical), _remainders(own)
    largest = np.abs(vectors).max(initial=0) * np.abs(queries).max(initial=0) * max(1, queries.shape[1])
    exact = largest < _EXACT
    found: tuple[list, list, list] = ([], [], [])
    for step in range(0, len(query_ids), 256):
        first = own[0][:, step : step + 256].T @ vertical[0]
        for q in range(step, min(step + 256, len(query_ids))):
            alive = np.flatnonzero(vec_ids != query_ids[q])
            score = first[q - step][alive]
            for block in range(len(vertical)):
                if block:
                    score = score + own[block][:, q] @ vertical[block][:, alive]
                if len(alive) > k and block + 1 < len(vertical):
                    room = rest[block][alive] * own_rest[block][q]
                    slack = 1e-9 * np.abs(score) + (0.0 if exact else 1e-6 * largest)
                    least = score - room - slack
                    bar = np.partition(least, len(least) - k)[len(least) - k]
                    keep = score + room + slack >= bar
                    alive, score = alive[keep], score[keep]
            if not exact:
                whole = [int(x) for x in queries[q]]
                score = np.array([sum(a * int(b) for a, b in zip(whole, vectors[c])) for c in alive], dtype=object)
            if len(alive) > k:
                ordered = score if exact else np.array([float(s) for s in score])
                bar = np.partition(ordered, len(alive) - k)[len(alive) - k]
                near = np.flatnonzero(ordered >= bar - (0.0 if exact else abs(bar) * 1e-9))
                alive, score = alive[near], score[near]
            best = sorted(zip((-int(s) for s in score), vec_ids[alive].tolist()))[:k]
            found[0].extend([int(query_ids[q])] * len(best))
            found[1].extend(v for _, v in best)
            found[2].extend(min(max(-s, -(2**63)), 2**63 - 1) for s, _ in best)
    return tuple(np.array(c, dtype=np.int64) for c in found)


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE) -> DataFrame:
    """The ``k`` other vectors with the highest integer inner product, for each vector where ``is_query`` holds.

    ``vectors`` (vec_id, embedding): each component x counts as floor(scale * x). Vectors that are null or hold
    null, NaN or infinite components take no part, nor do rows without vec_id; vectors of different length do
    not meet. Rows repeated with one vec_id are candidates of their own, and as queries each brings its own
    rows. A query with fewer than ``k`` candidates gets all; a score beyond 64 bits is cut to that range. Other
    columns are ignored; an empty table gives no rows.

    Columns: query_id, rank, vec_id, score.
    """
    usable = vectors.where(_usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long"),
        F.col("embedding").cast("array<double>"),
        F.size("embedding").alias("size"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
    )
    usable = durable(usable)
    n, n_queries = usable.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    rows = max(1, -(-n // CANDIDATES))
    groups = max(1, -(-n_queries // QUERIES))

    # Rows of one id stay apart, so that repeated ids spread as well.
    deal = F.monotonically_increasing_id()
    numbers = lambda count: F.explode(F.expr(f"sequence(0L, {count - 1}L)"))
    candidates = usable.select("size", F.pmod(F.xxhash64("vec_id", deal), F.lit(rows)).alias("block"), "vec_id", "embedding")
    queries = usable.where("is_query").select(
        "size",
        F.pmod(F.xxhash64("vec_id", deal), F.lit(groups)).alias("group"),
        F.col("vec_id").alias("query_id"),
        deal.alias("query_row"),
        "embedding",
    )
    left = durable(queries).withColumn("block", numbers(rows))
    right = candidates.withColumn("group", numbers(groups))

    def meet(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(others):
            return pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")
        matrices = [_integers(np.stack(d["embedding"].to_numpy()), scale) for d in (own, others)]
        place = np.arange(len(own))
        ids = own["query_id"].to_numpy()
        # Searched by place in the block, as ids may repeat; the query's own id is left out by its value.
        query, vec, score = _search_by_place(place, ids, matrices[0], others["vec_id"].to_numpy(), matrices[1], k)
        rows_of = own["query_row"].to_numpy()
        return pd.DataFrame({"query_row": rows_of[query], "query_id": ids[query], "vec_id": vec, "score": score})

    met = left.groupBy("size", "block", "group").cogroup(right.groupBy("size", "block", "group"))
    best = met.applyInPandas(meet, "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search_by_place(place, ids, queries, vec_ids, vectors, k):
    """``search`` with each query named by its place in the block."""
    query, vec, score = [], [], []
    distinct, of = np.unique(ids, return_inverse=True)
    if len(distinct) == len(ids):
        found_id, vec, score = search(ids, queries, vec_ids, vectors, k)
        order = np.argsort(ids)
        return place[order[np.searchsorted(ids[order], found_id)]], vec, score
    for number in place:
        one = slice(number, number + 1)
        _, v, s = search(ids[one], queries[one], vec_ids, vectors, k)
        query.append(np.full(len(v), number))
        vec.append(v)
        score.append(s)
    return tuple(np.concatenate(x).astype(np.int64) for x in (query, vec, score))
