"""Exact top-k inner products by aggregating sorted lists without random access (NRA)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.blocks import best_of, nearest, usable

#: Shares of each list read by the end of a round.
ROUNDS = (1 / 8, 1 / 2, 7 / 8, 1.0)


def ranks(vectors: np.ndarray) -> dict[str, bytes]:
    """The sorted list of each component, kept as every vector's place in it (0: the largest value)."""
    order = np.argsort(-vectors, axis=0, kind="stable")
    place = np.empty(order.shape, np.int32)
    np.put_along_axis(place, order, np.arange(len(vectors), dtype=np.int32)[:, None], axis=0)
    return {"places": place.tobytes()}


def search_block(queries: np.ndarray, vectors: np.ndarray, places: np.ndarray, barred: np.ndarray, k: int) -> np.ndarray:
    """Which vectors may be among the k best of each query: lists are read from their good end, round by round.

    A positive component of a query reads its list from the largest value, a negative one from the smallest.
    A vector's score so far, plus for each unread component the worst or the best value that its list can
    still hold, bounds its score; for all queries of a block these are two products each with what was read from
    either end. A round drops the vectors whose upper bound is below the k-th lower bound; a query stops
    once no more than 2 k are left, or all is read. ``barred``: a query's own rows.
    """
    n = len(vectors)
    alive = ~barred
    if n <= 2 * k:
        return alive
    ordered = np.take_along_axis(vectors, np.argsort(places, axis=0), axis=0).astype(np.float64)
    exact = vectors.astype(np.float64)
    plus, minus = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
    # of sums beyond 53 bits
    slack = (np.abs(queries).astype(np.float64) @ np.abs(exact).max(0)) * 2.0**-44
    slack[slack < 2.0**8] = 0
    open_ = np.arange(len(queries))
    for share in ROUNDS:
        depth = max(1, int(n * share))
        from_top, from_end = places < depth, n - 1 - places < depth
        up, down = plus[open_], minus[open_]

        def bound(unread_top, unread_end):
            return up @ np.where(from_top, exact, unread_top).T + down @ np.where(from_end, exact, unread_end).T  # noqa: B023

        lower = bound(ordered[-1], ordered[0])
        lower[~alive[open_]] = -np.inf
        floor = np.partition(lower, n - k, axis=1)[:, n - k]
        upper = bound(ordered[min(depth, n - 1)], ordered[max(n - 1 - depth, 0)])
        alive[open_] &= upper >= (floor - 2 * slack[open_])[:, None]
        open_ = open_[alive[open_].sum(1) > 2 * k]
        if not len(open_):
            break
    return alive


def search(k: int):
    def pair(query_ids, queries, ids, vectors, row):
        places = np.frombuffer(row["places"], np.int32).reshape(vectors.shape)
        i, j = np.nonzero(search_block(queries, vectors, places, query_ids[:, None] == ids[None, :], k))
        score = np.empty(len(i), np.int64)  # the final scores of those that are left
        for a in range(0, len(i), 1 << 15):
            score[a:a + (1 << 15)] = (queries[i[a:a + (1 << 15)]] * vectors[j[a:a + (1 << 15)]]).sum(1)
        best = best_of(i, ids[j], score, k)
        return query_ids[i[best]], ids[j[best]], score[best]
    return pair


def top_inner_products(vectors: DataFrame, is_query, k: int = 5, scale: int = 256) -> DataFrame:
    """Each query's k highest integer inner products with other vectors: query_id, rank, vec_id, score.

    Components are floor(scale * x). Ties go to the smaller vec_id. Null and empty vectors, those with
    null or non-finite components and rows without vec_id take no part; zero vectors do. Vectors meet
    those of their length; a table with fewer candidates gives what there is. Sums are 64-bit.
    """
    own = usable(vectors).select("vec_id", F.transform("vec", lambda v: F.floor(v * scale)).alias("vec"))
    return nearest(own, is_query, np.int64, search(k), k, "long", ranks, ("places",))


SQL = """
WITH v AS (SELECT vec_id, min(embedding::DOUBLE[]) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
u AS (SELECT vec_id, list_transform(vec, lambda x: floor(256 * x)) AS vec FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vec, c.vec)::BIGINT AS score
  FROM u q JOIN u c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec))
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
