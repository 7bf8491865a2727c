"""Approximate nearest neighbours from randomly rotated one-bit codes (RaBitQ), reranked by exact cosines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.blocks import best_of, nearest, usable
from chronoweave.llm.common import rows, written

#: Width of the error bound in standard deviations of the estimate.
EPSILON = 4.0
#: Estimates whose exact scores set a query's threshold within a block.
PROBES = 32
SEED = 20240521
#: Pairs whose exact scores are taken at once.
PAIRS = 1 << 14


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(centre: np.ndarray):
    """Index of a block: packed sign bits of the rotated residuals; the correction scalars."""
    def run(vectors: np.ndarray) -> dict[str, bytes]:
        dim = vectors.shape[1]
        c = centre if len(centre) == dim else np.zeros(dim)
        unit = vectors / _norms(vectors)[:, None]
        rest = unit - c
        length = np.sqrt((rest * rest).sum(1))
        turned = rest @ rotation(dim) / np.where(length, length, 1)[:, None]
        return {"bits": np.packbits(turned > 0, axis=1).tobytes(),
                "scalars": np.stack([length, np.abs(turned).sum(1) / np.sqrt(dim), unit @ c], 1).tobytes()}
    return run


def _norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(_dots(vectors, vectors))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first component to the last, so equal vectors have equal scores."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def exact(queries: np.ndarray, qn: np.ndarray, vectors: np.ndarray, vn: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for a in range(0, len(i), PAIRS):
        x, y = i[a:a + PAIRS], j[a:a + PAIRS]
        out[a:a + PAIRS] = _dots(queries[x], vectors[y]) / (qn[x] * vn[y])
    return np.clip(out, -1, 1)


def search(centre: np.ndarray, k: int, epsilon: float):
    def pair(query_ids, queries, ids, vectors, row):
        dim, n = vectors.shape[1], len(ids)
        c = centre if len(centre) == dim else np.zeros(dim)
        signs = np.unpackbits(np.frombuffer(row["bits"], np.uint8).reshape(n, -1), axis=1, count=dim).astype(np.float32) * 2 - 1
        length, corrected, on_centre = np.frombuffer(row["scalars"]).reshape(n, 3).T
        qn, vn = _norms(queries), _norms(vectors)
        unit = queries / qn[:, None]
        rest = unit - c
        q_length = np.sqrt((rest * rest).sum(1))
        turned = rest @ rotation(dim)
        safe = np.where(corrected > 0, corrected, 1)
        # <o, q> is estimated by <code, q> / <code, o>; its error shrinks with the root of the dimension
        estimate = (turned.astype(np.float32) @ signs.T) / np.sqrt(dim) * (length / safe) + on_centre + (unit @ c)[:, None] - c @ c
        margin = epsilon * np.sqrt(np.maximum(1 - safe * safe, 0)) / safe / np.sqrt(max(dim - 1, 1)) * length * q_length[:, None]
        margin += 1e-5  # of single precision
        own = query_ids[:, None] == ids[None, :]
        upper = np.where(own, -np.inf, estimate + margin)
        probes = min(n, PROBES + k)
        top = np.argpartition(-np.where(own, -np.inf, estimate), probes - 1, axis=1)[:, :probes]
        i = np.repeat(np.arange(len(query_ids)), probes)
        first = exact(queries, qn, vectors, vn, i, top.ravel()).reshape(top.shape)
        first[np.take_along_axis(own, top, 1)] = -np.inf
        least = np.sort(first, axis=1)[:, -k] if probes >= k else np.full(len(query_ids), -np.inf)
        i, j = np.nonzero((upper >= least[:, None]) & ~own)
        score = exact(queries, qn, vectors, vn, i, j)
        best = best_of(i, ids[j], score, k)
        return query_ids[i[best]], ids[j[best]], score[best]
    return pair


def mean_direction(vectors: DataFrame) -> np.ndarray:
    """Mean of all unit vectors of the most frequent length; summed in each task, then a row for each length."""
    schema = pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("total", pa.binary())])
    ddl = "dim int, n long, total binary"

    def part(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            sizes = pc.list_value_length(batch.column("vec")).to_numpy()
            for dim in np.unique(sizes).tolist():
                x = np.array(batch.column("vec").filter(pa.array(sizes == dim)).flatten()).reshape(-1, dim)
                own = sums.setdefault(dim, [0, np.zeros(dim)])
                own[0] += len(x)
                own[1] += (x / _norms(x)[:, None]).sum(0)
        yield rows(schema, dim=list(sums), n=[v[0] for v in sums.values()], total=[v[1].tobytes() for v in sums.values()])

    def whole(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b) for b in table.column("total").to_pylist())
        n = sum(table.column("n").to_pylist())
        return pa.Table.from_batches([rows(schema, dim=[len(total)], n=[n], total=[total.tobytes()])])

    widest = vectors.select("vec").mapInArrow(part, ddl).groupBy("dim").applyInArrow(whole, ddl).orderBy(F.desc("n"), "dim").first()
    return np.frombuffer(widest.total) / widest.n if widest else np.zeros(0)


def nearest_by_cosine(vectors: DataFrame, is_query, k: int = 5, epsilon: float = EPSILON) -> DataFrame:
    """Each query's k nearest other vectors by cosine: query_id, rank, vec_id, score.

    Every vector is coded by one bit a dimension after subtracting the mean of all unit vectors and a
    random rotation. A query's estimates, with an error of ``epsilon`` deviations either way, choose the
    vectors whose exact cosine is taken; ties go to the smaller vec_id. Null, empty and zero vectors and
    those with null or non-finite components take no part, nor do rows without vec_id; vectors meet
    those of their length; a table with fewer candidates gives what there is.
    """
    own = usable(vectors).filter(F.exists("vec", lambda v: v != 0))
    own = written(own, "vectors")
    centre = mean_direction(own)
    return nearest(own, is_query, np.float64, search(centre, k, epsilon), k, "double", encode(centre), ("bits", "scalars"))


SQL = """
WITH v AS (SELECT vec_id, min(embedding::DOUBLE[]) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
u AS (SELECT * FROM v WHERE len(list_filter(vec, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.vec, c.vec) AS score
  FROM u q JOIN u c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec))
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
