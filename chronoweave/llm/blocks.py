"""A stated set of query vectors against all vectors, block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.llm.common import rows, shuffle_parts, workers, written

#: Vectors of a block, and queries of a block: what one step of a task holds.
BLOCK = 4096
QUERY_BLOCK = 512


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and vec (doubles): rows with an id and a non-empty vector of finite components; one row an id.

    Rows that repeat a vec_id count once, with the smallest of their vectors.
    """
    workers(vectors.sparkSession)
    x = F.col(column)
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    own = vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("vec"))
    return own.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def _pack(kind: np.dtype, prepare: Callable[[np.ndarray], dict[str, bytes]], fields: list[str]):
    schema = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), *((f, pa.binary()) for f in fields)])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        vectors = np.array(table.column("vec").combine_chunks().flatten(), kind).reshape(table.num_rows, -1)
        row = {"dim": [vectors.shape[1]], "block": [table.column("block")[0].as_py()], "ids": [table.column("vec_id").to_numpy().tobytes()], "vectors": [vectors.tobytes()]}
        return pa.Table.from_batches([rows(schema, **row, **{k: [v] for k, v in prepare(vectors).items()})])
    return run, "dim int, block int, ids binary, vectors binary" + "".join(f", {f} binary" for f in fields)


def packed(vectors: DataFrame, n_blocks: int, kind, prepare=lambda v: {}, fields=()) -> DataFrame:
    """One row a block of at most about ``BLOCK`` vectors of one length, with what ``prepare`` makes of them."""
    run, schema = _pack(np.dtype(kind), prepare, list(fields))
    own = vectors.withColumn("dim", F.size("vec")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int"))
    return own.groupBy("dim", "block").applyInArrow(run, schema)


def nearest(vectors: DataFrame, is_query: Column, kind, pair, k: int, score: str, prepare=lambda v: {}, fields=()) -> DataFrame:
    """Query blocks meet vector blocks; ``pair`` gives each query's best of a block, a window the best of all.

    pair(query ids, queries, ids, vectors, index fields) yields (query_id, vec_id, score) arrays.
    """
    spark = vectors.sparkSession
    counts = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    n_blocks, n_queries = -(-counts.n // BLOCK) or 1, -(-counts.q // QUERY_BLOCK) or 1
    index = packed(vectors, n_blocks, kind, prepare, fields)
    index = written(index, "vector-index")
    asked = packed(vectors.filter(is_query), n_queries, kind).select("dim", F.col("block").alias("asked"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
    parts = max(shuffle_parts(spark), min(4 * shuffle_parts(spark), n_blocks * n_queries))
    left = index.withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)))).repartition(parts, "dim", "block", "asked")
    right = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).repartition(parts, "dim", "block", "asked")
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64() if score == "long" else pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                array = lambda c, t=np.int64: np.frombuffer(row[c], t)
                a, b, s = pair(array("query_ids"), array("queries", kind).reshape(-1, row["dim"]), array("ids"), array("vectors", kind).reshape(-1, row["dim"]), row)
                yield rows(out, query_id=a, vec_id=b, score=s)

    met = left.join(right, ["dim", "block", "asked"]).mapInArrow(run, f"query_id long, vec_id long, score {score}")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_of(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Of pairs (row of query, id, score): places of each query's k best, ties to the smaller id."""
    order = np.lexsort((ids, -scores, query))
    own = query[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    nth = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return order[nth < k]
