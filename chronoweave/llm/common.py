"""Helpers of the operators: inputs, work folders in the shared store, byte blocks, word hashes."""

from __future__ import annotations

import ctypes
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.session import ensure_checkpoint_dir, ship_package

#: Bytes of text that one vectorised step takes; a longer document is a step of its own.
STEP_BYTES = 1 << 20

#: Bytes that a batch of rows sent to Python is closed at.
BATCH_BYTES = 8 << 20
#: Bytes of text whose share of an exchange is one group of a task.
PART_BYTES = 1 << 22

_names = itertools.count()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def workers(spark: SparkSession) -> None:
    """Prepare the session for work in Python: the package sent, and batches of at most a few MB (or one row), of which a task holds several."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), and the columns asked for, whatever else the table has.

    Rows without a doc_id are no documents and are left out.
    """
    workers(docs.sparkSession)
    return (docs.filter(F.col("doc_id").isNotNull())
            .select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more))


def crc_mod(column: str, n: int):
    """crc32 of a column's decimal text, modulo ``n``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def low_hashes(order, wanted: int, count):
    """Whether a 64-bit hash is among the lowest that hold about half as many again as the rows wanted of ``count``."""
    share = F.least(F.lit(1.0), F.lit(1.5 * wanted) / F.greatest(count, F.lit(1)))
    return order.cast("double") <= (share * 2 - 1) * F.lit(float(1 << 63))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder of the session."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}-{next(_names)}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts its lineage."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def exchange_parts(docs: DataFrame, text: str = "text") -> int:
    """Parts that an exchange of packed blocks is dealt into: some for each shuffle partition, so that these fill evenly, and more
    where a part would hold what more than ``PART_BYTES`` of text gives."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(2 * shuffle_parts(docs.sparkSession), -(-size // PART_BYTES))


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES, kind=pa.binary(), most: int = 1 << 14) -> Iterator[tuple[int, int, list]]:
    """At most ``most`` consecutive rows, their texts near ``limit`` together: first row, end row, texts (null: empty)."""
    first, size, out = 0, 0, []
    for i, v in enumerate(batch.column(column).cast(kind)):
        v = v.as_py() or ("" if kind == pa.string() else b"")
        if out and (size + len(v) > limit or len(out) == most):
            yield first, i, out
            first, size, out = i, 0, []
        out.append(v)
        size += len(v)
    if out:
        yield first, first + len(out), out
    give_back()


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: a worker outlives its task, and others on its machine need the room."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


# ---- hashes of spans, all vectorised modulo 2**64

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        size = max(n, 1 << 16)
        p = np.full(size, base, np.uint64)
        p[0] = 1
        if size > 3 * STEP_BYTES:  # not kept: one very long text
            return np.cumprod(p, dtype=np.uint64)
        _powers[base] = np.cumprod(p, dtype=np.uint64)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """Running polynomial hash; ``span_hashes`` takes differences of it."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(symbols)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [first, end): equal content, equal hash."""
    own = (sums[end] - sums[first]) * _power(_INVERSE, len(sums))[first]
    return mix(own + (end - first).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of other bytes than space and 9 to 13) of several texts, A-Z lower-cased.

    Returns the bytes, the words' starts and ends in them, and for each text the number of words
    before it (one more entry than texts).
    """
    data = LOWER[np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = ~_SPACE[data]
    edge = np.diff(inside)
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begins = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=begins[1:])
    return data, first, end, np.searchsorted(first, begins)


def shingle_hashes(parts: list[bytes], n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the word n-grams of several texts, joined by one space, repeats included, and how many each text has.

    A text of fewer words has its whole sequence as one gram; a text without words has none.
    """
    data, first, end, begins = words(parts)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(parts), np.int64)
    # all words one after another, a space behind each
    sizes = end - first
    at = np.zeros(len(first) + 1, np.int64)
    np.cumsum(sizes + 1, out=at[1:])
    line = np.full(at[-1], 0x20, np.uint8)
    line[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(first)), sizes)] = data[~_SPACE[data]]
    line = line.tobytes()
    count = np.diff(begins)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    head = np.arange(int(grams.sum())) + np.repeat(begins[:-1] - (np.cumsum(grams) - grams), grams)
    tail = np.minimum(head + n, np.repeat(begins[1:], grams))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(at[head].tolist(), (at[tail] - 1).tolist())), np.uint64, len(head))
    return hashes, grams


def unique_in_groups(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each group, ascending; ``sizes``: rows of each group, one after another. Values and new sizes."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((values, group))
    values, group = values[order], group[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (group[1:] != group[:-1])
    return values[keep], np.bincount(group[keep], minlength=len(sizes))
