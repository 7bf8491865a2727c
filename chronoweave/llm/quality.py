"""Quality of texts: a linear classifier over n-gram indicators scaled by naive Bayes log-count ratios (NBSVM)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import crc_mod, low_hashes, mix, prefix_sums, rows, span_hashes, steps, texts, words, written

#: Hashed indicators.
BUCKETS = 1 << 17
#: Labelled rows that the linear model is fitted on at most; log-count ratios take all labelled rows.
SAMPLE = 8000
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12
#: An n-gram has an indicator for each of these shares of the text's words that it reaches.
SHARES = (0.0, 1 / 64, 1 / 16, 1 / 8, 1 / 4, 1 / 2)
THRESHOLD = 0.7

# kinds of bytes: small letters and all bytes of other alphabets, capitals, digits; other bytes are their own kind
_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123] = 97
_KIND[128:] = 97
_KIND[65:91] = 65
_KIND[48:58] = 48

FEATURES = pa.schema([("doc_id", pa.int64()), ("features", pa.binary())])


def _grams(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, n-gram and count of every n-gram of every text, and the texts' word counts.

    The n-grams: shapes of single words and of neighbours, a word that repeats the one before it, and
    three words that stood earlier in the text.
    """
    data, first, end, bounds = words(parts)
    n = np.diff(bounds)
    if not len(first):
        return np.zeros((3, 0), np.uint64), n
    raw = _KIND[np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)]
    change = np.ones(len(raw), bool)
    change[1:] = raw[1:] != raw[:-1]
    change[first] = True
    at = np.flatnonzero(change)
    shape = span_hashes(prefix_sums(raw[at]), np.searchsorted(at, first), np.searchsorted(at, end))
    word = span_hashes(prefix_sums(data), first, end)
    text = np.repeat(np.arange(len(parts)), n)
    inner = text[1:] == text[:-1]
    pair = mix(shape[:-1] * np.uint64(3) + shape[1:])[inner]
    again = np.flatnonzero(inner & (word[1:] == word[:-1]))
    three = mix(mix(word[:-2] * np.uint64(3) + word[1:-1]) * np.uint64(3) + word[2:]) if len(word) > 2 else word[:0]
    where = text[2:]
    whole = inner[1:] & inner[:-1]
    three, where = three[whole], where[whole]
    order = np.lexsort((three, where))
    a, b = three[order], where[order]
    old = b[1:][(a[1:] == a[:-1]) & (b[1:] == b[:-1])]
    who = np.concatenate([text, text[1:][inner], text[1:][again], old]).astype(np.uint64)
    gram = np.concatenate([shape, pair, np.full(len(again), 11, np.uint64), np.full(len(old), 13, np.uint64)])
    order = np.lexsort((gram, who))
    who, gram = who[order], gram[order]
    new = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (gram[1:] != gram[:-1])))
    return np.stack([who[new], gram[new], np.diff(np.append(new, len(who))).astype(np.uint64)]), n


def indicators(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text, one after another, and how many each text has."""
    (who, gram, count), n = _grams(parts)
    who = who.astype(np.int64)
    share = count / np.maximum(n, 1)[who]
    own, bucket = [], []
    for level, least in enumerate(SHARES):
        has = share >= least
        own.append(who[has])
        bucket.append((mix(gram[has] + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(BUCKETS)).astype(np.int64))
    key = np.unique(np.concatenate(own) * BUCKETS + np.concatenate(bucket))
    return (key % BUCKETS).astype(np.uint32), np.bincount(key // BUCKETS, minlength=len(parts))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the text's indicators."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, parts in steps(batch, "text"):
                buckets, sizes = indicators(parts)
                ends = np.append(0, np.cumsum(sizes)) * 4
                values = pa.Array.from_buffers(pa.binary(), end - first, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(buckets)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), values], schema=FEATURES)
    return texts(docs).mapInArrow(run, "doc_id long, features binary")


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """All indicators of a column of them, and how many each row has."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint32), np.array([len(r) // 4 for r in raw], np.int64)


def _sum_rows(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    total = np.append(0, np.cumsum(values))
    return total[ends] - total[ends - sizes]


def counts(labelled: DataFrame) -> np.ndarray:
    """Rows of class 0 and of class 1 that have each indicator, over all labelled rows; summed in each task first."""
    schema = pa.schema([("bucket", pa.int32()), ("zero", pa.int64()), ("one", pa.int64())])

    def run(batches):
        own = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            flat, sizes = _flat(batch.column("features"))
            label = np.repeat(batch.column("label").to_numpy(), sizes)
            for k in (0, 1):
                own[k] += np.bincount(flat[label == k], minlength=BUCKETS)
        used = np.flatnonzero(own.any(0))
        yield rows(schema, bucket=used, zero=own[0, used], one=own[1, used])

    # at most BUCKETS rows
    table = labelled.mapInArrow(run, "bucket int, zero long, one long").groupBy("bucket").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one")).toArrow()
    out = np.zeros((2, BUCKETS))
    out[:, table.column("bucket").to_numpy()] = [table.column("zero").to_numpy(), table.column("one").to_numpy()]
    return out


def dual_coordinate_descent(data: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, dim: int, cost: float, epochs: int) -> np.ndarray:
    """L2-regularised squared hinge loss, one dual variable at a time in a shuffled order; the last weight is the bias."""
    w, alpha = np.zeros(dim + 1), np.zeros(len(y))
    diagonal = 0.5 / cost
    square = np.array([v @ v for v in values]) + 1 + diagonal
    random = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(len(y)):
            at, v = data[i], values[i]
            gradient = y[i] * (w[at] @ v + w[-1]) - 1 + diagonal * alpha[i]
            new = max(alpha[i] - gradient / square[i], 0.0)
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * v
                w[-1] += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-6:
            break
    return w


def platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a sigmoid fitted to margins by Newton steps."""
    n1, n0 = label.sum(), (1 - label).sum()
    goal = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, np.log((n1 + 1) / (n0 + 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - goal) * margin).sum() + 1e-3 * a, (p - goal).sum()])
        s = p * (1 - p) + 1e-12
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float, float, float]:
    """Weights of all indicators with the ratios in them, the bias, and the sigmoid's slope and shift.

    labelled: features, label (0 or 1). All rows make the log-count ratios; the hinge-loss model takes the
    ``sample`` rows first in the order of a hash of doc_id, three quarters for the weights and one for the sigmoid.
    """
    both = counts(labelled)
    p, q = both[1] + SMOOTHING, both[0] + SMOOTHING
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    seen = both.sum(0) > 0
    ordered = labelled.withColumn("order", F.xxhash64(F.col("doc_id"), F.lit(5))).filter(low_hashes(F.col("order"), sample, F.lit(labelled.count())))
    picked = ordered.orderBy("order", "doc_id", "label").limit(sample).select("features", "label").toArrow()
    label = picked.column("label").to_numpy().astype(np.int64)
    data = [np.frombuffer(r, np.uint32) for r in picked.column("features").to_pylist()]
    if len(set(label.tolist())) < 2:
        share = (label.sum() + 1) / (len(label) + 2)
        return np.zeros(BUCKETS), 0.0, 1.0, float(np.log(share / (1 - share)))
    data = [d[seen[d]] for d in data]
    values = [ratio[d] / np.sqrt(max(len(d), 1)) for d in data]
    held = np.arange(len(label)) % 4 == 3
    if len(set(label[held].tolist())) < 2 or len(set(label[~held].tolist())) < 2:
        held = np.zeros(len(label), bool)
    learn = np.flatnonzero(~held)
    w = dual_coordinate_descent([data[i] for i in learn], [values[i] for i in learn], np.where(label[learn] == 1, 1.0, -1.0), BUCKETS, COST, EPOCHS)
    margin = np.array([w[d] @ v + w[-1] for d, v in zip(data, values, strict=True)])
    a, b = platt(margin[held], label[held]) if held.any() else platt(margin, label)
    return np.where(seen, w[:-1] * ratio, 0.0), float(w[-1]), a, b


def score(docs: DataFrame, labels: DataFrame, held_out, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text, learned from the labelled rows that are not held out.

    Labels other than 0 and 1 are ignored; a label counts once for each row of either table. Null and empty
    texts have no indicators and get the score of the bias. Without both classes all scores are the smoothed
    share of class 1. Rows without doc_id are left out, repeated rows each have a result.
    """
    spark = docs.sparkSession
    own = written(features(docs), "quality-features")
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    labelled = own.join(known, "doc_id").filter(~held_out)
    weights, bias, slope, shift = fit(written(labelled, "quality-labelled"), sample)
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))  # BUCKETS numbers
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        w = shared.value.astype(np.float64)
        seen = w != 0
        for batch in batches:
            flat, sizes = _flat(batch.column("features"))
            margin = _sum_rows(w[flat], sizes) / np.sqrt(np.maximum(_sum_rows(seen[flat].astype(np.int64), sizes), 1)) + bias
            yield rows(schema, doc_id=batch.column("doc_id"), score=1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30))))

    scored = own.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def held_out():
    return crc_mod("doc_id", 4) == 2
