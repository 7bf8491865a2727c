"""Language of texts: nearest of several centroids per language over TF-IDF letter n-grams, with rejection by distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.llm.common import crc_mod, low_hashes, mix, rows, steps, texts

#: Hashed n-grams of two and three bytes of letters.
DIM = 4096
#: Documents of each language that its centroids are clustered from at most; document frequencies take all.
SAMPLE = 1000
CENTROIDS = 4
ROUNDS = 10
#: A text is rejected if its cosine is below LEAST times the one that all but a share FAR of its language's clustered documents have.
FAR = 0.01
LEAST = 0.5
#: Texts whose dense counts a step holds.
TEXTS = 64
#: Bytes of text that a step holds.
STEP = 1 << 18

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def gram_counts(parts: list[bytes]) -> np.ndarray:
    """Counts of hashed n-grams, a row a text: bytes of letters, A-Z and the Latin-1 capitals in small, others as one space."""
    data = _FOLD[np.frombuffer(b" " + b" ".join(parts) + b"  ", np.uint8)]
    capital = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)) + 1
    data[capital] += 0x20
    begins = np.append(0, np.cumsum([len(p) + 1 for p in parts]))
    text = np.repeat(np.arange(len(parts)), np.diff(begins))
    wide = data.astype(np.uint64)
    a, b, c = wide[:-2][:len(text)], wide[1:-1][:len(text)], wide[2:][:len(text)]
    out = np.zeros(len(parts) * DIM, np.int64)
    letter = b != 32
    for code, keep in (((a << np.uint64(16)) | (b << np.uint64(8)) | c, letter), ((np.uint64(1) << np.uint64(24)) | (b << np.uint64(8)) | c, letter)):
        bucket = (mix(code[keep]) % np.uint64(DIM)).astype(np.int64)
        out += np.bincount(text[keep] * DIM + bucket, minlength=len(out))
    return out.reshape(len(parts), DIM)


def vectors(parts: list[bytes], idf: np.ndarray) -> np.ndarray:
    x = np.log1p(gram_counts(parts)).astype(np.float32) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def _frequencies(learn: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that have each n-gram, and all documents; summed in each task first, DIM + 1 rows in the end."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        own = np.zeros(DIM + 1, np.int64)
        for batch in batches:
            for _, _, parts in steps(batch, "text", STEP, most=TEXTS):
                own[:DIM] += (gram_counts(parts) > 0).sum(0)
                own[DIM] += len(parts)
        yield rows(schema, bucket=np.arange(DIM + 1), n=own)

    found = learn.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(DIM + 1, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out[:DIM], int(out[DIM])


def spherical_means(x: np.ndarray, k: int, turns: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of unit vectors by cosine, started far from each other; empty ones go. Centroids and members."""
    chosen = [int(np.argmax(x @ x.mean(0)))]
    nearest = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    centre = x[chosen]
    for _ in range(turns):
        own = np.argmax(x @ centre.T, axis=1)
        centre = np.stack([x[own == j].mean(0) for j in np.unique(own)])
        centre /= np.maximum(np.sqrt((centre * centre).sum(1, keepdims=True)), 1e-12)
    return centre, np.argmax(x @ centre.T, axis=1)


def _cluster(idf: np.ndarray, k: int):
    schema = pa.schema([("lang", pa.string()), ("near", pa.float64()), ("centroid", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("doc_id", "ascending")])
        parts = [vectors(p, idf) for b in table.combine_chunks().to_batches() for _, _, p in steps(b, "text", STEP, most=TEXTS)]
        x = np.concatenate(parts)
        centre, own = spherical_means(x, k, ROUNDS)
        # of all documents of the language: clusters of one or two odd documents have no quantile of their own
        near = [float(np.quantile(np.einsum("ij,ij->i", x, centre[own]), FAR))] * len(centre)
        return pa.Table.from_batches([rows(schema, lang=[table.column("lang")[0].as_py()] * len(centre), near=near, centroid=[c.astype(np.float32).tobytes() for c in centre])])
    return run


def model(docs: DataFrame, held_out, sample: int = SAMPLE, centroids: int = CENTROIDS) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Inverse document frequencies; languages, cosines of their far documents and centroids, a few for each language."""
    learn = texts(docs, F.col("lang").cast("string").alias("lang")).filter(~held_out & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    df, n = _frequencies(learn)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    order = F.xxhash64(F.col("doc_id"), F.lit(3))
    # a row a language; then about sample and a half rows of each
    sizes = F.broadcast(learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    low = learn.select("lang", order.alias("order")).join(sizes, "lang").filter(low_hashes(F.col("order"), sample, F.col("n")))
    ranked = low.select("lang", "order").withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy("order"))).filter(F.col("nth") <= sample)
    last = ranked.groupBy("lang").agg(F.max("order").alias("last"))  # a row a language
    picked = learn.withColumn("order", order).join(F.broadcast(last), "lang").filter(F.col("order") <= F.col("last")).select("doc_id", "lang", "order", "text")
    found = picked.groupBy("lang").applyInArrow(_cluster(idf, centroids), "lang string, near double, centroid binary").orderBy("lang", "centroid").collect()
    centre = np.array([np.frombuffer(r.centroid, np.float32) for r in found]).reshape(-1, DIM)
    return idf, [r.lang for r in found], np.array([r.near for r in found]), centre


class Nearest:
    """The model as its tasks hold it."""

    def __init__(self, idf: np.ndarray, names: list[str], least: np.ndarray, centre: np.ndarray):
        self.idf, self.names, self.least, self.centre = idf, names, least, centre

    def __call__(self, parts: list[bytes], letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and rejections of texts; letters: whether each has a letter."""
        if not self.names:
            return ["und"] * len(parts), np.zeros(len(parts)), np.ones(len(parts), bool)
        near = vectors(parts, self.idf) @ self.centre.T
        best = np.argmax(near, axis=1)
        score = np.clip(near[np.arange(len(parts)), best].astype(np.float64), 0, 1)
        names = [self.names[b] if k else "und" for b, k in zip(best.tolist(), letters.tolist(), strict=True)]
        return names, np.where(letters, score, 0.0), ~letters | (score < self.least[best])


def learned(docs: DataFrame, held_out, sample: int = SAMPLE, centroids: int = CENTROIDS, least: float = LEAST):
    """The model of ``docs``, sent to the workers: DIM numbers for each centroid."""
    idf, names, near, centre = model(docs, held_out, sample, centroids)
    return docs.sparkSession.sparkContext.broadcast(Nearest(idf, names, near * least, centre))


def _letters():
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, held_out, sample: int = SAMPLE, centroids: int = CENTROIDS, least: float = LEAST) -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine to the nearest centroid), rejected.

    Learned from text and non-null lang of the rows that are not held out. Ties go to the first language.
    Null, empty and letterless texts are ``und`` with score 0 and rejected, and so is everything when there is
    nothing to learn from, and a text much farther from its nearest centroid than that language's documents are
    (``least``). Rows without doc_id are left out, repeated rows each have a result.
    """
    shared = learned(docs, held_out, sample, centroids, least)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = np.array(batch.column("letters").to_pylist(), bool)
            for first, end, parts in steps(batch, "text", STEP, most=TEXTS):
                names, score, rejected = shared.value(parts, letters[first:end])
                yield rows(schema, doc_id=batch.column("doc_id").slice(first, end - first), lang_pred=names, score=score, rejected=rejected)

    found = texts(docs).withColumn("letters", _letters()).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, least: float = LEAST) -> DataFrame:
    """The rows whose text is not rejected, with all columns as they are; learned from all rows with a lang."""
    shared = learned(docs, F.lit(False), sample, centroids, least)

    @F.pandas_udf("boolean")
    def near(text, letters):
        known = np.zeros(len(text), bool)
        table = pa.RecordBatch.from_arrays([pa.array(text, pa.string())], ["text"])
        for first, end, parts in steps(table, "text", STEP, most=TEXTS):
            known[first:end] = ~shared.value(parts, letters.to_numpy(bool)[first:end])[2]
        return text.__class__(known, index=text.index)

    return docs.filter(near(F.col("text"), _letters()))


def held_out():
    return crc_mod("doc_id", 5) == 0
