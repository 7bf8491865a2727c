"""The numbered queries and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import bpe, language, mixing, ngrams, quality, repair, rotated, simhash, suffixes, topk, urls, wavelet, whitening
from chronoweave.llm.common import documents

#: Files of the public tokenizers; a path, never a copy.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
END_ID = 2


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated.nearest_by_cosine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), quality.held_out())


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir), language.held_out())


def op6_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.stored(documents(spark, sf_dir), BYTE_BPE, END_ID, added=True)


def op7_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.similar(documents(spark, sf_dir), 3, 90)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(documents(spark, sf_dir))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), MULTI_RANKS, public_tokenizers.PATTERN)


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), 3, 2)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 4)


QUERIES = {f.__name__: f for f in (op1_suffixes, op2_rotated, op3_topk, op4_quality, op5_language, op6_wavelet, op7_ngrams, op8_mixing, op9_bpe, op10_urls,
                                 op11_simhash, op12_repair, op13_whitening)}
ORACLES = {"op2_rotated": rotated.SQL, "op3_topk": topk.SQL, "op8_mixing": mixing.SQL, "op10_urls": urls.SQL, "op12_repair": repair.SQL}
