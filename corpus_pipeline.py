"""From raw documents to token digests: language, near copies, repeated passages, source mix, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chronoweave.llm import bpe, language, mixing, ngrams, suffixes
from chronoweave.llm.common import documents, written
from chronoweave.llm.queries import MULTI_RANKS


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a language that the documents teach (operator 5)."""
    return language.accepted(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component over five-word n-grams with a similarity of 0.8 or more (operator 7)."""
    return ngrams.one_of_each(docs, 5, 80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that stand earlier (operator 1)."""
    return suffixes.deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix begins them (operator 8)."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and decoded bytes (operator 9)."""
    return bpe.round_trip(docs, MULTI_RANKS, public_tokenizers.PATTERN)


STAGES = [("language", known_language), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("mix", mixed), ("tokens", tokens)]

#: Language identification and suffix arrays have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each result written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
