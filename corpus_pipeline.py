"""The corpus pipeline: five stages over ``documents``, each a step of its own in a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from areastats.llm import decontaminate, mixing, ngram_join, quality, sharding
from areastats.llm.tables import read
from areastats.scale import Scratch

#: Near-duplicates: shingles of five words, Jaccard of 0.8 or more.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
SHARDS = 16


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the threshold table."""
    return quality.keep_good(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each group of near copies."""
    return ngram_join.one_per_group(docs, length=SHINGLE_WORDS, percent=SIMILAR_PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by an item of ``benchmark``."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture at its target weights: each document once per epoch of its source."""
    return mixing.mixed_documents(docs)


def sharding_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mixture."""
    return sharding.shard_by_bytes(docs, shards=SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_sources", mixing_sources),
    ("sharding", sharding_documents),
]

#: SQL has no best-fit packing; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's answer is written and read back by the next."""
    docs, scratch, before = read(spark, sf_dir, "documents"), Scratch(spark), None
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
