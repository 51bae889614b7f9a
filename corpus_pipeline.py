"""Corpus pipeline: each stage is written as Parquet and read by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from llm import decontaminate, mixing, ngram_join, quality_rules, suffix_dedup
from llm.common import discard, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at 0.8 on five words, the smallest doc_id stays."""
    return ngram_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that occur earlier go; so do documents of which nothing is left.

    A character of which some bytes go goes whole; n_chars counts what is left."""
    return suffix_dedup.dedup_text(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target asks for."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("benchmark_decontamination", decontamination),
    ("mix_sources", mix_sources),
]

#: Suffix removal and edit distances have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, before, sf_dir), f"stage-{name}")
        if name != STAGES[0][0]:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
