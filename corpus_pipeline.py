"""The corpus pipeline: a classifier rejects, near copies go, benchmark leaks go, sources are mixed, rows are sharded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontaminate, jaccard, mixing, quality, sharding
from textloom.llm.common import materialize, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose score reaches the threshold of the quality model, which is trained on these documents' labels."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a Jaccard similarity of 0.8 over five-word shingles, the one with the least doc_id stays."""
    return jaccard.keep_one(docs, jaccard.Join(words=5, percent=80))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, re-parameterised or not, go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal target weights for all sources, about as many bytes as came in."""
    return mixing.mix(docs).select(docs.columns)


def sharding_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot by a reproducible permutation of the row numbers."""
    return sharding.shard(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("sharding", sharding_),
]

#: Scores of a boosted model and regular expressions with look-behind are beyond SQL; tests/llm/test_pipeline.py holds the rows of every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), docs)  # the stage before it is read no more
    return STAGES[-1][1](spark, docs, sf_dir)
