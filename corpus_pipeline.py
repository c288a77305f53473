"""Corpus pipeline: documents to packed training sequences, one written table between stages."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from datalathe.llm import gam, packing, repetition, shingles
from datalathe.llm.common import small_batches, table
from datalathe.llm.queries import byte_bpe
from datalathe.session import cut_lineage


#: Fragments of a worker's memo in packing, which comes last, when the executors' heaps have grown.
MEMO_FRAGMENTS = 50_000


def in_small_batches(stage):
    """The stage with small batches, in its own jobs and in the one that reads its rows: the settings stay with the session."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what fails the base or the repetition rules."""
    return repetition.filtered(docs)


@in_small_batches
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what a model fitted on the labelled ones of these documents scores below 0.7."""
    return gam.filtered(docs, table(spark, sf_dir, "labels"))


@in_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by 0.8 or more of their 5-word shingles: Golay keys first, then a prefix filter."""
    return shingles.deduplicated(docs)


@in_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences that mix the sources in proportion."""
    return packing.pack(docs, byte_bpe(), memo=MEMO_FRAGMENTS)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("packing", packed),
]

#: Suffix arrays, fitted models and token ids have no SQL; stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
