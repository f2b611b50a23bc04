"""Corpus pipeline: documents pass the stages of ``STAGES`` one after the other.

Each stage is one of the operators of ``ledgerlens.llm``; its result is written
as Parquet to the shared folder and reread as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import language_id, mixing, piece_sampling, quality, simhash_dedup
from ledgerlens.llm._util import arrow_batches, stored, table

#: Texts that Python gets at once in the encoding stage.
BATCH_ROWS = 1000


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a clearly identified language."""
    return language_id.keep_identified(docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the co-trained classifier finds of low quality."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash component."""
    return simhash_dedup.keep_one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (none, one or two copies)."""
    return mixing.mixed_corpus(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of the mixed documents."""
    with arrow_batches(spark, BATCH_ROWS):  # read when it runs, so the result is stored within
        return stored(piece_sampling.encode_documents(docs), "pipeline-encoded")


STAGES = [
    ("language_id", language_stage),
    ("quality", quality_stage),
    ("simhash_dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: Hashing, model fitting and sampling over word pieces have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table; the last one's result."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
