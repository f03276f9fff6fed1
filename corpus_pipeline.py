"""Corpus pipeline: quality filter, near-duplicate removal, PII redaction, source mixing, piece encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelspark.llm import mixing, ngram_join, pii, piece_sampling, quality
from pixelspark.session import discard, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. A null text is scored as the empty one."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; documents without id or words stay."""
    return ngram_join.first_of_each(docs).select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the new text."""
    return pii.redact_pii(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the target weights of their sources, in a global pseudo-random order."""
    return mixing.mix_sources(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document's text, with inclusion scores."""
    return piece_sampling.encode_samples(docs)


STAGES = [("quality", keep_good), ("near_copies", drop_near_copies), ("pii", redact), ("mixing", mix), ("pieces", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        kept = written(stage(spark, docs, sf_dir), name)
        if k:
            discard(docs)  # the stage before has been read for the last time
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
