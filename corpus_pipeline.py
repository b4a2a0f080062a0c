"""The corpus pipeline: STAGES, each (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import packing, pii, quality, similar, substring
from tessera.llm.common import stash, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return similar.keep_first(docs, similarity=0.8, shingle=5)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages that an earlier document holds out of the texts."""
    return substring.cut(docs, window=13)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a placeholder for each piece of personal data."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places each document's words in training sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality", keep_good), ("near copies", drop_near_copies), ("repeats", cut_repeats), ("personal data", redact), ("packing", pack)]

#: No SQL: the classifier and the tagger are trained. tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
