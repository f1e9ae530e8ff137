"""The corpus pipeline: quality, near duplicates, mixture, tokens; each stage works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from orefold.llm import bpe, minhash, mixture, quality
from orefold.llm.common import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on the labelled rows of ``docs`` outside the held-out fold.

    Null and empty texts are scored as texts without words; without labels of both classes all documents stay. Extra
    columns are kept.
    """
    return quality.accepted(spark, docs, quality.fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id. Word shingles of five, similarity 0.8.

    Documents without words or without id stay; of repeated ids one row stays. Extra columns are kept.
    """
    return minhash.keep_one(spark, docs, width=5, threshold=80)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of what is left: a row for each pass in which a document is read, cut where its source's target ends.

    Documents of no words are taken 0 times and go; a null source is a source. Extra columns are kept.
    """
    return mixture.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mixed documents, a row for each. Null and empty texts have no tokens."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("mixture", mixture_stage), ("tokens", token_stage)]

#: The classifier's scores can't be expressed in SQL; tests hold each stage's operator against brute force, and the stages against these operators and on odd rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    s = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = s.save(stage(spark, docs, sf_dir), name)
    return docs
