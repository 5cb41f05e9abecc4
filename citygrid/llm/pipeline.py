"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame, with the columns of docs but for the last."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, near_dedup, packing, quality, secrets
from .common import cut, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; null and blank texts go, repeated rows and rows without an id are judged by their text."""
    return docs.where(quality.keeps(F.col("text").cast("string"), quality.fit(docs, table(spark, sf_dir, "labels")), spark))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8), that of the smallest doc_id; blank texts stay, equal rows fall together."""
    return near_dedup.one_of_each(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; a null text has none. Repeated rows fare alike; all columns stay as they are."""
    return docs.where(~decontaminate.has_leak(F.col("text").cast("string"), table(spark, sf_dir, "benchmark")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows. Null texts and repeated rows stay."""
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents and their places in sequences; a null text is the end token alone, repeated rows are packed each."""
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


def run(spark: SparkSession, sf_dir: str, stages: list[tuple[str, Stage]]) -> DataFrame:
    """The stages one after the other over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(stages):
        docs = stage(spark, docs, sf_dir)
        if i < len(stages) - 1:
            docs = cut(docs, name)
    return docs
