"""The corpus pipeline: five stages over documents, each written and read again by whoever runs it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citygrid.llm import pipeline as p

STAGES = [
    ("quality_classifier", p.quality_classifier),
    ("near_dedup", p.near_dedup_stage),
    ("decontamination", p.decontamination),
    ("secret_scan", p.secret_scan),
    ("best_fit_packing", p.best_fit_packing),
]
#: Classifier, MinHash and tokens are beyond SQL; tests hold the pipeline against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.run(spark, sf_dir, STAGES)
