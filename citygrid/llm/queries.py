"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, dual_tree, knn, line_dedup, vector_codes, warc
from .common import table
from .decontaminate import leaks
from .near_dedup import near_duplicates
from .packing import pack, token_pieces
from .quality import classify
from .secrets import scan
from .suffix_dedup import remove_repeats
from .url_filter import judge


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return chat.read_back(chat.prefix_trees(chat.with_hard_case(table(spark, sf_dir, "conversations")), tokenizer), tokenizer)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, the removed runs, and what is left of each text."""
    return remove_repeats(table(spark, sf_dir, "documents"), 400)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return knn.top_k(e, e.where("vec_id % 50 = 0"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items of which they have passages."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their scores."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).where("kept")


def op11_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_shared_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.cluster(table(spark, sf_dir, "embeddings"))


_ALL = (
    op1_url_filter, op2_chat_formatting, op3_suffix_array_dedup, op4_minhash_near_dedup, op5_secret_scans, op6_exact_top_k, op7_warc, op8_best_fit_packing,
    op9_benchmark_decontamination, op10_quality_classifier, op11_vector_code_compression, op12_line_dedup,
    op13_centroid_clustering,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_formatting": chat.ORACLE_SQL, "op6_exact_top_k": knn.ORACLE_SQL, "op7_warc": warc.ORACLE_SQL, "op11_vector_code_compression": vector_codes.oracle_sql(),
        "op12_line_dedup": line_dedup.ORACLE_SQL, "op13_centroid_clustering": dual_tree.oracle_sql(),
    }
