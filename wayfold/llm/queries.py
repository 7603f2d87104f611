"""The queries of this subpackage and their SQL; ``__spark_entry__`` adds them if the subpackage is there."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import (
    bpe_transducer, collocations, exact_dedup, fill_in_middle, language, line_dedup, near_vectors, ngram_join, oracles, packing,
    personal_data, quality, secrets, suffix_dedup,
)
from wayfold.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents"), 1)
    return found.select("doc_id", "n_lines", "n_removed", F.length("kept_text").cast("long").alias("n_chars_kept"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_of_documents(table(spark, sf_dir, "documents"))


def language_id_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on pages, whose markup and addresses carry the evidence that documents lack."""
    return language.language_of_pages(table(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), keep_text=False)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "token_no", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("n_chars"), "score", "is_secret")


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), size=4, percent=85)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_transducer.token_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))


_ALL = (
    op1_line_dedup, op2_language_id, op3_suffix_dedup, op4_best_fit_packing, op5_secret_scan, op6_near_vectors,
    op7_exact_dedup, op8_ngram_join, op9_quality, op10_byte_bpe, op11_personal_data, op12_collocations, op13_fill_in_middle, language_id_of_pages,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": oracles.LINE_DEDUP,
    "op3_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op6_near_vectors": oracles.NEAR_VECTORS,
    "op7_exact_dedup": exact_dedup.ORACLE_SQL,
    "op8_ngram_join": oracles.NGRAM_JOIN,
    "op12_collocations": oracles.COLLOCATIONS,
    "op13_fill_in_middle": oracles.FILL_IN_MIDDLE,
}
