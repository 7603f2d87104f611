"""A training-data pipeline over documents: language, lines, near duplicates, secrets, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the
last return the columns of documents. ``run`` writes each stage as Parquet in the shared folder and reads it again.

Defined results of every stage: null and empty texts are texts without words: language identification rejects them, the
later stages would keep them and packing gives them the end id alone; a null id is kept, and rows that share an id are
judged together by language and by their texts elsewhere; a repeated row is a copy, of which the near-duplicate stage
keeps those of the smallest id; texts of any length are taken whole; an empty table gives an empty table; columns other
than those of documents are dropped, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import language, line_dedup, ngram_join, packing, secrets
from wayfold.llm.common import stage, table

#: No SQL: language models, tries and a random forest are not expressible; tests hold the stages against brute force.
ORACLE_SQL = None
#: Words of a shingle and similarity in percent of the near-duplicate stage.
SHINGLE, PERCENT = 5, 80


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents, with the text replaced and its length counted anew."""
    return docs.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(F.coalesce(text, F.lit(""))).cast("long").alias("n_chars"))


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents alone, so that no other column can clash."""
    return docs.select("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the language found takes the place of the one declared. Rows that share an id stand or fall together."""
    docs = _documents(docs)
    found = language.language_of_documents(docs).where("kept")
    one = found.groupBy("doc_id").agg(F.min("lang").alias("found")).withColumnRenamed("doc_id", "__id")
    joined = docs.join(one, F.col("doc_id").eqNullSafe(F.col("__id")))
    return joined.select("doc_id", "text", F.col("found").alias("lang"), "source", "n_chars")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an equal or near line precedes are cut; documents of which no line is left go."""
    docs = _documents(docs)
    texts = docs.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    gone = line_dedup.repeated_lines(line_dedup.keyed_texts(docs), 1).withColumnsRenamed({"text_key": "__key", "doc_id": "__id"})
    joined = texts.join(gone, (F.col("text_key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    cut = joined.withColumn("__text", line_dedup.without_lines(F.col("text"), F.col("gone")))
    return _with_text(cut.where(F.col("gone").isNull() | F.col("__text").rlike(r"[^\x20\x09-\x0D]")), "__text")


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    docs = _documents(docs)
    found = ngram_join.ngram_join(docs, SHINGLE, PERCENT)
    kept = found.where("doc_id <=> component_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; the documents stay."""
    docs = _documents(docs)
    found = secrets.secrets_by_text(secrets.scan(docs))
    return _with_text(secrets.redact(docs, F.col("text"), found), "__text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and its place there."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_join", join_ngrams),
    ("secret_scan", scan_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
