"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wayfold.llm import bpe_transducer, collocations, exact_dedup, fill_in_middle, language, line_dedup, near_vectors, ngram_join, packing, personal_data, quality, secrets, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mark int, copies string, text_key string, n int, at string, key string"
LONG = " ".join(f"word{i % 977} other{i % 613}." for i in range(30_000))
SAME = "one two three four five six seven eight nine ten " * 6
TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, SAME), (6, SAME), (6, SAME), (None, SAME), (None, None), (7, "a" * 700), (8, "Ünïcode ß 中文 😀 text with signs"), (9, "\n\n\n")]
IDS = sorted((i for i, _ in TEXTS), key=lambda i: (i is None, i or 0))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "src0", None, 7, "x", "y", 3, "z", None) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, None, 0), (2, 0, 0), (4, 1, 0), (5, 1, 1), (5, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def one_row_each(df):
    rows = df.collect()
    assert sorted((r.doc_id for r in rows), key=lambda i: (i is None, i or 0)) == IDS
    return {r.doc_id: r for r in rows}


def operators(labels):
    word, byte = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return {
        "lines": line_dedup.line_dedup,
        "language": language.language_of_documents,
        "suffix": suffix_dedup.suffix_dedup,
        "packing": lambda d: packing.pack_documents(d, word),
        "secrets": secrets.scan,
        "exact": exact_dedup.exact_dedup,
        "ngrams": ngram_join.ngram_join,
        "quality": lambda d: quality.quality_scores(d, labels),
        "personal": personal_data.personal_data,
        "phrases": collocations.collocations,
        "middle": fill_in_middle.fill_in_middle,
        "bpe": lambda d: bpe_transducer.token_digests(d, byte, public_tokenizers.PATTERN),
    }


@pytest.mark.parametrize("name", ["lines", "language", "suffix", "packing", "secrets", "exact", "ngrams", "quality", "personal", "phrases", "middle", "bpe"])
def test_empty_table(empty, labels, name):
    assert operators(labels)[name](empty).collect() == []


def test_lines(docs):
    got = one_row_each(line_dedup.line_dedup(docs))
    assert (got[2].n_lines, got[2].n_removed, got[9].n_lines, got[9].n_removed) == (1, 0, 4, 0)
    assert got[5].n_removed == 0 and got[6].n_removed == 1 and got[6].kept_text == ""
    assert got[4].kept_text == LONG


def test_language(docs):
    got = one_row_each(language.language_of_documents(docs))
    assert (got[1].lang, got[1].kept, got[3].kept) == ("und", False, False)
    assert got[4].lang == "en" and got[4].kept


def test_suffix(docs):
    got = one_row_each(suffix_dedup.suffix_dedup(docs))
    assert (got[1].n_bytes, got[1].n_removed, got[1].kept_sha256) == (0, 0, hashlib.sha256(b"").hexdigest())
    assert got[5].n_removed == got[5].n_bytes == len(SAME) and got[5].n_spans == 1
    assert got[7].n_removed == 700 and got[3].n_removed == 0


def test_packing(docs):
    rows = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    lengths = sorted(r.length for r in rows if r.doc_id in (1, 2, 3, 9))
    assert lengths == [1, 1, 1, 1] and sum(r.doc_id == 6 for r in rows) == 2
    assert sorted(r.piece for r in rows if r.doc_id == 4) == list(range(sum(r.doc_id == 4 for r in rows)))


def test_exact(docs):
    got = one_row_each(exact_dedup.exact_dedup(docs))
    assert got[5].keep_id == 5 and got[6].keep_id == 5 and got[5].group_size == 4 and got[5].kept and not got[6].kept
    # 1, 2, 3, 9 and the null id are all empty once blanks are gone; 3 and 9 have the most code points, 3 more of them.
    assert {got[i].keep_id for i in (1, 2, 3, 9)} == {3} and got[3].group_size == 5


def test_ngrams(docs):
    got = one_row_each(ngram_join.ngram_join(docs, 4, 85))
    assert (got[1].n_shingles, got[1].component_id, got[3].n_shingles) == (0, 1, 0)
    assert got[6].component_id == 5 and got[5].n_shingles == 10 and got[7].n_shingles == 1


def test_quality(docs, labels):
    got = one_row_each(quality.quality_scores(docs, labels))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_quality_without_labels(docs, labels):
    assert {r.score for r in quality.quality_scores(docs, labels.where("false")).collect()} == {0.5}


def test_bpe(docs):
    got = one_row_each(bpe_transducer.token_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))
    assert got[1].n_tokens == 0 and got[4].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()


def test_secrets(docs):
    assert secrets.scan(docs).where("is_secret").count() == 0


def test_vectors(spark):
    a, nan, inf = [1.0, 0.0, 0.5], float("nan"), float("inf")
    rows = [(1, a), (2, a), (2, a), (3, [2.0, 0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]), (9, [1.0, None, 2.0]), (10, [1.0, 0.0]), (None, a)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rep int, h1 string")
    got = {r.vec_id: r for r in near_vectors.near_vectors(df).collect()}
    assert (got[1].n_links, got[3].n_links, got[3].component_id) == (3, 3, 1)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (4, 5, 6, 7, 8, 9, 10))
    assert near_vectors.near_vectors(df.where("false")).collect() == []


def test_other_columns_do_not_clash(docs):
    assert "mark" in docs.columns and ngram_join.ngram_join(docs.withColumn("token", F.lit(1)).withColumn("component", F.lit(2))).count() == len(TEXTS)
