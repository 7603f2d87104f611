"""Odd rows through every stage of the pipeline: nulls, empty and long texts, repeated rows, foreign columns, no rows."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i} and more of it" for i in range(40_000))
PLAIN = "the quick brown fox jumps over the lazy dog\nand then sleeps all day long in the warm sun"
ROWS = [
    (1, PLAIN, "en", "web", len(PLAIN)),
    (1, PLAIN, "en", "web", len(PLAIN)),
    (2, "", "en", "web", 0),
    (3, None, None, None, None),
    (None, "a text without any id that stands alone here", "en", None, 44),
    (4, LONG, "en", "web", len(LONG)),
    (5, "the token = hunter2!correct#horse is not for you", "en", "web", 47),
]
FOREIGN = ("found", "gone", "values", "text_key", "key", "component_id", "kept", "line", "sequence_id")


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.createDataFrame(ROWS, COLUMNS).withColumns({c: F.lit(1) for c in FOREIGN})
    return {name: function(spark, docs, "") for name, function in corpus_pipeline.STAGES}


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


def test_language_rejects_what_has_no_letters(results):
    assert results["language_id"].columns == [c.split()[0] for c in COLUMNS.split(", ")]
    assert ids(results["language_id"]) == [1, 1, 4, 5, None]


def test_lines_keep_the_first_and_both_copies_of_a_row(results):
    rows = results["line_dedup"].collect()
    assert sum(r.doc_id == 1 for r in rows) == 2 and {r.text for r in rows if r.doc_id == 1} == {PLAIN}
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, None} and all(r.n_chars == len(r.text or "") for r in rows)


def test_one_document_of_a_group_stays(results):
    assert {r.doc_id for r in results["ngram_join"].collect()} == {1, 2, 3, 4, 5, None}


def test_secrets_go_and_documents_stay(results):
    texts = {r.doc_id: r.text for r in results["secret_scan"].collect()}
    assert len(ids(results["secret_scan"])) == len(ROWS) and "hunter2" not in texts[5] and texts[5].endswith("is not for you") and texts[4] == LONG


def test_packing_holds_every_token(results):
    pieces = results["packing"].collect()
    assert {r.doc_id for r in pieces} == {1, 2, 3, 4, 5, None} and all(0 <= r.offset and r.offset + r.length <= 4096 for r in pieces)
    assert sum(r.length for r in pieces if r.doc_id in (2, 3)) == 2


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_no_rows(spark, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame([], COLUMNS), "").count() == 0


def test_only_the_span_of_a_finding_changes(spark):
    cases = [
        ("the password: 1 was tried 11 times in 2011 with 1 user", "the password: [secret] was tried 11 times in 2011 with 1 user"),
        (" \n bearer A1 class A1 road A10\n\n", " \n bearer [secret] class A1 road A10\n\n"),
        ("password=hunter2 and hunter2\n x", "password=[secret] and hunter2\n x"),
        ("token = 2024 in the year 2024", "token = [secret] in the year 2024"),
        ('see (secret="Ab1!x#9qZ"). end  ', 'see (secret="[secret]"). end  '),
        ("ghp_abcdefghijklmnop123456,ghp_abcdefghijklmnop123456 x", "[secret],[secret] x"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, (t, _) in enumerate(cases)], COLUMNS)
    texts = {r.doc_id: r.text for r in corpus_pipeline.scan_secrets(spark, docs, "").collect()}
    assert [texts[i] for i in range(len(cases))] == [t for _, t in cases]
