"""The pipeline: every stage's decisions hold on its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from wayfold.llm import language, ngram_join, secrets
from wayfold.llm.common import stage

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, function in corpus_pipeline.STAGES:
        before = docs
        docs = stage(function(spark, docs, SF), f"test-{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            assert docs.where(F.length(F.coalesce("text", F.lit(""))) != F.col("n_chars")).isEmpty() or name == "language_id" or name == "ngram_join"
            assert docs.join(before, "doc_id", "left_anti").isEmpty()
        seen[name] = (before, docs)
    before, after = seen["language_id"]
    assert after.count() == language.language_of_documents(before).where("kept").count()
    before, after = seen["ngram_join"]
    kept = {r.doc_id for r in after.collect()}
    assert kept == {r.component_id for r in ngram_join.ngram_join(before, 5, 80).collect()}
    before, after = seen["secret_scan"]
    assert after.count() == before.count() and secrets.scan(after).where("is_secret").isEmpty()
    before, after = seen["packing"]
    assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == {r.doc_id for r in before.collect()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length").collect())) == sorted(map(tuple, after.select("doc_id", "piece", "length").collect()))
