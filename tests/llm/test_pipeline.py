"""The pipeline on the smallest tables: each stage's decisions, and the whole run."""

import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from tapeline.llm import langid, minhash


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, sf).cache()
        seen[name] = (before, docs)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
    before, after = seen["language_id"]
    assert after.count() == langid.identify_documents(before).where("kept").count()
    before, after = seen["minhash_dedup"]
    assert sorted(r[0] for r in after.select("doc_id").collect()) == sorted(r[0] for r in minhash.near_duplicates(before).where("kept").select("doc_id").collect())
    before, after = seen["pii"]
    assert after.count() == before.count() and after.where(F.contains("text", F.lit("@mail"))).count() == 0
    _, after = seen["source_mixing"]
    assert after.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 2
    before, after = seen["byte_bpe"]
    assert after.count() == before.count() and after.where("not round_trip").count() == 0
    r = after.orderBy("doc_id").first()
    assert r["n_tokens"] == len(r["token_ids"]) and len(r["ids_sha256"]) == len(hashlib.sha256().hexdigest())


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two three four five six seven", "en", "a", 33), (3, "one two three four five six seven", "en", "a", 33), (None, "some other words that stand here for a text", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        now = table
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, "")
        assert now.count() >= 0


def test_stages_bound_what_is_read_at_once(spark, sf):
    name = "spark.sql.parquet.columnarReaderBatchSize"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(5)
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset(name)
        stage(spark, docs, sf)
        assert int(spark.conf.get(name)) <= 512
