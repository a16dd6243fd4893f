"""The pipeline's stages on the smallest tables: what they keep, and that each decision takes effect."""

import corpus_pipeline
import duckdb

from anchorline.llm import pii, queries
from anchorline.llm.queries import op3_toxicity, op4_jaccard_join, op6_decontamination
from anchorline.llm.shared import workspace, written


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    clean = written(corpus_pipeline.toxicity(spark, docs, sf_dir), workspace(spark, "test"))
    assert clean.columns == columns
    assert clean.count() == op3_toxicity(spark, sf_dir).filter("predicted = 0").count() <= n
    kept = written(corpus_pipeline.near_duplicates(spark, docs, sf_dir), workspace(spark, "test"))
    assert kept.columns == columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in op4_jaccard_join(spark, sf_dir).filter("doc_id = class_id").select("doc_id").collect()}
    assert {r[0] for r in corpus_pipeline.near_duplicates(spark, docs.unionByName(docs), sf_dir).select("doc_id").collect()} == {r[0] for r in kept.select("doc_id").collect()}
    left = corpus_pipeline.decontamination(spark, docs, sf_dir)
    assert left.columns == columns
    assert left.count() == op6_decontamination(spark, sf_dir).filter("not contaminated").count() < n
    redacted = corpus_pipeline.personal_data(spark, docs, sf_dir)
    assert redacted.columns == columns and redacted.count() == n
    assert pii.personal_data(redacted).filter("n_email + n_ip + n_card + n_phone > 0").count() == 0
    assert corpus_pipeline.packing(spark, docs.limit(0), sf_dir).count() == 0


def test_decontamination_matches_sql(spark, sf_dir):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    expected = sorted(tuple(r) for r in c.sql(f"select doc_id, n_words, n_hit, n_items, items_sha256, contaminated from ({queries.OP6_SQL})").fetchall())
    got = op6_decontamination(spark, sf_dir).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(tuple(r) for r in got.collect()) == expected
