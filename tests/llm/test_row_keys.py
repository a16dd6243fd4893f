"""Rows whose doc_id is null or repeats: decisions go by doc_id and text."""

import corpus_pipeline
import numpy as np

from anchorline.llm import jaccard_join

WORDS = ["".join(chr(97 + c) for c in np.random.default_rng(k).integers(0, 26, 6)) for k in range(400)]
A, B, C, D, E = (" ".join(WORDS[k : k + 60]) for k in range(0, 300, 60))
NEAR_B = B.replace(WORDS[119], "other")
SCHEMA = "doc_id long, text string, mark string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(k, t, "own", len(t)) for k, t in rows], SCHEMA)


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_near_duplicates_of_ids_that_repeat_or_lack(spark, sf_dir):
    rows = [(1, A), (1, B), (2, NEAR_B), (None, C), (None, C), (None, D), (3, D), (4, E), (4, E)]
    kept = corpus_pipeline.near_duplicates(spark, docs(spark, rows), sf_dir)
    assert kept.columns == ["doc_id", "text", "mark", "n_chars"]
    assert texts(kept) == texts(docs(spark, [(1, A), (1, B), (None, C), (3, D), (4, E)]))


def test_classes_of_one_least_doc_id(spark):
    rows = [(1, A), (1, B), (2, NEAR_B), (3, A)]
    got = sorted(tuple(r) for r in jaccard_join.jaccard_classes(docs(spark, rows)).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_decontamination_by_row(spark, tmp_path):
    spark.createDataFrame([(1, A)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, A), (1, B), (None, A), (None, C), (2, D)]
    kept = corpus_pipeline.decontamination(spark, docs(spark, rows), str(tmp_path))
    assert texts(kept) == texts(docs(spark, [(1, B), (None, C), (2, D)]))
