"""Toxic terms that few sampled texts have, few labels, and labels of other documents."""

import numpy as np
from pyspark.sql import functions as F

from anchorline.llm import toxicity

WORDS = ["".join(chr(97 + c) for c in np.random.default_rng(k).integers(0, 26, 5)) for k in range(400)]
SCHEMA = "doc_id long, text string"
LABELS = "doc_id long, toxic int"


def text(k, *more):
    return " ".join([*np.random.default_rng(k).choice(WORDS, 40), *more])


def scores(spark, rows, labels):
    return {r["doc_id"]: r for r in toxicity.toxicity(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()}


def test_a_term_of_few_toxic_texts_counts(spark):
    # 25 toxic texts of 500 have only the rare term, less than z = 6 asks for.
    rows = [(k, text(k, *([] if k % 2 else ["qqvilex"] if k % 40 == 0 else ["zzcommon"]))) for k in range(1000)]
    got = scores(spark, [*rows, *[(5000 + k, text(5000 + k, "qqvilex")) for k in range(20)], *[(6000 + k, text(6000 + k)) for k in range(20)]], [(k, 1 - k % 2) for k, _ in rows])
    assert all(got[5000 + k]["predicted"] == 1 for k in range(20))
    assert not any(got[6000 + k]["predicted"] for k in range(20))


def test_few_labels_tell_texts_apart(spark):
    rows = [(k, text(k, *(["zzcommon"] if k % 2 else []))) for k in range(24)]
    got = scores(spark, [*rows, (100, text(100, "zzcommon")), (101, text(100))], [(k, k % 2) for k, _ in rows])
    assert got[100]["score"] > got[101]["score"]


def test_labels_of_other_documents_take_no_place_in_the_sample(spark):
    rows = [(k, text(k, *(["zzcommon"] if k % 2 else []))) for k in range(100)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    few, all_of_them = (toxicity.fit(docs, t, 30) for t in (labels.filter("doc_id < 100"), labels))
    assert few.bias == all_of_them.bias and (few.kept == all_of_them.kept).all() and (few.weights == all_of_them.weights).all() and few.weights.any()
