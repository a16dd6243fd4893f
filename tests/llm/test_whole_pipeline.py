"""A run of all stages over planted documents, stages without rows, and columns whose names the operators use."""

import collections

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from anchorline.llm import pii
from anchorline.llm.queries import TOKENIZER

WORDS = ["".join(chr(97 + c) for c in np.random.default_rng(k).integers(0, 26, 6)) for k in range(900)]
PASSAGE = " ".join(WORDS[800:830])
CLASHES = "mark row toxicity spans email ip card phone base added path rep words hit_at key".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def text(k, n=80):
    return " ".join(np.random.default_rng(1000 + k).choice(WORDS[:700], n))


def planted():
    clean = {k: text(k) for k in range(150)}
    toxic = {1000 + k: text(1000 + k) + " vilefool scumbag" for k in range(60)}
    copies = {2000 + k: text(0).replace(text(0).split()[40], f"other{k}") for k in range(6)} | {2100: text(1), 2101: text(2).upper()}
    leaked = {3000: f"{text(3000)} {PASSAGE} {text(3001)}", 3001: PASSAGE}
    private = {4000: f"{text(4000)} mail a.b@c.de and 1.2.3.4", 4001: None, 4002: ""}
    return clean, toxic, copies, leaked, private


def rows_of(*parts):
    return [(k, t, "en", "s", len(t or ""), *["own"] * len(CLASHES)) for part in parts for k, t in part.items()]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    clean, toxic, *rest = planted()
    spark.createDataFrame(rows_of(clean, toxic, *rest), SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([*[(k, 1, 0) for k in clean], *[(k, 0, 1) for k in toxic]], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_run_keeps_the_clean_and_packs_all_of_it(spark, tables):
    clean, _, _, _, private = planted()
    # Of the near copies and the two equal rows without words the least doc_id stays.
    kept = {**clean, 4000: private[4000].replace("a.b@c.de", "<EMAIL>").replace("1.2.3.4", "<IP>"), 4001: ""}
    tokenizer, held = Tokenizer.from_file(TOKENIZER), collections.Counter()
    for r in corpus_pipeline.run(spark, tables).collect():
        held[r["doc_id"]] += r["length"]
        assert r["doc_tokens"] == len(tokenizer.encode(kept[r["doc_id"]], add_special_tokens=False).ids) + 1
    assert held == {k: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for k, t in kept.items()}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_without_rows_and_with_clashing_names(spark, tables, name, stage):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = stage(spark, docs.limit(0), tables)
    assert out.columns == docs.columns and out.count() == 0
    one_id = docs.filter("doc_id < 3 or doc_id = 4001").withColumn("doc_id", F.lit(7).cast("long"))
    got = stage(spark, one_id, tables)
    assert got.columns == docs.columns
    assert [r["mark"] for r in got.collect()] == ["own"] * 4


def test_redact_leaves_other_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").filter("doc_id >= 4000")
    got = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert got[4000]["text"].endswith("<EMAIL> and <IP>") and got[4001]["text"] is None and got[4002]["text"] == ""
    assert all(r[c] == "own" for r in got.values() for c in CLASHES)
    spans = {r["doc_id"]: r for r in pii.with_spans(docs).collect()}
    assert [s["kind"] for s in spans[4000]["spans"]] == ["email", "ip"] and spans[4000]["email"] == "own"
