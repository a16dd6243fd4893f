"""Identifiers that the base patterns miss, of other shapes than long numbers."""

import pytest
from pyspark.sql import functions as F

from anchorline.llm import pii

MISSED = ["user[at]host.com", "user(at)host", "user@localhost", "jo (at) host (dot) org", "jo at host dot org", "jo.van_dam-x", "id42"]


def docs(spark):
    emails = [(k, f"filler text mailto e-mail u{chr(97 + k % 26)}{chr(97 + k // 26)}@host.com end") for k in range(60)]
    ips = [(100 + k, f"words host-address {a} end") for k, a in enumerate(["8.8.8.8", "1.1.1.1", "9.9.9.9", "4.4.4.4", "7.7.7.7", "2.2.2.2"])]
    missed = [(200 + k, f"filler text mailto e-mail {m} end") for k, m in enumerate(MISSED)]
    return spark.createDataFrame([*emails, *ips, *missed, (300, "a well-known part-time thing of 42 and some.thing else"), (301, "words host-address db.local end")], "doc_id long, text string")


@pytest.fixture(scope="module")
def spans(spark):
    rows = pii.with_spans(docs(spark)).select("doc_id", "text", F.filter("spans", lambda s: ~s["base"]).alias("new")).collect()
    return {r["doc_id"]: [(s["kind"], r["text"][s["start"] : s["end"]]) for s in r["new"]] for r in rows}


def test_confident_contexts_add_identifiers_of_any_shape(spans):
    for k, m in enumerate(MISSED):
        assert [(kind, x.rstrip(")")) for kind, x in spans[200 + k]] == [("email", m.rstrip(")"))]


def test_short_ips_seed(spans):
    assert spans[301] == [("ip", "db.local")]


def test_words_without_a_context_are_left(spans):
    assert spans[300] == [] and not any(spans[k] for k in range(60))
