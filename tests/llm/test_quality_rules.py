"""Quality rules: figures against plain counting, expectation-maximisation against a plain version, and planted junk."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorline.llm import quality_rules as Q

SCHEMA = "doc_id long, text string"
PROSE = "The old house by the sea had a garden. It was full of trees and birds.\nNobody came to see it, but on some days a cat slept in the sun. "


def plain_figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit)}


TEXTS = [None, "", "  \t\n ", "one", "a b c a b c", "x x x x", "# * $ % & | < >", "l 1\nl 1\n\nl 1 \n l 1\n", "é ü \x1c nbsp is no space", "😀 😀 😀 😀", "the\x0bend\x0cof\rit", "w " * 50_000, PROSE * 300, " ".join(f"v{k}" for k in range(60))]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in ("votes", "n_words", "base_failed", "p_good", "kept", "n_chars")})


def test_figures_equal_plain_counting(spark, sf_dir):
    texts = TEXTS + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = [(None if k == 3 else k // 2, t) for k, t in enumerate(texts)]
    got = Counter((r["doc_id"], *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), r["base_failed"]) for r in Q.quality_rules(table(spark, rows)).collect())
    expected = Counter()
    for doc_id, text in rows:
        f = plain_figures(text)
        expected[doc_id, *f.values(), f["n_words"] < 50 or 100 * f["n_repeat_words"] > 50 * f["n_words"]] += 1
    assert got == expected


def test_windows_of_batched_texts_stay_apart():
    import pyarrow as pa

    words = pa.array("a b c a b c x a b c d a b c".split())
    assert Q.repeated_words(words, np.array([0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2, 2, 2, 2]), 4).tolist() == [0, 0, 6, 0]
    assert Q.repeated_words(pa.array([], pa.string()), np.zeros(0, np.int64), 2).tolist() == [0, 0]


def plain_em(votes, times):
    """The same model over dictionaries, a document at a time."""
    docs = [v for v, n in zip(votes, times, strict=True) for _ in range(int(n))]
    p = [0.9 if v.count(1) >= v.count(0) else 0.1 for v in docs]
    for _ in range(Q.SWEEPS):
        chance, n = {}, len(docs)
        for j in range(len(votes[0])):
            for y in (0, 1):
                w = [x if y else 1 - x for x in p]
                told = [1 + sum(a for a, v in zip(w, docs, strict=True) if v[j] == k) for k in range(3)]
                for k in range(3):
                    chance[j, y, k] = told[k] / sum(told)
        prior = (sum(p) + 1) / (n + 2)
        new = []
        for v in docs:
            a = math.log(1 - prior) + sum(math.log(chance[j, 0, k]) for j, k in enumerate(v))
            b = math.log(prior) + sum(math.log(chance[j, 1, k]) for j, k in enumerate(v))
            new.append(1 / (1 + math.exp(min(500, max(-500, a - b)))))
        moved, p = max(abs(x - y) for x, y in zip(p, new, strict=True)), new
        if moved < Q.TOLERANCE:
            break
    return dict(zip(docs, p, strict=True))


def test_expectation_maximisation_equals_the_plain_version():
    rng = np.random.default_rng(4)
    truth = rng.random(300) < 0.7
    accuracy = [0.95, 0.8, 0.7, 0.6]
    docs = [tuple(2 if rng.random() < 0.3 else int(t if rng.random() < a else not t) for a in accuracy) for t in truth]
    patterns = sorted(set(docs))
    times = [docs.count(v) for v in patterns]
    chances, prior, p = Q.expectation_maximisation(np.array(patterns), np.array(times, float))
    expected = plain_em(patterns, times)
    assert p == pytest.approx([expected[v] for v in patterns], abs=1e-6)
    of = dict(zip(patterns, p, strict=True))
    assert 0.5 < prior < 0.9 and np.mean([(of[v] >= 0.5) == t for v, t in zip(docs, truth, strict=True)]) > 0.85
    assert Q.accuracies(chances).mean(1) == pytest.approx(accuracy, abs=0.12)


def test_junk_goes_and_clean_stays(spark):
    rng = np.random.default_rng(6)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(500)]
    prose = lambda: " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(rng.choice(words, 120))) + "."
    rows = [(k, prose()) for k in range(200)]
    rows += [(1000 + k, " | ".join(rng.choice(words, 100))) for k in range(10)] + [(2000 + k, "!! ".join(w.upper() for w in rng.choice(words, 100))) for k in range(10)]
    rows += [(3000, "a few words"), (3001, "again and again " * 40), (3002, None)]
    kept = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in Q.quality_rules(table(spark, rows)).collect()}
    assert all(kept[k] == (False, True) for k in range(200)) and all(not kept[k][1] for k in kept if k >= 1000)
    assert all(kept[k][0] for k in (3000, 3001, 3002)) and not kept[1000][0]


def test_junk_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(labels[r["doc_id"]], r["kept"], r["base_failed"]) for r in Q.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r["doc_id"] in labels]
    assert np.mean([not k for q, k, _ in judged if q == 0]) > 0.95 and np.mean([k for q, k, b in judged if q == 1 and not b]) > 0.99


def test_empty_table(spark):
    assert Q.quality_rules(table(spark, [])).count() == 0
