"""Source divergence against plain counting."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorline.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, least_docs, top):
    counts, docs, in_lang = defaultdict(Counter), defaultdict(Counter), Counter()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= least_docs)
        sources = sorted(s for g, s in counts if g == lang)
        in_lang = Counter()
        for s in sources:
            in_lang.update(counts[lang, s])
        share = lambda n, of: {t: 1 + 10**9 * (n[t] + 2) // (of + 2 * len(kept)) for t in kept}
        p = {s: share(counts[lang, s], sum(counts[lang, s][t] for t in kept)) for s in sources}
        q = share(in_lang, sum(in_lang[t] for t in kept))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = defaultdict(list)
        for a, b in permutations(sources, 2):
            pairs[a].append((-sum(f(p[a][t], p[b][t]) for t in kept), b.encode()))
        for s in sources:
            out += [(lang, s, "pair", item.decode(), -v, k) for k, (v, item) in enumerate(sorted(pairs[s]), 1)]
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", item.decode(), -v, k) for k, (v, item) in enumerate(terms[:top], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in ("term", "n", "total", "terms", "item", "rank", "k")})


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    words = ["The", "the", "Élan", "élan", "straße", "a1b", "x_y", "İ", "😀", *[f"w{chr(97 + k)}" for k in range(20)]]
    rows = [(k, " ".join(rng.choice(words, rng.integers(1, 30))), ("en", "de", None)[k % 3], ("a", "b", "ü", None)[rng.integers(4)]) for k in range(90)]
    rows += [(200, None, "en", "silent"), (201, "", "fr", "a"), (202, "12 34", "fr", "b"), (203, "Seul", "it", "one"), (203, "Seul", "it", "one"), (None, "the " * 20_000, "en", "a")]
    return rows


@pytest.mark.parametrize(("least", "top"), [(10, 10), (1, 3), (1000, 10)])
def test_divergence_equals_plain_counting(spark, rows, least, top):
    assert got(divergence.source_divergence(table(spark, rows), least, top)) == plain(rows, least, top)


def test_groups_beyond_the_broadcast(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    assert got(divergence.source_divergence(table(spark, rows))) == plain(rows, 10, 10)


def test_empty_table(spark):
    assert got(divergence.source_divergence(table(spark, []))) == []


def test_shares_of_huge_counts_are_exact(spark):
    n, total, terms = 10**13 + 7, 3 * 10**14 + 1, 12345
    df = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long")
    r = df.select(divergence.billionths(F.col("n"), F.col("total"), F.col("terms")).alias("p")).first()
    assert r["p"] == 1 + 10**9 * (n + 2) // (total + 2 * terms)
