"""Operators against plain versions of themselves: the pattern graph, the toxicity score, links of all pairs, salted joins."""

import collections
import math

import numpy as np
import pytest

from anchorline.llm import decontaminate, jaccard_join, pii, shared, toxicity
from anchorline.llm.shared import workspace

DOCS = "doc_id long, text string"


def pii_rows():
    rows = [(k, f"send it to contact u{k}@host{k % 7}.com now please") for k in range(40)]
    rows += [(100 + k, f"send it to contact user{k}[at]host now please") for k in range(5)]
    rows += [(200 + k, f'config token = "{k:040x}" here') for k in range(10, 30)]
    rows += [(300, 'config token = "ghp_abc123def456" here'), (301, f"a digest {7:040x} alone"), (302, "numbers 12345 and 99-88-77 and id_4")]
    return rows


def plain_rounds(seen, rounds):
    """The rounds by their definition, over dictionaries."""
    edges = {(p, r["instance"]) for r in seen for p in r["patterns"]}
    seeds = {(r["instance"], r["kind"]) for r in seen if r["kind"]}
    n = collections.Counter(p for p, _ in edges)
    known, found = {(i, k): 1.0 for i, k in seeds}, {}
    for _ in range(rounds):
        hits = collections.Counter()
        for p, i in edges:
            for (j, k), c in known.items():
                if i == j:
                    hits[p, k] += c
        score = {(p, k): c / n[p] for (p, k), c in hits.items() if n[p] >= pii.LEAST_KNOWN and c >= pii.LEAST_KNOWN and c / n[p] >= pii.PATTERN_CONFIDENCE}
        doubt = collections.Counter()
        for p, i in edges:
            for (q, k), s in score.items():
                if p == q:
                    doubt[i, k] += math.log(max(1 - s, 0.05))
        best = {}
        for (i, k), x in doubt.items():
            best[i] = max(best.get(i, (-1, "")), (1 - math.exp(x), k))
        found = {i: (k, c) for i, (c, k) in best.items() if c >= pii.INSTANCE_CONFIDENCE and not any(j == i and kind != pii.SECRET for j, kind in seeds)}
        known = {(i, k): 1.0 for i, k in seeds} | {(i, k): c for i, (k, c) in found.items() if not any(j == i for j, _ in seeds)}
    return found


def test_pattern_graph(spark):
    seen = pii.occurrences(spark.createDataFrame(pii_rows(), DOCS)).cache()
    got = {r["instance"]: (r["kind"], r["confidence"]) for r in pii.discover(seen, workspace(spark, "test"), 3).collect()}
    expected = plain_rounds(seen.collect(), 3)
    assert got.keys() == expected.keys() and {k for k, _ in got.values()} == {"email", "secret"}
    for i, (kind, confidence) in expected.items():
        assert got[i][0] == kind and got[i][1] == pytest.approx(confidence)


def test_secrets_are_found_in_their_contexts_alone(spark):
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(pii_rows(), DOCS)).collect()}
    assert all(got[200 + k]["secrets"] == "secret:16:56" and got[200 + k]["spans"] == "" for k in range(10, 30))
    assert got[300]["secrets"] == "secret:16:32" and got[301]["secrets"] == "" and got[302]["secrets"] == ""
    # Addresses that no base pattern finds are added to the kind that their context tells.
    assert all(got[100 + k]["spans"].startswith("email:19:") and got[100 + k]["n_email"] == 0 for k in range(5))


def test_phones_and_cards_that_the_patterns_miss(spark):
    rows = [(k, f"for a table call me on +49 30 {k:07d}1 before noon") for k in range(30)] + [(100 + k, f"for a table call me on 030/{k:07d} before noon") for k in range(6)]
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[k]["n_phone"] == 1 for k in range(30))
    assert all(got[100 + k]["spans"] == "phone:23:34" and got[100 + k]["n_phone"] == 0 for k in range(6))


def test_toxicity_scores_one_by_one(spark):
    rng = np.random.default_rng(0)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(200)]
    rows = [(k, " ".join([*rng.choice(words, 30), *(["vile"] * (1 + k % 3) if k % 2 else [])])) for k in range(200)]
    rows += [(1000, None), (1001, ""), (1002, "ab"), (1003, "vile " * 3000)]
    docs = spark.createDataFrame(rows, DOCS)
    model = toxicity.fit(docs, spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int"))
    kept = dict(zip(model.kept.tolist(), zip(model.ratios.tolist(), model.weights.tolist(), strict=True), strict=True))
    odd, top = int(toxicity._ODD), 2**64
    for r in toxicity.score_texts(docs, model).collect():
        text = (r["text"] or "").lower()
        n = collections.Counter()
        for size in toxicity.SIZES:
            for i in range(len(text) - size + 1):
                h = (ord(text[i]) + 1) * odd % top
                for c in text[i + 1 : i + size]:
                    h = (h + ord(c) + 1) * odd % top
                at = ((h ^ (h >> 29)) * odd % top) >> (64 - toxicity.BITS)
                if at in kept:
                    n[at] += 1
        v = {at: kept[at][0] * (1 + math.log(k)) for at, k in n.items()}
        norm = max(1e-9, math.sqrt(sum(x * x for x in v.values())))
        z = model.bias + sum(kept[at][1] * x / norm for at, x in v.items())
        assert r["toxicity"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-3)


def test_links_of_all_pairs(spark):
    """Every link of the small tables' documents, found by comparing all pairs that share a shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    hashed = docs.select("doc_id", jaccard_join.word_hashes(docs["text"]).alias("w")).collect()
    sets = {r["doc_id"]: set(jaccard_join.shingles(np.array(r["w"], np.int64)).tolist()) for r in hashed if r["w"]}
    holders = collections.defaultdict(list)
    for k, s in sets.items():
        for x in s:
            holders[x].append(k)
    shared_by = collections.Counter((a, b) for held in holders.values() for i, a in enumerate(held) for b in held[i + 1 :])
    links = collections.Counter()
    for (a, b), n in shared_by.items():
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_classes(docs).collect()}
    found = {k: got[k]["n_links"] for k in sets}
    assert all(found[k] <= links[k] for k in sets)
    assert sum(found.values()) >= 0.995 * sum(links.values()) > 0


def test_salted_joins_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in range(300)]
    draw = lambda n: " ".join(rng.choice(words, n))
    items = [(k, draw(15)) for k in range(6)] + [(9, "lone wolf")]
    docs = spark.createDataFrame([(k, f"{draw(40)} {items[k % 7][1]} {draw(10)}") for k in range(30)] + pii_rows(), DOCS)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    jobs = [lambda: rows(decontaminate.contamination(docs, benchmark)), lambda: rows(pii.personal_data(docs)), lambda: rows(jaccard_join.jaccard_classes(docs))]
    before = [job() for job in jobs]
    for module in (decontaminate, pii, jaccard_join):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(shared, "SALTS", 3)
    assert [job() for job in jobs] == before
