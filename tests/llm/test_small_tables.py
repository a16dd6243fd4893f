"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows, no rows, clashing columns."""

import base64
import collections
import hashlib
import io
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from anchorline.llm import decontaminate, fingerprint, jaccard_join, kneser_ney, packing, pii, token_files, tokens, toxicity, url_filter, warc
from anchorline.llm.queries import TOKENIZER

LONG = "alpha beta gamma delta " * 20_000
TEXTS = [(1, "Hello, world! It's 12 o'clock."), (2, None), (3, ""), (4, "Ünïcödé ΣΊΣΥΦΟΣ İstanbul e\u0301 <|endoftext|> x"), (5, LONG), (5, "twice"), (5, "twice"), (7, "\x00\x1f tab\tand\u00a0nbsp 😀"), (8, " ")]
DOCS = "doc_id long, text string"


def docs(spark, rows=TEXTS, extra=True):
    df = spark.createDataFrame(rows, DOCS)
    # Columns whose names the operators use themselves.
    return df.withColumns({n: F.lit("x") for n in ("mark", "row", "part", "key", "start", "words", "hash_a", "lang")}) if extra else df


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library(tokenizer, sf_dir, spark):
    import pyarrow as pa

    texts = [t for _, t in TEXTS] + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    ids, bounds = tokens.encoder(TOKENIZER)(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 239, 240, 241, 1000])
@pytest.mark.parametrize("most", [1, 2, 50, 5000, 49407, 1 << 29, 1 << 40, 1 << 60])
def test_simple8b_round_trip(n, most):
    ids = np.random.default_rng(n).integers(0, most, n).astype(np.uint64)
    words, per_block = token_files.pack_blocks(ids)
    assert (token_files.unpack_blocks(words, per_block, n) == ids).all()


def test_token_files(spark, tokenizer):
    got = [tuple(r) for r in token_files.token_id_files(docs(spark), TOKENIZER).collect()]
    expected, start = [], 0
    for key, text in sorted(TEXTS, key=lambda r: (r[0], r[1] or "")):
        ids = ids_of(tokenizer, text)
        expected.append((key, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == expected
    assert token_files.token_id_files(docs(spark, []), TOKENIZER).count() == 0


def test_packing_is_whole_and_without_padding(spark, tokenizer):
    pieces = packing.pack_documents(docs(spark).repartition(2), TOKENIZER).collect()
    held = collections.Counter()
    for r in pieces:
        held[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert sum(held.values()) == sum(len(ids_of(tokenizer, t)) for _, t in TEXTS)
    sequences = collections.defaultdict(list)
    for r in pieces:
        sequences[r["sequence_id"]].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and at & (at - 1) == 0
    by_doc = {k: ids_of(tokenizer, t) for k, t in TEXTS if k != 5}
    for r in pieces:
        if r["doc_id"] != 5:
            assert r["ids_crc32"] == crc(by_doc[r["doc_id"]][r["start"] : r["start"] + r["length"]])
    assert packing.pack_documents(docs(spark, []), TOKENIZER).count() == 0


def test_packing_balances_cost():
    lengths = [4096, 2000, 2000, 1000, 1000, 1096, 1096]
    out = packing.pack_group(lengths, [4096] * 3)
    assert [sum(n for _, _, n in s) for s in out] == [4096] * 3
    assert [n for _, _, n in out[0]] == [4096]
    costs = [sum(packing.cost(n) for _, _, n in s) for s in out]
    assert max(costs[1:]) / min(costs[1:]) < 1.05


PAGES = [(1, "http://a/", "x"), (2, "http://b/\r\nEvil: 1", "x"), (3, None, None), (4, "http://c/", ""), (5, "u", "é" * 300_000), (6, "v", "only"), (6, "v", "only"), (None, "w", "x")]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"sha1": F.lit(1), "salt": F.lit(2)})
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["verified"]) for r in warc.warc_round_trip(pages).collect())
    same = collections.defaultdict(list)
    for k, _, h in PAGES:
        same[h or ""].append(k)
    expected = []
    for k, _, h in PAGES:
        b = (h or "").encode()
        top = max(x for x in same[h or ""] if x is not None)
        refers = top if k is not None and k != top else None
        expected.append((k or 0, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if refers else "response", refers, True))
    assert got == sorted(expected)
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_warc_reader_finds_faults():
    good = warc.member(1, "http://a/", b"payload", None)
    assert [r.payload for r in warc.records(io.BytesIO(good + warc.member(2, None, b"", None)), True)] == [b"payload", b""]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(good[:-12])))
    raw = zlib.decompress(good, 31)
    for changed, fault in ((raw.replace(b"payload", b"Payload"), False), (raw.replace(b"payload\r\n", b"payloads\r\n"), True)):
        c = zlib.compressobj(wbits=31)
        data = io.BytesIO(c.compress(changed) + c.flush())
        if fault:
            with pytest.raises(ValueError):
                list(warc.records(data))
        else:
            assert [r.verified for r in warc.records(data)] == [False]


def base_spans(text):
    """The base kinds by the patterns as they are given."""
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            twice = [int(x) * (1 + i % 2) for i, x in enumerate(reversed(digits))]
            return 16 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in twice) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in kinds.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


PII = [(1, "😀 a.b@c.d-e.f, a@b.c_d@e.fg x@y"), (2, "1.2.3.4.5 256.1.1.1 0001.2.3.04"), (3, "4111 1111 1111 1111 4111-1111-1111-1112 " + "1" * 30), (4, "+1 (487) 555-7209 +12 +1234567890123456"), (5, None), (6, ""), (7, " ".join(f"1.1.1.{i % 256}" for i in range(700))), (8, "a" * 50_000 + "1" * 50_000), (9, "1 " * 20_000), (1, "other"), (1, "other")]


def test_personal_data(spark):
    got = pii.personal_data(docs(spark, PII, False)).collect()
    expected = collections.Counter()
    for k, t in PII:
        s = base_spans(t)
        expected[(k, *[sum(x[0] == kind for x in s) for kind in pii.KINDS], hashlib.sha256(",".join("%s:%d:%d" % x for x in s).encode()).hexdigest())] += 1
    assert collections.Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == expected
    assert pii.personal_data(docs(spark, [], False)).count() == 0


def test_patterns_find_unseen_identifiers(spark):
    known = [(i, f"please dial hotline +1 (200) 555-{1000 + i} today") for i in range(40)]
    rest = known + [(100, "please dial hotline 0044-7777-1 today"), (101, "number 0044-7777-2 is a part")]
    spans = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs(spark, rest, False)).collect()}
    assert spans[100] == "phone:20:31"
    assert spans[101] == ""
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(docs(spark, [*rest, (102, "a@b.cd 1.2.3.4")], False)).collect()}
    assert redacted[100] == "please dial hotline <PHONE> today"
    assert redacted[102] == "<EMAIL> <IP>"
    assert redacted[101] == rest[41][1]


def windows_hit(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for key, item in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), item or ""))
        n = min(10, len(w))
        mine = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in mine:
                hit |= set(range(i, i + n))
                found.add(str(key))
    return len(words), len(hit), sorted(found)


def test_decontamination(spark):
    rng = np.random.default_rng(0)
    vocabulary = ["Ab", "É", "x1", "the", "zoo", "öl", "k9"]
    draw = lambda n: " ".join(vocabulary[i] for i in rng.integers(0, len(vocabulary), n))
    items = [(i, draw(int(rng.integers(11, 30)))) for i in range(10)] + [(20, "lone"), (21, "Three Words; here"), (22, None), (23, "..."), (2, "again and again and again and again and again and again")]
    texts = [(i, draw(200) + " " + items[i % 10][1] + ", " + draw(50)) for i in range(30)] + [(50, None), (51, ""), (52, "a lone wolf"), (53, "three   words--HERE three words here"), (50, "lone"), (50, "lone"), (54, "again and again and again and again and again and again and again")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.contamination(docs(spark, texts), benchmark).collect())
    expected = collections.Counter()
    for k, t in texts:
        n, hit, found = windows_hit(t, items)
        expected[k, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0] += 1
    assert got == expected
    assert decontaminate.contamination(docs(spark, []), benchmark).count() == 0
    assert decontaminate.contamination(docs(spark, texts), benchmark.limit(0)).filter("contaminated").count() == 0


def plain_mix(x):
    for _ in range(2):
        x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 % 2**64
    return x ^ (x >> 32)


def plain_fingerprint(text, k=12, bins=64, take=2):
    """Order MinHash one k-mer after another: number, hash, part into ranges, take the least of each in the text's order."""
    odd = 0x9E3779B97F4A7C15
    k = min(k, len(text))
    seen, items = collections.Counter(), []
    for place in range(len(text) - k + 1 if text else 0):
        h = 0
        for c in text[place : place + k]:
            h = (h * odd + ord(c) + 1) % 2**64
        kmer = plain_mix((h + k) % 2**64) >> 26
        items.append((plain_mix((kmer * odd + seen[kmer]) % 2**64) >> 26, place))
        seen[kmer] += 1
    out = []
    for b in range(bins):
        lo, hi = b * (2**38 // bins), (b + 1) * (2**38 // bins) if b + 1 < bins else 2**38
        chosen = sorted(sorted(x for x in items if lo <= x[0] < hi)[:take], key=lambda x: x[1])
        tuple_hash = 0
        for item, _ in chosen:
            tuple_hash = plain_mix((tuple_hash * odd + item + 1) % 2**64)
        out.append(max(1, tuple_hash >> 48) if chosen else 0)
    return out


def plain_likeness(a, b):
    used = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
    return sum(x == y for x, y in used) / len(used) if used else 1.0


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_fingerprints(spark, partitions):
    rows = [(3, "gamma delta " * 40), (1, "alpha beta gamma " * 30), (2, None), (9, "x"), (5, "a man a plan a canal " * 90), (5, "twice"), (5, "twice"), (None, "no id"), (None, "nor this"), (None, None), (4, "😀" * 13)]
    rows += [(7, f"row {i} of one id") for i in range(20)]
    got = collections.Counter(tuple(r) for r in fingerprint.fingerprint_edits(docs(spark, rows), partitions).collect())
    turn = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64 - 2**63
    order = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is None, r[0], turn(r[1])))
    expected = collections.Counter()
    for i, (k, t) in enumerate(order):
        cut = len(t) // 4
        following = order[(i + 1) % len(order)][1]
        edited = t[: len(t) - cut] + following[:cut]
        prints = [plain_fingerprint(x) for x in (t, edited, following)]
        texts = ["".join(f"{x:04x}" for x in p) for p in prints[:2]]
        expected[k, len(t), hashlib.sha256(edited.encode()).hexdigest(), *texts, plain_likeness(*prints[:2]), plain_likeness(prints[0], prints[2])] += 1
    assert got == expected


def test_fingerprints_of_no_rows_and_long_texts(spark):
    assert fingerprint.fingerprint_edits(docs(spark, [])).count() == 0
    one = fingerprint.fingerprint_edits(docs(spark, [(1, LONG)])).first()
    assert one["n_chars"] == len(LONG) and one["near_next"] == 1.0


def test_likeness_falls_with_edits_and_order():
    rng = np.random.default_rng(0)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(600)]
    text = " ".join(words)
    near = [fingerprint.likeness(*map(fingerprint.fingerprint, (text, text[: len(text) - cut] + "z" * cut))) for cut in (0, 40, 400, 2000)]
    assert near[0] == 1 and near == sorted(near, reverse=True) and near[1] > 0.8 > near[3]
    turned = " ".join(words[300:] + words[:300])
    assert fingerprint.likeness(fingerprint.fingerprint(text), fingerprint.fingerprint(turned)) < 0.8


def test_urls(spark):
    cases = {
        "http://net/": ("net", "/", "net/", "block"),
        "https://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "https://example.net/EN/": ("example.net", "/EN/", "net/", "block"),
        "https://notexample.com/de/": ("notexample.com", "/de/", None, None),
        "https://example.com/de/?x": ("example.com", "/de/", "example.com/de/", "block"),
        "x://a.org/fr/1": ("a.org", "/fr/1", "org/fr/", "allow"),
        "https://b.net?x=http://c.org/fr/": ("b.net", "", None, None),
        "no scheme": ("", "", None, None),
        None: ("", "", None, None),
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages).collect()}
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))
    judged = {u: v for u, v in url_filter.judge_urls(spark.createDataFrame([(1, "https://ads-track.example.com/fr/9"), (2, "https://m.library.example.com/en/7")], "page_id long, url string")).select("page_id", "verdict").collect()}
    assert judged == {1: "block", 2: "allow"}


def test_url_model_on_unseen_words_and_families():
    table = url_filter.labelled_table()
    held = [r for r in table if url_filter.held_out(r)]
    seen = {r.word for r in table if not url_filter.held_out(r)}, {r.family for r in table if not url_filter.held_out(r)}
    by_word, by_family = [r for r in held if r.word not in seen[0] and r.family in seen[1]], [r for r in held if r.family not in seen[1]]
    assert len(by_word) > 1500 and len(by_family) > 1000 and len({r.word for r in by_word if r.label}) > 10
    for rows in (by_word, by_family):
        found = url_filter.shipped_model().scores(*zip(*[url_filter.split_url(r.url) for r in rows], strict=True)) >= 0.5
        label = np.array([r.label for r in rows], bool)
        assert (found & label).sum() / found.sum() >= 0.9
        assert (found & label).sum() / label.sum() >= 0.7


def plain_url_buckets(host, path):
    top, odd, out = 2**64, int(url_filter._ODD), set()
    for kind, t in ((0, f"^{host}$"), (1, f"^{path}$")):
        for n in (3, 4, 5):
            for j in range(len(t) - n + 1):
                h = ((ord(t[j]) + 1) * odd + kind) % top
                for c in t[j + 1 : j + n]:
                    h = (h + ord(c) + 1) * odd % top
                out.add(((h ^ (h >> 29)) * odd % top) >> (64 - url_filter.BITS))
    return out


def test_url_scores_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SLICE_CHARS", 300)
    urls = [r.url for r in url_filter.labelled_table(40)] + ["", "x://", None, "https://ü.de/\U0001f600", "https://a.com/" + "long/" * 20_000]
    urls += urls[:3]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"score": F.lit("x"), "rule": F.lit("x"), "verdict": F.lit("x")})
    got = {r["page_id"]: r["score"] for r in url_filter.judge_urls(pages).collect()}
    weights, bias = url_filter.shipped_model()
    for i, url in enumerate(urls):
        at = plain_url_buckets(*url_filter.split_url(url or ""))
        z = bias + sum(float(weights[k]) for k in at) / max(1, len(at)) ** 0.5
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_toxicity_learns_from_its_fold_alone(spark):
    rng = np.random.default_rng(0)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(400)]
    make = lambda bad: " ".join([*rng.choice(words, 60), *(["vilefool"] if bad else [])])
    rows = [(i, make(i % 3 == 0)) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0) if zlib.crc32(str(i).encode()) % 5 else 1) for i in range(600)] + [(None, 1), (3, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs(spark, [*rows, (1000, None), (1001, ""), (0, make(True))]), labels).collect()
    assert len(got) == 603
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == (r["doc_id"] < 600 and r["doc_id"] % 3 == 0), r
    assert toxicity.toxicity(docs(spark, []), labels).count() == 0
    assert toxicity.toxicity(docs(spark), labels.limit(0)).count() == len(TEXTS)


def brute_classes(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset([t or ""]))
    n = len(rows)
    near = [[i != j and (5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])) and bool(sets[i]) for j in range(n)] for i in range(n)]
    group = list(range(n))
    for _ in range(n):
        group = [min([group[i], *[group[j] for j in range(n) if near[i][j]]]) for i in range(n)]
    return collections.Counter((rows[i][0], min(rows[j][0] for j in range(n) if group[j] == group[i]), sum(near[i])) for i in range(n))


def test_jaccard_join(spark):
    rng = np.random.default_rng(0)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 4)) for _ in range(3000)]
    rows, key = [], 0
    for size in (1, 2, 3, 160):
        base = list(rng.choice(words, 120))
        for _ in range(size):
            copy = list(base)
            for at in rng.integers(0, 120, int(rng.integers(0, 4))):
                copy[at] = str(rng.choice(words))
            rows.append((key, " ".join(copy)))
            key += 1
    rows += [(key, rows[0][1].upper() + "!"), (key + 1, None), (key + 2, ""), (key + 3, "!!"), (key + 4, "one two"), (key + 5, "One, two"), (key + 6, " ".join(words))]
    got = collections.Counter(tuple(r) for r in jaccard_join.jaccard_classes(docs(spark, rows)).collect())
    assert got == brute_classes(rows)
    assert jaccard_join.jaccard_classes(docs(spark, [])).count() == 0
    alone = jaccard_join.jaccard_classes(docs(spark, [(None, "a b c d e f"), (1, "a b c d e f")])).collect()
    assert sorted(map(tuple, alone), key=repr) == sorted([(None, None, 0), (1, 1, 0)], key=repr)


def test_kneser_ney_sums_to_one_and_both_ways_agree(spark):
    text = "the cat sat on the mat and the dog sat on the log " * 20
    trusted = spark.createDataFrame([(text,)], "text string")
    counts = trusted.mapInArrow(kneser_ney.count_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    context = int.from_bytes(b" the", "big")
    needed = spark.createDataFrame([((context << 8) | b,) for b in range(256)] + [((int.from_bytes(b"\xff\xfe\xfd\xfc", "big") << 8) | b,) for b in range(256)], "gram long")
    from anchorline.llm.shared import workspace

    p = kneser_ney.probabilities(counts, needed, workspace(spark, "test"))
    sums = {r["c"]: r["s"] for r in p.groupBy(F.shiftright("gram", 8).alias("c")).agg(F.sum("p").alias("s")).collect()}
    assert list(sums.values()) == pytest.approx([1.0, 1.0])
    rows = spark.createDataFrame([(1, "en", False, "the cat"), (2, None, True, ""), (3, "de", False, "xyz " * 50), (3, "de", False, "xyz " * 50)], "doc_id long, lang string, held_out boolean, text string")
    wanted = rows.select("text").mapInArrow(kneser_ney.count_grams, "gram long, n long").select("gram").distinct()
    p = kneser_ney.probabilities(counts, wanted, workspace(spark, "test"))
    one, two = (sorted((r["doc_id"], r["n_bytes"], r["log_p"]) for r in f(rows, p).collect()) for f in (kneser_ney.by_broadcast, kneser_ney.by_join))
    assert [x[:2] for x in one] == [x[:2] for x in two]
    assert [x[2] for x in one] == pytest.approx([x[2] for x in two], rel=1e-12)
    plain = plain_kneser_ney([text.encode()])
    assert one[0][2] == pytest.approx(sum(np.log(plain(g)) for g in grams("the cat".encode())))


def grams(text, order=5):
    padded = bytes(order - 1) + text
    return [padded[i : i + order] for i in range(len(text))]


def plain_kneser_ney(texts, order=5):
    """Interpolated modified Kneser-Ney of bytes, by its definition and without joins."""
    counts = collections.Counter(g for t in texts for g in grams(t, order))
    levels = []
    for _ in range(order):
        levels.insert(0, counts)
        counts = collections.Counter(g[1:] for g in counts)
    steps = []
    for c in levels:
        n = collections.Counter(c.values())
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            two = 2 - 3 * y * n[3] / n[2]
            d = [1 - 2 * y * n[2] / n[1], two, 3 - 4 * y * n[4] / n[3] if n[3] else two]
            d = [min(max(x, 0.05), top) for x, top in zip(d, (0.95, 1.95, 2.95), strict=True)]
        else:
            d = [0.5, 0.75, 0.75]
        total, taken = collections.Counter(), collections.Counter()
        for g, k in c.items():
            total[g[:-1]] += k
            taken[g[:-1]] += d[min(k, 3) - 1]
        steps.append((c, d, total, taken))

    def p(gram):
        out = 1 / 256
        for n, (c, d, total, taken) in enumerate(steps, 1):
            g = gram[-n:]
            if total[g[:-1]]:
                out = (c[g] - d[min(c[g], 3) - 1] if c[g] else 0) / total[g[:-1]] + taken[g[:-1]] / total[g[:-1]] * out
        return out

    return p


def test_quality(spark):
    rng = np.random.default_rng(0)
    good = lambda: " ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat", "and", "dog"], 80))
    rows = [(i, good(), "en") for i in range(1000, 1400)] + [(100, "#$% @!^ " * 40, "en"), (101, None, "en"), (102, "", None), (103, good(), None)]
    labels = spark.createDataFrame([(i, 1) for i in range(1000, 1300)] + [(100, 0), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in kneser_ney.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("own", F.lit(1)), labels).collect()}
    assert len(got) == len(rows)
    # The quantile of 60 or so held-out texts; and of a language without trusted texts, that of all.
    assert np.mean([got[i]["keep"] for i in range(1000, 1400)]) > 0.9
    assert got[103]["threshold"] == pytest.approx(got[1000]["threshold"])
    assert not any(got[i]["keep"] for i in (100, 101, 102)) and got[101]["perplexity"] is None
    none = kneser_ney.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels.limit(0))
    assert none.filter("keep").count() == 402
    assert kneser_ney.quality(spark.createDataFrame([], "doc_id long, text string, lang string"), labels).count() == 0
