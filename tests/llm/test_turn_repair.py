"""Repair of conversations against a search through all edits; long conversations against short ones."""

import functools
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorline.llm import turn_repair as T

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        here = out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        here += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_repair(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    numbers = {t for t, *_ in rows if t is not None}
    initials = [role[:1] for _, role, _ in rows]

    @functools.cache
    def best(i, done, room):
        """Cheapest (cost, letters, repaired turns) from row i on, after roles ``done`` (at most the last and whether any)."""
        found = []
        if i == len(rows) and done in ("", "a"):
            found.append((0, "", ()))
        takes = {"": "su", "s": "u", "u": "a", "a": "u"}[done]
        if room:
            for r in takes.replace("s", ""):
                c, x, t = best(i, r, room - 1)
                found.append((c + 5, "I" + x, (f"{T.ROLES[r]}:", *t)))
        if i < len(rows):
            _, role, text = rows[i]
            c, x, t = best(i + 1, done, 3)
            found.append((c + 2, "D" + x, t))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                if initials[i] and initials[i] in takes:
                    c, x, t = best(i + 1, initials[i], 3)
                    found.append((c + more, "K" + x, (f"{role}:{text}", *t)))
                for r in takes.replace("s", ""):
                    c, x, t = best(i + 1, r, 3)
                    found.append((c + more + 1, "R" + x, (f"{T.ROLES[r]}:{text}", *t)))
        return min(found, default=(10**9, "", ()))

    cost, audit, turns = best(0, "", 3)
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
        **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(turns).encode()).hexdigest(),
    }, turns


def made_up():
    rng = np.random.default_rng(11)
    texts = ["", " \t", "One.", "Two", "Three!", "four? \n", "Ünï.", None, "a.b", "x" * 5000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "unknown"]
    rows = []
    for conv in range(300):
        n = int(rng.integers(1, 9))
        for k in range(n):
            turn = None if rng.random() < 0.05 else int(k + (rng.random() < 0.1) * rng.integers(0, 3))
            role = ("user", "assistant")[k % 2] if rng.random() < 0.6 else roles[rng.integers(len(roles))]
            rows.append((None if conv == 7 else conv, turn, role, texts[rng.integers(len(texts))]))
    return rows


@pytest.fixture(scope="module")
def rows():
    return made_up()


@pytest.fixture(scope="module")
def expected(rows):
    return {conv: plain_repair(held) for conv, held in plain_damage(rows).items()}


def table(spark, rows):
    # Columns whose names the operator uses itself.
    return spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in ("key", "fault", "copies", "mark", "part", "seq")})


def told(df):
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in df.collect()}


@pytest.mark.parametrize("bound", [T.LONG_ROWS, 4, 0])
def test_repair_equals_the_search(spark, rows, expected, bound):
    got = told(T.repaired(T.damaged(table(spark, rows)), long_rows=bound))
    assert got.keys() == expected.keys()
    for conv, (figures, _) in expected.items():
        assert got[conv] == figures, conv


@pytest.mark.parametrize("bound", [T.LONG_ROWS, 0])
def test_repaired_turns(spark, rows, expected, bound):
    got = defaultdict(dict)
    for r in T.repaired(T.damaged(table(spark, rows)), turns=True, long_rows=bound).collect():
        got[r["conv_id"]][r["place"]] = f"{r['role']}:{r['text']}"
    for conv, (_, turns) in expected.items():
        assert tuple(got[conv][k] for k in range(len(got[conv]))) == turns


def test_one_long_conversation_in_shares(spark):
    rng = np.random.default_rng(5)
    rows = [(1, int(k), ("user", "assistant", "system")[rng.integers(3)], f"text {rng.integers(50)}{'.' if rng.random() < 0.7 else ''}") for k in range(700)] + [(1, 3, "user", "copy.")] * 200
    whole = told(T.repaired(T.damaged(table(spark, rows))))
    shares = told(T.repaired(T.damaged(table(spark, rows).repartition(8)), long_rows=100))
    assert whole == shares and whole[1]["duplicate"] >= 199 and re.fullmatch("[DIKR]+", whole[1]["audit"])


def test_a_whole_conversation_stays(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello."), (2, 5, "assistant", "Alone.")]
    got = told(T.repaired(T.undamaged(table(spark, rows))))
    assert got[1]["audit"] == "KKK" and got[1]["cost"] == 0 and got[1]["repaired_sha256"] == hashlib.sha256(b"system:Be kind.\nuser:Hi!\nassistant:Hello.").hexdigest()
    assert got[2]["audit"] == "D" and got[2]["cost"] == 2


def test_empty_table_and_dropped_rows(spark):
    assert T.turn_repair(table(spark, [])).count() == 0
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = told(T.turn_repair(table(spark, [(conv, 0, "user", "Gone.")])))
    assert got[conv] == {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}


def test_query_on_the_tables(spark, sf_dir):
    from anchorline.llm.queries import op11_turn_repair

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = told(op11_turn_repair(spark, sf_dir))
    assert got == {conv: plain_repair(held)[0] for conv, held in plain_damage(rows).items()}
