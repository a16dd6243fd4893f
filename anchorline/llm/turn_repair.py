"""Conversation structure repair: the cheapest edits that give a conversation the roles ``(system? (user assistant)+)?``.

A dynamic programme over turns and states of the grammar gives, from the last turn back, the cost to go; a walk from the first
turn on then takes, among the transitions that meet that cost, the one whose letter is least.

Most conversations are short: one shuffle sorts their turns, and a task solves them as they pass. A conversation beyond
LONG_ROWS or LONG_BYTES is never held by one task. Its turns are sorted over all tasks; each task's share is summed up as
costs from each state to each state, the shares are chained, and each task walks its own share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import pairwise

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from anchorline.llm.shared import small_enough, spread_join, texts_of, workspace, written

# The costs of edits, what undeleted truncated turns add, and the pairs of initials that may be neighbours.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LEGAL = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}
#: States: nothing yet, after the system's, a user's and an assistant's turn; those in which a conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The initial that a new role has in each state, and the state after it.
WANTED = (("u", USER), ("u", USER), ("a", ASSISTANT), ("u", USER))
FAR = 1 << 50
SPACE = r"\x20\x09-\x0D"
#: A conversation with more turns, or more bytes of text, is solved in shares.
LONG_ROWS, LONG_BYTES = 5_000, 8 << 20
#: Long conversations up to which their names are broadcast.
BROADCAST_ROWS = 100_000
#: Conversations whose results are one Arrow batch.
BATCH = 500

#: A turn in short: its role's initial, its fault (b, d, t or none), and how many copies of it follow.
Turn = tuple[str, str, int]


def closed(cost: list[int]) -> list[int]:
    """Costs of the states with insertions before the next turn."""
    for _ in range(3):
        cost = [min(c, INSERT + cost[WANTED[x][1]]) for x, c in enumerate(cost)]
    return cost


def costs_to_go(turns: list[Turn], end: list[int]) -> list[list[int]]:
    """Before each turn and after the last, for each state, the least cost of what follows; ``end`` is that after the last."""
    out = [end]
    for initial, fault, copies in reversed(turns):
        after, more = out[-1], TRUNCATED if fault == "t" else 0
        cost = [DELETE + c for c in after]
        if fault not in ("b", "d"):
            for x in range(4):
                cost[x] = min(cost[x], more + REROLE + after[WANTED[x][1]])
                if (kept := AFTER.get((x, initial))) is not None:
                    cost[x] = min(cost[x], more + after[kept])
        out.append(closed([c + DELETE * copies for c in cost]))
    return out[::-1]


def the_end() -> list[int]:
    return closed([0 if x in ENDS else FAR for x in range(4)])


def walk(turns: list[Turn], cost: list[list[int]], state: int, last: bool = True) -> tuple[list[tuple[int, str, str | None]], int]:
    """Edits as (turn, letters, new role or None), and the state after them. Only the last share inserts after its last turn."""
    out: list[tuple[int, str, str | None]] = []
    for i, (initial, fault, copies) in enumerate(turns):
        more, extra, after = TRUNCATED if fault == "t" else 0, DELETE * copies, cost[i + 1]
        while True:
            here, (wanted, onward) = cost[i][state] - extra, WANTED[state]
            if here == DELETE + after[state]:
                out.append((i, "D" * (1 + copies), None))
                break
            if here == INSERT + cost[i][onward] - extra:
                out.append((i, "I", ROLES[wanted]))
                state = onward
                continue
            kept = AFTER.get((state, initial))
            if kept is not None and here == more + after[kept]:
                out.append((i, "K" + "D" * copies, None))
                state = kept
            else:
                out.append((i, "R" + "D" * copies, ROLES[wanted]))
                state = onward
            break
    while last and cost[-1][state]:
        out.append((len(turns), "I", ROLES[WANTED[state][0]]))
        state = WANTED[state][1]
    return out, state


def illegal_pairs(turns: list[Turn]) -> int:
    return sum(c for _, _, c in turns) + sum(a[0] + b[0] not in LEGAL for a, b in pairwise(turns))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of every row, in bad repair: by the crc32 of ``conv_id:turn``, modulo 20, it is dropped (0
    copies), emptied, freed of ``.!?``, repeated (2 copies) or made the user's. Null roles and texts, and nulls in that name, are a space."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind, role, text = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20, known("role"), known("text")
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def flagged(rows: DataFrame) -> DataFrame:
    """key, conv_id, turn, role, text, copies, fault of rows (conv_id, turn, role, text, copies): blank or truncated, as the text by itself tells."""
    key = F.when(F.col("conv_id").isNull(), "null").otherwise(F.concat(F.lit("of "), F.col("conv_id").cast("string")))
    fault = F.when(~F.rlike("text", F.lit(f"[^{SPACE}]")), "b").when(F.rlike("text", F.lit(rf"[.!?][{SPACE}]*\z")), "").otherwise("t")
    return rows.select(key.alias("key"), "conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def solved(rows: list[tuple], turns: bool) -> tuple[list[int], str, Iterable[tuple[str, str]]]:
    """FIGURES, audit and repaired turns (role, text) of one conversation's rows (turn, role, text, copies, fault), in order."""
    seen: set[tuple[str, str]] = set()
    short: list[Turn] = []
    n = dict.fromkeys("bdt", 0)
    for _, role, text, copies, fault in rows:
        if fault != "b":
            fault = "d" if (role, text) in seen else fault
            seen.add((role, text))
        short.append((role[:1], fault, copies - 1))
        if fault:
            n[fault] += 1
        n["b" if fault == "b" else "d"] += copies - 1
    numbers = {t for t, *_ in rows if t is not None}
    cost = costs_to_go(short, the_end())
    edits, _ = walk(short, cost, START)
    repaired = ((role or rows[i][1], "" if letters == "I" else rows[i][2]) for i, letters, role in edits if letters[0] != "D") if turns else ()
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    return [gaps, *n.values(), illegal_pairs(short), cost[0][START]], "".join(x for _, x, _ in edits), repaired


def conversations_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """conv_id and rows of one conversation after another, of batches (key, conv_id, turn, role, text, copies, fault) sorted by key."""
    held, name, rows = None, None, []
    for batch in batches:
        for key, conv_id, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key != held:
                if held is not None:
                    yield name, rows
                held, name, rows = key, conv_id, []
            if row[3]:
                rows.append(tuple(row))
    if held is not None:
        yield name, rows


def digest(turns: Iterable[tuple[str, str]]) -> str:
    sha, first = hashlib.sha256(), True
    for role, text in turns:
        sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
        first = False
    return sha.hexdigest()


def in_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = BATCH) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def arrow_schema(conv_id: str, rest: str) -> tuple[pa.Schema, str]:
    """Of conv_id of a type, and more columns."""
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    first = pa.int64() if conv_id == "bigint" else pa.int32() if conv_id == "int" else pa.string()
    return pa.schema([("conv_id", first), *[(n, kinds[k]) for n, k in (x.split() for x in rest.split(", "))]]), f"conv_id {conv_id}, {rest}"


SHORT_FIGURES = ", ".join(f"{c} long" for c in FIGURES) + ", audit string, repaired_sha256 string"
TURNS = "place long, role string, text string"


def solve_short(rows: DataFrame, turns: bool) -> DataFrame:
    """Conversations that fit into a task: their figures, audit and digest, or their repaired turns."""
    schema, ddl = arrow_schema(dict(rows.dtypes)["conv_id"], TURNS if turns else SHORT_FIGURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            for conv_id, held in conversations_of(batches):
                figures, audit, repaired = solved(held, True)
                if turns:
                    yield from ((conv_id, k, *t) for k, t in enumerate(repaired))
                else:
                    yield conv_id, *figures, audit, digest(repaired)

        return in_batches(results(), schema)

    return texts_of(rows).repartition("key").sortWithinPartitions("key", "turn", "role", "text").mapInArrow(run, ddl)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (key, turn, role, text, ...) in order, with their task's number and their own in it. The bounds of the ranges hold
    beginnings of texts, as they go through the driver."""
    kinds = StructType([*rows.schema.fields, StructField("part", IntegerType()), StructField("seq", LongType())])
    ordered = rows.repartitionByRange("key", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("key", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(range(at, at + b.num_rows), pa.int64())], [*b.schema.names, "part", "seq"])
            at += b.num_rows

    return ordered.mapInArrow(run, kinds)


def share_of(pdf: pd.DataFrame) -> list[Turn]:
    return list(zip(pdf["initial"], pdf["fault"], pdf["copies"], strict=True))


def share_costs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Costs of a share from each state to each state (16), and what its neighbours need to count illegal pairs."""
    pdf = pdf.sort_values("seq")
    turns = share_of(pdf)
    table = [costs_to_go(turns, [0 if x == y else FAR for x in range(4)])[0] for y in range(4)]
    return pd.DataFrame({"key": [pdf["key"].iloc[0]], "part": [pdf["part"].iloc[0]], "costs": [[table[y][x] for x in range(4) for y in range(4)]], "first": [turns[0][0]], "last": [turns[-1][0]], "illegal": [illegal_pairs(turns)]})


def chained(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each share of a conversation the costs to go after it; on its first, the whole cost and all illegal pairs."""
    pdf = pdf.sort_values("part")
    ends, costs = [the_end()], list(pdf["costs"])
    for table in reversed(costs):
        ends.append([min(table[4 * x + y] + ends[-1][y] for y in range(4)) for x in range(4)])
    between = sum(a + b not in LEGAL for a, b in zip(pdf["last"][:-1], pdf["first"][1:], strict=True))
    total, illegal = [ends[-1][START]] + [0] * (len(pdf) - 1), [int(pdf["illegal"].sum()) + between] + [0] * (len(pdf) - 1)
    return pd.DataFrame({"key": pdf["key"], "part": pdf["part"], "togo": ends[-2::-1], "is_last": [False] * (len(pdf) - 1) + [True], "cost": total, "illegal": illegal})


def share_exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state in which a share ends for each that it begins in."""
    pdf = pdf.sort_values("seq")
    turns, last = share_of(pdf), bool(pdf["is_last"].iloc[0])
    cost = costs_to_go(turns, list(pdf["togo"].iloc[0]))
    return pd.DataFrame({"key": [pdf["key"].iloc[0]], "part": [pdf["part"].iloc[0]], "exits": [[walk(turns, cost, x, last)[1] if cost[0][x] < FAR else x for x in range(4)]]})


def entries(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("part")
    states = [START]
    for exits in pdf["exits"]:
        states.append(int(exits[states[-1]]))
    return pd.DataFrame({"key": pdf["key"], "part": pdf["part"], "entry": states[:-1]})


def share_edits(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("seq")
    turns, seq = share_of(pdf), [*pdf["seq"], pdf["seq"].iloc[-1] + 1]
    edits, _ = walk(turns, costs_to_go(turns, list(pdf["togo"].iloc[0])), int(pdf["entry"].iloc[0]), bool(pdf["is_last"].iloc[0]))
    out = pd.DataFrame([(seq[i], n, letters, role) for n, (i, letters, role) in enumerate(edits)], columns=["seq", "n", "letters", "new_role"])
    return out.assign(key=pdf["key"].iloc[0], part=pdf["part"].iloc[0])[["key", "part", "seq", "n", "letters", "new_role"]]


def joined_in_order(df: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """keys..., ``text`` of a group's rows put together in their order."""
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda s: s[text]), "").alias(text))


def solve_long(rows: DataFrame, turns: bool) -> DataFrame:
    """Conversations of any length, in shares; no task holds more than its share of their turns.

    The digest of a conversation reads its repaired turns one after another, in bounded memory.
    """
    base = workspace(rows.sparkSession, "turn-repair")
    conv_id = dict(rows.dtypes)["conv_id"]
    # Equal rows are neighbours, so they are one with a number of copies, however many there are.
    merged = rows.filter("copies > 0").groupBy("key", "turn", "role", "text").agg(F.first("conv_id").alias("conv_id"), F.first("fault").alias("fault"), F.sum("copies").alias("copies"))
    merged = written(merged.withColumn("mark", F.md5(F.concat("role", F.lit("\0"), "text"))), f"{base}/merged")
    when = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    repeated = merged.filter("fault <> 'b'").groupBy("key", "mark").agg(F.min(when).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    repeated = written(repeated, f"{base}/repeated")
    told = spread_join(merged, repeated, ["key", "mark"], BROADCAST_ROWS, "left", wide="key", leave=("text",))
    told = told.withColumn("fault", F.when((F.col("fault") != "b") & (F.col("first") < when), "d").otherwise(F.col("fault"))).drop("first")
    turned = written(numbered(texts_of(told)), f"{base}/turns")
    short = turned.select("key", "part", "seq", F.substring("role", 1, 1).alias("initial"), "fault", (F.col("copies") - 1).alias("copies"))
    shares = written(short.groupBy("key", "part").applyInPandas(share_costs, "key string, part int, costs array<long>, first string, last string, illegal long"), f"{base}/shares")
    chain = written(shares.groupBy("key").applyInPandas(chained, "key string, part int, togo array<long>, is_last boolean, cost long, illegal long"), f"{base}/chain")
    told_ends = short.join(chain.select("key", "part", "togo", "is_last"), ["key", "part"])
    exits = told_ends.groupBy("key", "part").applyInPandas(share_exits, "key string, part int, exits array<int>")
    entry = written(exits.groupBy("key").applyInPandas(entries, "key string, part int, entry int"), f"{base}/entries")
    edits = told_ends.join(entry, ["key", "part"]).groupBy("key", "part").applyInPandas(share_edits, "key string, part int, seq long, n long, letters string, new_role string")
    edits = written(edits, f"{base}/edits")
    text = F.when(F.col("letters") == "I", "").otherwise(F.col("text"))
    kept = edits.filter("letters not like 'D%'").join(turned.select("key", "part", "seq", "role", "text"), ["key", "part", "seq"], "left")
    kept = kept.select("key", "part", "n", F.coalesce("new_role", "role").alias("role"), text.alias("text"))
    names = merged.groupBy("key").agg(F.first("conv_id").alias("conv_id"))
    ordered = kept.repartition("key").sortWithinPartitions("key", "part", "n")
    if turns:
        schema, ddl = arrow_schema("string", TURNS)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, at = None, 0
            for b in batches:
                places = []
                for key in b.column(0).to_pylist():
                    held, at = (key, at + 1) if key == held else (key, 0)
                    places.append(at)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(places, pa.int64()), b.column(3), b.column(4)], schema=schema)

        return texts_of(ordered).mapInArrow(placed, ddl).withColumnRenamed("conv_id", "key").join(names, "key").select("conv_id", "place", "role", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sha = None, hashlib.sha256()
        out: list[tuple[str, str]] = []
        for b in batches:
            for key, role, said in zip(*[b.column(i).to_pylist() for i in (0, 3, 4)], strict=True):
                if key != held:
                    if held is not None:
                        out.append((held, sha.hexdigest()))
                    held, sha = key, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{said}".encode())
        if held is not None:
            out.append((held, sha.hexdigest()))
        yield from in_batches(out, pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())]))

    hashes = texts_of(ordered).mapInArrow(hashed, "key string, repaired_sha256 string")
    audit = joined_in_order(joined_in_order(edits, ["key", "part"], ["seq", "n"], "letters"), ["key"], ["part"], "letters").withColumnRenamed("letters", "audit")
    extra = F.col("copies") - 1
    faults = turned.groupBy("key").agg(
        F.sum(F.when(F.col("fault") == "b", F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == "b", 0).otherwise(extra + (F.col("fault") == "d").cast("int"))).alias("duplicate"),
        F.sum((F.col("fault") == "t").cast("long")).alias("truncated"),
    )
    gaps = turned.select("key", "turn").distinct().groupBy("key").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    sums = chain.groupBy("key").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"))
    out = names.join(gaps, "key").join(faults, "key").join(sums, "key").join(audit, "key").join(hashes, "key", "left")
    out = out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
    return out.select(F.col("conv_id").cast(conv_id).alias("conv_id"), *FIGURES, "audit", "repaired_sha256")


def repaired(rows: DataFrame, turns: bool = False, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """Figures of each conversation of ``rows`` (conv_id, turn, role, text, copies), or its repaired turns (conv_id, place, role, text).

    A conversation's rows are taken by turn, nulls first; rows of one turn by role and text. Rows of no copies are not there, but
    their conversation is: without any other it has zeros, no edits and the digest of an empty text. A null conv_id is a conversation of its own.
    """
    told = flagged(rows)
    sizes = told.filter("copies > 0").groupBy("key").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.octet_length("text")).alias("bytes"))
    long = written(sizes.filter((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)).select("key"), workspace(rows.sparkSession, "long-conversations"))
    if long.isEmpty():
        return solve_short(told, turns)
    hinted = F.broadcast(long) if small_enough(long, BROADCAST_ROWS) else long
    return solve_short(told.join(hinted, "key", "left_anti"), turns).unionByName(solve_long(told.join(hinted, "key", "left_semi"), turns))


def turn_repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation, damaged and repaired.

    Each row's first fault counts: blank, duplicate (role and text seen earlier) or truncated. Rows that repeat are duplicates. An
    empty table gives no rows. Other columns are not read, whatever their names.
    """
    return repaired(damaged(conversations))


def undamaged(conversations: DataFrame) -> DataFrame:
    """Rows for repaired() of conversations as they are; null roles and texts are a space."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), known("role"), known("text"), F.lit(1).alias("copies"))
