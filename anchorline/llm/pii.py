"""Personal data: pattern matches, and bootstrapped extraction of identifiers that the patterns miss.

The base kinds are found by regular expressions and checks. They seed a graph of instances (identifier-like tokens) and
lexical patterns (the one or two words before them, and the word after); quoted digests seed a kind SECRET besides. In rounds, a pattern's confidence in a kind is the share of its
instances that are known to be of that kind, and an instance's is the noisy-or over its confident patterns; instances
of high confidence count as known in the next round. Unseen tokens that end as known are added to the base spans; those
of SECRET, which has no base spans, only if a confident pattern holds them, seeds among them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.llm.shared import row_mark, small_enough, spread_join, workspace, written

KINDS = ("email", "ip", "card", "phone")
#: The kind that the method alone finds: keys and tokens that open a door.
SECRET = "secret"
ROUNDS = 3
#: A pattern needs so many known instances, and such a share of its instances; an instance needs such a confidence.
LEAST_KNOWN, PATTERN_CONFIDENCE, INSTANCE_CONFIDENCE = 5, 0.8, 0.9
BROADCAST_ROWS = 1_000_000
#: Characters before an instance in which its pattern is sought.
CONTEXT = 80
#: Matches whose lengths are added up together.
BLOCK = 128

# The base kinds. Possessive repeats find the same matches without going back; a match begins where a run of
# its first characters begins, or where the match before it ended (\G).
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

# An address whose at or dots are spelt out or in brackets, with blanks or without; with a bare "at", only if a dot is spelt.
_DOTS = r"(?:\x20?[(\[{<]\x20?(?i:dot|punkt|\.)\x20?[)\]}>]\x20?|\x20(?i:dot)\x20)[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
_HOST = r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
_IN_BRACKETS = r"\x20?[(\[{<]\x20?(?i:at|@)\x20?[)\]}>]\x20?"
SPELT = rf"(?<!\S)[A-Za-z0-9._%+-]++(?:{_IN_BRACKETS}{_HOST}(?:{_DOTS})*+|(?:\x20(?i:at)\x20|@){_HOST}(?:{_DOTS})++)"
#: What may be an instance besides: a token with a digit, an @, an at or dot in brackets, or letters joined by . _ or -. One
#: that holds a base match is left to that.
_NO_BASE = r"(?!\S*?(?:[A-Za-z0-9._%+-]@[A-Za-z0-9-]++\.[A-Za-z0-9-]|[0-9]\.[0-9]++\.[0-9]++\.[0-9]))"
TOKEN = rf"(?<!\S)(?=\S*?(?:[0-9@]|\p{{L}}[._-]\p{{L}}|[(\[{{<](?i:at|dot)[)\]}}>])){_NO_BASE}\S++"
INSTANCE = f"{PHONE}|(?<![0-9])[0-9]++(?:[\\x20-][0-9]++){{2,}}+|{EMAIL}|{IP}|{SPELT}|{TOKEN}"
#: What seeds SECRET: digests in hexadecimal, right after a quote.
DIGEST = r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"
QUOTED = r"[\"'`]$"
#: Instances that end the context of those after them; others, such as joined words, are words of it.
ENDS_CONTEXT = r"@|(?:[0-9][^0-9]*+){5}"


def luhn(digits: Column) -> Column:
    """True if the digits pass Luhn's check."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda total, i: total + F.when((n - i) % 2 == 1, twice(value(i))).otherwise(value(i))) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        # Only digits of the right number are checked, so the check's loop is short.
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def passes(kind: str) -> Callable[[Column], Column]:
    return lambda m: valid(kind, m["match"])


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def as_span(kind: str, base: bool) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"))


def running(lengths: Column) -> Column:
    """Of each element the sum of those before it: within its block, plus the sums of the blocks before."""
    n = F.size(lengths)
    add = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: add(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
    within = lambda i: add(F.slice(lengths, (F.floor(i / BLOCK) * BLOCK + 1).cast("int"), (i % BLOCK).cast("int")))
    earlier = F.transform(F.sequence(F.lit(0), F.size(blocks) - 1), lambda b: add(F.slice(blocks, F.lit(1), b)))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: within(i) + F.element_at(earlier, (F.floor(i / BLOCK) + 1).cast("int")))


def with_matches(df: DataFrame, text: str, pattern: str, name: str, ends: str | None = None) -> DataFrame:
    """``df`` with all matches of a pattern in turn: (start, end, match, before, after), in characters; ``before`` lies between
    the match and the one before it, ``after`` between it and the next. What stands between matches gives their places.

    With ``ends``, ``before`` goes on over up to two matches that it does not find, which hold two words at least.
    """
    gap = lambda i: F.element_at("_gaps", i)
    words = lambda i, rest: F.when((i >= 1) & ~F.get("_found", i - 1).rlike(ends), F.concat(rest(i), F.get("_found", i - 1))).otherwise("")
    before = gap if ends is None else lambda i: F.concat(words(i - 1, lambda j: F.concat(words(j - 1, lambda k: F.get("_gaps", k - 1)), F.get("_gaps", j - 1))), gap(i))
    empty = F.array().cast("array<struct<start:int,end:int,match:string,before:string,after:string>>")
    df = df.withColumn("_found", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = df.withColumn("_gaps", F.when(F.size("_found") > 0, F.split(F.col(text), pattern, -1)))
    df = df.withColumn("_lengths", F.zip_with(F.col("_found"), F.slice("_gaps", F.lit(1), F.size("_found")), lambda m, g: F.length(m) + F.length(g)))
    df = df.withColumn("_before", F.when(F.size("_found") > 0, running(F.col("_lengths"))))
    each = F.transform(
        F.sequence(F.lit(1), F.size("_found")),
        lambda i: F.struct(
            (F.element_at("_before", i) + F.length(F.element_at("_gaps", i))).alias("start"),
            (F.element_at("_before", i) + F.element_at("_lengths", i)).alias("end"),
            F.element_at("_found", i).alias("match"),
            F.substring(before(i), F.lit(-CONTEXT), F.lit(CONTEXT)).alias("before"),
            (F.lit("") if ends is None else F.substring(F.element_at("_gaps", i + 1), F.lit(1), F.lit(CONTEXT))).alias("after"),
        ),
    )
    return df.withColumn(name, F.when(F.size("_found") > 0, each).otherwise(empty)).drop("_found", "_gaps", "_lengths", "_before")


def with_base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with an array of (start, end) for each base kind, in the order of the text; null texts have none."""
    for kind, pattern in PATTERNS.items():
        df = with_matches(df, text, pattern, f"_{kind}")
        held = F.transform(F.filter(f"_{kind}", passes(kind)), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
        df = df.withColumn(kind, F.coalesce(held, F.array().cast("array<struct<start:int,end:int>>"))).drop(f"_{kind}")
    return df


def occurrences(docs: DataFrame) -> DataFrame:
    """mark, start, end, instance, kind (null unless a base kind or a seed of SECRET) and patterns of every possible instance."""
    found = with_matches(docs.withColumn("mark", row_mark()).select("mark", "text").filter("text is not null"), "text", INSTANCE, "found", ENDS_CONTEXT)
    # explode() would ask for non-empty lists below all the steps that make them, and so compute these again.
    each = found.select("mark", F.explode_outer("found").alias("f")).filter("f is not null").select("mark", "f.*")
    instance = F.regexp_replace(F.regexp_replace("match", r"[^A-Za-z0-9]+$", ""), r"^[^A-Za-z0-9+]+", "")
    lead = F.length("match") - F.length(F.regexp_replace("match", r"^[^A-Za-z0-9+]+", ""))
    kind = reduce(lambda rest, k: F.when(F.col("instance").rlike(f"^(?:{PATTERNS[k]})$") & valid(k, F.col("instance")), F.lit(k)).otherwise(rest), reversed(KINDS), F.lit(None).cast("string"))
    kind = F.coalesce(kind, F.when(F.col("instance").rlike(DIGEST) & F.concat("before", F.substring("match", F.lit(1), lead)).rlike(QUOTED), F.lit(SECRET)))
    one = F.lower(F.regexp_extract("before", r"([^\s.,;:!?()\[\]\"']+)[\s.,;:!?()\[\]\"']*$", 1))
    two = F.lower(F.regexp_extract("before", r"([^\s.,;:!?()\[\]\"']+[\s.,;:!?()\[\]\"']+[^\s.,;:!?()\[\]\"']+)[\s.,;:!?()\[\]\"']*$", 1))
    after = F.lower(F.regexp_extract("after", r"^[\s.,;:!?()\[\]\"']*([^\s.,;:!?()\[\]\"']+)", 1))
    placed = each.withColumn("instance", instance).withColumn("start", F.col("start") + lead).withColumn("end", F.col("start") + F.length("instance"))
    named = placed.filter(F.length("instance") > 0).withColumn("kind", kind)
    return named.select("mark", "start", "end", "instance", "kind", F.filter(F.array(F.concat(F.lit("1:"), one), F.concat(F.lit("2:"), two), F.concat(F.lit("+:"), after)), lambda p: F.length(p) > 2).alias("patterns"))


def discover(seen: DataFrame, base: str, rounds: int = ROUNDS) -> DataFrame:
    """instance, kind and confidence of the instances that the rounds find; an instance gets its kind of most confidence.

    Seeds of the base kinds are found already; those of SECRET are too if a confident pattern holds them.
    """
    edges = written(seen.select(F.explode("patterns").alias("pattern"), "instance").distinct(), f"{base}/edges")
    seeds = written(seen.filter("kind is not null").select("instance", "kind").distinct().withColumn("confidence", F.lit(1.0)), f"{base}/known-0")
    totals = written(edges.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_KNOWN), f"{base}/totals")
    base_seeds = seeds.filter(F.col("kind") != SECRET).select("instance")
    known, found = seeds, seeds.limit(0)
    for k in range(rounds):
        hits = spread_join(edges, known, ["instance"], BROADCAST_ROWS, wide="instance").groupBy("pattern", "kind").agg(F.sum("confidence").alias("known"))
        held = hits.filter(F.col("known") >= LEAST_KNOWN).join(totals, "pattern").withColumn("score", F.col("known") / F.col("n")).filter(F.col("score") >= PATTERN_CONFIDENCE)
        confident = written(held.select("pattern", "kind", "score"), f"{base}/patterns-{k}")
        # Noisy-or, as a sum of logs; a pattern of which all are known counts as nearly sure.
        doubt = F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(0.05))))
        scored = spread_join(edges, confident, ["pattern"], BROADCAST_ROWS).groupBy("instance", "kind").agg(doubt.alias("doubt")).withColumn("confidence", 1 - F.exp("doubt"))
        best = scored.groupBy("instance").agg(F.max_by(F.struct("kind", "confidence"), F.struct("confidence", "kind")).alias("best")).select("instance", "best.*")
        found = written(best.filter(F.col("confidence") >= INSTANCE_CONFIDENCE).join(base_seeds, "instance", "left_anti"), f"{base}/found-{k + 1}")
        known = seeds.unionByName(found.join(seeds.select("instance"), "instance", "left_anti"))
    return found


def held(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all columns of ``docs`` as one, so that no name of theirs clashes."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def spanned(docs: DataFrame, rounds: int) -> DataFrame:
    """doc_id, text, row and spans of held() rows: an array of (kind, start, end, base), by kind as listed and then by start."""
    base = workspace(docs.sparkSession, "pii")
    seen = written(occurrences(docs), f"{base}/seen")
    found = discover(seen, base, rounds).select("instance", F.col("kind").alias("as"))
    added = spread_join(seen.filter(F.coalesce(F.col("kind") == SECRET, F.lit(True))).select("instance", "mark", "start", "end"), found, ["instance"], BROADCAST_ROWS, wide="instance")
    added = written(added.groupBy("mark").agg(F.collect_set(F.struct(F.col("as").alias("kind"), "start", "end")).alias("added")), f"{base}/added")
    rows = with_base_spans(docs.withColumn("mark", row_mark()))
    for kind in KINDS:
        rows = rows.withColumn(kind, F.transform(kind, as_span(kind, True)))
    few = small_enough(added, BROADCAST_ROWS) and (added.agg(F.sum(F.size("added")).alias("n")).first()["n"] or 0) <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(added) if few else added, "mark", "left")
    rows = rows.withColumn("base", F.concat(*KINDS))
    rows = rows.withColumn("added", F.filter(F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>")), lambda a: ~F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"]))))
    ranked = F.concat(*[F.array_sort(F.concat(F.col(kind) if kind in KINDS else F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean>>"), F.transform(F.filter("added", of_kind(kind)), as_span(kind, False)))) for kind in (*KINDS, SECRET)])
    return rows.select("doc_id", "text", "row", ranked.alias("spans"))


def with_spans(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with spans: an array of (kind, start, end, base), by kind as listed and then by start.

    Spans that the method adds overlap no base span. Null and empty texts have none; rows that repeat have the same; empty
    tables give no rows. Columns of ``docs`` of any name stay, but one named spans gives way.
    """
    return spanned(held(docs), rounds).select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "spans"], "spans")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, spans and secrets of every row of ``docs``.

    ``spans`` has the listed KINDS, base spans and added ones; ``secrets`` the spans of SECRET, which no list names. An instance has to
    look like an identifier (INSTANCE): what is letters alone, without a digit, an @ or a joint, is never one. Null and empty texts have
    no spans; rows that repeat have the same; an empty table gives no rows.
    """
    found = with_spans(docs.select("doc_id", "text"), rounds)
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.filter("spans", lambda s: s["kind"] != SECRET)).alias("spans"), joined(F.filter("spans", of_kind(SECRET))).alias("secrets"))


def redact(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``<KIND>``; overlapping spans become one, of the first's kind."""
    found = spanned(held(docs), rounds)
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    nothing = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    last = lambda out: F.element_at(out, -1)
    own = lambda s: F.array(F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), s["kind"].alias("kind")))
    longer = lambda out, s: F.array(F.struct(last(out)["start"].alias("start"), F.greatest(last(out)["end"], -s["back"]).alias("end"), last(out)["kind"].alias("kind")))
    merged = F.aggregate(by_start, nothing, lambda out, s: F.when((F.size(out) > 0) & (last(F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("kind"))), out))["end"] > s["start"]), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), longer(out, s))).otherwise(F.concat(out, own(s))))
    found = found.withColumn("_cuts", F.when(F.size("spans") > 0, merged))
    pieces = F.transform(
        F.sequence(F.lit(1), F.size("_cuts")),
        lambda i: F.concat(
            F.substring("text", F.when(i > 1, F.get("_cuts", i - 2)["end"]).otherwise(0) + 1, F.get("_cuts", i - 1)["start"] - F.when(i > 1, F.get("_cuts", i - 2)["end"]).otherwise(0)),
            F.lit("<"),
            F.upper(F.get("_cuts", i - 1)["kind"]),
            F.lit(">"),
        ),
    )
    tail = F.substring("text", F.element_at("_cuts", -1)["end"] + 1, F.length("text"))
    text = F.when(F.size("spans") > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col("text"))
    return found.withColumn("text", text).select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
