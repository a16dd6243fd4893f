"""Benchmark decontamination by winnowing.

A window is WINDOW consecutive words of an item, or the whole item if it has fewer. Documents and items keep, of every run of
WINDOW - K + 1 of their K-grams, the least hash and where it stands, so a window that stands in both leaves the same
hash at the same place of it. A common hash gives a document, an item and the shift between the two places; along that
shift the words of both are held against each other, which extends the match both ways, and runs of a window's words or more
are hits. Shorter items are found by the hash of as many words, at every place of a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.llm.shared import ascii_lower, row_mark, spread_join, workspace, written

WINDOW = 10
K = 5
#: Rows of fingerprints, shifts or hits up to which they are broadcast; more are joined with salts.
BROADCAST_ROWS = 1_000_000

# Fixed value: what separates words once A-Z are lower-cased.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text; none if it is null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BETWEEN), lambda w: w != "")


def pairwise(a: Column, b: Column, shift: int, f) -> Column:
    """f of each element of ``a`` and the one of ``b`` that stands ``shift`` further on, as long as there is one."""
    n = F.greatest(F.size(b) - shift, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(shift + 1), n), lambda x, y: f(x, y))


def with_gram_hashes(df: DataFrame, words: str, n: int, name: str) -> DataFrame:
    """``df`` with the hashes of the n-grams in turn, by doubling; none if there are fewer words.

    Every step is a column of its own, so that a step that is used twice is computed once.
    """
    df = df.withColumn(f"{name}_1", F.transform(words, lambda w: F.xxhash64(w)))
    h, length = f"{name}_1", 1
    for bit in f"{n:b}"[1:]:
        df = df.withColumn(f"{name}_{2 * length}", pairwise(F.col(h), F.col(h), length, F.xxhash64))
        h, length = f"{name}_{2 * length}", 2 * length
        if bit == "1":
            df = df.withColumn(f"{name}_{length + 1}", pairwise(F.col(h), F.col(f"{name}_1"), length, F.xxhash64))
            h, length = f"{name}_{length + 1}", length + 1
    return df.withColumn(name, F.col(h)).drop(*[c for c in df.columns if c.startswith(f"{name}_")])


def with_fingerprints(df: DataFrame, words: str, window: int, k: int, name: str) -> DataFrame:
    """``df`` with (hash, place from 0) of the least k-gram of every window, once each; none if there are fewer words than a
    window has.

    The upper half of a hash and its place make one number, whose least is the least hash and of equals the first.
    """
    df = with_gram_hashes(df, words, k, f"{name}g")
    df = df.withColumn(f"{name}m1", F.transform(f"{name}g", lambda h, i: F.shiftleft(F.shiftright(h, 32), 32).bitwiseOR(i.cast("long"))))
    least, length = f"{name}m1", 1
    while length < window - k + 1:
        step = min(length, window - k + 1 - length)
        df = df.withColumn(f"{name}m{length + step}", pairwise(F.col(least), F.col(least), step, F.least))
        least, length = f"{name}m{length + step}", length + step
    place = lambda p: p.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    df = df.withColumn(name, F.transform(F.array_distinct(least), lambda p: F.struct(F.get(f"{name}g", place(p)).alias("hash"), place(p).alias("place"))))
    return df.drop(*[c for c in df.columns if c.startswith((f"{name}g", f"{name}m"))])


def with_places(df: DataFrame, words: str, n: int, name: str) -> DataFrame:
    """``df`` with (hash, place from 0) of every run of n words."""
    df = with_gram_hashes(df, words, n, f"{name}h")
    return df.withColumn(name, F.transform(f"{name}h", lambda h, i: F.struct(h.alias("hash"), i.alias("place")))).drop(f"{name}h")


def tagged(n: int) -> Callable[[Column], Column]:
    return lambda f: F.struct(f["hash"].alias("hash"), F.lit(n).alias("n"), f["place"].alias("place"))


def marked_places(df: DataFrame, keys: list[str], window: int, k: int, short: list[int]) -> DataFrame:
    """keys..., hash, n, place of the fingerprints of ``df`` (keys..., words), and of all runs of as many words as ``short`` has."""
    df = with_fingerprints(df, "words", window, k, "f")
    for n in short:
        df = with_places(df, "words", n, f"s{n}")
    parts = [F.transform("f", tagged(window)), *[F.transform(f"s{n}", tagged(n)) for n in short]]
    # explode() would ask for non-empty lists below all the steps that make them, and so compute these again.
    return df.select(*keys, F.explode_outer(F.concat(*parts)).alias("of")).filter("of is not null").select(*keys, "of.hash", "of.n", "of.place")


def with_runs(df: DataFrame, same: str, window: int) -> tuple[DataFrame, str]:
    """``df`` with a column that tells of each place whether ``window`` trues begin there, by doubling; and its name."""
    length, at = 1, same
    while length < window:
        step = min(length, window - length)
        df = df.withColumn(f"_run{length + step}", pairwise(F.col(at), F.col(at), step, lambda x, y: x & y))
        at, length = f"_run{length + step}", length + step
    return df, at


def extended(matched: DataFrame, window: int) -> DataFrame:
    """mark, item, place, n of every window of an item that stands in a document along a match.

    ``matched`` has mark, item, n, lo, part (the document's words that stand against the item's, from place lo on), skip (the item's
    words before these) and item_words. An item of n < ``window`` words is one window.
    """
    matched = matched.withColumn("_same", F.zip_with("part", F.slice("item_words", F.col("skip") + 1, F.size("part")), lambda a, b: a == b))
    matched, run = with_runs(matched, "_same", window)
    whole = F.when((F.size("_same") == F.col("n")) & F.forall("_same", lambda x: x), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    begins = F.filter(F.transform(run, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    at = matched.withColumn("_at", F.when(F.col("n") < window, whole).otherwise(begins))
    return at.select("mark", "item", "n", F.explode_outer(F.transform("_at", lambda i: i + F.col("lo"))).alias("place")).filter("place is not null")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs``.

    Null and wordless texts have no words and no hits, null and wordless items no windows; items_sha256 is then that of
    the empty text. An item without an item_id makes hits but is not counted. Rows that repeat have the same figures each;
    rows of one doc_id, null among them, with other texts have their own. Empty tables give no rows, or no hits.
    """
    return marked_contamination(docs, benchmark, window, k).drop("mark")


def marked_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """The columns of contamination() and the row's ``mark``."""
    base = workspace(docs.sparkSession, "decontaminate")
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("item_words")).filter("size(item_words) > 0")
    items = written(items.withColumn("no", F.monotonically_increasing_id()), f"{base}/items")
    # At most window - 1 numbers: the lengths of items that are shorter than a window.
    short = sorted(r["n"] for r in items.select(F.size("item_words").alias("n")).filter(F.col("n") < window).distinct().collect())
    fingerprints = marked_places(items.select("no", F.size("item_words").alias("size"), F.col("item_words").alias("words")), ["no", "size"], window, k, short)
    wanted = written(fingerprints.filter(F.col("n") == F.least("size", F.lit(window))).select("hash", "n", "no", "size", F.col("place").alias("item_place")), f"{base}/wanted")

    rows = docs.select("doc_id", "text").withColumn("mark", row_mark())
    places = marked_places(rows.select("mark", words_of(F.col("text")).alias("words")), ["mark"], window, k, short)
    met = spread_join(places, wanted, ["hash", "n"], BROADCAST_ROWS).select("mark", "no", "n", "size", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    shifts = written(met.groupBy("mark").agg(F.collect_list(F.struct("no", "n", "size", "shift")).alias("shifts")), f"{base}/shifts")

    # A document's words are split once; of each shift only those that stand against the item's go on.
    few = (shifts.agg(F.sum(F.size("shifts")).alias("n")).first()["n"] or 0) <= BROADCAST_ROWS
    told = spread_join(rows.select("mark", "text"), shifts, ["mark"], BROADCAST_ROWS if few else 0, leave=["text"]).select("mark", words_of(F.col("text")).alias("words"), "shifts")
    lo = lambda s: F.greatest(s["shift"], F.lit(0))
    part = lambda s: F.slice("words", lo(s) + 1, F.least(F.size("words"), s["size"] + s["shift"]) - lo(s))
    against = F.transform("shifts", lambda s: F.struct(s["no"].alias("no"), s["n"].alias("n"), lo(s).alias("lo"), (lo(s) - s["shift"]).alias("skip"), part(s).alias("part")))
    each = told.select("mark", F.explode_outer(against).alias("of")).select("mark", "of.*")
    hit_at = extended(spread_join(each, items, ["no"], BROADCAST_ROWS, wide="item_words", leave=["part"]), window)
    found = hit_at.groupBy("mark").agg(F.collect_set(F.struct("place", "n")).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["place"], s["place"] + s["n"] - 1)))))
    sha = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    hits = written(found.select("mark", hit.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256")), f"{base}/hits")

    counted = rows.select("doc_id", "mark", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    return spread_join(counted, hits, ["mark"], BROADCAST_ROWS, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        "mark",
    )
