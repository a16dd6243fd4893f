"""Source divergence audit: how far the words of a language's sources are from each other, and which words make them so.

Plain relational: words are exploded and counted, the kept vocabulary of a language is crossed with its sources so that words a
source lacks count as zeros, the dense counts are joined to themselves on language and word, summed and ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorline.llm.shared import ascii_lower, spread_join, workspace, written

#: A run of ASCII letters and of characters beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that a kept term is in, at least.
LEAST_DOCS = 10
#: Terms told of a source.
TOP = 10
#: Parts of a share are counted in billionths; each term has two occurrences on loan.
UNIT, LOAN = 1_000_000_000, 2
#: Sources up to which they are broadcast.
BROADCAST_GROUPS = 200_000


def term_counts(rows: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), n_docs of rows (lang, source, text): each document's different terms stand before all of
    its terms in one array, so one pass over the texts and one shuffle count both."""
    listed = rows.select("lang", "source", F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0)).alias("terms"))
    listed = listed.select("lang", "source", "terms", F.array_distinct("terms").alias("own"))
    each = listed.select("lang", "source", F.size("own").alias("k"), F.posexplode(F.concat("own", "terms")).alias("at", "term"))
    mine = F.col("at") < F.col("k")
    return each.groupBy("lang", "source", "term").agg(F.sum(F.when(mine, 0).otherwise(1)).alias("n"), F.sum(F.when(mine, 1).otherwise(0)).alias("n_docs"))


def billionths(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT (n + LOAN) / (total + LOAN terms)), exact for counts of any size: the product is a decimal."""
    return F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + F.lit(LOAN)).cast("decimal(20,0)"), (total + F.lit(LOAN) * terms).cast("decimal(20,0)"))


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language its distance to each other source (part ``pair``), and the
    ``top`` terms it uses more than the language does (part ``term``).

    Null text, lang and source are read as ''. Each row is a document, so rows that repeat count each. A language without kept
    terms has pairs at distance 0 and no terms; a language of one source has no pairs. Ties of value go by item, in UTF-8 order. An
    empty table gives no rows. Other columns of ``docs`` are not read, whatever their names.
    """
    base = workspace(docs.sparkSession, "divergence")
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = written(term_counts(rows), f"{base}/counts")
    # A term has a row for each source at most, so a window over them is small.
    of_term = Window.partitionBy("lang", "term")
    kept = counted.withColumns({"n_lang": F.sum("n").over(of_term), "docs": F.sum("n_docs").over(of_term), "first": F.row_number().over(of_term.orderBy("source")) == 1})
    kept = written(kept.filter(F.col("docs") >= least_docs).select("lang", "term", "source", "n", "n_lang", "first"), f"{base}/kept")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.filter("first").groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("lang_total"))
    # A row for each language and source; sums of both sides were shuffled.
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = written(groups.na.fill(0, ["total", "terms", "lang_total"]), f"{base}/groups")

    zeros = spread_join(kept.filter("first").select("lang", "term", "n_lang"), groups.filter("terms > 0"), ["lang"], BROADCAST_GROUPS, wide="source")
    zeros = zeros.select("lang", "term", "source", "n_lang", "total", "terms", "lang_total", F.lit(0).cast("long").alias("n"))
    held = kept.select("lang", "term", "source", "n_lang", *[F.lit(None).cast("long").alias(c) for c in ("total", "terms", "lang_total")], "n")
    # Dealt by language and term, which serves the sum of zeros and counts and the join of sources.
    dense = zeros.unionByName(held).repartition("lang", "term").groupBy("lang", "term", "source").agg(*[F.max(c).alias(c) for c in ("n_lang", "total", "terms", "lang_total")], F.sum("n").alias("n"))
    shares = dense.select("lang", "term", "source", "n", billionths(F.col("n"), F.col("total"), F.col("terms")).alias("p"), billionths(F.col("n_lang"), F.col("lang_total"), F.col("terms")).alias("q"))

    mine = shares.select("lang", "term", "source", "p")
    others = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    # Distances are the same both ways, so each pair is summed once.
    half = mine.join(others, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item").agg(F.sum(distance(F.col("p"), F.col("q"))).alias("value"))
    idle = groups.filter("terms = 0").select("lang", "source")
    half = half.unionByName(idle.join(idle.withColumnRenamed("source", "item"), "lang").filter("source < item").withColumn("value", F.lit(0).cast("long")))
    both = F.explode(F.array(F.struct(F.col("source"), F.col("item")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = half.select("lang", both.alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    terms = shares.filter("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= top))
