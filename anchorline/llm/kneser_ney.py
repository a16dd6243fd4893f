"""Quality classifier: an interpolated modified Kneser-Ney model of byte n-grams, trained on trusted text.

A gram of ORDER bytes is a number, so its context is a shift of it and its suffix a mask. Counts of the highest order are
those of the trusted text, lower ones count the bytes that precede a gram. Joins of the count tables, sharded by gram and
by context, give each gram that occurs in the corpus its probability; a document's perplexity follows from its grams,
and is held against a quantile of trusted documents of its language and length that the model was not trained on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.llm.shared import small_enough, texts_of, workspace, written

ORDER = 5
#: A document is kept if its perplexity is at most this quantile of the held-out trusted ones of its language and length class.
QUANTILE = 0.97
#: One of so many trusted texts, by their hash, is held out of the training.
FOLDS = 5
#: Classes of a language with fewer held-out documents are judged by the language's quantile, such languages by that of all.
LEAST_TRUSTED = 20
#: Text bytes that are looked at together, and grams that a task merges its counts at.
SLICE_BYTES = 2 << 20
MERGE_AT = 4 << 20
#: Grams up to which their probabilities are broadcast (16 bytes each); more are joined to the documents' grams.
BROADCAST_GRAMS = 4_000_000
SALTS = 32
#: Ids of trusted documents up to which they are broadcast.
BROADCAST_IDS = 1_000_000


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each byte of each text, zeros standing before a text; and the n + 1 bounds of the texts."""
    size = np.array([len(t) for t in texts], np.int64)
    pad = b"\0" * (ORDER - 1)
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t)) + b"\0", np.uint8)[:-1].astype(np.int64)
    n = len(data) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    packed = np.zeros(n, np.int64)
    for j in range(ORDER):
        packed <<= 8
        packed |= data[j : j + n]
    ends = np.cumsum(size + ORDER - 1)
    own = np.ones(n, bool)
    for j in range(ORDER - 1):  # grams that end in the zeros of the next text
        at = ends[:-1] + j - ORDER + 1
        own[at[(at >= 0) & (at < n)]] = False
    return packed[own], np.concatenate(([0], np.cumsum(size)))


def text_slices(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in turn, about SLICE_BYTES together, and the number of the first; a longer one is by itself."""
    texts, first, total = [], 0, 0
    for i, t in enumerate(column.cast(pa.binary()).to_pylist()):
        t = t or b""
        if texts and total + len(t) > SLICE_BYTES:
            yield first, texts
            texts, first, total = [], i, 0
        texts.append(t)
        total += len(t)
    if texts:
        yield first, texts


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> gram, n: each gram of a task's texts, once or a few times."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    total = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, of = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(of, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

    for batch in batches:
        for _, texts in text_slices(batch.column(0)):
            held.append(np.unique(grams_of(texts)[0], return_counts=True))
            total += len(held[-1][0])
            if total > MERGE_AT:
                held = [merged()]
                if (total := len(held[0][0])) > MERGE_AT // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["gram", "n"])
                    held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["gram", "n"])


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of grams seen once, twice and more often."""
    n = {r["n"]: r["k"] for r in counts.filter("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()}
    n1, n2, n3, n4 = (float(n.get(i, 0)) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return (0.5, 0.75, 0.75)
    y = n1 / (n1 + 2 * n2)
    d2 = 2 - 3 * y * n3 / n2
    return tuple(min(max(d, 0.05), top) for d, top in ((1 - 2 * y * n2 / n1, 0.95), (d2, 1.95), (3 - 4 * y * n4 / n3 if n3 else d2, 2.95)))


def mask(order: int) -> int:
    return (1 << 8 * order) - 1


def probabilities(counts: DataFrame, needed: DataFrame, base: str) -> DataFrame:
    """gram, p of each gram of ``needed``, of ORDER bytes, by the model of ``counts`` (gram, n).

    From the lowest order on, each needed suffix is joined to its count and to its context's sums. A context that was never
    seen passes on the probability of the lower order.
    """
    tables = [counts]
    for order in range(ORDER - 1, 0, -1):
        tables.append(tables[-1].select(F.col("gram").bitwiseAND(F.lit(mask(order))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")))
    p = None
    for order in range(1, ORDER + 1):
        table = written(tables[ORDER - order], f"{base}/counts-{order}")
        d1, d2, d3 = discounts(table)
        context = F.shiftright("gram", 8)
        sums = table.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)).alias("taken"))
        wanted = needed.select(F.col("gram").bitwiseAND(F.lit(mask(order))).alias("gram")).distinct() if order < ORDER else needed.select("gram")
        rows = wanted.join(table, "gram", "left").withColumn("context", context).join(sums, "context", "left")
        rows = rows.withColumn("suffix", F.col("gram").bitwiseAND(F.lit(mask(order - 1))))
        rows = rows.withColumn("lower", F.lit(1 / 256)) if p is None else rows.join(p.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix")
        kept = F.coalesce((F.col("n") - F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)) / F.col("total"), F.lit(0.0))
        p = written(rows.select("gram", (kept + F.coalesce(F.col("taken") / F.col("total"), F.lit(1.0)) * F.col("lower")).alias("p")), f"{base}/p-{order}")
    return p


FIGURES = "doc_id long, lang string, held_out boolean, n_bytes long, log_p double"


def log_likelihoods(rows: DataFrame, p: DataFrame) -> DataFrame:
    """``rows`` (doc_id, lang, held_out, text) as FIGURES; log_p is the natural log of a text's probability by the grams' ``p``."""
    if small_enough(p, BROADCAST_GRAMS):
        return by_broadcast(rows, p)
    return by_join(rows, p)


def by_broadcast(rows: DataFrame, p: DataFrame) -> DataFrame:
    # As Arrow columns: 16 bytes a gram, where rows would take hundreds in the driver.
    found = p.select("gram", "p").toArrow()
    grams, logs = found["gram"].to_numpy(), np.log(found["p"].to_numpy())
    order = np.argsort(grams)
    model = rows.sparkSession.sparkContext.broadcast((grams[order], logs[order]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs = model.value
        for batch in batches:
            n, total = [], []
            for _, texts in text_slices(batch.column(3)):
                grams, bounds = grams_of(texts)
                for i in range(len(texts)):
                    g, k = np.unique(grams[bounds[i] : bounds[i + 1]], return_counts=True)
                    n.append(len(texts[i]))
                    total.append(float(logs[np.searchsorted(keys, g)] @ k) if len(g) else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(total, pa.float64())], ["doc_id", "lang", "held_out", "n_bytes", "log_p"])

    return rows.select("doc_id", "lang", "held_out", "text").mapInArrow(score, FIGURES)


def by_join(rows: DataFrame, p: DataFrame) -> DataFrame:
    """Each text's grams joined to ``p``. Common grams are in most texts, so every gram is dealt over SALTS parts."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                grams, bounds = grams_of(texts)
                for i in range(len(texts)):
                    g, k = np.unique(grams[bounds[i] : bounds[i + 1]], return_counts=True)
                    mark = pa.array([batch.column(0)[first + i].as_py()] * len(g), pa.string())
                    yield pa.RecordBatch.from_arrays([mark, pa.array(g, pa.int64()), pa.array(k, pa.int64())], ["mark", "gram", "k"])

    # Rows with one text have one likelihood.
    marked = rows.withColumn("mark", F.md5("text"))
    texts = marked.groupBy("mark").agg(F.first("text").alias("text"))
    dealt = texts.mapInArrow(listed, "mark string, gram long, k long").withColumn("salt", F.pmod(F.xxhash64("mark"), F.lit(SALTS)).cast("int"))
    many = p.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    summed = dealt.join(many, ["gram", "salt"]).groupBy("mark").agg(F.sum(F.log("p") * F.col("k")).alias("log_p"))
    copies = summed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = marked.select("doc_id", "lang", "held_out", "mark", F.octet_length("text").cast("long").alias("n_bytes"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    return salted.join(copies, ["mark", "salt"], "left").select("doc_id", "lang", "held_out", "n_bytes", F.coalesce("log_p", F.lit(0.0)).alias("log_p"))


def length_class(n_bytes: Column) -> Column:
    """Texts of 4**k to 4**(k+1) - 1 bytes: the mean over a short text varies more."""
    return F.floor(F.log2(F.greatest(n_bytes, F.lit(1)).cast("double")) / 2).cast("int")


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity (per byte), threshold and keep of every row of ``docs``.

    Trusted are the documents of quality 1 in ``labels``, all of them: the model is trained on those whose texts' hash is not
    divisible by FOLDS, and thresholds are quantiles of the others (of all if there are none). Null and empty texts have no
    perplexity and are not kept; a null lang is a language of its own. Rows that repeat are judged each by itself. Without trusted texts there is
    no threshold, and every text but the empty ones is kept. Empty tables give no rows.
    """
    base = workspace(docs.sparkSession, "kneser-ney")
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = F.broadcast(good) if small_enough(good, BROADCAST_IDS) else good
    rows = texts_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("held_out", F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0)
    trusted = rows.join(good, "doc_id", "left_semi").filter("not held_out").select("text")
    counts = written(trusted.mapInArrow(count_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), f"{base}/counts")
    needed = written(rows.select("text").mapInArrow(count_grams, "gram long, n long").select("gram").distinct(), f"{base}/needed")
    figures = written(log_likelihoods(rows, probabilities(counts, needed, base)), f"{base}/figures")
    perplexity = F.when(F.col("n_bytes") > 0, F.exp(-F.col("log_p") / F.col("n_bytes")))
    judged = figures.select("doc_id", "lang", "held_out", "n_bytes", length_class(F.col("n_bytes")).alias("class"), perplexity.alias("perplexity"))
    known = judged.join(good, "doc_id", "left_semi").filter("perplexity is not null")
    unseen = known.filter("held_out")
    known = known if unseen.isEmpty() else unseen
    # A row for each language and class.
    cut = F.percentile_approx("perplexity", quantile, 10_000)
    of_all = known.agg(cut.alias("of_all")).first()["of_all"]
    by_lang = known.groupBy("lang").agg(cut.alias("of_lang"), F.count("*").alias("k")).filter(F.col("k") >= LEAST_TRUSTED).select(F.col("lang").alias("l"), "of_lang")
    by_class = known.groupBy("lang", "class").agg(cut.alias("own"), F.count("*").alias("k")).filter(F.col("k") >= LEAST_TRUSTED).select(F.col("lang").alias("l2"), F.col("class").alias("c2"), "own")
    small = lambda df: F.broadcast(df) if small_enough(df, 100_000) else df
    out = judged.join(small(by_lang), F.col("lang").eqNullSafe(F.col("l")), "left").join(small(by_class), F.col("lang").eqNullSafe(F.col("l2")) & (F.col("class") == F.col("c2")), "left")
    out = out.withColumn("threshold", F.when(F.col("n_bytes") > 0, F.coalesce("own", "of_lang", F.lit(of_all).cast("double"))))
    keep = F.coalesce((F.col("perplexity") <= F.col("threshold")) | (F.col("perplexity").isNotNull() & F.col("threshold").isNull()), F.lit(False))
    return out.select("doc_id", "lang", "n_bytes", "perplexity", "threshold", keep.alias("keep"))
