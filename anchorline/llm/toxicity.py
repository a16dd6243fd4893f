"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are the hash buckets of its lower-cased 3- to 5-grams, each as 1 + log of how often it occurs. Fitted are,
on a bounded sample of the labelled rows: the buckets' log-count ratios, drawn towards 0 as far as chance may have made
them, and a logistic regression on the features times these, each text scaled to length 1. All buckets of LEAST_TEXTS
sampled texts or more have a weight. The sampled texts' features go to the driver as the packed gaps between their numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorline.llm.shared import small_enough, texts_of, workspace, written

BITS = 22
SIZES = (3, 4, 5)
#: Labelled rows of each label to fit on, at most: those with the least hash of their keys.
FIT_ROWS = 3000
#: Sampled texts without which a bucket has no weight.
LEAST_TEXTS = 2
#: Characters of a text that are looked at together.
PIECE = 1 << 20
SMOOTHING = 1.0
EPOCHS, RATE = 10, 0.5
#: A toxic text that is missed weighs as much as so many clean ones that are not.
MISSED = 2.0
#: One of so many sampled texts is left out of the fit that the scores' level and spread are taken from.
FOLDS = 5
#: The square of the z at which half of a bucket's ratio is taken; below it less, and far below hardly any.
HALF_Z2 = 16.0
BROADCAST_ROWS = 1_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


class Model(NamedTuple):
    kept: np.ndarray  # the buckets that have a weight, in ascending order
    ratios: np.ndarray  # of each its log-count ratio, drawn towards 0
    weights: np.ndarray  # of each the regression's weight
    bias: float

    def wanted(self) -> np.ndarray:
        """Of each bucket whether it has a weight."""
        out = np.zeros(1 << BITS, bool)
        out[self.kept] = True
        return out

    def logit(self, text: str, wanted: np.ndarray) -> float:
        at, n = counted(buckets(text, wanted))
        k = np.searchsorted(self.kept, at)
        return self.bias + float(self.weights[k] @ scaled(self.ratios[k], n))


NOTHING = np.zeros(0, np.int32)


def buckets(text: str, wanted: np.ndarray | None = None) -> np.ndarray:
    """The buckets of a text's n-grams, those that ``wanted`` marks, as often as they occur.

    Long texts come in pieces that overlap by the longest n-gram less one character; what stands in the overlap counts twice.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    found = [np.zeros(0, np.uint32)]
    for i in range(0, len(codes), PIECE):
        c = codes[i : i + PIECE + SIZES[-1] - 1].astype(np.uint64) + np.uint64(1)
        h = c * _ODD
        for n in range(2, SIZES[-1] + 1):
            if len(c) < n:
                break
            h = (h[:-1] + c[n - 1 :]) * _ODD
            if n in SIZES:
                at = ((h ^ (h >> np.uint64(29))) * _ODD >> np.uint64(64 - BITS)).astype(np.uint32)
                found.append(at if wanted is None else at[wanted[at]])
    return np.concatenate(found)


def counted(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets once each, in ascending order, and 1 + log of how often they occur."""
    at, n = np.unique(found, return_counts=True)
    return at, (1 + np.log(n)).astype(np.float32)


def scaled(ratios: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A text's features times their ratios, scaled to length 1."""
    v = ratios * n
    return v / np.float32(max(1e-9, float(np.sqrt(v @ v))))


def bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, text -> bucket, n0, n1: a task's texts of each label that have the bucket."""
    n = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n[label, np.unique(buckets(text))] += 1
    at = np.flatnonzero(n.any(0))
    for i in range(0, len(at), 100_000):
        part = at[i : i + 100_000]
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(part.astype(np.int32)), "n0": pa.array(n[0, part]), "n1": pa.array(n[1, part])})


def log_ratios(n0: np.ndarray, n1: np.ndarray, rows: tuple[float, float]) -> np.ndarray:
    """Of each bucket: log of its smoothed share in texts of label 1 over that in texts of label 0."""
    return np.log((n1 + SMOOTHING) / (rows[1] + 2 * SMOOTHING)) - np.log((n0 + SMOOTHING) / (rows[0] + 2 * SMOOTHING))


def features(n0: np.ndarray, n1: np.ndarray, rows: tuple[float, float]) -> np.ndarray:
    """Of each bucket its log-count ratio, less the more the difference of its shares may be chance."""
    share = (n0 + n1 + SMOOTHING) / (sum(rows) + 2 * SMOOTHING)
    z2 = (n1 / rows[1] - n0 / rows[0]) ** 2 / (share * (1 - share) * (1 / rows[0] + 1 / rows[1]))
    return log_ratios(n0, n1, rows) * z2**2 / (z2**2 + HALF_Z2**2)


Text = tuple[np.ndarray, np.ndarray]  # the numbers of its features, and 1 + log of how often they occur


class Packed:
    """A sampled text's features as the gaps between their numbers and their counts, deflated: some two bytes each."""

    def __init__(self, data: bytes, size: int) -> None:
        self.data, self.size = data, size

    @staticmethod
    def bytes_of(numbers: np.ndarray, times: np.ndarray) -> bytes:
        return zlib.compress(np.diff(numbers, prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes() + times.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)

    def text(self) -> Text:
        raw = np.frombuffer(zlib.decompress(self.data), np.uint8)
        gaps, times = (part.reshape(4, self.size).T.copy().view("<u4").ravel() for part in (raw[: 4 * self.size], raw[4 * self.size :]))
        return np.cumsum(gaps.astype(np.int64)), (1 + np.log(times)).astype(np.float32)


def logistic(texts: list[Packed], ratios: np.ndarray, y: np.ndarray, importance: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the features and a bias, by AdaGrad on the weighted log loss, a text after another.

    The order of an epoch only depends on the number of texts.
    """
    importance = importance / importance.mean()
    w, g2 = np.zeros(len(ratios), np.float32), np.full(len(ratios), 1e-8, np.float32)
    b, b2 = float(np.log((importance * y).sum() / (importance * (1 - y)).sum())), 1.0
    # Scale so that a text's features do not outgrow the steps.
    step = np.float32(1 / max(1e-6, sum(float(np.abs(scaled(ratios[k], n)).sum()) for k, n in (t.text() for t in texts)) / len(y)))
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            k, n = texts[i].text()
            xi, wi = scaled(ratios[k], n) * step, w[k]
            error = importance[i] * (1 / (1 + np.exp(-np.clip(b + float(wi @ xi), -30, 30))) - y[i])
            g = np.float32(error) * xi
            h = g2[k] + g * g
            g2[k], w[k] = h, wi - np.float32(RATE) * g / np.sqrt(h)
            b2 += error * error
            b -= RATE * error / np.sqrt(b2)
    return w * step, float(b)


def level(z: np.ndarray, y: np.ndarray, importance: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logits of texts that were not fitted on, by Newton's steps on smoothed labels (Platt), of which
    those of 1 weigh MISSED times as much."""
    n0, n1 = float((y == 0).sum()), float((y == 1).sum())
    if not n0 or not n1:
        return 1.0, 0.0
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    importance = importance * np.where(y == 1, MISSED, 1.0)
    weight, x, v = importance / importance.mean(), np.stack([z, np.ones(len(z))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(v @ x, -30, 30)))
        # A pull to slope 1 and shift 0, of the weight of one text.
        step = np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + np.eye(2), x @ (weight * (p - target)) + v - [1.0, 0.0])
        v = v - step * min(1.0, 2 / max(1e-9, float(np.abs(step).max())))
    return max(float(v[0]), 0.05), float(v[1])


def fitted(texts: list[Packed], n0: np.ndarray, n1: np.ndarray, y: np.ndarray, importance: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Ratios, weights and bias of all sampled texts, with the level and spread that scores of unseen texts have."""
    out = np.arange(len(y)) % FOLDS == 0
    a0, a1 = n0.copy(), n1.copy()
    for i in np.flatnonzero(out):
        (a1 if y[i] else a0)[texts[i].text()[0]] -= 1
    slope, shift = 1.0, 0.0
    rows = (float((y[~out] == 0).sum()), float((y[~out] == 1).sum()))
    if all(rows):
        x = (features(a0, a1, rows) * (a0 + a1 >= LEAST_TEXTS)).astype(np.float32)
        w, b = logistic([texts[i] for i in np.flatnonzero(~out)], x, y[~out], importance[~out])
        z = [b + float(w[k] @ scaled(x[k], n)) for k, n in (texts[i].text() for i in np.flatnonzero(out))]
        slope, shift = level(np.array(z), y[out], importance[out])
    x = features(n0, n1, (float((y == 0).sum()), float((y == 1).sum()))).astype(np.float32)
    w, b = logistic(texts, x, y, importance)
    return x, w * np.float32(slope), b * slope + shift


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The model from labelled rows whose crc32 of the doc_id as text is not divisible by 5.

    Of each label at most ``fit_rows`` whose doc_id is in ``docs`` are taken, by the hash of the doc_id; importance weights give the labels back their
    shares. Rows of ``labels`` without doc_id or with another toxic value than 0 and 1 are left out; a doc_id with several
    rows counts as toxic if any is. With no row of either label the model gives every text the share of label 1.
    """
    held_in = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("label"))
    )
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    held_in = ids.join(F.broadcast(held_in) if small_enough(held_in, BROADCAST_ROWS) else held_in, "doc_id").select("doc_id", "label").distinct()
    held_in = written(held_in, workspace(docs.sparkSession, "labelled"))
    totals = {r["label"]: r["n"] for r in held_in.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    chosen = None
    for label in (0, 1):
        part = held_in.filter(F.col("label") == label).orderBy(order, "doc_id").limit(fit_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # At most 2 * fit_rows rows of ids, so they may be broadcast.
    sample = texts.join(F.broadcast(chosen), "doc_id").select("label", "text", F.xxhash64("doc_id", "text").alias("place")).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).persist()
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rows = (float(n.get(0, 0)), float(n.get(1, 0)))
    share = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
    if not all(rows):
        sample.unpersist()
        return Model(NOTHING, NOTHING.astype(np.float32), NOTHING.astype(np.float32), float(np.log(share / (1 - share))))
    counts = sample.mapInArrow(bucket_counts, "bucket int, n0 int, n1 int").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))

    found = counts.filter(F.col("n0") + F.col("n1") >= LEAST_TEXTS).toArrow()
    kept = found["bucket"].to_numpy()
    order = np.argsort(kept)
    kept = kept[order]
    n0, n1 = (found[c].to_numpy()[order].astype(float) for c in ("n0", "n1"))
    number = np.full(1 << BITS, -1, np.int32)
    number[kept] = np.arange(len(kept))
    numbers = docs.sparkSession.sparkContext.broadcast(number)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = numbers.value >= 0
        for batch in batches:
            found = [np.unique(buckets(t, wanted), return_counts=True) for t in batch.column(1).to_pylist()]
            data, size = [Packed.bytes_of(numbers.value[at], n) for at, n in found], [len(at) for at, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(data, pa.binary()), pa.array(size, pa.int32())], ["label", "place", "data", "size"])

    lists = sample.mapInArrow(packed, "label int, place long, data binary, size int").toArrow()
    sample.unpersist()
    # One order, however the rows were dealt.
    turn = np.argsort(lists["place"].to_numpy(), kind="stable")
    y = lists["label"].to_numpy()[turn].astype(float)
    texts = [Packed(data, size) for data, size in zip(lists["data"].to_pylist(), lists["size"].to_pylist(), strict=True)]
    texts = [texts[i] for i in turn]
    importance = np.where(y == 1, totals[1] / rows[1], totals[0] / rows[0])
    return Model(kept, *fitted(texts, n0, n1, y, importance))


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a double column toxicity from 0 to 1; null and empty texts have the score of no feature."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    # Of Arrow arrays: a worker that has no need of pandas is some 50 MB smaller, for as long as it lives.
    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        wanted = model.wanted()
        for texts in parts:
            z = np.array([model.logit(t or "", wanted) for t in texts.to_pylist()], float)
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return texts_of(docs).withColumn("toxicity", score(F.col("text")))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (1 at a score of 0.5) of every row of ``docs``; a null doc_id is not held out."""
    scored = score_texts(docs.select("doc_id", "text"), fit(docs, labels, fit_rows))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"))
