"""Order MinHash of documents: fingerprints whose likeness follows the edit distance.

Every K characters of a text make a k-mer, numbered by its occurrence. Hashes of the numbered k-mers fall into BINS equal
ranges; in each, the TAKE least are chosen, put into the order in which they stand in the text, and hashed as a tuple. One
hash of each k-mer so serves all bins. A text of fewer than K characters is a single k-mer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorline.llm.shared import mix, texts_of

K = 12
BINS = 64
TAKE = 2

#: Bits of a sort key that hold a k-mer's place; the hash has the rest.
LOW = 26
_ODD = np.uint64(0x9E3779B97F4A7C15)
FINGERPRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def kmer_hashes(text: str, k: int = K) -> np.ndarray:
    """Hashes of the k-mers in turn, by doubling: a run of 2n characters from two of n."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(codes):
        return codes
    k = min(k, len(codes))
    odd = int(_ODD)
    power, n, bits = odd, 1, f"{k:b}"[1:]
    h = codes + np.uint64(1)
    base = h
    for bit in bits:
        h = h[:-n] * np.uint64(power) + h[n:]
        power, n = power * power % 2**64, 2 * n
        if bit == "1":
            h = h[:-1] * _ODD + base[n:][: len(h) - 1]
            power, n = power * odd % 2**64, n + 1
    return mix(h + np.uint64(k))


def sorted_places(h: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The upper 64 - LOW bits of the hashes in ascending order, ties by place, and their places."""
    upper = h >> np.uint64(LOW)
    if len(h) >= 1 << LOW:
        order = np.lexsort((places, upper))
        return upper[order], places[order]
    key = np.sort((upper << np.uint64(LOW)) | places)
    return key >> np.uint64(LOW), key & np.uint64((1 << LOW) - 1)


def fingerprint(text: str, k: int = K, bins: int = BINS, take: int = TAKE) -> np.ndarray:
    """A 16-bit number for each bin, 0 where no k-mer fell into it."""
    out = np.zeros(bins, np.uint16)
    h = kmer_hashes(text, k)
    n = len(h)
    if not n:
        return out
    kmer, at = sorted_places(h, np.arange(n, dtype=np.uint64))
    new = np.flatnonzero(np.concatenate(([True], kmer[1:] != kmer[:-1])))
    nth = np.arange(n, dtype=np.uint64)
    nth -= np.repeat(new, np.diff(np.append(new, n))).astype(np.uint64)
    item, at = sorted_places(mix(kmer * _ODD + nth), at)
    edge = np.searchsorted(item, np.arange(bins, dtype=np.uint64) * np.uint64((1 << 64 - LOW) // bins))
    end = np.append(edge[1:], n)
    chosen = edge[:, None] + np.arange(take)
    held = chosen < end[:, None]
    take_at = np.minimum(chosen, n - 1)
    order = np.argsort(np.where(held, at[take_at].astype(np.int64), 1 << 62), axis=1, kind="stable")
    value, held = np.take_along_axis(item[take_at], order, 1), np.take_along_axis(held, order, 1)
    tuples = np.zeros(bins, np.uint64)
    for j in range(take):
        tuples = np.where(held[:, j], mix(tuples * _ODD + value[:, j] + np.uint64(1)), tuples)
    number = (tuples >> np.uint64(48)).astype(np.uint16)
    return np.where(held[:, 0], np.maximum(number, 1), 0).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of bins, of those in which either has k-mers, in which both have the same tuple; 1 if neither has any."""
    used = (a > 0) | (b > 0)
    return float(((a == b) & used).sum() / used.sum()) if used.any() else 1.0


def as_text(x: np.ndarray) -> str:
    return x.astype(">u2").tobytes().hex()


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the order of documents: place (doc_id, the largest number for none) and turn (a hash of the text)."""
    rows = texts_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.withColumn("place", F.coalesce("doc_id", F.lit(2**63 - 1))).withColumn("turn", F.xxhash64("text"))


class Ranges:
    """Ranges of (place, turn) of about equally many documents: the bounds of places, of which one that holds several ranges'
    documents repeats, its ranges parting them by turn."""

    def __init__(self, bounds: list[int]) -> None:
        self.bounds = np.array(sorted(bounds), np.int64)

    def of(self, place: np.ndarray, turn: np.ndarray) -> np.ndarray:
        left, right = (np.searchsorted(self.bounds, place, side) for side in ("left", "right"))
        share = turn.astype(np.float64) / 2.0**64 + 0.5
        own = 1 + np.minimum((share * (right - left)).astype(np.int64), right - left - 1)
        return np.where(right > left, left + own, left)


def ranged(rows: DataFrame, n: int) -> tuple[DataFrame, int]:
    """``rows`` with part, the range that a document is in, and guest: the first of a range is also in the range before.

    What reaches the driver is a bound and a first document's key for each range, and no text.
    """
    found = rows.agg(F.percentile_approx("place", [i / n for i in range(1, n)], 10_000).alias("at")).first() if n > 1 else None
    ranges = rows.sparkSession.sparkContext.broadcast(Ranges(list(found["at"] or []) if found else []))

    @F.pandas_udf("long")
    def part(place: pd.Series, turn: pd.Series) -> pd.Series:
        return pd.Series(ranges.value.of(place.to_numpy(), turn.to_numpy()))

    dealt = rows.withColumn("part", part("place", "turn"))
    firsts = sorted((r["part"], r["key"]["place"], r["key"]["turn"]) for r in dealt.groupBy("part").agg(F.min(F.struct("place", "turn")).alias("key")).collect())
    sent = rows.sparkSession.sparkContext.broadcast({(place, turn): firsts[i - 1][0] for i, (_, place, turn) in enumerate(firsts)})

    @F.pandas_udf("array<struct<part:long,guest:boolean>>")
    def parts(place: pd.Series, turn: pd.Series) -> pd.Series:
        own, before = ranges.value.of(place.to_numpy(), turn.to_numpy()), sent.value
        guests = (before.get(key) for key in zip(place.tolist(), turn.tolist(), strict=True))
        return pd.Series([[(int(p), False)] if g is None else [(int(p), False), (g, True)] for p, g in zip(own, guests, strict=True)])

    return rows.withColumn("at", F.explode(parts("place", "turn"))).select("doc_id", "text", "place", "turn", "at.part", "at.guest"), len(ranges.value.bounds) + 1


def fingerprint_edits(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likenesses.

    The edited text's last floor(n_chars / 4) characters give way to the first as many, or all, of the next document by
    doc_id (after the last: the first). Null texts are empty. Rows of one doc_id are in the order of a hash of their texts; rows
    without one come last, in that order. A single document is its own next; an empty table gives no rows. Texts move once, to
    ranges of the order; besides, the first document of each range goes to the range before, that of the first to the last.
    """
    spark = docs.sparkSession
    home, n = ranged(keyed(docs), partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, str, np.ndarray] | None = None
        at = None
        schema = pa.schema([(k.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[k.split()[1]]) for k in FINGERPRINTS.split(", ")])
        names = schema.names
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, part, guest in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if part != at:
                    at, held = part, None
                if held is None and guest:
                    continue
                print_ = fingerprint(text)
                if held is not None:
                    key, mine, own = held
                    cut = len(mine) // 4
                    edited = mine[: len(mine) - cut] + text[:cut]
                    other = fingerprint(edited)
                    out.append((key, len(mine), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own), as_text(other), likeness(own, other), likeness(own, print_)))
                held = None if guest else (doc_id, text, print_)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], names)

    placed = home.repartitionById(n, F.col("part").cast("int")).sortWithinPartitions("part", "guest", "place", "turn", "text")
    return placed.select("doc_id", "text", "part", "guest").mapInArrow(run, FINGERPRINTS)
