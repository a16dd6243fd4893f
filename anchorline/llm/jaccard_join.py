"""N-gram Jaccard join by chosen paths.

A document is the set of its 5-word shingles. Documents with equal sets form a class, and one of each class goes on. It
is embedded as COORDINATES MinHash values, of which two documents share about as large a part as their sets' Jaccard
similarity. A run splits all documents again and again: a node of the path chooses one coordinate, and now and then a
second, and its documents part by their values there. Nodes of few documents are compared by brute force; nodes that
are still large after DEPTH splits, or that a split leaves nearly whole, are compared in blocks. Runs are repeated until
the chance of finding a pair at the threshold reaches the target recall. Of pairs that the embeddings leave possible the
exact sets decide.

Many runs find a large group of near copies again and again. Each document is therefore at home in the largest of its
large nodes; documents of one home are compared there alone, so other nodes only compare documents of different homes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.llm.shared import SALTS, mix, row_mark, small_enough, spread_join, texts_of, workspace, written

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
COORDINATES = 64
DEPTH = 4
#: Documents of a node, and of a block of a larger node, that are compared by brute force.
BRUTE = 128
#: Strays of a large node that go to each of its blocks; with more, all are compared in pairs of blocks.
STRAYS = 4 * BRUTE
#: Share of nodes that choose a second coordinate, so that a pair at the threshold has one child on average.
SECOND = 1 / THRESHOLD - 1
RUNS_AT_ONCE = 4
#: Standard deviations below the threshold at which the embeddings rule a pair out.
SLACK = 4.5
BROADCAST_ROWS = 1_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


#: Odd multipliers of the MinHash functions.
_MULTIPLIERS = mix(np.arange(1, 1025, dtype=np.uint64) * _ODD) | np.uint64(1)


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words; none of a null text."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """The set of n-word shingles in ascending order; all words make one if there are fewer."""
    w = words.astype(np.int64).view(np.uint64)
    if not len(w):
        return w
    n = min(n, len(w))
    h = w[: len(w) - n + 1] * _ODD
    for j in range(1, n):
        h = (h ^ (h >> np.uint64(31))) * _ODD + w[j : len(w) - n + 1 + j]
    return np.unique(mix(h + np.uint64(n)))


def embed(s: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Of each MinHash function the upper 32 bits of the least value."""
    out = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, (1 << 20) // coordinates)
    for i in range(0, len(s), step):
        out = np.minimum(out, (_MULTIPLIERS[:coordinates, None] * s[None, i : i + step]).min(axis=1))
    return (out >> np.uint64(32)).astype(np.uint32)


def lists(column: pa.Array) -> Iterator[np.ndarray]:
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield values[offsets[i] : offsets[i + 1]]


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, words, text_hash, mark -> doc_id, mark, set_hash (two numbers), size, values."""
    for batch in batches:
        size, a, b, values = [], [], [], []
        for words, text in zip(lists(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            s = shingles(words)
            size.append(len(s))
            if len(s):
                a.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                b.append(int(mix(s ^ _ODD).sum(dtype=np.uint64).view(np.int64)))
            else:
                a.append(text)
                b.append(-1)
            values.append(embed(s))
        flat = np.concatenate(values).view(np.int32) if values else np.zeros(0, np.int32)
        column = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * COORDINATES), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(size, pa.int32()), column], ["doc_id", "mark", "hash_a", "hash_b", "size", "values"])


def survival(depth: int, similarity: float = THRESHOLD, second: float = SECOND) -> float:
    """The chance that a pair of such similarity is still together in some node after so many splits of a run."""
    p = 1.0
    for _ in range(depth):
        p = 1 - (1 - similarity * p) * (1 - second * similarity * p)
    return p


def children(run: Column, path: Column, values: Column) -> Column:
    """The nodes below a node to which a document goes: one for each coordinate that the node chooses."""
    seed = F.xxhash64(path, run)
    first = F.pmod(seed, F.lit(COORDINATES)).cast("int")
    second = F.pmod(F.xxhash64(seed, F.lit(2)), F.lit(COORDINATES)).cast("int")
    down = lambda i: F.xxhash64(seed, i, F.element_at(values, i + 1))
    twice = (F.pmod(F.xxhash64(seed, F.lit(3)), F.lit(10_000)) < int(SECOND * 10_000)) & (first != second)
    return F.when(twice, F.array(down(first), down(second))).otherwise(F.array(down(first)))


def nodes(reps: DataFrame, first_run: int, runs: int, base: str) -> tuple[DataFrame, int]:
    """path, rep, count of the nodes of two documents or more at which some runs end, and the deepest split."""
    spread = reps.select("rep", "values", F.explode(F.sequence(F.lit(first_run), F.lit(first_run + runs - 1))).alias("run"))
    level = spread.select("rep", F.explode(children(F.col("run"), F.lit(0), F.col("values"))).alias("path"))
    level = written(level.withColumn("above", F.lit(None).cast("long")), f"{base}/level-{first_run}-1")
    done, depth = [], 1
    while True:
        counts = level.groupBy("path").agg(F.count("*").alias("count")).filter(F.col("count") > 1)
        counted = written(spread_join(level, counts, ["path"], BROADCAST_ROWS), f"{base}/counted-{first_run}-{depth}")
        # As many of its parent's documents as pairs at the threshold leave together: more splits would not part them.
        whole = F.coalesce(F.col("count") >= THRESHOLD * F.col("above"), F.lit(False))
        ends = (F.col("count") <= BRUTE) | whole
        large = counted.filter(~ends)
        if depth == DEPTH or large.isEmpty():
            done.append(counted.select("path", "rep", "count"))
            break
        done.append(counted.filter(ends).select("path", "rep", "count"))
        again = large.select("rep", "path", "count").join(reps.select("rep", "values"), "rep")
        level = written(again.select("rep", F.explode(children(F.lit(depth), F.col("path"), F.col("values"))).alias("path"), F.col("count").alias("above")), f"{base}/level-{first_run}-{depth + 1}")
        depth += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out, depth


def homes(members: DataFrame) -> DataFrame:
    """rep, paths, home: of each document its nodes in ascending order and the largest of the large ones, 0 if none is."""
    largest = F.max(F.when(F.col("count") > BRUTE, F.struct("count", "path")))["path"]
    return members.groupBy("rep").agg(F.sort_array(F.collect_set("path")).alias("paths"), F.coalesce(largest, F.lit(0)).alias("home"))


def tallies(members: DataFrame, at: DataFrame) -> DataFrame:
    """path, host, strays of each large node: the home of most of its documents, and the number of the others."""
    large = members.filter(F.col("count") > BRUTE).join(at.select("rep", "home"), "rep")
    each = large.groupBy("path", "home").agg(F.count("*").alias("n"))
    return each.groupBy("path").agg(F.max_by("home", F.struct("n", "home")).alias("host"), (F.sum("n") - F.max("n")).alias("strays"))


#: What a document is in its node: compared with all there, one of many that are at home in another node, or a stray there.
ALL, HOSTED, STRAY = 0, 1, 2


def blocks(members: DataFrame) -> DataFrame:
    """``members`` (path, rep, count, home, host, strays, ...) with the pairs of blocks in which each is compared: row,
    column, its own block, and what it is.

    A node of up to BRUTE documents is one block. Of a larger one, each document goes to its block's pairs with all blocks.
    Where most are at home in another node and few are not, only these strays go to all blocks, the others to their own.
    """
    n = F.ceil(F.col("count") / BRUTE).cast("int")
    mine = F.pmod(F.xxhash64("rep", F.lit(7)), n).cast("int")
    others = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.least(mine, k).alias("row"), F.greatest(mine, k).alias("column")))
    alone = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("row"), k.alias("column")))
    own = F.array(F.struct(mine.alias("row"), mine.alias("column")))
    light = F.coalesce((F.col("host") != F.col("path")) & (F.col("strays") <= STRAYS), F.lit(False))
    what = F.when(~light, ALL).when(F.col("home") == F.col("host"), HOSTED).otherwise(STRAY)
    # Where nobody strays from a home elsewhere, nothing is left to compare.
    here = members.filter(~(light & (F.col("strays") == 0))).withColumn("what", what).withColumn("block", mine)
    return here.withColumn("pair", F.explode(F.when(what == ALL, others).when(what == HOSTED, own).otherwise(alone))).select("*", "pair.row", "pair.column").drop("pair")


#: Embeddings that share fewer values rule a pair out.
LEAST_SHARED = (THRESHOLD - SLACK * (THRESHOLD * (1 - THRESHOLD) / COORDINATES) ** 0.5) * COORDINATES


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches, sorted by their first three columns, cut where these change; with the bounds of their groups."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        rows = batch if held is None else pa.concat_batches([held, batch])
        keys = [rows.column(i).to_numpy() for i in range(3)]
        starts = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0)))) if rows.num_rows else np.zeros(1, int)
        if len(starts) > 1:
            yield rows.slice(0, starts[-1]), starts
        held = rows.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


def padded(column: pa.Array, fill: int) -> np.ndarray:
    """Lists as the rows of a matrix."""
    size = np.diff(column.offsets.to_numpy())
    out = np.full((len(column), max(1, int(size.max(initial=1)))), fill, np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


class Members:
    """The rows of some pairs of blocks: which of their pairs are to be compared there.

    Those across the two blocks, or within the one, that share no node before this: a pair that meets in several nodes
    is compared in the least of them alone, or in its home if it has one home. Two strays are compared in one of the blocks.
    """

    def __init__(self, rows: pa.RecordBatch) -> None:
        self.path, row, column, self.block, self.rep = (rows.column(i).to_numpy() for i in range(5))
        self.row, self.inner = row, row == column
        self.home, self.stray = rows.column(6).to_numpy(), rows.column(7).to_numpy() == STRAY
        self.left, self.right = (padded(rows.column(5), np.iinfo(np.int64).min + k) for k in (0, 1))

    def here(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = (self.inner[i] | (self.block[i] != self.block[j])) & (self.rep[i] != self.rep[j])
        ok &= ~(self.stray[i] & self.stray[j]) | (self.row[i] == np.minimum(self.block[i], self.block[j]))
        housed = (self.home[i] == self.home[j]) & (self.home[i] != 0)
        ok &= ~housed | (self.home[i] == self.path[i])
        step = max(1, (1 << 22) // self.left.shape[1] ** 2)
        for k in range(0, len(i), step):
            part = np.flatnonzero((ok & ~housed)[k : k + step]) + k
            a, b = self.left[i[part]], self.right[j[part]]
            met = (a[:, :, None] == b[:, None, :]) & (a < self.path[i[part]][:, None])[:, :, None]
            ok[part[met.any((1, 2))]] = False
        return ok


MEMBERS = "path long, row int, column int, block int, rep long, paths array<long>, home long, what int, copies long"


def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MEMBERS, size, values -> MEMBERS of the documents that have a possible partner where they are compared."""
    for rows, bounds in whole_groups(batches):
        members, n = Members(rows), rows.num_rows
        size = rows.column(9).to_numpy()
        values = rows.column(10).flatten().to_numpy(zero_copy_only=False).reshape(n, COORDINATES)
        last = np.repeat(bounds[1:], np.diff(bounds))
        found = np.zeros(n, bool)
        i = np.arange(n)
        for d in range(1, int(np.diff(bounds).max(initial=1))):
            i = i[i + d < last[i]]
            j = i + d
            near = i[np.minimum(size[i], size[j]) >= THRESHOLD * np.maximum(size[i], size[j])]
            near = near[(values[near] == values[near + d]).sum(1) >= LEAST_SHARED]
            near = near[members.here(near, near + d)]
            found[near] = found[near + d] = True
        yield rows.filter(pa.array(found)).select(list(range(9)))


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    number = np.cumsum(new) - 1
    often = np.bincount(number) > 1
    keep = often[number]
    number, owner = (np.cumsum(often) - 1)[number[keep]], owner[keep]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, 8192):
        i, j = np.searchsorted(number, (lo, lo + 8192))
        x = np.zeros((len(sets), 8192), np.float32)
        x[owner[i:j], number[i:j] - lo] = 1
        out += x @ x.T
    return out.astype(np.int64)


def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MEMBERS, shingles -> rep, lead, linked: of each document the copies of its partners here, and the least
    document that they lead to."""
    for rows, bounds in whole_groups(batches):
        members, copies = Members(rows), rows.column(8).to_numpy()
        out: list[list[np.ndarray]] = [[], [], []]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo < 2:
                continue
            sets = list(lists(rows.column(9).slice(lo, hi - lo)))
            size = np.array([len(x) for x in sets])
            shared = shared_counts(sets)
            # shared / union >= THRESHOLD, in whole numbers.
            near = 100 * shared >= round(100 * THRESHOLD) * (size[:, None] + size[None, :] - shared)
            np.fill_diagonal(near, False)
            i, j = np.nonzero(near)
            ok = members.here(i + lo, j + lo)
            near[i[~ok], j[~ok]] = False
            rep = members.rep[lo:hi]
            lead = rep
            while True:
                now = np.minimum(lead, np.where(near, lead[None, :], np.iinfo(np.int64).max).min(1))
                if (now == lead).all():
                    break
                lead = now
            found = near.any(1)
            for x, y in zip(out, (rep[found], lead[found], (near * copies[None, lo:hi]).sum(1)[found]), strict=True):
                x.append(y)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["rep", "lead", "linked"])


def components(edges: DataFrame, base: str) -> DataFrame:
    """rep, group of the connected parts of rep - lead edges: the least rep of each, by alternating star steps."""
    edges = written(edges.filter("rep <> lead").select(F.greatest("rep", "lead").alias("u"), F.least("rep", "lead").alias("v")).distinct(), f"{base}/edges-0")
    k = 0
    while True:
        k += 1
        # Large star: neighbours above a node go to its least neighbour. Small star: those below it do.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both, least, ["u"], BROADCAST_ROWS).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, down, ["u"], BROADCAST_ROWS).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        after = written(small, f"{base}/edges-{k}")
        if after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty():
            return after.select(F.col("u").alias("rep"), F.col("v").alias("group"))
        edges = after


def grouped(df: DataFrame) -> DataFrame:
    """The rows of each pair of blocks, about BRUTE + STRAYS at most, one after another."""
    return df.repartition("path", "row", "column").sortWithinPartitions("path", "row", "column", "rep")


def jaccard_classes(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id and n_links of every document.

    Linked are documents whose shingle sets have a Jaccard similarity of THRESHOLD or more; class_id is the least doc_id
    that links lead to, n_links the number of other documents linked directly. Texts without words are linked to equal
    texts (null counts as empty). Rows without a doc_id have none to be linked by: they return with a null class and no
    links. Rows that repeat a doc_id count as documents each, and return each. Empty tables give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    out = marked_classes(rows.filter("doc_id is not null"), recall).select("doc_id", "class_id", "n_links")
    return out.unionByName(rows.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def marked_classes(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """doc_id, mark, class_id, class_mark, n_links of every row, rows without a doc_id as documents like the others.

    The first document of a class, by class_id and class_mark, is that of the least doc_id and of these the least mark; one
    without a doc_id comes first only where none has one.
    """
    spark = docs.sparkSession
    base = workspace(spark, "jaccard")
    rows = texts_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).withColumn("mark", row_mark())
    prepared = rows.select("doc_id", word_hashes(F.col("text")).alias("words"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "mark")
    sketches = written(prepared.mapInArrow(sketch, "doc_id long, mark string, hash_a long, hash_b long, size int, values array<int>"), f"{base}/sketches")
    # Classes are numbered, as two of them may have one least doc_id; written, the numbers stay as they are.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    same = written(sketches.groupBy("hash_a", "hash_b").agg(first, F.count("*").alias("members")).withColumn("rep", F.monotonically_increasing_id()), f"{base}/classes")
    # The first document of a class stands for it; rows that repeat it are one.
    reps = sketches.filter("size > 0").join(same.select(F.col("first.mark").alias("mark"), "rep", "members"), "mark")
    reps = written(reps.select("rep", "mark", "members", "size", "values").dropDuplicates(["rep"]), f"{base}/reps")

    parts, missed, run = [], 1.0, 0
    while 1 - missed < recall:  # every run finds a pair with a chance above 0
        found, depth = nodes(reps, run, RUNS_AT_ONCE, base)
        parts.append(found)
        missed *= (1 - survival(depth)) ** RUNS_AT_ONCE
        run += RUNS_AT_ONCE
    members = parts[0]
    for part in parts[1:]:
        members = members.unionByName(part)
    at = written(homes(members), f"{base}/homes")
    tallied = written(tallies(members, at), f"{base}/tallies")
    placed = blocks(spread_join(members.join(at.join(reps.select("rep", F.col("members").alias("copies"), "size", "values"), "rep"), "rep"), tallied, ["path"], BROADCAST_ROWS, "left", leave=["values"]))
    active = written(grouped(placed.select("path", "row", "column", "block", "rep", "paths", "home", "what", "copies", "size", "values")).mapInArrow(possible, MEMBERS), f"{base}/active")

    chosen = written(active.select("rep").distinct().join(reps.select("rep", "mark"), "rep"), f"{base}/chosen")
    texts = rows.select("mark", "text").join(F.broadcast(chosen) if small_enough(chosen, BROADCAST_ROWS) else chosen, "mark")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(w).view(np.int64) for w in lists(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["rep", "shingles"])

    known = texts.select("rep", word_hashes(F.col("text")).alias("words")).mapInArrow(sets, "rep long, shingles array<long>").dropDuplicates(["rep"])
    exact = active.join(known, "rep").select("path", "row", "column", "block", "rep", "paths", "home", "what", "copies", "shingles")
    linked = written(grouped(exact).mapInArrow(links, "rep long, lead long, linked long"), f"{base}/links")

    groups = components(linked, base)
    totals = linked.groupBy("rep").agg(F.sum("linked").alias("linked"))
    # Only linked classes are looked at for the first document of all that they lead to.
    led = written(groups.unionByName(groups.select(F.col("group").alias("rep"), "group").distinct()).join(same.select("rep", "first"), "rep"), f"{base}/led")
    heads = spread_join(led.select("rep", "group"), led.groupBy("group").agg(F.min("first").alias("head")), ["group"], BROADCAST_ROWS).select("rep", "head")
    classes = same.join(totals, "rep", "left").join(heads, "rep", "left").select("first", "members", "hash_a", "hash_b", F.coalesce("head", "first").alias("head"), (F.coalesce("linked", F.lit(0)) + F.col("members") - 1).cast("long").alias("n_links"))
    classes = written(classes, f"{base}/named")
    classes = classes.select("first", "members", "hash_a", "hash_b", F.col("head.doc_id").alias("class_id"), F.col("head.mark").alias("class_mark"), "n_links")
    # A class of one is its document; only members of larger ones are looked up, dealt over SALTS parts.
    single = classes.filter("members = 1").select("first.doc_id", "first.mark", "class_id", "class_mark", "n_links")
    many = classes.filter("members > 1").select("hash_a", "hash_b", "class_id", "class_mark", "n_links", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = sketches.select("doc_id", "mark", "hash_a", "hash_b").withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(SALTS)).cast("int"))
    return single.unionByName(salted.join(many, ["hash_a", "hash_b", "salt"]).select("doc_id", "mark", "class_id", "class_mark", "n_links"))
