"""Quality rules under weak supervision: rules vote on a document or abstain, and the votes are weighed by how well the rules do.

A rule's accuracy is not given: expectation-maximisation estimates it from how the rules agree over all documents. All it needs is
how often each pattern of votes occurs, which Spark counts; R rules have 3**R patterns at most, however many documents there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.llm.shared import texts_of, workspace, written

#: Text bytes that are looked at together.
SLICE_BYTES = 2 << 20
# The characters that are symbols, and the limits of a document that fails at once.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A document is kept whose probability to be good is this at least.
LEAST_GOOD = 0.5
#: Votes on loan to each kind of vote, and how sure the first guess is.
LOAN, MAJORITY = 1.0, 0.9
SWEEPS, TOLERANCE = 500, 1e-10

FIGURES = ("n_chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_marks", "n_plain", "n_short", "n_lines", "n_ends")
#: A word of letters, hyphens and apostrophes, with quotes, brackets and a mark at its ends.
PLAIN = r"""^["'(]?[^\x00-\x26\x28-\x2C\x2E-\x40\x5B-\x60\x7B-\x7F]+["')]?[.,;:!?]?["')]?$"""


def repeated_words(words: pa.Array, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document, words in windows of three that its text holds twice or more. Words are numbered by Arrow's dictionary, windows
    by the numbers of their words, so equal numbers are equal words."""
    coded = words.dictionary_encode()
    of, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
    if len(of) < 3:
        return np.zeros(n_docs, np.int64)
    inside = doc[:-2] == doc[2:]
    _, pair = np.unique((doc[:-2] * size + of[:-2]) * size + of[1:-1], return_inverse=True)
    _, window, times = np.unique(np.where(inside, pair * size + of[2:], -1), return_inverse=True, return_counts=True)
    twice = inside & (times[window] > 1)
    hit = np.zeros(len(of), bool)
    for k in range(3):
        hit[k : len(of) - 2 + k] |= twice
    return np.bincount(doc[hit], minlength=n_docs)


def repeated_lines(text: bytes) -> tuple[int, int, int]:
    """Lines with a word that equal an earlier one, lines with a word, and those of them that end a sentence."""
    seen, dup, n, ends = set(), 0, 0, 0
    for line in text.split(b"\n"):
        if bare := line.strip():
            n += 1
            ends += bare[-1:] in (b".", b"!", b"?")
            dup += line in seen
            seen.add(line)
    return dup, n, ends


def figures_of(texts: list[str]) -> dict[str, np.ndarray]:
    """FIGURES of each text."""
    raw = [t.encode() for t in texts]
    split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    words, doc = split.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(words), 0)
    words, doc = words.filter(full), doc[full.to_numpy(zero_copy_only=False)]
    per = lambda w=None: np.bincount(doc if w is None else doc[w.to_numpy(zero_copy_only=False)], minlength=len(texts))
    lines = np.array([repeated_lines(t) for t in raw], np.int64).reshape(-1, 3)
    spaces = [sum(t.count(c) for c in b" \t\n\x0b\x0c\r") for t in raw]
    upper, letters = zip(*[case_of(t) for t in raw], strict=True) if raw else ((), ())
    rows = {
        "n_chars": [len(t) for t in texts],
        "n_words": per(),
        "word_chars": [len(t) - n for t, n in zip(texts, spaces, strict=True)],
        "n_symbols": [sum(t.count(c) for c in SYMBOLS.encode()) for t in raw],
        "n_dup_lines": lines[:, 0],
        "n_repeat_words": repeated_words(words, doc, len(texts)),
        "n_upper": upper,
        "n_letters": letters,
        "n_marks": [t.count(b"!") + t.count(b"?") for t in raw],
        "n_plain": per(pc.match_substring_regex(words, PLAIN)),
        "n_short": per(pc.less_equal(pc.binary_length(words), 3)),
        "n_lines": lines[:, 1],
        "n_ends": lines[:, 2],
    }
    return {k: np.asarray(v, np.int64) for k, v in rows.items()}


def case_of(text: bytes) -> tuple[int, int]:
    """ASCII capitals and letters."""
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=128)
    upper = int(count[65:91].sum())
    return upper, upper + int(count[97:123].sum())


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id and FIGURES, of texts of about SLICE_BYTES at a time; a longer one is by itself."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, "right")))
            found = figures_of([t or "" for t in batch.column(1).slice(at, end - at).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), *[pa.array(found[c]) for c in FIGURES]], ["doc_id", *FIGURES])
            at = end


def share(a: str, b: str) -> Column:
    """a / b; null without b, so that rules on it abstain."""
    return F.when(F.col(b) > 0, F.col(a) / F.col(b))


def vote(bad: Column, good: Column | None = None) -> Column:
    """0 for bad, 1 for good, else null, which is to abstain."""
    at_fault = F.when(bad, 0)
    return at_fault if good is None else at_fault.when(good, 1)


def rules() -> dict[str, Column]:
    """The rules' votes as columns of FIGURES. That a fault is absent tells little, so most rules then abstain."""
    length, symbols, repeats, dup = share("word_chars", "n_words"), share("n_symbols", "n_words"), share("n_repeat_words", "n_words"), share("n_dup_lines", "n_lines")
    upper, marks, plain, short, ends = share("n_upper", "n_letters"), share("n_marks", "n_words"), share("n_plain", "n_words"), share("n_short", "n_words"), share("n_ends", "n_lines")
    return {
        "symbols_per_word": vote(symbols > 0.1),
        "symbols_per_character": vote(share("n_symbols", "n_chars") > 0.02),
        "plain_words": vote(plain < 0.75, plain > 0.9),
        "capitals": vote(upper > 0.3),
        "loud_marks": vote(marks > 0.25),
        "repeated_words": vote(repeats > 0.3),
        "repeated_lines": vote(dup > 0.3),
        "word_length": vote((length < 2.5) | (length > 12)),
        "short_words": vote((short < 0.01) | (short > 0.8), short.between(0.05, 0.7)),
        "line_ends": vote(ends < 0.1, ends > 0.5),
    }


def expectation_maximisation(votes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """How often each rule votes bad, votes good and abstains on bad and on good documents (rules, 2, 3), the share of good ones, and
    each pattern's probability to be good.

    ``votes`` has a row for each pattern: 0 bad, 1 good, 2 abstains; ``times`` how often it occurs. Rules differ in how often they
    speak on either kind, so abstaining counts too. The start is a majority vote, an even one being a good one; LOAN votes of each
    kind keep every chance above 0.
    """
    cast = np.stack([votes == k for k in range(3)], 2).astype(float)
    margin = cast[:, :, 1].sum(1) - cast[:, :, 0].sum(1)
    p, prior = np.where(margin >= 0, MAJORITY, 1 - MAJORITY), 0.5
    chances = np.full((votes.shape[1], 2, 3), 1 / 3)
    for _ in range(SWEEPS):
        weights = np.stack([(1 - p) * times, p * times])
        told = np.einsum("yi,irk->ryk", weights, cast) + LOAN
        chances = told / told.sum(2, keepdims=True)
        prior = float((weights[1].sum() + LOAN) / (times.sum() + 2 * LOAN))
        logs = np.einsum("irk,ryk->iy", cast, np.log(chances)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        moved, p = np.abs(new - p).max(initial=0.0), new
        if moved < TOLERANCE:
            break
    return chances, prior, p


def accuracies(chances: np.ndarray) -> np.ndarray:
    """(rules, 2): the share of a rule's votes that are right on bad and on good documents."""
    voted = chances[:, :, :2]
    return np.stack([voted[:, 0, 0], voted[:, 1, 1]], 1) / voted.sum(2)


def quality_rules(docs: DataFrame, least_good: float = LEAST_GOOD, named: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_good and votes of every row of ``docs``.

    Null and empty texts have no words, so they fail at once. Rows that repeat are judged alike; their votes count each. A null doc_id
    stays null. An empty table gives no rows. Other columns of ``docs`` are not read, whatever their names.
    """
    spark = docs.sparkSession
    named = rules() if named is None else named
    counted = texts_of(docs).select("doc_id", "text").mapInArrow(measured, f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"{c} long" for c in FIGURES))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    code = F.concat(*[F.coalesce(v.cast("string"), F.lit("-")) for v in named.values()])
    base = written(counted.select("*", failed.alias("base_failed"), code.alias("votes")), workspace(spark, "quality-rules"))
    patterns = base.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()  # 3**R rows at most
    votes = np.array([["01-".index(c) for c in r["votes"]] for r in patterns], np.int64).reshape(-1, len(named))
    _, _, p = expectation_maximisation(votes, np.array([r["n"] for r in patterns], float))
    good = spark.createDataFrame([(r["votes"], float(x)) for r, x in zip(patterns, p, strict=True)], "votes string, p_good double")
    judged = base.join(F.broadcast(good), "votes")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("p_good") >= least_good)).alias("kept"), "p_good", "votes")
