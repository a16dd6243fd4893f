"""Pieces of chunks against the tokenizers library, and how many of them a worker encodes."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from anchorline.llm import tokens
from anchorline.llm.queries import TOKENIZER

PARTS = [*"''''aAsStTmMdDrReEvVlL09 \t\n\x0b\x1c\x00\x7f<|>!.,-_", "'s", "'RE", "'ll", "''s", "'S'T", "<|endoftext|>", "<|EndOfText|>", *"×÷İıſŸÿÀÞßÑéŉŐĸΣς中😀½²́ \u0085K‍", "the", "Straße"]


def same_as_library(encode, texts, kind):
    library = Tokenizer.from_file(TOKENIZER)
    ids, bounds = encode(pa.array(["x'", *texts], kind).slice(1))
    assert ids.dtype == np.uint32 and bounds[-1] == len(ids) and len(bounds) == len(texts) + 1
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("plain", [True, False])
def test_pieces_of_odd_texts(kind, plain):
    draw = random.Random(5)
    encode = tokens.Encoder(TOKENIZER)
    assert encode.plain
    encode.plain = plain
    for most in (0, 3, 12, 60):
        texts = ["".join(draw.choices(PARTS, k=draw.randint(0, most))) for _ in range(150)]
        same_as_library(encode, [None, *texts, "it's", "s", "'", None, "'ll 'l l", "x<", "|y"], kind)
    same_as_library(encode, [], kind)
    same_as_library(encode, [None, "", " "], kind)


def test_each_piece_is_encoded_once_whatever_chunks_hold_it():
    words, signs = ["alpha", "Alpha", "ALPHA", "été", "ÉTÉ", "o'clock"], [",", ".", "!?", "(", ")"]
    chunks = [a + w + b + str(n) for a, w, b, n in itertools.product(signs, words, signs, range(20))]
    encode = tokens.Encoder(TOKENIZER)
    same_as_library(encode, [" ".join(chunks), *chunks], pa.string())
    # Of 3,000 chunks only the pieces take work and memory.
    kept = [x for x in vars(encode).values() if isinstance(x, tokens.Kept)]
    assert sum(map(len, kept)) <= 40


def test_long_and_many_pieces_stay_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_BYTES", 50 * tokens.ENTRY_BYTES)
    encode = tokens.Encoder(TOKENIZER)
    same_as_library(encode, [f"w{'x' * n} {'y' * n}" for n in range(100)], pa.string())
    assert 0 < len(encode.pieces) <= 50 and max(map(len, encode.pieces)) <= tokens.KEPT_CHARS
