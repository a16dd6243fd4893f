"""Token ids of Arrow string columns, by the tokenizers library.

Pre-tokenizers of this kind never join text across white space, so ids of a text are the ids of its chunks between
ASCII white space, in turn. Plain chunks are cut into the pre-tokenizer's pieces, those of a slice of texts all at once by the
kinds of their bytes; others stay whole. Each worker keeps the ids of the pieces it has met; only new ones are encoded.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are looked up together; bounds the memory for one step.
SLICE_BYTES = 2 << 20
#: Bytes that a worker keeps of pieces before it starts afresh; what an entry takes besides its text and ids.
KEPT_BYTES, ENTRY_BYTES = 48 << 20, 200
#: Longest piece that is kept.
KEPT_CHARS = 64

# What a byte is to the pre-tokenizer of word_bpe_49k.json, whose pieces are contractions, runs of letters, single digits
# and runs of other signs. Letters are those of ASCII and U+00C0 to U+017F: here NFC changes nothing, and all but U+0130 have one
# lower-case letter of as many bytes. An ODD byte leaves its chunk to the library.
SPACE, LETTER, DIGIT, SIGN, ODD = range(5)
_KIND = np.full(256, ODD, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE
_KIND[0x21:0x7F] = SIGN
_KIND[0x30:0x3A] = DIGIT
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = LETTER
#: Multiplication, division, and the dotted capital I.
_ODD_PAIRS = (0xC397, 0xC3B7, 0xC4B0)
_LOWER = np.array([b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
#: Byte-level vocabularies write a byte that is no visible Latin-1 character as the next free one from U+0100; "\n" stays, to part pieces.
_HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD)]
_SHOWN = np.arange(256, dtype="<u4")
_SHOWN[_HIDDEN] = 0x100 + np.arange(len(_HIDDEN))
_SHOWN[ord("\n")] = ord("\n")

_ENCODERS: dict[str, Encoder] = {}


class Kept(dict[str, bytes]):
    """Ids of short texts, bounded in bytes: emptied when it is full."""

    held = 0

    def keep(self, text: str, ids: bytes) -> None:
        if len(text) > KEPT_CHARS:
            return
        self.held += len(text) + len(ids) + ENTRY_BYTES
        if self.held > KEPT_BYTES:
            self.clear()
            self.held = len(text) + len(ids) + ENTRY_BYTES
        self[text] = ids


def cut(raw: np.ndarray, plain: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of UTF-8 that ends with a space: it in lower case, which bytes are no white space, where pieces begin, and which of these are whole chunks.

    Chunks that are left to the library keep their case; if not ``plain``, all are. Capital letters of U+0100 on keep it, too.
    """
    kind = _KIND[raw]
    black = kind != SPACE
    chunk = black.copy()
    chunk[1:] &= ~black[:-1]
    if not plain:
        at = np.flatnonzero(chunk)
        return raw, black, at, np.ones(len(at), bool)
    first = kind == DIGIT
    first[1:] |= kind[1:] != kind[:-1]
    first[:1] = True
    first &= black
    # 's, 't, 'm, 'd, 're, 've and 'll: the apostrophe begins a run of signs, and is all of it.
    low = _LOWER[raw]
    quote = np.flatnonzero(raw == ord("'"))
    quote = quote[first[quote]]
    one, two = low[quote + 1], low[np.minimum(quote + 2, len(raw) - 1)]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = (two == ord("e")) & ((one == ord("r")) | (one == ord("v"))) | (two == ord("l")) & (one == ord("l"))
    first[quote[short | long] + 1] = False
    after = np.concatenate((quote[short] + 2, quote[long] + 3))
    first[after] = black[after]

    high, less = np.flatnonzero(raw >= 0xC3), np.flatnonzero(raw == ord("<"))
    second = raw[high + 1]
    low[high[(raw[high] == 0xC3) & (second < 0x9F)] + 1] |= 0x20
    strange = high[np.isin(raw[high].astype(np.uint16) << 8 | second, _ODD_PAIRS)]
    odd = np.concatenate((np.flatnonzero(kind == ODD), strange, less[raw[less + 1] == ord("|")]))
    whole = np.zeros(0, np.int64)
    if len(odd):
        begin = np.flatnonzero(chunk)
        mine = np.unique(np.searchsorted(begin, odd, "right") - 1)
        whole, edge = begin[mine], np.zeros(len(raw), np.int8)
        edge[whole] = 1
        edge[np.flatnonzero(black[:-1] & ~black[1:])[mine] + 1] = -1
        inside = np.cumsum(edge, dtype=np.int8) == 1
        low[inside] = raw[inside]
        first &= ~inside
        first[whole] = True
    at = np.flatnonzero(first)
    return low, black, at, np.isin(at, whole, assume_unique=True)


class Encoder:
    """Ids by one tokenizer file. ``plain``: its pre-tokenizer makes the pieces that cut() makes, and special tokens begin with "<|"."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.plain = "[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in (spec := self.tokenizer.to_str()) and '"Lowercase"' in spec
        self.plain &= all(x.content.startswith("<|") for x in self.tokenizer.get_added_tokens_decoder().values())
        self.pieces = Kept()

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def of_pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of pieces of plain chunks."""
        shown = _SHOWN[np.frombuffer("\n".join(texts).lower().encode(), np.uint8)].tobytes().decode("utf-32-le")
        return [array("I", [x.id for x in self.tokenize(piece)]).tobytes() for piece in shown.split("\n")] if texts else []

    def ids_of(self, texts: list[str], whole: np.ndarray) -> list[bytes]:
        """Ids of different pieces, and of chunks where ``whole``."""
        out = list(map(self.pieces.get, texts))
        new = [k for k, ids in enumerate(out) if ids is None]
        pieces = [k for k in new if not whole[k]]
        for k, ids in zip(pieces, self.of_pieces([texts[k] for k in pieces]), strict=True):
            out[k] = ids
        for k in new:
            if whole[k]:
                out[k] = self.whole(texts[k])
            self.pieces.keep(texts[k], out[k])
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none), and the n + 1 offsets of the texts in them."""
        nothing, space = pa.scalar("", texts.type), pa.scalar(" ", texts.type)
        spaced = pc.binary_join_element_wise(pc.fill_null(texts, nothing), nothing, space)
        ends = np.cumsum(pc.binary_length(spaced).to_numpy(zero_copy_only=False), dtype=np.int64)
        if not len(ends):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        low, black, at, whole = cut(np.frombuffer(spaced.buffers()[2], np.uint8, int(ends[-1])), self.plain)
        data = low[black]
        # Where the pieces begin in ``data``: a piece's place less the white space before it.
        offsets = np.append(at - np.cumsum(~black, dtype=np.int32)[at], len(data)).astype(np.int32)
        coded = pc.dictionary_encode(pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)))
        code = coded.indices.to_numpy(zero_copy_only=False)
        apart = np.zeros(len(coded.dictionary), bool)
        apart[code[whole]] = True
        found = self.ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), apart)
        of_piece = np.frombuffer(b"".join(found), np.uint32)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start = np.cumsum(size) - size
        count = size[code]
        end = np.concatenate(([0], np.cumsum(count)))
        ids = of_piece[np.repeat(start[code] - end[:-1], count) + np.arange(end[-1])]
        return ids, end[np.concatenate(([0], np.searchsorted(at, ends)))]


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text each; one longer text is a range of its own."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(size):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += int(n)
    if at < len(size):
        yield at, len(size)
