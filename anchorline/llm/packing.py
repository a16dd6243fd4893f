"""Cost-balanced packing of tokenized documents into training sequences.

Attention makes a piece of n tokens cost LINEAR * n + QUADRATIC * n**2. Each task packs its documents in groups of whole
sequences: the documents of a group, in descending order of cost, go to the sequence of least cost that still has room
for them. What fits nowhere whole is cut. A group's tokens are a multiple of the sequence length, so its sequences
are full; what a task has left at its end fills sequences whose lengths are powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorline.llm.shared import texts_of
from anchorline.llm.tokens import encoder, slices

SEQUENCE = 4096
#: Sequences of a group: bounds the tokens that a task holds.
GROUP = 128
END_ID = 2
LINEAR = 1.0
#: Set so that the quadratic part of a full sequence of one document is as large as the linear part.
QUADRATIC = 1.0 / SEQUENCE

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
Piece = tuple[int, int, int]


def cost(n: float, linear: float = LINEAR, quadratic: float = QUADRATIC) -> float:
    return linear * n + quadratic * n * n


def pack_group(lengths: list[int], capacities: list[int], linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[list[Piece]]:
    """Pieces (document, start, length) of each sequence; the capacities sum to the lengths, so all end full.

    A document longer than every sequence, or that no remaining room holds whole, is cut to the room of the sequence of
    least cost.
    """
    room = np.array(capacities, np.int64)
    load = np.zeros(len(room))
    out: list[list[Piece]] = [[] for _ in capacities]
    for doc in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[doc]
        while left:
            fits = room >= left
            able = fits if fits.any() else room > 0
            k = int(np.where(able, load, np.inf).argmin())
            n = int(min(left, room[k]))
            out[k].append((doc, start, n))
            room[k] -= n
            load[k] += cost(n, linear, quadratic)
            start, left = start + n, left - n
    return out


def powers(n: int, most: int = SEQUENCE) -> list[int]:
    """n as powers of two, none above ``most`` (itself a power of two)."""
    return [most] * (n // most) + [1 << k for k in range(most.bit_length() - 2, -1, -1) if n % most >> k & 1]


class Packer:
    """Collects documents and gives back the rows of each full group."""

    def __init__(self, task: int, sequence: int = SEQUENCE, group: int = GROUP) -> None:
        self.sequence, self.most = sequence, sequence * group
        self.docs: list[tuple[int | None, int, int, np.ndarray]] = []  # key, start in the document, its tokens, ids
        self.held, self.next = 0, task << 40

    def add(self, key: int | None, ids: np.ndarray) -> Iterator[dict[str, list]]:
        start = 0
        while start < len(ids):
            n = min(len(ids) - start, self.most - self.held)
            self.docs.append((key, start, len(ids), ids[start : start + n]))
            self.held, start = self.held + n, start + n
            if self.held == self.most:
                yield self.pack([self.sequence] * (self.most // self.sequence))

    def close(self) -> Iterator[dict[str, list]]:
        if self.held:
            yield self.pack(powers(self.held, self.sequence))

    def pack(self, capacities: list[int]) -> dict[str, list]:
        rows: dict[str, list] = {k.split()[0]: [] for k in PIECES.split(", ")}
        columns = list(rows.values())
        for pieces in pack_group([len(x[3]) for x in self.docs], capacities):
            offset = 0
            for doc, start, n in pieces:
                key, base, total, ids = self.docs[doc]
                row = (key, base + start, n, zlib.crc32(ids[start : start + n].astype("<u4").tobytes()), total, self.next, offset)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
                offset += n
            self.next += 1
        self.docs, self.held = [], 0
        return rows


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, group: int = GROUP, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of ``docs``: which ids of the document, in which sequence, and where.

    Nothing is shuffled: a task packs the rows of its own split, and a sequence's id begins with the split's number. Null
    texts are empty and have the end id only; rows that repeat are packed each by itself; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer), Packer(TaskContext.get().partitionId(), sequence, group)
        schema = pa.schema([(k.split()[0], pa.int64()) for k in PIECES.split(", ")])
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, j in slices(texts):
                ids, bounds = encode(texts.slice(i, j - i))
                for k in range(j - i):
                    for rows in packer.add(keys[i + k], np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id))):
                        yield pa.RecordBatch.from_pydict(rows, schema)
        for rows in packer.close():
            yield pa.RecordBatch.from_pydict(rows, schema)

    return texts_of(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)
