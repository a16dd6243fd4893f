"""Token-ID output: files of Simple-8b words.

A file holds the ids of a run of documents as one stream, cut into blocks of BLOCK ids. A block is a run of 64-bit
words (little-endian): the low four bits select how many values of which width fill the other sixty. Selector 15 is
the escape: one value of up to 60 bits. The footer is an Arrow stream of two tables: the blocks' word offsets, and for
each document its key, whether the key is null, and where its ids begin; after it come the footer's length and MAGIC.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anchorline.llm.shared import texts_of, workspace, written
from anchorline.llm.tokens import encoder, slices

MAGIC = b"S8BIDS01"
BLOCK = 240
#: Blocks that are coded or decoded at once.
GROUP = 4096
END_ID = 2
# Simple-8b's selectors, values in a word and bits of each.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of ids below 2**60, in blocks of BLOCK (the last may be shorter), and the words in each block.

    Every block is coded greedily by itself; one step codes one word of each. What is left of a block's last word is 0.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blocks = -(-n // BLOCK)
    last = np.minimum(np.arange(1, blocks + 1) * BLOCK, n)
    values = np.zeros(blocks * BLOCK, np.uint64)
    values[:n] = ids
    # widest[k]: the bits of the widest of the 2**k values from each place on; what lies behind a block has none.
    bits = np.zeros((blocks, 2 * BLOCK), np.uint8)
    bits[:, :BLOCK] = np.frexp(values.astype(np.float64))[1].reshape(blocks, BLOCK)
    widest = [bits]
    for k in range(7):
        widest.append(wider := widest[-1].copy())
        np.maximum(widest[-2][:, : -(1 << k)], widest[-2][:, 1 << k :], out=wider[:, : -(1 << k)])
    selector = np.full((blocks, BLOCK), 15, np.uint8)
    for s in range(14, -1, -1):
        k = int(COUNTS[s]).bit_length() - 1
        rest = COUNTS[s] - (1 << k)
        selector[np.maximum(widest[k][:, :BLOCK], widest[k][:, rest : rest + BLOCK]) <= WIDTHS[s]] = s
    selector = selector.ravel()
    live = np.arange(blocks)
    at = live * BLOCK
    out, owner = [], []
    while len(live):
        s = selector[at]
        word = s.astype(np.uint64)
        for k in np.unique(s):
            mine = np.flatnonzero(s == k)
            if WIDTHS[k]:
                j = np.arange(COUNTS[k])
                take = at[mine, None] + j
                part = np.where(take < last[live[mine], None], values[np.minimum(take, len(values) - 1)], np.uint64(0))
                shift = (4 + j * WIDTHS[k]).astype(np.uint64)
                word[mine] |= np.bitwise_or.reduce(part << shift, axis=1)
        out.append(word)
        owner.append(live)
        at = at + COUNTS[s]
        go = at < last[live]
        at, live = at[go], live[go]
    order = np.argsort(np.concatenate(owner), kind="stable")
    return np.concatenate(out)[order], np.bincount(np.concatenate(owner), minlength=blocks)


def unpack_blocks(words: np.ndarray, per_block: np.ndarray, n: int) -> np.ndarray:
    """The first n ids of whole blocks, every selector's words at once."""
    selector = (words & np.uint64(15)).astype(np.int8)
    held = COUNTS[selector]
    block = np.repeat(np.arange(len(per_block)), per_block)
    before = np.cumsum(held) - held
    first = before[np.cumsum(per_block) - per_block] if len(per_block) else before
    at = block * BLOCK + before - first[block]
    out = np.zeros(len(per_block) * BLOCK, np.uint64)
    for s in np.unique(selector):
        if width := int(WIDTHS[s]):
            mine = np.flatnonzero(selector == s)
            j = np.arange(COUNTS[s])
            value = (words[mine, None] >> (4 + j * width).astype(np.uint64)) & np.uint64((1 << width) - 1)
            to = at[mine, None] + j
            inside = to < (block[mine, None] + 1) * BLOCK
            out[to[inside]] = value[inside]
    return out[:n]


class IdFile:
    """Writes one file: add() documents, then close()."""

    def __init__(self, out) -> None:
        self.out, self.held, self.n_held = out, [], 0
        self.keys: list[int] = []
        self.nulls: list[bool] = []
        self.starts: list[int] = []
        self.n, self.n_words = 0, 0
        self.blocks: list[np.ndarray] = []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(0 if key is None else key)
        self.nulls.append(key is None)
        self.starts.append(self.n)
        self.n += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= GROUP * BLOCK:
            self.flush(self.n_held // (GROUP * BLOCK) * GROUP * BLOCK)

    def flush(self, upto: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for i in range(0, upto, GROUP * BLOCK):
            words, per_block = pack_blocks(ids[i : min(i + GROUP * BLOCK, upto)])
            self.blocks.append(self.n_words + np.cumsum(per_block) - per_block)
            self.n_words += len(words)
            self.out.write(words.astype("<u8").tobytes())
        self.held, self.n_held = [ids[upto:]], len(ids) - upto

    def close(self) -> None:
        self.flush(self.n_held)
        offsets = np.concatenate([*self.blocks, [self.n_words]]).astype(np.int64)
        sink = pa.BufferOutputStream()
        for columns in ({"offset": offsets}, {"key": np.array(self.keys, np.int64), "null": np.array(self.nulls, bool), "start": np.array([*self.starts], np.int64)}):
            batch = pa.record_batch(columns)
            with pa.ipc.new_stream(sink, batch.schema) as stream:
                stream.write_batch(batch)
        footer = sink.getvalue().to_pybytes()
        self.out.write(footer + struct.pack("<QQ", self.n, len(footer)) + MAGIC)
        self.out.close()


def read_ids(file) -> Iterator[tuple[int | None, int, np.ndarray, bool]]:
    """Pieces of a file's documents in turn: key, start in the file, ids, and whether the document ends with them."""
    size = file.size()
    tail = file.read_at(24, size - 24)
    n, length = struct.unpack("<QQ", tail[:16])
    if tail[16:] != MAGIC:
        raise ValueError("not a file of token ids")
    footer = pa.BufferReader(file.read_at(length, size - 24 - length))
    offsets, docs = (pa.ipc.open_stream(footer).read_all() for _ in range(2))
    offset = offsets["offset"].to_numpy()
    key, null, start = docs["key"].to_pylist(), docs["null"].to_pylist(), docs["start"].to_numpy()
    end = np.append(start[1:], n)
    doc = 0
    for b in range(0, max(1, len(offset) - 1), GROUP):
        stop = min(b + GROUP, len(offset) - 1)
        lo, hi = b * BLOCK, min(stop * BLOCK, n)
        words = np.frombuffer(file.read_at(int(offset[stop] - offset[b]) * 8, int(offset[b]) * 8), "<u8")
        ids = unpack_blocks(words, np.diff(offset[b : stop + 1]), hi - lo)
        while doc < len(key) and (start[doc] < hi or start[doc] == end[doc]):
            over = end[doc] <= hi
            yield None if null[doc] else key[doc], int(start[doc]), ids[max(start[doc], lo) - lo : min(end[doc], hi) - lo], bool(over)
            if not over:
                break
            doc += 1


def write_ids(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write the ids of ``docs`` in ascending order of ``key`` and return the files' list: file, first, n_ids.

    Null texts are empty, so they have the end id only; a null key sorts first; rows of one key are in the order of their
    texts. A lost task writes its file again under another name; only names in the returned table count.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        encode, out, name = encoder(tokenizer), None, ""
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, j in slices(texts):
                if out is None:
                    store, at = pafs.FileSystem.from_uri(path)
                    name = f"ids-{task.partitionId():05d}-{task.taskAttemptId()}.s8b"
                    out, first = IdFile(store.open_output_stream(f"{at}/{name}")), keys[0]
                ids, bounds = encode(texts.slice(i, j - i))
                for k in range(j - i):
                    out.add(keys[i + k], np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id)))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "file": [name], "first": pa.array([first], pa.int64()), "n_ids": [out.n]}, files)

    files = pa.schema([("part", pa.int64()), ("file", pa.string()), ("first", pa.int64()), ("n_ids", pa.int64())])
    rows = texts_of(docs).select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # The rows of one key, or without, are ranged by the beginnings of their texts, which go through the driver as bounds.
    ranged = rows.repartitionByRange("key", F.substring("text", 1, 64)).sortWithinPartitions("key", "text")
    return written(ranged.mapInArrow(write, "part long, file string, first long, n_ids long"), f"{path}/list")


def scan_ids(files: DataFrame, path: str) -> DataFrame:
    """Documents of the listed files: key, start (ids of all documents before it), n_tokens, ids_crc32.

    One task reads one file, so there is a row in ``files`` for each range of keys, however large the corpus.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: dict[str, list] = {"key": [], "start": [], "n_tokens": [], "ids_crc32": []}
                crc, n = 0, 0
                with store.open_input_file(f"{at}/{name}") as file:
                    for key, start, ids, over in read_ids(file):
                        crc, n = zlib.crc32(ids.astype("<u4").tobytes(), crc), n + len(ids)
                        if over:
                            for column, value in zip(rows.values(), (key, base + start, n, crc), strict=True):
                                column.append(value)
                            crc, n = 0, 0
                yield pa.RecordBatch.from_pydict(rows, pa.schema([(x, pa.int64()) for x in rows]))

    # A row a file: the window sums as many rows as there are ranges of keys.
    based = files.withColumn("base", F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids"))
    spread = based.select("file", "base").repartition(max(1, files.count()), "file")
    return spread.mapInArrow(read, "key long, start long, n_tokens long, ids_crc32 long")


def token_id_files(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write ``docs`` as Simple-8b files and read them back: doc_id, start, n_tokens, ids_crc32.

    An empty table has no files and no rows.
    """
    path = folder or workspace(docs.sparkSession, "token-ids")
    if not os.path.isfile(tokenizer):
        raise FileNotFoundError(tokenizer)
    return scan_ids(write_ids(docs, path, tokenizer), path).withColumnRenamed("key", "doc_id")
