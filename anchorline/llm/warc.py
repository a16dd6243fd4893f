"""WARC archives: one gzip member per record, written by every task and read back as a sequence of members."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorline.llm.shared import workspace, written

CHUNK = 1 << 18
#: Parts into which the pages of one payload are dealt when they look for their original.
SALTS = 32
DATE = "2000-01-01T00:00:00Z"
# Fixed value: the profile of revisits in WARC 1.1.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, verified boolean"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """The gzip member of one page. A revisit has the HTTP head, with the payload's length, but not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Date": date}
    if url is not None:
        fields["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f\x85  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)
    if refers_to is not None:
        fields |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": SAME_PAYLOAD}
    fields |= {"WARC-Payload-Digest": f"sha1:{digest(payload)}", "WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    record = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    gzip = zlib.compressobj(wbits=31)
    return gzip.compress(record.encode() + block + b"\r\n\r\n") + gzip.flush()


class Members:
    """Bytes of an archive's gzip members, decompressed as they are asked for."""

    def __init__(self, file) -> None:
        self.file, self.raw, self.held, self.inflate = file, b"", b"", None

    def next(self) -> bool:
        """Go on to the next member; False at the end of the archive."""
        if self.held or self.inflate is not None and not self.inflate.eof:
            raise ValueError("a member holds more than its record")
        self.raw = self.raw if self.inflate is None else self.inflate.unused_data
        self.raw = self.raw or self.file.read(CHUNK)
        self.inflate = zlib.decompressobj(31)
        return bool(self.raw)

    def more(self) -> bool:
        """Decompress at most CHUNK bytes more of this member."""
        while not self.inflate.eof:
            data = self.raw or self.file.read(CHUNK)
            if not data:
                raise ValueError("the archive ends within a member")
            got = self.inflate.decompress(data, CHUNK)
            self.raw = self.inflate.unconsumed_tail
            if got:
                self.held += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        while (at := self.held.find(mark)) < 0:
            if not self.more():
                raise ValueError("the record has no end of its head")
        found, self.held = self.held[:at], self.held[at + len(mark) :]
        return found

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.held and not self.more():
                raise ValueError("the member ends within a record")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            yield part

    def rest(self) -> bytes:
        while self.more():
            pass
        found, self.held = self.held, b""
        return found


class Record(NamedTuple):
    fields: dict[str, str]
    http: dict[str, str]
    payload_bytes: int
    payload_digest: str
    verified: bool
    payload: bytes | None


def head_fields(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode().split("\r\n")[1:])}


def records(file, keep_payload: bool = False) -> Iterator[Record]:
    """Records in turn. Framing faults raise ValueError; digests that do not fit make ``verified`` false.

    Unless it is kept, a payload is only hashed as it comes, so its length does not matter.
    """
    members = Members(file)
    while members.next():
        fields = head_fields(members.until(b"\r\n\r\n"))
        length = int(fields["content-length"])
        block, payload = hashlib.sha1(), hashlib.sha1()
        head, n, kept, in_head = b"", 0, [], True
        for part in members.take(length):
            block.update(part)
            if in_head:
                head += part
                if b"\r\n\r\n" not in head:
                    continue
                head, _, part = head.partition(b"\r\n\r\n")
                in_head = False
            payload.update(part)
            n += len(part)
            if keep_payload:
                kept.append(part)
        if members.rest() != b"\r\n\r\n":
            raise ValueError("the record's length does not fit its member")
        http = head_fields(head)
        declared = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        found = base64.b32encode(payload.digest()).decode()
        fits = fields.get("warc-block-digest", "").removeprefix("sha1:") in ("", base64.b32encode(block.digest()).decode())
        if fields["warc-type"] == "revisit":
            n = int(http["content-length"])
        else:
            fits &= declared in ("", found) and int(http.get("content-length", n)) == n
        yield Record(fields, http, n, declared or found, fits, b"".join(kept) if keep_payload else None)


def page_number(urn: str | None) -> int | None:
    return int(x) if urn and (x := urn.removeprefix("<urn:page:").removesuffix(">")) else None


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to: of equal payloads of ``min_bytes`` or more, all refer to the largest page_id.

    Rows without a page_id, and all rows of the largest one, refer to none. Ids and digests alone are grouped; the pages of
    one digest are dealt over SALTS parts to be joined.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("sha1", F.unhex(F.sha1("payload")))
    shared = (
        rows.filter(F.col("page_id").isNotNull() & (F.octet_length("payload") >= min_bytes))
        .groupBy("sha1")
        .agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("sha1", "original", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    joined = dealt.join(shared, ["sha1", "salt"], "left")
    mine = F.col("original").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("original")) & (F.octet_length("payload") >= min_bytes)
    return joined.select("page_id", "url", "payload", F.when(mine, F.col("original")).alias("refers_to"))


def write_archives(rows: DataFrame, path: str) -> DataFrame:
    """An archive for each task, of page_id, url, payload, refers_to; returns the table of files.

    A lost task writes another file; only names in the table count.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, n = TaskContext.get(), None, 0
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if out is None:
                    store, at = pafs.FileSystem.from_uri(path)
                    name = f"pages-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
                    out = store.open_output_stream(f"{at}/{name}", compression=None)
                out.write(member(page_id, url, payload, refers_to))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "n": [n]})

    return written(rows.mapInArrow(write, "file string, n long"), f"{path}/list")


def read_archives(files: DataFrame, path: str, n_files: int) -> DataFrame:
    """The records of the archives ``file`` in a folder; a task reads one archive at a time from its beginning to its end."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = pafs.FileSystem.from_uri(path)
        names = [x.split()[0] for x in RECORDS.split(", ")]
        schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()], strict=True)))
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{at}/{name}", compression=None) as file:
                    rows: list[tuple] = []
                    for r in records(file):
                        rows.append((page_number(r.fields["warc-record-id"]), r.payload_bytes, r.payload_digest, r.fields["warc-type"], page_number(r.fields.get("warc-refers-to")), r.fields.get("warc-target-uri"), r.verified))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return files.select("file").repartition(n_files, "file").mapInArrow(read, RECORDS)


def warc_round_trip(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) and read the archives back: a row for each record.

    Null html is an empty payload, a null url is left out, control characters in a url are percent-encoded, and equal
    payloads are written once. An empty table has no archives and no rows.
    """
    path = folder or workspace(pages.sparkSession, "warc")
    files = write_archives(with_originals(pages, min_bytes), path)
    return read_archives(files, path, max(1, files.count()))
