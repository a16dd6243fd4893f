"""Archives of NumPy arrays as a Spark data source: a partition is a range of draws of one array, read from its bytes alone.

``spark.read.format("array_archive").load(uri)`` gives array, draw, place (of a value in a draw's array, in C order), value. Options:
``array`` names one member, ``draws`` is a range ``from:to`` (the end excluded), ``rows`` how many draws a partition has. Members are stored
without compression; headers alone are read to plan. The first axis of an array is its draws.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "array string, draw long, place long, value double"
DRAWS = 64


class Member(NamedTuple):
    name: str
    shape: tuple[int, ...]
    dtype: str
    start: int  # where its values begin in the file


class Ranged(io.RawIOBase):
    """A file of any Arrow file system for readers that seek; it counts the bytes that were asked for."""

    def __init__(self, file) -> None:  # noqa: ANN001
        self.file, self.at, self.size, self.taken = file, 0, file.size(), 0

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = self.size - self.at if n is None or n < 0 else min(n, self.size - self.at)
        out = self.file.read_at(n, self.at)
        self.at += len(out)
        self.taken += len(out)
        return out


def opened(uri: str) -> Ranged:
    store, path = pafs.FileSystem.from_uri(uri)
    return Ranged(store.open_input_file(path))


def members(file: Ranged) -> list[Member]:
    """Name, shape, type and place of every array, from the archive's directory and the arrays' headers. ValueError for members that are
    compressed or not in C order, as no range of their bytes is a range of draws."""
    out = []
    with zipfile.ZipFile(file) as archive:
        for info in archive.infolist():
            if info.compress_type != zipfile.ZIP_STORED:
                raise ValueError(f"{info.filename} is compressed")
            file.seek(info.header_offset)
            name, extra = struct.unpack("<HH", file.read(30)[26:])
            file.seek(info.header_offset + 30 + name + extra)
            version = np.lib.format.read_magic(file)
            shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
            if fortran and len(shape) > 1 or dtype.hasobject:
                raise ValueError(f"{info.filename} is not in C order, or of objects")
            out.append(Member(info.filename.removesuffix(".npy"), tuple(shape), dtype.str, file.tell()))
    return out


class DrawRange(InputPartition):
    def __init__(self, member: Member, first: int, end: int) -> None:
        self.member, self.first, self.end = member, first, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.uri, self.array = options["path"], options.get("array")
        self.draws, self.rows = options.get("draws"), int(options.get("rows", DRAWS))

    def partitions(self) -> list[DrawRange]:
        out = []
        for m in members(opened(self.uri)):
            if self.array in (None, m.name):
                n = m.shape[0] if m.shape else 1
                lo, hi = (int(x) for x in self.draws.split(":")) if self.draws else (0, n)
                out += [DrawRange(m, k, min(k + self.rows, hi, n)) for k in range(lo, min(hi, n), self.rows)]
        if not out:
            raise ValueError(f"no array {self.array} in {self.uri}, or none of the draws")
        return out

    def read(self, part: DrawRange) -> Iterator[pa.RecordBatch]:
        m, file = part.member, opened(self.uri)
        size = int(np.prod(m.shape[1:], dtype=np.int64))
        width = np.dtype(m.dtype).itemsize * size
        for k in range(part.first, part.end):
            file.seek(m.start + k * width)
            values = np.frombuffer(file.read(width), m.dtype).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([m.name] * size), pa.array(np.full(size, k, np.int64)), pa.array(np.arange(size)), pa.array(values)], ["array", "draw", "place", "value"])


class ArrayArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "array_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:  # noqa: ANN001
        return ArchiveReader(self.options)


def read_archive(spark: SparkSession, uri: str, **options: str) -> DataFrame:
    spark.dataSource.register(ArrayArchive)
    return spark.read.format("array_archive").options(**options).load(uri)


def archive_manifest(spark: SparkSession, uri: str) -> DataFrame:
    """array, shape, type of an archive's members: a row each, from headers."""
    rows = [(m.name, list(m.shape), np.dtype(m.dtype).name) for m in members(opened(uri))]
    return spark.createDataFrame(rows, "array string, shape array<long>, type string")


def write_archives(cube: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """An archive of each of ``keys`` from rows (keys..., array, draw, place, value); keys..., uri of them.

    One group, a run, is one file, so a task holds one run's arrays. An array lacks no value, else ValueError is raised; draws and
    places count from 0. A task that is repeated writes the same file again.
    """
    import pandas as pd

    kinds = dict(cube.dtypes)

    def write(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        arrays = {}
        for name, rows in frame.groupby("array"):
            shape = (int(rows["draw"].max()) + 1, int(rows["place"].max()) + 1)
            if len(rows) != shape[0] * shape[1]:
                raise ValueError(f"array {name} of {key} has {len(rows)} values for {shape}")
            arrays[name] = rows.sort_values(["draw", "place"])["value"].to_numpy(float).reshape(shape)
        store, path = pafs.FileSystem.from_uri(folder)
        made = io.BytesIO()
        np.savez(made, **arrays)
        file = "-".join(str(k) for k in key).replace("/", "_").replace(" ", "_")
        store.create_dir(path)
        with store.open_output_stream(f"{path}/{file}.npz") as out:
            out.write(made.getvalue())
        return pd.DataFrame([(*key, f"{folder}/{file}.npz")], columns=[*keys, "uri"])

    return cube.groupBy(*keys).applyInPandas(write, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "uri string"]))
