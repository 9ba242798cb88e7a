"""A data source of fixed-length records: headerless files and the payload of .npy files, read by byte range.

Each partition of a scan is a range of whole records of one file with the id of its first, so ids need no job of their
own and a file of any size is read by many tasks. A task reads its range a batch at a time, as one buffer that becomes
Arrow columns without a loop over records. Only the wanted elements of a record, and only the wanted ids, are read or kept.
"""

from __future__ import annotations

import ast
import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from neighborflow.model import COLUMN_TYPES

#: Bytes that a task reads at once.
BATCH_BYTES = 8 << 20


def store(path: str):
    """The file system of a path and the path in it, for the driver and for tasks."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def sizes(paths: list[str]) -> list[int]:
    """Bytes of each file; a missing one is an error."""
    found = []
    for path in paths:
        system, inner = store(path)
        info = system.get_file_info(inner)
        if info.type != fs.FileType.File:
            raise ValueError(f"{path} is no file")
        found.append(info.size)
    return found


class Range(InputPartition):
    """``count`` records of a file from record ``at`` on, the first of which has the id ``first``."""

    def __init__(self, path: str, at: int, count: int, first: int):
        self.path, self.at, self.count, self.first = path, at, count, first


class RecordReader(DataSourceReader):
    def __init__(self, o: dict):
        self.files = json.loads(o["files"])
        self.dtype = np.dtype(o["dtype"])
        self.width, self.offset, self.dim = int(o["width"]), int(o["offset"]), int(o["dim"])
        self.head, self.columns, self.flat = int(o["head"]), int(o["columns"]), o["flat"] == "1"
        self.start, self.end, self.split = int(o["start"]), int(o["end"]), int(o["split"])

    def partitions(self) -> list[Range]:
        entry, found, first = self.dtype.itemsize * self.width, [], 0
        for path, size in self.files:
            n = (size - self.head) // entry
            a, b = max(0, self.start - first), n if self.end < 0 else min(n, self.end - first)
            step = max(1, self.split // entry)
            found += [Range(path, at, min(step, b - at), first + at) for at in range(a, b, step)]
            first += n
        return found or [Range("", 0, 0, 0)]  # a scan has one partition at least

    def _arrays(self, f, at: int, count: int) -> np.ndarray:
        """Records ``at`` and on, their wanted elements."""
        item = self.dtype.itemsize
        if self.columns:  # element after element: the wanted ones are strips of their own
            strips = [np.frombuffer(f.read_at(item * count, self.head + item * (c * self.columns + at)), self.dtype) for c in range(self.offset, self.offset + self.dim)]
            return np.stack(strips, axis=1)
        a = np.frombuffer(f.read_at(item * self.width * count, self.head + item * self.width * at), self.dtype)
        return a.reshape(count, self.width)[:, self.offset : self.offset + self.dim]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        system, inner = store(partition.path)
        step = max(1, BATCH_BYTES // (self.dtype.itemsize * max(self.width, 1)))
        kind = "<f4" if self.dtype.itemsize == 2 and self.dtype.kind == "f" else self.dtype.newbyteorder("<")
        with system.open_input_file(inner) as f:
            for at in range(partition.at, partition.at + partition.count, step):
                count = min(step, partition.at + partition.count - at)
                a = np.ascontiguousarray(self._arrays(f, at, count), kind)
                ids = np.arange(count, dtype="<i8") + (partition.first + at - partition.at)
                flat = pa.array(a.reshape(-1))
                data = flat if self.flat else pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype="<i4") * self.dim), flat)
                yield pa.RecordBatch.from_arrays([pa.array(ids), data], names=["id", "value" if self.flat else "vec"])


class RecordSource(DataSource):
    """``spark.read.format("fixed_records")``; see ``read_records`` for its options."""

    @classmethod
    def name(cls) -> str:
        return "fixed_records"

    def schema(self) -> str:
        kind = COLUMN_TYPES[np.dtype(self.options["dtype"]).name]
        return f"id bigint, value {kind}" if self.options["flat"] == "1" else f"id bigint, vec array<{kind}>"

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)


def read_records(spark: SparkSession, files: list[str], dtype: str, width: int, offset: int, dim: int, flat: bool, head: int = 0, columns: int = 0, start: int = 0, end: int | None = None) -> DataFrame:
    """(id, value) if ``flat``, else (id, vec), of files of records of ``width`` elements behind ``head`` bytes: ``dim``
    elements from ``offset`` on of the records with ids from ``start`` up to ``end``. columns: the number of records, if
    the file holds all first elements, then all second ones, and so on."""
    if np.dtype(dtype).name not in COLUMN_TYPES:
        raise ValueError(f"unknown element type {dtype}")
    found, entry = sizes(files), np.dtype(dtype).itemsize * width
    for path, size in zip(files, found, strict=True):
        if size < head or (size - head) % max(entry, 1):
            raise ValueError(f"{path} does not hold whole entries of {entry} bytes")
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    options = {"dtype": dtype, "width": width, "offset": offset, "dim": dim, "flat": int(flat), "head": head, "columns": columns, "start": start, "end": -1 if end is None else max(0, end), "split": most}
    spark.dataSource.register(RecordSource)
    read = spark.read.format("fixed_records").options(**{k: str(v) for k, v in options.items()})
    return read.option("files", json.dumps(list(zip(files, found, strict=True)))).load()


def npy_header(path: str) -> tuple[np.dtype, tuple[int, ...], bool, int]:
    """Element type, shape, whether in Fortran order, and where the payload begins: only the header is read."""
    system, inner = store(path)
    if system.get_file_info(inner).type != fs.FileType.File:
        raise ValueError(f"{path} is missing")
    with system.open_input_file(inner) as f:
        lead = f.read(12)
        if lead[:6] != b"\x93NUMPY":
            raise ValueError(f"{path} is no .npy file")
        begin = 10 if lead[6] == 1 else 12
        head = begin + struct.unpack("<H" if begin == 10 else "<I", lead[8:begin])[0]
        meta = ast.literal_eval(f.read_at(head - begin, begin).decode("latin1"))
    return np.dtype(meta["descr"]), tuple(meta["shape"]), bool(meta["fortran_order"]), head
