"""Headerless binary parts and .npy files as row tables.

A part file holds whole entries one after the other. Files are read by byte ranges, in the order given; the row id is the
entry's place over all files. Part names are ``<prefix>_part_<i>_of_<n>``.
"""

from __future__ import annotations

import os
from io import BytesIO
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neighborflow.model import COLUMN_TYPES
from neighborflow.sources.records import npy_header, read_records, sizes, store

NUMPY = {"float64": "<f8", "float32": "<f4", "float16": "<f2", "int64": "<i8", "int32": "<i4", "int16": "<i2", "int8": "i1"}


def part_names(prefix: str, count: int) -> list[str]:
    return [f"{prefix}_part_{i}_of_{count}" for i in range(count)]


def read_binary(spark: SparkSession, files: list[str], dtype: str, dim: int = 1, stride: int = 0, offset: int = 0, start: int = 0, end: int | None = None) -> DataFrame:
    """(id, value) or, for dim > 1, (id, vec). stride: elements per stored entry, dim by default; offset: first element
    of an entry that is kept; start, end: ids that are read, the others' bytes are not touched."""
    if dtype not in NUMPY:
        raise ValueError(f"element type must be one of {sorted(NUMPY)}")
    if len(files) >= 65536:
        raise ValueError("too many files")
    width = stride or dim
    if offset + dim > width:
        raise ValueError("offset and dimension exceed the stride")
    return read_records(spark, files, NUMPY[dtype], width, offset, dim, dim == 1, start=start, end=end)


def read_parts(spark: SparkSession, prefix: str, count: int, dtype: str, dim: int = 1, n: int | None = None, stride: int = 0, offset: int = 0) -> DataFrame:
    """All parts of a prefix as one table. n: entries that the table holds; parts with more are refused."""
    files = part_names(prefix, count)
    item = np.dtype(NUMPY[dtype]).itemsize * (stride or dim)
    if n is not None and (found := sum(sizes(files)) // item) > n:
        raise ValueError(f"the parts hold {found} entries, the table {n}")
    return read_binary(spark, files, dtype, dim, stride, offset)


def deal_round_robin(table: DataFrame, block: int, world: int) -> DataFrame:
    """The table with the rank and slot of each row when blocks are dealt in turn."""
    from neighborflow.functions.partition import round_robin

    rank, slot = round_robin(F.col("id"), block, world)
    return table.withColumn("rank", rank).withColumn("slot", slot)


def write_binary(table: DataFrame, prefix: str, count: int, dtype: str, n: int, names: list[str] | None = None, header: bytes = b"") -> list[str]:
    """The table (ids 0 to n - 1) in id order as ``count`` part files under the even plan. Each part is written by the task
    that holds its rows, a batch at a time and under a name of its own, and takes its place when it is whole: a task that
    is lost or runs twice leaves no half part."""
    from neighborflow.functions.partition import even_rank

    col = "vec" if "vec" in table.columns else "value"
    code, names = NUMPY[dtype], names or part_names(prefix, count)

    def save(batches):
        at, out, rows = -1, None, 0

        def close():
            out.close()
            system, name = store(names[at])
            system.move(temporary, name)
            return pd.DataFrame({"part": [at], "rows": [rows]})

        for pdf in filter(len, batches):
            for part, own in pdf.groupby("part", sort=True):
                if part != at:
                    if out is not None:
                        yield close()
                    at, rows = int(part), 0
                    system, temporary = store(f"{names[at]}.{uuid4().hex}")
                    out = system.open_output_stream(temporary)
                    out.write(header)
                out.write(np.array(own[col].tolist()).astype(code).tobytes())
                rows += len(own)
        if out is not None:
            yield close()

    for name in names[:1]:
        system, inner = store(name)
        system.create_dir(os.path.dirname(inner), recursive=True)
    ranked = table.select("id", col, even_rank(F.col("id"), n, count).cast("long").alias("part"))
    done = ranked.repartitionById(count, F.col("part").cast("int")).sortWithinPartitions("part", "id").mapInPandas(save, "part long, rows long").collect()  # a row per part
    if sum(r["rows"] for r in done) != n:
        raise ValueError(f"the table holds {sum(r['rows'] for r in done)} entries, not {n}")
    for i in set(range(count)) - {r["part"] for r in done}:
        system, name = store(names[i])
        with system.open_output_stream(name) as out:
            out.write(header)
    return names


def _frame(spark: SparkSession, a: np.ndarray) -> DataFrame:
    """An array as a row table."""
    kind = COLUMN_TYPES.get(a.dtype.name)
    if kind is None:
        raise ValueError(f"unknown element type {a.dtype}")
    if a.ndim == 1:
        return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(a)), "value": a}), f"id long, value {kind}")
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(a)), "vec": a.tolist()}), f"id long, vec array<{kind}>")


def read_npy(spark: SparkSession, path: str, start: int = 0, end: int | None = None, col_start: int = 0, col_end: int | None = None) -> DataFrame:
    """A one- or two-dimensional array, in either order of elements and bytes, as (id, value) or (id, vec): rows start to
    end, columns col_start to col_end. The driver reads the header, tasks their ranges of the payload, so a file may be
    larger than any machine's memory."""
    dtype, shape, fortran, head = npy_header(path)
    if len(shape) not in (1, 2):
        raise ValueError("only arrays of one or two dimensions are read")
    n, width = shape[0], shape[1] if len(shape) == 2 else 1
    last = width if col_end is None else min(width, col_end)
    if width and not 0 <= col_start < last:
        raise ValueError("the slice of columns is empty")
    if sizes([path])[0] != head + n * width * dtype.itemsize:
        raise ValueError(f"{path} does not hold {n} rows of {width}")
    by_column = n if fortran and len(shape) == 2 else 0
    return read_records(spark, [path], dtype.str, width, col_start, last - col_start, len(shape) == 1, head, by_column, start, n if end is None else min(n, end))


def write_npy(table: DataFrame, path: str, dtype: str, n: int) -> None:
    """The table (ids 0 to n - 1) in id order as one .npy file. A file is one task's work, a batch at a time; tables for
    which that is too slow go to parts."""
    code = NUMPY[dtype]
    col = "vec" if "vec" in table.columns else "value"
    dim = (table.select(F.size(col).alias("d")).first() or {"d": 0})["d"] if col == "vec" else 0  # one number
    header = BytesIO()
    np.lib.format.write_array_header_1_0(header, {"descr": np.dtype(code).str, "fortran_order": False, "shape": (n, dim) if col == "vec" else (n,)})
    write_binary(table, path, 1, dtype, n, names=[path], header=header.getvalue())


def read_table(spark: SparkSession, src, dtype: str | None = None, shape: tuple | None = None) -> DataFrame:
    """By kind of source: a .npy or .parquet path, a list of binary files with dtype and shape, or a numpy array."""
    if isinstance(src, np.ndarray):
        return _frame(spark, src)
    if isinstance(src, (list, tuple)):
        if dtype is None or shape is None:
            raise ValueError("a list of files needs shape and dtype")
        return read_binary(spark, list(src), dtype, shape[1] if len(shape) > 1 else 1)
    if str(src).endswith(".npy"):
        return read_npy(spark, src)
    if str(src).endswith(".parquet"):
        return spark.read.parquet(src)
    raise ValueError(f"unknown kind of source: {src}")


def save_embedding(table: DataFrame, prefix: str, optimizer_only: bool = False) -> None:
    """The table and its optimizer state, a Parquet folder each."""
    states = [c for c in table.columns if c not in ("id", "vec")]
    for c in ([] if optimizer_only else ["vec"]) + states:
        table.select("id", c).write.mode("overwrite").parquet(f"{prefix}_{c}")


def load_embedding(spark: SparkSession, prefix: str, states: list[str]) -> DataFrame:
    out = spark.read.parquet(f"{prefix}_vec")
    for c in states:
        out = out.join(spark.read.parquet(f"{prefix}_{c}"), "id")
    return out
