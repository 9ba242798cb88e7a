"""Batches for trainers: sampled tables as files in which every batch is whole, an index of the files, and a reader.

``write_batches`` range-sorts edges, nodes and inputs by batch, so a batch lies in one file of each, its rows together; the
index has a row per file with its first and last batch. A trainer opens the index, then only the files and row groups of
its own batches, one batch at a time: rows go from storage to the trainer, not through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neighborflow.sources.records import store

ORDERS = {"edges": ("batch_id", "hop", "etype", "eid"), "nodes": ("batch_id", "vtype", "local_id"), "inputs": ("batch_id", "pos")}
#: Rows of a row group: what a reader has to look through for one batch.
GROUP_ROWS = 1 << 16


def write_batches(tables: dict[str, DataFrame], path: str, files: int | None = None) -> None:
    """Tables by name (edges, nodes, inputs) under ``path``, in about ``files`` files each."""
    spark = next(iter(tables.values())).sparkSession
    parts, indexes = files or int(spark.conf.get("spark.sql.shuffle.partitions")), []
    for name, df in tables.items():
        ranged = df.repartitionByRange(parts, "batch_id").sortWithinPartitions(*ORDERS[name])
        ranged.write.option("parquet.block.row.count.limit", GROUP_ROWS).mode("overwrite").parquet(f"{path}/{name}")
        held = spark.read.parquet(f"{path}/{name}").select("batch_id", F.input_file_name().alias("file"))
        each = held.groupBy(F.regexp_extract("file", "([^/]+)$", 1).alias("file")).agg(F.min("batch_id").alias("first"), F.max("batch_id").alias("last"), F.count("*").alias("rows"))
        indexes.append(each.select(F.lit(name).alias("name"), "file", "first", "last", "rows"))
    index = indexes[0]
    for more in indexes[1:]:
        index = index.unionByName(more)
    index.coalesce(1).write.mode("overwrite").parquet(f"{path}/index")  # a row per file


def _files(path: str) -> list[dict]:
    system, inner = store(f"{path}/index")
    found = [x.path for x in system.get_file_info(fs.FileSelector(inner)) if x.path.endswith(".parquet")]
    return [row for f in found for row in pq.read_table(f, filesystem=system).to_pylist()]


def batch_range(path: str, rank: int = 0, world: int = 1) -> range:
    """The batches of one of ``world`` trainers: consecutive ones, so that few files are opened by two of them."""
    if not 0 <= rank < world:
        raise ValueError("the rank must be one of the trainers")
    files = _files(path)
    if not files:
        return range(0)
    first, end = min(f["first"] for f in files), max(f["last"] for f in files) + 1
    share = -(-(end - first) // world)
    return range(min(end, first + rank * share), min(end, first + (rank + 1) * share))


def open_batches(path: str, rank: int = 0, world: int = 1) -> Iterator[tuple[int, dict[str, list[dict]]]]:
    """(batch, rows by table) of a trainer's batches in order; a batch without any row is left out."""
    files = sorted(_files(path), key=lambda f: (f["first"], f["last"], f["file"]))
    names = sorted({f["name"] for f in files})
    for batch in batch_range(path, rank, world):
        rows = {name: [] for name in names}
        for f in files:
            if f["first"] <= batch <= f["last"]:
                system, inner = store(f"{path}/{f['name']}/{f['file']}")
                rows[f["name"]] += pq.read_table(inner, filesystem=system, filters=[("batch_id", "=", batch)]).to_pylist()
        if any(rows.values()):
            yield batch, rows
