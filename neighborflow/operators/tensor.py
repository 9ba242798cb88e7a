"""Row tables: gather, scatter, slices, sorts, deduplication, placement by rank.

A table is (id, value) or (id, vec). Indices are (pos, id); a negative id skips its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from neighborflow.functions import partition as P
from neighborflow.scratch import written

#: Bytes of rows up to which they may be sent to every task.
BROADCAST_BYTES = 64 << 20


def gather(table: DataFrame, indices: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the table at indices, places kept, nulls where the index is negative or unknown. Spark picks the join by
    its own bound on broadcasts, and again by the sizes it measures at run time."""
    right = table.select(F.col("id").alias("_id"), *columns)
    return indices.join(right, (F.col("id") == F.col("_id")) & (F.col("id") >= 0), "left").drop("_id")


def row_bytes(table: DataFrame, columns: list[str]) -> Column:
    """Bytes of a decoded row: eight for its id and each number."""
    arrays = [F.coalesce(F.size(c), F.lit(0)) if isinstance(table.schema[c].dataType, ArrayType) else F.lit(1) for c in columns]
    return (8 * (1 + sum(arrays[1:], arrays[0]))).cast("long")


def gather_cached(table: DataFrame, indices: DataFrame, cached: DataFrame, columns: list[str]) -> DataFrame:
    """As ``gather``, with ``hit``: whether the row is among the ids of ``cached``. Rows that are go to every task if they
    measure at most BROADCAST_BYTES, so a hot row is not shuffled to one task; the other places are joined by id."""
    hot = written(table.join(cached.select("id"), "id", "left_semi").select(F.col("id").alias("_id"), *columns), "cache")
    size = hot.agg(F.coalesce(F.sum(row_bytes(hot, columns)), F.lit(0)).alias("n")).first()["n"]  # one number
    near = F.broadcast if size <= BROADCAST_BYTES else (lambda df: df)
    at = F.col("id") == F.col("_id")
    hits = indices.join(near(hot), at).drop("_id").withColumn("hit", F.lit(True))
    rest = indices.join(near(hot.select("_id")), at, "left_anti")
    return hits.unionByName(gather(table, rest, columns).withColumn("hit", F.lit(False)))


def from_local_tables(parts: list[DataFrame], n: int) -> DataFrame:
    """One table from each rank's own, with ids from 0 in each; the inverse of ``local_table``. Parts need equal columns and
    the even plan's sizes."""
    if len({tuple((f.name, f.dataType.simpleString()) for f in p.schema) for p in parts}) != 1:
        raise ValueError("the parts need the same columns and types")
    world, size = len(parts), -(-n // len(parts))
    ranked = parts[0].withColumn("rank", F.lit(0))
    for rank, part in enumerate(parts[1:], 1):
        ranked = ranked.unionByName(part.withColumn("rank", F.lit(rank)))
    found = {r["rank"]: (r["n"], r["lo"], r["hi"]) for r in ranked.groupBy("rank").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).collect()}  # a row per rank
    for rank in range(world):
        want = max(0, min(n, (rank + 1) * size) - rank * size)
        if found.get(rank, (0, None, None)) != ((want, 0, want - 1) if want else (0, None, None)):
            raise ValueError(f"part {rank} does not hold the {want} rows of its rank")
    return ranked.withColumn("id", F.col("id") + P.even_start(F.col("rank"), n, world)).drop("rank")


def scatter(table: DataFrame, updates: DataFrame, column: str) -> DataFrame:
    """The table with rows overwritten by updates (pos, id, column), cast to the table's type; of several updates to a row
    the last place wins."""
    updates = updates.withColumn(column, F.col(column).cast(table.schema[column].dataType))
    last = updates.where("id >= 0").groupBy("id").agg(F.max_by(column, "pos").alias("_new"), F.lit(True).alias("_hit")).select("id", "_new", F.lit(True).alias("_hit"))
    return table.join(last, "id", "left").withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_hit")


def sub_table(table: DataFrame, start: int, end: int, col_start: int = 0, col_end: int = -1, vec: str | None = "vec", n: int | None = None) -> DataFrame:
    """Half-open slices of rows and, for vectors, of columns; -1 is the open end. Empty slices are refused."""
    if (end != -1 and end <= max(start, 0)) or (col_end != -1 and col_end <= max(col_start, 0)):
        raise ValueError("the slice is empty")
    out = table.where((F.col("id") >= max(start, 0)) & ((F.lit(end) == -1) | (F.col("id") < end)))
    if vec:
        first = max(col_start, 0)
        length = F.size(vec) - first if col_end == -1 else F.lit(col_end - first)
        out = out.withColumn(vec, F.slice(vec, first + 1, F.greatest(length, F.lit(0))))
    return out


def local_table(table: DataFrame, rank: int, n: int, world: int) -> DataFrame:
    """A rank's slice under the even plan: a plain range filter, pushed to the scan."""
    size = -(-n // world)
    return table.where((F.col("id") >= rank * size) & (F.col("id") < min(n, (rank + 1) * size)))


def rank_counts(ids: DataFrame, n: int, world: int) -> DataFrame:
    """(rank, cnt) of non-negative ids by owner."""
    return ids.where("id >= 0").groupBy(P.even_rank(F.col("id"), n, world).alias("rank")).agg(F.count("*").alias("cnt"))


def unique_ids(ids: DataFrame) -> DataFrame:
    """(id, cnt): runs of the sorted ids."""
    return ids.groupBy("id").agg(F.count("*").alias("cnt"))


def sorted_with_places(ids: DataFrame) -> DataFrame:
    """(id, pos, place): the order of a stable sort, negative ids last."""
    from neighborflow.operators.numbering import number_rows

    return number_rows(ids.select("id", "pos"), [(F.col("id") < 0).asc(), F.col("id").asc(), F.col("pos").asc()], "place")


def unique_inverse(pairs: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Endpoints of each batch, both columns one after the other, mapped to places among the batch's sorted ids. The
    distinct ids are numbered, so neither a large batch nor an id with many places is one task's work."""
    from neighborflow.operators.numbering import number_within

    long = pairs.select(by, "pos", F.posexplode(F.array(*columns)).alias("side", "id"))
    ids = number_within(long.select(by, "id").distinct(), [by], ["id"], "inverse")
    return long.join(ids, [by, "id"]).select(by, "side", "pos", "id", "inverse")


def edges_at(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (pos, eid) with both ends of the edge, nulls where the id is negative or unknown."""
    return wanted.join(edges.select(F.col("eid").alias("_eid"), "nbr", "ctr"), (F.col("eid") == F.col("_eid")) & (F.col("eid") >= 0), "left").drop("_eid")


def update_edges(edges: DataFrame, updates: DataFrame, column: str) -> DataFrame:
    """Edges with a column overwritten by updates (pos, eid, column); the last place wins."""
    return scatter(edges.withColumnRenamed("eid", "id"), updates.withColumnRenamed("eid", "id"), column).withColumnRenamed("id", "eid")
