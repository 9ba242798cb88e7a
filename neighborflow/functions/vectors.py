"""Arithmetic on array columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zip_map(fn, *arrays: Column) -> Column:
    """Elementwise function of any number of arrays of one length."""
    if len(arrays) == 1:
        return F.transform(arrays[0], fn)
    if len(arrays) == 2:
        return F.zip_with(arrays[0], arrays[1], fn)
    zipped = F.arrays_zip(*[a.alias(f"v{i}") for i, a in enumerate(arrays)])
    return F.transform(zipped, lambda z: fn(*[z[f"v{i}"] for i in range(len(arrays))]))


def constant_like(a: Column, value: float) -> Column:
    return F.transform(a, lambda _: F.lit(value))


def linear(v: Column, matrix: list[list[float]], bias: list[float] | None = None) -> Column:
    """matrix times v, plus the bias: a row of the matrix makes an element."""
    rows = [F.aggregate(F.zip_with(v, F.array(*map(F.lit, r)), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) for r in matrix]
    return F.array(*[r + F.lit(b) for r, b in zip(rows, bias or [0.0] * len(rows), strict=True)])


def exploded(df: DataFrame, id_cols: list[str], vec: str, out: str = "val", digits: int | None = 6) -> DataFrame:
    """One row per element: (ids, dim, value), rounded for comparison."""
    long = df.select(*id_cols, F.posexplode(vec).alias("dim", out))
    return long.withColumn(out, F.round(F.col(out).cast("double"), digits)) if digits is not None else long


#: Elements of a chunk: sums of so few fit one small compiled loop, whatever the vectors' length.
CHUNK = 16


def sum_vectors(df: DataFrame, by: list[str], vec: str, out: str, dim: int | None = None, rows: str | None = None, weight: str | None = None) -> DataFrame:
    """Elementwise sums per group as doubles; ``rows``: a column for the number of vectors, ``weight``: one with a vector's factor.

    Vectors are summed in chunks, (group, chunk, values), combined on the map side, and put together again from one row per
    chunk, so the plan is the same for any length. dim: the length, if known; vectors of one chunk are not taken apart."""
    one = dim is not None and dim <= CHUNK
    parts = F.greatest(F.ceil(F.size(vec) / CHUNK), F.lit(1)).cast("int")
    own = [F.col(weight).alias("_w")] if weight else []
    held = ["_w"] if weight else []
    cut = df.select(*by, F.col(vec).alias("_v"), F.lit(0).alias("_c"), *own) if one else df.select(*by, vec, F.explode(F.sequence(F.lit(0), parts - 1)).alias("_c"), *own).select(*by, F.slice(vec, F.col("_c") * CHUNK + 1, CHUNK).alias("_v"), "_c", *held)
    element = lambda i: F.get("_v", F.lit(i)).cast("double") * F.col("_w") if weight else F.get("_v", F.lit(i)).cast("double")
    sums = [F.sum(element(i)).alias(f"_s{i}") for i in range(CHUNK)]
    got = cut.groupBy(*by, "_c").agg(F.count("*").alias("_rows"), F.max(F.size("_v")).alias("_n"), *sums)
    summed = F.slice(F.array(*[F.col(f"_s{i}") for i in range(CHUNK)]), F.lit(1), F.greatest("_n", F.lit(0)))
    more = [F.col("_rows").alias(rows)] if rows else []
    if one:
        return got.select(*by, summed.alias(out), *more)
    whole = got.select(*by, F.struct("_c", summed.alias("_v"), "_rows").alias("_p")).groupBy(*by).agg(F.sort_array(F.collect_list("_p")).alias("_p"))
    more = [F.get("_p", F.lit(0))["_rows"].alias(rows)] if rows else []
    return whole.select(*by, F.flatten(F.transform("_p", lambda p: p["_v"])).alias(out), *more)
