"""Global row numbers and prefix sums without a single-task window.

Rows are range-partitioned and sorted, written once, and numbered by the place in their partition plus the rows of the
partitions before. Only one count per partition reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neighborflow.scratch import written


def _ordered(df: DataFrame, order: list) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    return written(df.repartitionByRange(parts, *cols).sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id()), "ordered")


def _with_base(rows: DataFrame, values: dict, kind: str = "long") -> DataFrame:
    """Each row with its partition's base: a look-up table of one row per partition, sent to every task."""
    table = rows.sparkSession.createDataFrame(sorted(values.items()), f"_p long, _base {kind}")
    return rows.join(F.broadcast(table), F.shiftright("_at", 33) == F.col("_p")).drop("_p")


def _numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    rows = _ordered(df, order)
    sizes = rows.groupBy(F.shiftright("_at", 33).alias("p")).count().orderBy("p").collect()  # one row per partition
    before, total = {}, 0
    for r in sizes:
        before[r["p"]] = total
        total += r["count"]
    return _with_base(rows, before).withColumn(name, (F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_base")


def number_rows(df: DataFrame, order: list, name: str = "eid") -> DataFrame:
    """0-based row numbers in an order that must be total for them to be fixed."""
    return _numbered(df, order, name).drop("_at")


def number_within(df: DataFrame, by: list[str], order: list, name: str, size: str | None = None) -> DataFrame:
    """0-based row numbers within each key ``by`` in an order that must be total for them to be fixed; nulls are a key like
    any other. ``size``: a column for the key's number of rows.

    One range sort over key and order, so a key with any share of the rows spans as many tasks as it needs. A row's number
    is its global one less that of its key's first row. That first row is carried to each part of the sort as one line per
    (part, key), and looked up by both, so no task of the look-up holds more of a key than one part does."""
    rows = _numbered(df, [*by, *order], "_g").withColumn("_part", F.shiftright("_at", 33)).drop("_at")
    runs = rows.groupBy("_part", *by).agg(F.min("_g").alias("_lo"), F.count("*").alias("_n"))
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    first = runs.groupBy(*keys).agg(F.min("_lo").alias("_first"), F.sum("_n").alias("_all"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    carried = runs.join(first, same).select(F.col("_part").alias("_of"), *[F.col(f"_k{i}") for i in range(len(by))], "_first", "_all")
    found = rows.join(carried, [F.col("_part") == F.col("_of"), *same])
    more = [F.col("_all").alias(size)] if size else []
    return found.select(*df.columns, (F.col("_g") - F.col("_first")).alias(name), *more)


def prefix_sum(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """Exclusive running sum over a total order, long for whole numbers, else double: a window inside each partition, plus
    the partitions before."""
    from pyspark.sql import Window

    rows = _ordered(df, order)
    part = F.shiftright("_at", 33)
    sums = rows.groupBy(part.alias("p")).agg(F.sum(value).alias("s")).orderBy("p").collect()  # one row per partition
    whole = dict(rows.dtypes)[value] in ("tinyint", "smallint", "int", "bigint")
    kind, before, total = ("long", {}, 0) if whole else ("double", {}, 0.0)
    for r in sums:
        before[r["p"]] = total
        total += (r["s"] or 0) if whole else float(r["s"] or 0)
    inside = Window.partitionBy(part).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)).cast(kind))
    return _with_base(own, before, kind).withColumn(name, (F.col("_base") + F.col(name)).cast(kind)).drop("_at", "_base")


def search_sorted(values: DataFrame, probes: DataFrame, value: str, probe: str, name: str, by: tuple[str, ...] = (), inclusive: bool = True, count: str | None = None) -> DataFrame:
    """``probes`` with ``name``: how many of all ``values``, ordered by ``by`` and value, come before the probe; equal ones
    count if ``inclusive``, and a value as often as its column ``count`` says. The next value, if any, is the one with that number in the same order.

    Values and probes are range-sorted together and values counted as a prefix sum, so no side is sent to all tasks and a
    value that many probes share, or the reverse, is not one task's work."""
    first, second = (0, 1) if inclusive else (1, 0)
    tie = F.monotonically_increasing_id()
    v = values.select(*by, F.col(value).alias("_x"), F.lit(first).alias("_kind"), tie.alias("_tie"), (F.col(count) if count else F.lit(1)).cast("long").alias("_one"))
    p = probes.select(*by, F.col(probe).alias("_x"), F.lit(second).alias("_kind"), tie.alias("_tie"), F.lit(0).cast("long").alias("_one"), F.struct(*probes.columns).alias("_row"))
    both = v.unionByName(p, allowMissingColumns=True)
    counted = prefix_sum(both, [*by, "_x", "_kind", "_tie"], "_one", "_before")
    return counted.where(F.col("_row").isNotNull()).select("_row.*", F.col("_before").alias(name))


def prefix_within(df: DataFrame, by: list[str], order: list, value: str, name: str, total: str) -> DataFrame:
    """Inclusive running sums of a fractional ``value`` within each key, and the key's ``total``; a key may span tasks. Sums
    run inside each part of one range sort, and each part of a key adds the sums of its parts before."""
    from pyspark.sql import Window

    rows = _ordered(df, [*by, *order]).withColumn("_part", F.shiftright("_at", 33))
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    runs = rows.groupBy(F.col("_part").alias("_of"), *keys).agg(F.sum(value).cast("double").alias("_sum"))
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(by))])  # a row per part that holds the key
    upto = w.orderBy("_of").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = runs.withColumn("_end", F.sum("_sum").over(upto)).withColumn("_all", F.max("_end").over(w)).withColumn("_begin", F.coalesce(F.lag("_end").over(w.orderBy("_of")), F.lit(0.0)))
    own = Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = Window.partitionBy("_part", *by).orderBy(F.col("_at").desc())
    inside = rows.withColumn("_own", F.sum(F.col(value).cast("double")).over(own)).withColumn("_last", F.row_number().over(last) == 1)
    same = [F.col("_part") == F.col("_of"), *[F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]]
    # The last row of a part ends where the next part begins, whatever the rounding of sums in between.
    ends = F.when(F.col("_last"), F.col("_end")).otherwise(F.least(F.col("_begin") + F.col("_own"), F.col("_end")))
    return inside.join(runs, same).select(*df.columns, ends.alias(name), F.col("_all").alias(total))
