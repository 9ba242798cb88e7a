"""Tables cut by rank: a Parquet folder partitioned by rank for each table, and a folder that describes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from neighborflow.functions.partition import near_even_rank

ABOUT = "name string, n long, columns array<string>, types array<string>, dims array<int>, world int"


def dump_ranks(tables: dict[str, DataFrame], path: str, world: int) -> None:
    """Tables with ids 0 to n - 1 under ``path``, their rows owned by ranks under the near-even plan. Rows are dealt by
    ranges of ids first, so a task writes few ranks and a large rank is written by many tasks."""
    if world < 1:
        raise ValueError("at least one rank is needed")
    about, spark = [], None
    for name, table in tables.items():
        spark = table.sparkSession
        n, kept = table.count(), [c for c in table.columns if c != "id"]
        table.withColumn("rank", near_even_rank(F.col("id"), max(1, n), world).cast("int")).repartitionByRange("id").write.mode("overwrite").partitionBy("rank").parquet(f"{path}/{name}")
        arrays = [c for c in kept if isinstance(table.schema[c].dataType, ArrayType)]
        sizes = table.select(*[F.size(c).alias(c) for c in arrays]).first() if arrays else None
        about.append((name, n, kept, [table.schema[c].dataType.simpleString() for c in kept], [sizes[c] if sizes and c in arrays else 1 for c in kept], world))
    if spark:
        spark.createDataFrame(about, ABOUT).coalesce(1).write.mode("overwrite").json(f"{path}/about")


def about_ranks(spark: SparkSession, path: str) -> DataFrame:
    """What was dumped: a row per table."""
    return spark.read.schema(ABOUT).json(f"{path}/about")


def load_ranks(spark: SparkSession, path: str, name: str, rank: int | None = None) -> DataFrame:
    """A rank's rows of a table, read from its own folder only, or with ``rank`` the rows of all."""
    known = about_ranks(spark, path).where(F.col("name") == name).first()
    if known is None:
        raise KeyError(name)
    kinds = ", ".join(f"`{c}` {t}" for c, t in zip(known["columns"], known["types"], strict=True))
    table = spark.read.schema(f"id long, {kinds}, rank int").parquet(f"{path}/{name}")
    if rank is None:
        return table
    if not 0 <= rank < known["world"]:
        raise ValueError(f"there are {known['world']} ranks")
    return table.where(F.col("rank") == rank).drop("rank")
