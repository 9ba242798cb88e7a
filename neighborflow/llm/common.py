"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, read by Spark only, so any store that Spark knows works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most rows and bytes that go to Python at once: whole texts are long, so the default of 10,000 rows of any size would
#: hold too much.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker and its Arrow buffers hold, in rows and bytes. Spark has these bounds for a session only,
    so they stay set; a smaller setting of the session stays as it is."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    try:
        held = int(str(spark.conf.get(size)).rstrip("bB"))
    except ValueError:  # written with a unit: set by someone
        return
    if not 0 < held <= BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names; a null text is an empty one.

    Selecting first keeps every other column, whatever its name, out of the plan.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir, or the one set on its context. Without either, one
    in the warehouse on a single machine, and an error on a cluster, where the warehouse may be a local folder."""
    from neighborflow import scratch

    return scratch.shared_dir(spark)


class Scratch:
    """Intermediate tables of one run, in a folder of their own under the shared folder.

    A written table cuts the lineage for good: an executor lost later costs a re-read, not a recomputation.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.saved: set[str] = set()

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.saved.add(name)
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def only(self, *names: str) -> None:
        """Remove all tables but these, which a lazy result still reads."""
        if gone := sorted(self.saved - set(names)):
            self.drop(*gone)

    def drop(self, *names: str) -> None:
        """Remove tables no later step reads; without names, all of them."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for path in [f"{self.root}/{n}" for n in names] or [self.root]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        self.saved -= set(names or self.saved)
