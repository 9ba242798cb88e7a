"""Intermediate tables in the shared folder: lineage ends there, and a lost executor costs a re-read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: One folder per driver process under the shared one, so that ``clear`` removes what this process has written.
RUN = uuid.uuid4().hex


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the folder set on its context. Without either, one in the warehouse if Spark
    runs on this machine only; on a cluster that may be a local folder of each machine, so it is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = got.get() if got.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return found.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder of its own for tables or files of this process."""
    return f"{shared_dir(spark)}/neighborflow/{RUN}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """The same rows, read back from a table of their own. Results read such tables lazily; ``clear`` them once all results
    are stored."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove all intermediate tables and files of this process. DataFrames that read them are of no use afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/neighborflow/{RUN}")
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
