"""Edges that arrive as a stream: appended to a table with batch-stable ids, and windowed degree counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_edges(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch overwrites the partition of its own number, so a batch that is replayed after a failure is not
    added twice."""

    def put(df: DataFrame, batch: int) -> None:
        df.withColumn("arrival", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/arrival_batch={batch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_degree(stream: DataFrame, time: str, by: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window_start, by, deg): edges per centre and window; edges later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), F.col(by)).agg(F.count("*").alias("deg")).select(F.col("w.start").alias("window_start"), by, "deg")
