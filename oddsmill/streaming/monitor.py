"""Monitors on streams: windowed statistics with a watermark, and a metrics row a micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(stream: DataFrame, time: str, value: str, by: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, by, n, total, lowest, highest; rows later than ``late`` are dropped."""
    g = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by)
    out = g.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("lowest"), F.max(value).alias("highest"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n", "total", "lowest", "highest")


def each_batch(stream: DataFrame, statistics: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Append what ``statistics`` makes of each micro-batch, with its number, to a folder of Parquet.

    A batch that is run again overwrites its own partition, so results count once.
    """

    def one(batch: DataFrame, number: int) -> None:
        statistics(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
