"""Ranking snapshots as a stream: late repeats dropped, counts kept by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryscope.sources.shared import scratch


def distinct_snapshots(stream: DataFrame, keys: tuple[str, ...] = ("query_id", "item"), time: str = "ts", delay: str = "14 days") -> DataFrame:
    """Drop rows that repeat a key within the watermark; state is bounded by the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_weights(stream: DataFrame, width: str = "1 day", delay: str = "1 hour", time: str = "ts") -> DataFrame:
    """Summed value of each query and item by window; late rows beyond the delay are left out."""
    grouped = stream.withWatermark(time, delay).groupBy(F.window(time, width), "query_id", "item")
    return grouped.agg(F.sum("value").alias("weight")).select(F.col("window.start").alias("start"), "query_id", "item", "weight")


def run_once(result: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what there is now and return its result as a table in the shared folder.

    Each micro-batch replaces the table in ``complete`` mode and adds to it in ``append`` mode.
    """
    spark = result.sparkSession
    path = scratch(spark, name)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    query = result.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", scratch(spark, f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(path)
