"""Snapshots of a stream of events: the running form of the resource log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(events: DataFrame, seconds: int, *by: str | Column, value: str = "value", time: str = "ts") -> DataFrame:
    """``(window_start, *by, n, total)`` of tumbling windows; the same code for batches and streams."""
    window = F.window(time, f"{seconds} seconds")
    out = events.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    keys = [b if isinstance(b, str) else b._jc.toString() for b in by]
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def stream(spark: SparkSession, path: str, schema, seconds: int, *by: str, late: str = "1 minute", value: str = "value", time: str = "ts") -> DataFrame:
    """Tumbling snapshots of a folder that files arrive in; rows later than ``late`` are left out."""
    events = spark.readStream.schema(schema).parquet(path).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return tumbling(events, seconds, *by, value=value, time=time)


def run(snapshots: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append closed windows to Parquet; ``once`` takes what is there and ends."""
    writer = snapshots.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
