"""Run logs: phase durations and resource usage."""

from __future__ import annotations

import contextlib
import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import append_log


def durations(marks: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Each mark's time to the next mark of the same key: ``(key, value, started, seconds)``; the last has none."""
    following = F.lead(time).over(Window.partitionBy(key).orderBy(time, value))
    gap = F.unix_micros(following.cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))
    return marks.withColumn("_ls_gap", gap).where("_ls_gap is not null").select(key, value, F.col(time).alias("started"), F.round(F.col("_ls_gap") / 1e6, 3).alias("seconds"))


def usage(log: DataFrame, user: str, start: int, end: int) -> DataFrame:
    """``(second, containers, mem)``: a user's sums per snapshot between two epoch seconds, from the first one on."""
    own = log.where(F.col("user") == user).withColumn("s", F.unix_seconds("ts")).where(F.col("s").between(start, end))
    return own.groupBy((F.col("s") - start).alias("second")).agg(F.sum("containers").alias("containers"), F.sum("mem").alias("mem"))


class Phases:
    """Wall times of a run's phases, kept on the driver until they are appended to a log."""

    def __init__(self, task: str):
        self.task, self.rows = task, []

    @contextlib.contextmanager
    def phase(self, name: str):
        began = time.time()
        try:
            yield
        finally:
            self.rows.append((self.task, name, began, time.time() - began))

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, "task string, phase string, started double, seconds double")

    def append(self, spark, path: str) -> None:
        """The phases so far as lines behind those of a log."""
        append_log(spark, self.table(spark), path)
