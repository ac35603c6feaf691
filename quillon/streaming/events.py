"""Streams: windows over event time, deduplication, observations, watched pointers."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum per window and key; rows later than `late` behind the stream are dropped by the watermark. Batch frames give the same."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    return events.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark(time, late)
    return events.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def once(events: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each key once; state is kept as long as the watermark."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def observations(calls: DataFrame, outcome: str = "outcome") -> DataFrame:
    """An event per call: answered, or missing where nothing was accepted."""
    return calls.select("call_id", F.when(F.col(outcome) == "rejected", "missing").otherwise("answered").alias("event"))


def drained(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there, then stop: an incremental job run by a schedule."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


class Watched:
    """What a pointer points at, loaded anew when the pointer has changed and then stayed as it is for `settle` seconds, so that a
    burst of changes is one load. What is loaded takes the place of the former in one step; if loading fails, that stays."""

    def __init__(self, modified, load, settle: float = 0.0, now=time.monotonic):
        self.modified, self.load, self.settle, self.now = modified, load, settle, now
        self.seen, self.changed_at, self.version, self.value = None, 0.0, None, None

    def get(self):
        version = self.modified()
        if version != self.seen:
            self.seen, self.changed_at = version, self.now()
        if version != self.version and (self.version is None or self.now() - self.changed_at >= self.settle):
            self.value, self.version = self.load(), version
        return self.value
