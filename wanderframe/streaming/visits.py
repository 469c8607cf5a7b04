"""Footprints as a stream: visit counts by event time, and walks that are handed on epoch by epoch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FOOTPRINTS = "walker long, vertex long, step long, epoch int, logged_at timestamp"


def read_footprints(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(FOOTPRINTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_visits(visits: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, vertex, visits) for each window.  Rows up to `late` behind count; a row delivered twice within that time counts once."""
    rows = visits.where("walker IS NOT NULL AND vertex IS NOT NULL").withWatermark("logged_at", late)
    once = rows.dropDuplicatesWithinWatermark(["walker", "step", "vertex"])
    counted = once.groupBy(F.window("logged_at", window).alias("w"), "vertex").agg(F.count(F.lit(1)).alias("visits"))
    return counted.select(F.col("w.start").alias("start"), "vertex", "visits")


def each_epoch(visits: DataFrame, consumer: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls consumer(rows, batch) for every micro-batch, at least once; the batch number tells repeats apart."""
    return visits.writeStream.foreachBatch(consumer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
