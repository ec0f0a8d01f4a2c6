"""Bursts over a stream of calls: beyond the batch rule, which it follows day
by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "day date, n long"


def daily(calls: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, n) of a stream of ``start_time``: tumbling days, final once the
    watermark has passed them."""
    timed = calls.withColumn("at", F.col("start_time").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 day")).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("window.start").alias("day"), "n")


def judged(days: DataFrame, z: float = 2.5, high: float = 3.5, least: int = 6, seen: int = 5) -> DataFrame:
    """(day, n, z, severity) of the days far above the mean of all days held."""
    level = days.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"), F.count(F.lit(1)).alias("days"))
    scored = days.crossJoin(F.broadcast(level)).withColumn("z", (F.col("n") - F.col("mean")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")))
    return scored.where((F.col("days") >= seen) & (F.col("n") >= least) & (F.col("z") >= z)).select("day", "n", F.round("z", 2).alias("z"), F.when(F.col("z") >= high, "high").otherwise("medium").alias("severity"))


def watch(calls: DataFrame, folder: str, checkpoint: str, late: str = "2 days") -> StreamingQuery:
    """Finished days go to ``folder`` once each; ``judged`` reads it at any time."""
    return daily(calls, late).writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
