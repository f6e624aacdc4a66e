"""Sampling and level checks over a stream, by tumbling windows of event time (an extension of the batch checks)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_checks(events: DataFrame, time: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, n, distinct_times (approximate), mean, sd, lo and hi of each window; works on streams and tables. Rows later
    than `late` behind the watermark are dropped by a stream."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = events.withWatermark(time, late) if events.isStreaming else events
    found = rows.groupBy(F.window(time, width)).agg(
        F.count(value).alias("n"), F.approx_count_distinct(time).alias("distinct_times"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("lo"), F.max(value).alias("hi"),
    )
    return found.select(F.col("window.start").alias("window_start"), "n", "distinct_times", "mean", "sd", "lo", "hi")
