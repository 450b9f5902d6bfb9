"""Session windows over event time. An extension: the batch operator is in operators.bank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_counts(events: DataFrame, user: str = "user_id", ts: str = "ts", idle: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Events per user and session; works on batches and, with a watermark, on streams."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("__ts", late)
    return timed.groupBy(user, F.session_window("__ts", idle).alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")
