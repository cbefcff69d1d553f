"""The panel's cells over a stream of events: tumbling windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cells(events: DataFrame, period: str = "5 days", late: str = "1 day") -> DataFrame:
    """``id, grp, start`` and the period's measures; as a batch the watermark has no effect."""
    amount = F.col("value").cast("decimal(18,2)")
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", period).alias("w"), F.col("user_id").alias("id"), F.col("event_type").alias("grp"))
        .agg(F.sum(amount).cast("double").alias("total_value"), F.count("*").alias("volume"), F.max(amount).cast("double").alias("highest_amount"))
        .select("id", "grp", F.col("w.start").cast("timestamp_ntz").alias("start"), "total_value", "volume", "highest_amount")
    )
