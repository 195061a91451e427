"""Streaming form of the daily document attention.

The same sums as the batch operator, kept per day and topic as documents arrive.
A day is emitted once the watermark has passed its end, so late documents within
the delay still count and state never outgrows the open days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.columns import finite, ratio


def streaming_document_attention(theta: DataFrame, delay: str = "2 days", weighted: bool = True) -> DataFrame:
    """``(date, topic, level)`` from a stream of (ts, topic, weight, theta)."""
    w = F.col("weight") if weighted else F.lit(1.0)
    share = finite(F.col("theta"))
    sums = (
        theta.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day").alias("day"), "topic")
        .agg(F.sum(share * w).alias("num"), F.sum(F.when(share.isNotNull(), w)).alias("den"))
    )
    return sums.select(F.to_date("day.start").alias("date"), "topic", ratio(F.col("num"), F.col("den")).alias("level"))
