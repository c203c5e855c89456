"""Structured Streaming forms of certification and daily use.

Spark's watermark is the latest event time less a delay; the batch operators' is the
snapshot's processing time less an allowance, by date.  They are different quantities:
the streaming forms serve continuously arriving tables and are checked for coverage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.schemas import EVENT_TYPES, PRODUCTS


def silver_stream(events: DataFrame, delay: str = "48 hours") -> DataFrame:
    """Valid rows of a stream of typed events, each event_id once within the watermark."""
    valid = events.where(F.col("user_id").isNotNull() & (F.trim("user_id") != "") & F.col("product").isin(*PRODUCTS) & F.col("event_type").isin(*EVENT_TYPES) & (F.col("revenue_gbp") >= 0) & ((F.col("event_type") == "purchase") | (F.col("revenue_gbp") == 0)))
    return valid.withColumn("event_ts", F.col("event_ts").cast("timestamp")).withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def daily_active_stream(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """Distinct users with app_open by product and closed day: first one row a user and day, then a windowed count."""
    day = F.date_trunc("day", F.col("event_ts").cast("timestamp")).alias("day")
    seen = events.where("event_type = 'app_open'").select("product", "user_id", day).withWatermark("day", delay).dropDuplicates(["product", "user_id", "day"])
    return seen.groupBy("product", F.window("day", "1 day")).agg(F.count("*").alias("dau")).select("product", F.to_date("window.start").alias("date"), "dau")
