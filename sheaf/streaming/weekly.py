"""An extension: weekly bars of a stream, by event time with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_stream(events: DataFrame, ts: str, key: str, value: str, late: str = "2 days") -> DataFrame:
    """Weeks that end on Friday, with their last value and count. Windows of 7 days begin on Saturday."""
    # 1970-01-03 was a Saturday
    week = F.window(ts, "7 days", "7 days", "2 days")
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(week, key).agg(F.max_by(value, ts).alias("last_value"), F.count(F.lit(1)).alias("n")).select(F.date_sub(F.to_date("window.end"), 1).alias("week"), key, "last_value", "n")
