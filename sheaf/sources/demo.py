"""Made-up bars and weekly weather for trials without data: the same for the same seed and span.

The random stream is Spark's; only the shape of the series is meant. A series has some
thousand rows, so the running sum over it stays in one small partition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.functions.calendar import growing_degrees


def _wave(t: Column, period: float, shift: float = 0) -> Column:
    return F.sin((t + shift) * (2 * math.pi / period))


def demo_prices(spark: SparkSession, start: str, end: str, seed: int = 33200) -> DataFrame:
    """(date, open, high, low, close, adj_close, volume) of business days: a log walk with two seasons from 22."""
    days = spark.range(1).select(F.posexplode(F.filter(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date")), lambda d: F.weekday(d) < 5)).alias("t", "date")).coalesce(1)
    noise = lambda k: F.randn(seed + k)
    run = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    t = F.col("t")
    x = days.select("t", "date", *[noise(k).alias(f"e{k}") for k in range(5)])
    x = x.withColumn("close", F.exp(math.log(22) + F.sum(0.00005 + 0.00045 * _wave(t, 252) + 0.00025 * _wave(t, 63, 30) + 0.0075 * F.col("e0")).over(run)))
    x = x.withColumn("open", F.col("close") * (1 + 0.002 * F.col("e1")))
    volume = F.greatest(175_000 + 40_000 * (1 + _wave(t, 252)) + 12_000 * F.col("e4"), F.lit(10_000.0))
    return x.select("date", "open", (F.greatest("open", "close") * (1 + F.abs(0.002 + 0.001 * F.col("e2")))).alias("high"), (F.least("open", "close") * (1 - F.abs(0.002 + 0.001 * F.col("e3")))).alias("low"), "close", F.col("close").alias("adj_close"), volume.cast("long").alias("volume"))


def week_anomaly(df: DataFrame, value: str, week: str, by: list[str] | None = None, order: str | None = None) -> Column:
    """A value less the mean of its week of the year, summed up in an order if one is given: a sum's last bit depends on it."""
    w = Window.partitionBy(*(by or []), F.weekofyear(week))
    return F.col(value) - F.avg(value).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing) if order else w)


def demo_weather(spark: SparkSession, start: str, end: str, seed: int = 8080) -> DataFrame:
    """Weekly temperature, rain, growing degrees, anomalies and two weeks of forecasts, by Fridays."""
    weeks = spark.range(1).select(F.explode(F.filter(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date")), lambda d: F.weekday(d) == 4)).alias("week")).coalesce(1)
    x = weeks.select("week", *[F.randn(seed + k).alias(f"e{k}") for k in range(6)])
    day, rain = F.dayofyear("week"), lambda c: F.greatest(c, F.lit(0.0))
    x = x.withColumn("weather_temp_mean_f", 54 + 24 * _wave(day, 365.25, -105) + 3 * F.col("e0")).withColumn("weather_precip_mm", rain(18 + 10 * _wave(day, 365.25, -70) + 5 * F.col("e1")))
    t, p = F.col("weather_temp_mean_f"), F.col("weather_precip_mm")
    return x.select(
        "week", t, p, growing_degrees(t).alias("weather_gdd"), week_anomaly(x, "weather_temp_mean_f", "week").alias("weather_temp_anomaly_f"), week_anomaly(x, "weather_precip_mm", "week").alias("weather_precip_anomaly_mm"),
        (t + 2.5 * F.col("e2")).alias("weather_forecast_temp_week1_f"), rain(p + 4 * F.col("e3")).alias("weather_forecast_precip_week1_mm"), (t + 3.5 * F.col("e4")).alias("weather_forecast_temp_week2_f"), rain(p + 5 * F.col("e5")).alias("weather_forecast_precip_week2_mm"), F.year("week").alias("weather_year"),
    )
