"""Bars, weeks, features and labels of price series. All windows are partitioned by series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sheaf.functions.calendar import friday


def no_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities of double and float columns become null, as every aggregate below skips nulls only."""
    bad = lambda c: F.isnan(c) | F.abs(c).isin(float("inf"))
    return df.withColumns({c: F.when(~bad(F.col(c)), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the one with the greatest order; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*keys, "x.*")


def unique_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, failing at run time where a key stands twice."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("__n", n).withColumn("__ok", F.assert_true(F.col("__n") == 1, f"repeated key {keys}")).filter(F.col("__ok").isNull()).drop("__n", "__ok")


def daily_bars(raw: DataFrame, series: str = "symbol", day: str = "date", close: str = "close", volume: str = "volume", order: tuple[str, ...] = ("loaded_at", "bar_id")) -> DataFrame:
    """(series, date, close, volume): the last delivered bar of each day, without those that have no close."""
    named = raw.select(F.col(series).alias("series"), F.col(day).cast("date").alias("date"), F.col(close).cast("double").alias("close"), F.col(volume).cast("long").alias("volume"), *order)
    return no_nan(latest(named.filter("series is not null and date is not null"), ["series", "date"], list(order))).select("series", "date", "close", "volume").filter("close is not null")


def weekly_bars(bars: DataFrame) -> DataFrame:
    """(series, week, close, volume): weeks that end on Friday with their last close and total volume; weeks without bars are absent."""
    return bars.groupBy("series", friday(F.col("date")).alias("week")).agg(F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"))


def full(agg: Column, value: Column, over: WindowSpec, n: int) -> Column:
    """agg over a window, null unless all n values are there."""
    return F.when(F.count(value).over(over) == n, agg.over(over))


def weekly_features(weeks: DataFrame) -> DataFrame:
    """Lags, volatilities, momenta and next week's return, by rows within the series."""
    w = Window.partitionBy("series").orderBy("week")
    back = lambda n: w.rowsBetween(-(n - 1), 0)
    out = weeks.withColumn("price_log_close", F.when(F.col("close") > 0, F.ln("close")))
    out = out.withColumn("price_log_return", F.col("price_log_close") - F.lag("price_log_close").over(w))
    r, v = F.col("price_log_return"), F.when(F.col("volume") > 0, F.ln("volume"))
    return out.select(
        "*", *[F.lag(r, k).over(w).alias(f"price_lag_return_{k}w") for k in (1, 2, 4, 12)], *[full(F.stddev_samp(r), r, back(n), n).alias(f"price_rolling_vol_{n}w") for n in (4, 12)],
        *[(F.col("price_log_close") - F.lag("price_log_close", n).over(w)).alias(f"price_momentum_{n}w") for n in (4, 12)], (v - F.lag(v, 4).over(w)).alias("price_volume_change_4w"),
        F.lead(r).over(w).alias("target_log_return_next"), (F.lead(r).over(w) > 0).cast("int").alias("target_up_next"),
    )


def horizon_targets(features: DataFrame, weeks: int) -> DataFrame:
    """Total and realised volatility of the next so many weekly returns; null unless all are there."""
    ahead = Window.partitionBy("series").orderBy("week").rowsBetween(1, weeks)
    r = F.col("price_log_return")
    return features.select("series", "week", full(F.sum(r), r, ahead, weeks).alias("target_return"), F.sqrt(full(F.sum(r * r), r, ahead, weeks)).alias("target_vol"))


def daily_features(bars: DataFrame, horizon: int = 5, band: float = 0.02) -> DataFrame:
    """Daily returns, lags, volatilities, momenta and forward returns; a missing target has class 0."""
    w = Window.partitionBy("series").orderBy("date")
    out = bars.withColumn("log_close", F.when(F.col("close") > 0, F.ln("close")))
    out = out.withColumn("return_1d", F.try_divide("close", F.lag("close").over(w)) - 1).withColumn("log_return_1d", F.col("log_close") - F.lag("log_close").over(w))
    ahead = lambda n: F.try_divide(F.lead("close", n).over(w), F.col("close")) - 1
    r = F.col("log_return_1d")
    out = out.select(
        "series", "date", "close", "return_1d", "log_return_1d", ahead(1).alias("target_next_1d_return"), ahead(horizon).alias("target_return"), *[F.lag("return_1d", k).over(w).alias(f"price_return_lag_{k}d") for k in (1, 2, 5, 10, 21)],
        *[full(F.stddev_samp(r), r, w.rowsBetween(-(n - 1), 0), n).alias(f"price_vol_{n}d") for n in (5, 10, 21, 63)], *[(F.col("log_close") - F.lag("log_close", n).over(w)).alias(f"price_momentum_{n}d") for n in (5, 10, 21, 63)],
    )
    return out.withColumn("target_class", F.when(F.col("target_return") <= -band, -1).when(F.col("target_return") >= band, 1).otherwise(0))


def band_class(x: Column, band: float) -> Column:
    """-1, 0, 1 by a fixed band whose edges count; null stays null."""
    return F.when(x.isNull(), None).when(x <= -band, -1).when(x >= band, 1).otherwise(0)


def scaled_class(x: Column, scale: Column, k: float) -> Column:
    """-1, 0, 1 by a band of k times scale whose edges don't count; null if either is."""
    return F.when(x.isNull() | scale.isNull(), None).when(x < -k * scale, -1).when(x > k * scale, 1).otherwise(0)


def trailing_mean_before(df: DataFrame, value: str, rows: int, series: str = "series", order: str = "date") -> Column:
    """Mean of up to so many rows before the current one."""
    return F.avg(value).over(Window.partitionBy(series).orderBy(order).rowsBetween(-rows, -1))
