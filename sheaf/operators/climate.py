"""Lead-indexed forecasts: re-indexing, climatology, pivots, and statistics of grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.calendar import season_day


def climatology(rows: DataFrame, by: list[str], day: str, value: str, window: int = 10, least: int = 5, expanding: bool = True) -> DataFrame:
    """rows with climo_n, climo_mean, climo_std, anomaly and z against the days of the season around.

    Days of the season are on a circle of 365. Rows of earlier dates count (or, not expanding, all
    but the row's own date). Rows are first reduced to moments of each season day and date, those
    are spread over the days they reach, and each row meets its own day: an equi-join, whose work
    per row is the number of years times the window, never all pairs.
    """
    half = window // 2
    if 2 * half + 1 > 365:
        raise ValueError("the window would meet a day twice")
    sd = season_day(F.col(day))
    x = F.col(value)
    moments = rows.filter(x.isNotNull() & F.col(day).isNotNull()).groupBy(*by, F.col(day).alias("__d")).agg(F.count(x).alias("__n"), F.sum(x).alias("__s"), F.sum(x * x).alias("__q"))
    spread = moments.withColumn("__k", F.explode(F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda o: F.pmod(season_day(F.col("__d")) - 1 + o, F.lit(365)) + 1)))
    days = rows.filter(F.col(day).isNotNull()).select(*by, F.col(day).alias("__day"), sd.alias("__k")).distinct()
    older = (F.col("__d") < F.col("__day")) if expanding else (F.col("__d") != F.col("__day"))
    met = days.join(spread, [*by, "__k"]).filter(older).groupBy(*by, "__day").agg(F.sum("__n").alias("__n"), F.sum("__s").alias("__s"), F.sum("__q").alias("__q"))
    n, s, q = F.col("__n"), F.col("__s"), F.col("__q")
    enough = F.coalesce(n, F.lit(0)) >= least
    out = rows.withColumn("__day", F.col(day)).join(met, [*by, "__day"], "left")
    out = out.withColumns({"climo_n": F.coalesce(n, F.lit(0)), "climo_mean": F.when(enough, s / n), "climo_std": F.when(enough & (n > 1), F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))))})
    out = out.withColumn("anomaly", x - F.col("climo_mean"))
    return out.withColumn("z", F.when(F.col("climo_std") > 0, F.col("anomaly") / F.col("climo_std"))).drop("__day", "__n", "__s", "__q")


def lead_bucket(days: Column, leads: list[int]) -> Column:
    """The least lead of at least so many days; null beyond the last."""
    out = F.when(days <= leads[0], leads[0])
    for x in leads[1:]:
        out = out.when(days <= x, x)
    return out


def pivot_leads(rows: DataFrame, key: str, lead: str, leads: list[int], values: list[str]) -> DataFrame:
    """One row a key with <value>_l<lead> columns; the leads are given, so nothing is scanned to find them."""
    cells = [F.max(F.when(F.col(lead) == x, F.col(v))).alias(f"{v}_l{x}") for v in values for x in leads]
    return rows.groupBy(key).agg(*cells)


def row_mean(columns: list[str]) -> Column:
    """Mean over columns of those that aren't null; null if all are."""
    there = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there))


def heat_dryness(df: DataFrame, leads: list[int], heat: str, wet: str, heat0: str, wet0: str) -> DataFrame:
    """Heat, dryness, their product, and the projected changes against the initial state, for each lead."""
    out = df
    for x in leads:
        h, d = F.col(f"{heat}_l{x}"), -F.col(f"{wet}_l{x}")
        out = out.withColumns({f"heat_l{x}": h, f"dryness_l{x}": d, f"heat_x_dryness_l{x}": h * d, f"heat_change_l{x}": h - F.col(heat0), f"dryness_change_l{x}": d + F.col(wet0)})
        out = out.withColumn(f"projected_heat_x_dryness_l{x}", F.col(f"heat_change_l{x}") * F.col(f"dryness_change_l{x}"))
    return out


def weighted_moments(df: DataFrame, by: list[str], value: Column, weight: Column) -> DataFrame:
    """Weighted mean, population deviation and number of the cells that have both."""
    x = df.withColumns({"__x": value, "__w": weight}).filter("__x is not null and __w > 0")
    sw, sx, sq = F.sum("__w"), F.sum(F.col("__w") * F.col("__x")), F.sum(F.col("__w") * F.col("__x") * F.col("__x"))
    return x.groupBy(*by).agg((sx / sw).alias("mean"), F.sqrt(F.greatest(sq / sw - (sx / sw) * (sx / sw), F.lit(0.0))).alias("std"), F.count(F.lit(1)).alias("n_valid"))


def in_box(lat: Column, lon: Column, north: float, west: float, south: float, east: float) -> Column:
    """Whether a point lies in a box; longitudes of either convention, boxes may cross the date line."""
    x, w, e = F.pmod(lon, F.lit(360.0)), west % 360, east % 360
    return lat.between(south, north) & (x.between(w, e) if w <= e else (x >= w) | (x <= e))


def overlap(a0: Column, a1: Column, b0: float, b1: float) -> Column:
    """Length of what two intervals have in common."""
    return F.greatest(F.least(a1, F.lit(b1)) - F.greatest(a0, F.lit(b0)), F.lit(0.0))


def cell_overlap(lat: Column, lon: Column, dlat: float, dlon: float, north: float, west: float, south: float, east: float) -> Column:
    """Weight of a grid cell by the part of it inside a box on the sphere: difference of the latitudes' sines times degrees of longitude.

    Longitudes may be of either convention and the box may cross the date line.
    """
    top, low = F.least(lat + dlat / 2, F.lit(north)), F.greatest(lat - dlat / 2, F.lit(south))
    x, w = F.pmod(lon, F.lit(360.0)), west % 360
    e = w + (east - west) % 360
    wide = sum((overlap(x - dlon / 2 + turn, x + dlon / 2 + turn, w, e) for turn in (-360, 0, 360)), F.lit(0.0))
    return F.when(top > low, (F.sin(F.radians(top)) - F.sin(F.radians(low))) * wide).otherwise(0.0)


def calendar_grid(start: Column, end: Column, leads: list[int]) -> tuple[Column, Column]:
    """Expressions of (valid_date, lead) arrays to be exploded: every day and lead of a span."""
    return F.sequence(start, end), F.array(*map(F.lit, leads))


def first_non_null(df: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """For each key the first non-null of each column in an order."""
    return df.groupBy(key).agg(*[F.min_by(F.col(v), F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values])
