"""Calendar expressions on date columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def friday(d: Column) -> Column:
    """The Friday on or after a date."""
    return F.date_add(d, F.pmod(F.lit(6) - F.dayofweek(d), F.lit(7)))


def monday(d: Column) -> Column:
    """The Monday on or before a date."""
    return F.to_date(F.date_trunc("week", d))


def calendar_columns(d: Column) -> dict[str, Column]:
    """Month, quarter, ISO week with its circle, and the weekly track's seasons."""
    angle = F.weekofyear(d) * (2 * math.pi / 52)
    months = lambda *m: F.month(d).isin(*m).cast("int")
    return {
        "calendar_month": F.month(d), "calendar_quarter": F.quarter(d), "calendar_week_of_year": F.weekofyear(d), "calendar_week_sin": F.sin(angle), "calendar_week_cos": F.cos(angle),
        "calendar_is_planting_season": months(4, 5), "calendar_is_pollination_weather_season": months(6, 7, 8), "calendar_is_harvest_season": months(9, 10, 11), "calendar_is_winter_storage_season": months(12, 1, 2),
    }


def daily_calendar_columns(d: Column) -> dict[str, Column]:
    """The daily track's columns: week and weekday circles; its pollination season is July and August."""
    week, day = F.weekofyear(d) * (2 * math.pi / 52), F.weekday(d) * (2 * math.pi / 5)
    months = lambda *m: F.month(d).isin(*m).cast("int")
    return {
        "month": F.month(d), "quarter": F.quarter(d), "weekofyear_sin": F.sin(week), "weekofyear_cos": F.cos(week), "dayofweek_sin": F.sin(day), "dayofweek_cos": F.cos(day),
        "is_planting_season": months(4, 5), "is_pollination_season": months(7, 8), "is_harvest_season": months(9, 10, 11), "is_winter_storage_season": months(12, 1, 2),
    }


def is_leap(d: Column) -> Column:
    return F.dayofyear(F.last_day(F.make_date(F.year(d), F.lit(2), F.lit(1)))) == 60


def season_day(d: Column) -> Column:
    """Day of a year of 365 days: 29 February counts as 28 February."""
    return F.dayofyear(d) - F.when(is_leap(d) & (F.dayofyear(d) >= 60), 1).otherwise(0)


def circular_distance(a: Column, b: Column, period: int = 365) -> Column:
    return F.least(F.abs(a - b), period - F.abs(a - b))


def in_month_day_window(d: Column, start: tuple[int, int], end: tuple[int, int]) -> Column:
    """Whether a date lies in a yearly window, which may run over the year's end."""
    at, lo, hi = F.month(d) * 100 + F.day(d), start[0] * 100 + start[1], end[0] * 100 + end[1]
    return at.between(lo, hi) if lo <= hi else (at >= lo) | (at <= hi)


def yyyymmdd(d: Column) -> Column:
    return F.date_format(d, "yyyyMMdd").cast("int")


def from_yyyymmdd(n: Column) -> Column:
    """The date of a number; null for 0 and impossible dates."""
    return F.try_to_timestamp(F.lpad(n.cast("string"), 8, "0"), F.lit("yyyyMMdd")).cast("date")


def month_ranges(start: str, end: str) -> Column:
    """Array of (month_start, month_end): the months of a half-open span, the first from its start, the last up to its end."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    firsts = F.when(a < b, F.sequence(F.trunc(a, "month"), F.date_sub(b, 1), F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))
    return F.transform(firsts, lambda m: F.struct(F.greatest(m, a).alias("month_start"), F.least(F.add_months(m, 1), b).alias("month_end")))


def lead_hours(lead_days: int, six_hourly: bool = False) -> list[int]:
    """Hours ahead of a schedule: every 6, or at 7, 14, 21, 28 and each 30 days."""
    if six_hourly:
        return [*range(6, lead_days * 24 + 1, 6)]
    return sorted({24 * d for d in [7, 14, 21, 28, *range(30, lead_days + 1, 30)] if d <= lead_days})


def year_slots(year: Column) -> Column:
    """Array of 366 (slot, day) of a year, the last day null unless it is a leap year."""
    first = F.make_date(year, F.lit(1), F.lit(1))
    return F.transform(F.sequence(F.lit(1), F.lit(366)), lambda k: F.struct(k.alias("slot"), F.when(F.year(F.date_add(first, k - 1)) == year, F.date_add(first, k - 1)).alias("day")))


def init_span(first_year: int, last_year: int, hours: list[int]) -> tuple[Column, Column]:
    """(first, last) day of the initialisations whose forecasts reach into a span of years."""
    return F.date_sub(F.lit(f"{first_year}-01-01").cast("date"), max(hours) // 24), F.date_sub(F.lit(f"{last_year}-12-31").cast("date"), min(hours) // 24)


def growing_degrees(temperature_f: Column) -> Column:
    """Growing degree days of a week of a mean temperature in Fahrenheit."""
    return F.greatest((temperature_f - 50) * 7, F.lit(0.0))
