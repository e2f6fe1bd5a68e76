"""Addresses and request bodies of forecast archives, as columns of the initialisation time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _stamp(t: Column, form: str) -> Column:
    return F.date_format(t, form)


def _folders(base: str, init: Column) -> Column:
    return F.concat_ws("/", F.lit(base), _stamp(init, "yyyy"), _stamp(init, "yyyyMM"), _stamp(init, "yyyyMMdd"), _stamp(init, "yyyyMMddHH"))


def forecast_url(base: str, init: Column, hours: Column, kind: str = "pgbf", member: str = "01") -> Column:
    """A forecast file by valid time, member and initialisation; base ends before the year."""
    valid = F.timestamp_seconds(F.unix_seconds(init) + hours * 3600)
    return F.concat(_folders(base, init), F.lit(f"/{kind}"), _stamp(valid, "yyyyMMddHH"), F.lit(f".{member}."), _stamp(init, "yyyyMMddHH"), F.lit(".grb2"))


def reforecast_url(base: str, init: Column, level: str = "tmp_2m", member: str = "c00", days: str = "Days:1-10") -> Column:
    """A reforecast file by variable, member and range of days."""
    stamp = _stamp(init, "yyyyMMddHH")
    return F.concat(F.lit(f"{base}/"), _stamp(init, "yyyy"), F.lit("/"), stamp, F.lit(f"/{member}/{days}/{level}_"), stamp, F.lit(f"_{member}.grb2"))


def reanalysis_request(dataset: str, month: Column, variables: list[str], box: tuple[float, float, float, float]) -> Column:
    """The JSON body that asks for the daily means of a month; month is any date in it."""
    days = F.transform(F.sequence(F.lit(1), F.dayofmonth(F.last_day(month))), lambda k: F.lpad(k.cast("string"), 2, "0"))
    request = F.struct(
        F.lit("reanalysis").alias("product_type"), F.array(*map(F.lit, variables)).alias("variable"), F.date_format(month, "yyyy").alias("year"), F.date_format(month, "MM").alias("month"), days.alias("day"),
        F.lit("daily_mean").alias("daily_statistic"), F.lit("utc+00:00").alias("time_zone"), F.lit("1_hourly").alias("frequency"), F.array(*map(F.lit, box)).alias("area"),
    )
    return F.to_json(F.struct(F.lit(dataset).alias("dataset"), request.alias("request")))


def listing_url(base: str, start: Column, end: Column, query: Column, most: int = 250, sort: str = "datedesc") -> Column:
    """An article list's address; parameters are percent-encoded with + for spaces."""
    part = lambda name, c: F.concat(F.lit(f"{name}="), F.url_encode(c))
    return F.concat(F.lit(f"{base}?"), F.concat_ws("&", part("query", query), F.lit("mode=artlist&format=json"), part("startdatetime", _stamp(start, "yyyyMMddHHmmss")), part("enddatetime", _stamp(end, "yyyyMMddHHmmss")), F.lit(f"maxrecords={most}&sort={sort}")))
