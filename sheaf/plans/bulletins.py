"""Queries that take paginated bulletins apart, and over schedules, sets and made-up series, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import bulletin as B
from sheaf.functions import calendar as K
from sheaf.operators import climate as C
from sheaf.operators import panel as P
from sheaf.operators import series as S
from sheaf.plans.models import weekly_panel
from sheaf.plans.prices import DAY, bars, rounded
from sheaf.plans.reports import _CLEAN, _FRI
from sheaf.plans.weather import _FC, LEADS, climo_one_out, covered, forecasts
from sheaf.runtime import fresh_path, read, remove, stored
from sheaf.sources import requests as Q
from sheaf.sources import tables as T
from sheaf.sources.demo import demo_prices, demo_weather, week_anomaly
from sheaf.sources.html import manifest


def paginated(s: SparkSession, d: str) -> DataFrame:
    """Bulletins laid out on four pages: the front with highlights in the left column, two inner pages, the summary, the table."""
    day = F.col("report_date").try_cast("date")
    flat = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("\f"), F.lit(""))
    long = lambda x: F.date_format(x, "MMMM d, yyyy")
    n, ending = F.pmod("bulletin_id", F.lit(3)), F.col("week_ending").try_cast("date")
    dates = F.when(n == 0, F.concat(F.lit("Crop Progress and Condition\n Week Ending "), long(ending))).when(n == 1, F.concat(F.date_format(ending, "MMMM"), F.lit(" 1 - "), F.date_format(ending, "d, yyyy"))).otherwise("no date")
    left = F.array_join(F.transform(F.split(flat("weather_highlights"), "\n"), lambda x: F.concat(x, F.lit("      Contents"))), "\n")
    front = F.concat(long(day), F.lit("   Weekly Weather and Crop Bulletin   1\n"), dates, F.lit("\nA \n"), left, F.lit("\n(Continued on page 3)\n"))
    third = F.concat(F.lit("3  Weekly Weather and Crop Bulletin  "), long(day), F.lit("\n(Continued from front cover)\n"), flat("national_ag_summary"), F.lit("\nAs the week began, more.\n"))
    fourth = F.concat(F.lit("Weekly National Agricultural Summary provided by an office\nHIGHLIGHTS\n"), flat("national_ag_summary"), F.lit("\nCorn: the crop of row "), F.col("bulletin_id").cast("string"), F.lit("     right\n2 points behind.     right\nSorghum: another.\n"))
    fifth = F.concat(F.lit("corn percent planted\n"), flat("corn_table_text"), F.lit("\nSoybeans Percent Planted\nx"))
    rows = read(s, d, "wwcb_core_text").filter(day.isNotNull() & ending.isNotNull())
    return rows.select("bulletin_id", F.concat_ws("\f", front, F.lit("page two"), third, fourth, fifth).alias("t"))


def parsed(s: SparkSession, d: str) -> DataFrame:
    return rounded(B.parse(paginated(s, d), "t").drop("t"))


def schedules(s: SparkSession, d: str) -> DataFrame:
    """Months of a span, slots of two years, hours ahead and the span of initialisations, as (kind, key, value)."""
    one = s.range(1)
    out = one.select(F.explode(K.month_ranges("2023-11-17", "2024-03-05")).alias("m")).select(F.lit("month").alias("kind"), F.date_format("m.month_start", DAY).alias("key"), F.date_format("m.month_end", DAY).alias("value"))
    slots = s.createDataFrame([(2023,), (2024,)], "y int").select("y", F.explode(K.year_slots(F.col("y"))).alias("x")).select(F.lit("slot"), F.concat(F.col("y").cast("string"), F.lit("/"), F.col("x.slot").cast("string")), F.date_format("x.day", DAY))
    hours = one.select(F.explode(F.array(*map(F.lit, K.lead_hours(100)))).alias("h")).select(F.lit("hour"), F.col("h").cast("string"), F.lit(None).cast("string"))
    lo, hi = K.init_span(2023, 2024, K.lead_hours(100))
    return out.union(slots).union(hours).union(one.select(F.lit("init"), F.date_format(lo, DAY), F.date_format(hi, DAY)))


def requests(s: SparkSession, d: str) -> DataFrame:
    """Addresses and request bodies for the orders' days."""
    at = F.to_timestamp("o_orderdate")
    x = read(s, d, "orders").select(at.alias("at")).distinct()
    return x.select(F.date_format("at", DAY).alias("day"), Q.forecast_url("https://h.example/f", F.col("at"), F.lit(168)).alias("forecast"), Q.reforecast_url("https://h.example/r", F.col("at")).alias("reforecast"), Q.reanalysis_request("daily", F.to_date("at"), ["t2m", "tp"], (49.0, -104.0, 37.0, -80.0)).alias("body"), Q.listing_url("https://h.example/q", F.col("at"), F.col("at") + F.expr("interval 7 days"), F.lit('corn "maize"')).alias("listing"))


def anomalies(s: SparkSession, d: str) -> DataFrame:
    """Closes as temperatures: growing degrees and the difference from the week of the year's mean.

    Means are taken in the order in which the days came first. Closes have few digits, so that many
    differences lie halfway between two rounded ones, where the last bit of the sum decides.
    """
    came = read(s, d, "daily_prices").groupBy(F.col("symbol").alias("series"), "date").agg(F.min("bar_id").alias("came"))
    x = bars(s, d).join(came, ["series", "date"])
    return rounded(x.select("series", "date", K.growing_degrees(F.col("close")).alias("gdd"), week_anomaly(x, "close", "date", ["series"], "came").alias("anomaly")))


def price_weather(s: SparkSession, d: str) -> DataFrame:
    """Daily features with the covered forecasts of their day, 28 years on; days without enough of them fall away."""
    w = covered(s, d).select(F.add_months("decision_date", 336).alias("date"), "mean_v", "coverage")
    return rounded(S.daily_features(bars(s, d)).select("series", "date", "return_1d", "target_class").join(w, "date", "left").filter("coverage >= 0.5"))


def set_table(s: SparkSession, d: str) -> DataFrame:
    """The columns of each named set over the weekly panel, in order."""
    columns = weekly_panel(s, d).columns
    rows = [(name, k, c, text) for name in P.FEATURE_SETS for own, text in [P.feature_set(columns, name)] for k, c in enumerate(own)]
    return s.createDataFrame(rows, "set_name string, position int, column_name string, text_column string")


def run_names(s: SparkSession, d: str) -> DataFrame:
    """Names of runs over thresholds and sets."""
    rows = [(P.threshold_key(x["k"], x["set"]), P.threshold_model(x["k"], x["set"]), P.model_key(x["set"], "logit")) for x in P.configurations(k=[0.25, 0.5, 1.0], set=["price_only", "price_calendar"])]
    return s.createDataFrame(rows, "key string, model string, fitted string")


def first_values(s: SparkSession, d: str) -> DataFrame:
    """For each ship day the first discount above 5 % and the first quantity below 10, by order."""
    x = read(s, d, "lineitem").select("l_shipdate", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("high"), F.when(F.col("l_quantity") < 10, F.col("l_quantity")).alias("low"))
    return rounded(C.first_non_null(x.withColumn("l_shipdate", F.to_date("l_shipdate")), "l_shipdate", "at", ["high", "low"]))


def cell_weights(s: SparkSession, d: str) -> DataFrame:
    """Means of the customers' balances in cells of 2 by 2.5 degrees, weighted by what of each cell lies in a box over the date line."""
    lat, lon = F.col("c_nationkey") * 2 + 1.0, F.pmod(F.col("c_custkey") * 5, F.lit(720)) / 2
    return rounded(C.weighted_moments(read(s, d, "customer"), ["c_mktsegment"], F.col("c_acctbal"), C.cell_overlap(lat, lon, 2.0, 2.5, 40.25, 170.0, 11.5, -160.5)), 4)


def demo_shapes(s: SparkSession, d: str) -> DataFrame:
    """Rows and spans of the made-up series, whose values are random, and how many break what must hold."""
    p, w = demo_prices(s, "2020-01-01", "2020-12-31"), demo_weather(s, "2020-01-01", "2020-12-31")
    a = p.agg(F.lit("prices").alias("name"), F.count(F.lit(1)).alias("n"), F.date_format(F.min("date"), DAY).alias("first"), F.date_format(F.max("date"), DAY).alias("last"), F.count_if((F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")) | (F.col("volume") < 10000)).alias("bad"))
    b = w.agg(F.lit("weather").alias("name"), F.count(F.lit(1)).alias("n"), F.date_format(F.min("week"), DAY).alias("first"), F.date_format(F.max("week"), DAY).alias("last"), F.count_if((F.col("weather_precip_mm") < 0) | (F.col("weather_gdd") < 0)).alias("bad"))
    return a.unionByName(b)


def month_folders(s: SparkSession, d: str) -> DataFrame:
    """Headlines written as month folders, the months of a half-open span read back by them alone, in order of time and id."""
    path = fresh_path(s, "months")
    try:
        news = read(s, d, "news_headlines").filter("gkg_date is not null").select("row_id", "article_id", "gkg_date")
        T.write_months(news, path, "gkg_date")
        months = [r.m for r in s.range(1).select(F.explode(K.month_ranges("2023-02-10", "2023-07-01")).alias("x")).select(F.date_format("x.month_start", "yyyyMM").cast("int").alias("m")).collect()]
        kept = T.read_months(s, path).filter((F.col("year") * 100 + F.col("month")).isin(months)).filter((F.col("gkg_date") >= "2023-02-10") & (F.col("gkg_date") < "2023-07-01"))
        return stored(kept.orderBy("gkg_date", "article_id").select("row_id", "article_id", "year", "month"), "months")
    finally:
        remove(s, path)


def date_window(s: SparkSession, d: str) -> DataFrame:
    """Bars of an inclusive span, in order, with their load time as UTC wall-clock time without zone."""
    rows = read(s, d, "daily_prices").filter(F.col("date").between("2023-03-01", "2023-03-31"))
    return rows.orderBy("date", "bar_id").select("bar_id", F.date_format("date", DAY).alias("date"), F.date_format(F.to_timestamp_ntz(F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss"), F.lit("yyyy-MM-dd HH:mm:ss")), "yyyy-MM-dd HH:mm").alias("loaded"))


def fetched(s: SparkSession, d: str) -> DataFrame:
    """Which of the bulletins' files have scores already."""
    return manifest(read(s, d, "wwcb_core_text").select("source_file").distinct(), read(s, d, "report_scores"), "source_file").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def lead_set_table(s: SparkSession, d: str) -> DataFrame:
    """The columns of the three sets of each lead over the daily features with the leads' forecasts."""
    forecasts_of = [f"weather_{n}_l{x}" for x in (7, 14) for n in ("heat_forecast_z", "dryness_forecast_z", "heat_x_dryness", "heat_projected_change", "dryness_projected_change", "projected_heat_x_dryness")]
    columns = [*S.daily_features(bars(s, d)).columns, *P.DAILY_CALENDAR, *forecasts_of]
    rows = [(name, k, c) for x in (7, 14) for name, own in P.lead_sets(columns, x).items() for k, c in enumerate(own)]
    return s.createDataFrame(rows, "set_name string, position int, column_name string")


def panel_weather(s: SparkSession, d: str) -> DataFrame:
    """The weekly panel's weather and text, joined on the week."""
    return rounded(weekly_panel(s, d).select("series", "week", "weather_quantity", "weather_discount", F.length("report_text").alias("text_length"), "calendar_quarter"))


def parsed_sources(s: SparkSession, d: str) -> DataFrame:
    """Bars under other names, brought to the usual ones."""
    return rounded(T.normal_bars(read(s, d, "daily_prices").select(F.col("date").alias("Date"), F.col("open").alias("Open"), F.col("close").alias("Close"), F.col("volume").alias("Volume"))))


def yearly_means(s: SparkSession, d: str) -> DataFrame:
    """Means of each lead by year, a column a year; the years are the orders' own."""
    x = forecasts(s, d).withColumn("yr", F.year("decision_date"))
    years = [r.yr for r in x.select("yr").distinct().orderBy("yr").collect()]  # years, so few
    return rounded(x.groupBy("lead_day").pivot("yr", years).agg(F.avg("v")).select("lead_day", *[F.col(str(y)).alias(f"y{y}") for y in years]))


QUERIES = {
    "bulletin_parts": parsed, "schedules": schedules, "request_urls": requests, "week_anomalies": anomalies, "price_weather": price_weather, "feature_sets": set_table, "run_names": run_names, "first_values": first_values, "cell_weights": cell_weights, "demo_shapes": demo_shapes, "metrics_pivot": yearly_means,
    "month_folders": month_folders, "date_window": date_window, "fetch_manifest": fetched, "lead_sets": lead_set_table, "panel_weather": panel_weather, "normal_bars": parsed_sources,
    "climatology_one_out": lambda s, d: rounded(climo_one_out(s, d)),
}
_B = "b AS (SELECT *, try_cast(report_date AS DATE) AS rd, try_cast(week_ending AS DATE) AS we, " + ", ".join(f"replace(coalesce({c}, ''), chr(12), '') AS {n}" for c, n in (("weather_highlights", "wh"), ("national_ag_summary", "na"), ("corn_table_text", "ct"))) + " FROM wwcb_core_text WHERE try_cast(report_date AS DATE) IS NOT NULL AND try_cast(week_ending AS DATE) IS NOT NULL)"
_SETS = {"P": "price_log_return,price_lag_return_1w,price_lag_return_2w,price_lag_return_4w,price_lag_return_12w,price_rolling_vol_4w,price_rolling_vol_12w,price_momentum_4w,price_momentum_12w,price_volume_change_4w", "C": "calendar_month,calendar_quarter,calendar_week_of_year,calendar_week_sin,calendar_week_cos,calendar_is_planting_season,calendar_is_pollination_weather_season,calendar_is_harvest_season,calendar_is_winter_storage_season", "W": "weather_quantity,weather_discount", "T": "report_count,text_kw_drought,text_kw_ethanol,text_kw_export,text_kw_harvest,text_kw_heat,text_kw_planting,text_kw_rain,text_kw_yield", "A": "ai_moisture_stress,ai_heat_stress,ai_excess_rain_risk,ai_planting_delay_risk,ai_harvest_delay_risk,ai_yield_risk,ai_crop_condition_trend", "G": "gdelt_relevance_score,gdelt_yield_supply_risk"}
_OF = {"price_only": "P", "price_gdelt": "PG", "price_calendar": "PC", "price_calendar_gdelt": "PCG", "price_calendar_weather": "PCW", "price_calendar_text": "PCT*", "price_calendar_weather_text": "PCWT*", "price_ai": "PA", "price_ai_gdelt": "PAG", "price_calendar_ai": "PCA", "price_calendar_ai_gdelt": "PCAG", "price_calendar_weather_ai": "PCWA", "price_calendar_weather_text_ai": "PCWTA*", "A_price": "P", "A_price_calendar": "PC", "B_price_weather": "PW", "C_price_weather_text": "PWT*"}
_D = "strftime({0}, '%Y-%m-%d')"
_COVERED = _FC + ", pv AS (SELECT decision_date, list(v) FILTER (v IS NOT NULL) AS vs FROM fc GROUP BY 1), w AS (SELECT (decision_date + INTERVAL 336 MONTH)::DATE AS date, list_avg(vs) AS mean_v, len(vs) / 4.0 AS coverage FROM pv)"
_SD = "(dayofyear({0}) - CASE WHEN ((year({0}) % 4 = 0 AND year({0}) % 100 <> 0) OR year({0}) % 400 = 0) AND dayofyear({0}) >= 60 THEN 1 ELSE 0 END)"
_BARS = "bars AS (SELECT symbol AS series, date, x.c AS close FROM (SELECT symbol, date, arg_max({'c': close}, (loaded_at, bar_id)) AS x FROM daily_prices WHERE symbol IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2) WHERE x.c IS NOT NULL AND NOT isnan(x.c))"
ORACLE = {
    "bulletin_parts": f"""WITH {_B} SELECT bulletin_id, {_D.format('rd')} AS report_date, {_D.format('CASE WHEN bulletin_id % 3 < 2 THEN we ELSE rd - 2 END')} AS week_ending, {_D.format(_FRI.format('rd'))} AS week,
 {_CLEAN("array_to_string(list_transform(string_split(wh, chr(10)), lambda x: regexp_extract(x || '      Contents', '^(.*?)(?:[ ]{4,}|$)', 1)), chr(10)) || chr(10) || chr(10) || chr(10) || na")} AS weather_highlights,
 {_CLEAN("na || chr(10) || 'Corn: the crop of row ' || bulletin_id || '     right' || chr(10) || '2 points behind.     right' || chr(10) || 'Sorghum: another.'")} AS national_summary,
 'Corn: the crop of row ' || bulletin_id || chr(10) || '2 points behind.' AS crop_column, 'Corn: the crop of row ' || bulletin_id || ' right' || chr(10) || '2 points behind. right' AS crop_paragraph,
 {_CLEAN("'corn percent planted' || chr(10) || ct")} AS crop_table FROM b""",
    "schedules": """SELECT 'month' AS kind, k AS key, v AS value FROM (VALUES ('2023-11-17', '2023-12-01'), ('2023-12-01', '2024-01-01'), ('2024-01-01', '2024-02-01'), ('2024-02-01', '2024-03-01'), ('2024-03-01', '2024-03-05')) t(k, v)
 UNION ALL SELECT 'slot', y || '/' || i, CASE WHEN year(make_date(y, 1, 1) + (i - 1)::INT) = y THEN strftime(make_date(y, 1, 1) + (i - 1)::INT, '%Y-%m-%d') END FROM (VALUES (2023), (2024)) a(y), range(1, 367) r(i)
 UNION ALL SELECT 'hour', unnest([168, 336, 504, 672, 720, 1440, 2160])::VARCHAR, NULL UNION ALL SELECT 'init', '2022-10-03', '2024-12-24'""",
    "request_urls": """WITH t AS (SELECT DISTINCT o_orderdate::TIMESTAMP AS t FROM orders) SELECT strftime(t, '%Y-%m-%d') AS day, 'https://h.example/f/' || strftime(t, '%Y/%Y%m/%Y%m%d/%Y%m%d%H') || '/pgbf' || strftime(t + INTERVAL 168 HOUR, '%Y%m%d%H') || '.01.' || strftime(t, '%Y%m%d%H') || '.grb2' AS forecast,
 'https://h.example/r/' || strftime(t, '%Y/%Y%m%d%H') || '/c00/Days:1-10/tmp_2m_' || strftime(t, '%Y%m%d%H') || '_c00.grb2' AS reforecast,
 '{"dataset":"daily","request":{"product_type":"reanalysis","variable":["t2m","tp"],"year":"' || strftime(t, '%Y') || '","month":"' || strftime(t, '%m') || '","day":[' || array_to_string(list_transform(range(1, day(last_day(t)) + 1), lambda k: '"' || lpad(k::VARCHAR, 2, '0') || '"'), ',') || '],"daily_statistic":"daily_mean","time_zone":"utc+00:00","frequency":"1_hourly","area":[49.0,-104.0,37.0,-80.0]}}' AS body,
 'https://h.example/q?query=corn+%22maize%22&mode=artlist&format=json&startdatetime=' || strftime(t, '%Y%m%d%H%M%S') || '&enddatetime=' || strftime(t + INTERVAL 7 DAY, '%Y%m%d%H%M%S') || '&maxrecords=250&sort=datedesc' AS listing FROM t""",
    "week_anomalies": f"WITH {_BARS} SELECT series, {_D.format('date')} AS date, round(greatest((close - 50) * 7, 0), 6) AS gdd, round(close - avg(close) OVER (PARTITION BY series, week(date)), 6) AS anomaly FROM bars",
    "price_weather": f"WITH {_BARS}, {_COVERED}, r AS (SELECT series, date, close / nullif(lag(close) OVER s, 0) - 1 AS return_1d, lead(close, 5) OVER s / nullif(close, 0) - 1 AS t FROM bars WINDOW s AS (PARTITION BY series ORDER BY date)) SELECT series, {_D.format('date')} AS date, round(return_1d, 6) AS return_1d, CASE WHEN t <= -0.02 THEN -1 WHEN t >= 0.02 THEN 1 ELSE 0 END AS target_class, round(mean_v, 6) AS mean_v, coverage FROM r JOIN w USING (date) WHERE coverage >= 0.5",
    "feature_sets": " UNION ALL ".join(f"SELECT '{n}' AS set_name, unnest(range({len(cols)}))::INT AS position, unnest({cols}) AS column_name, {chr(39) + 'report_text' + chr(39) if '*' in b else 'NULL'} AS text_column" for n, b in _OF.items() for cols in [[c for x in b if x != "*" for c in _SETS[x].split(",")]]),
    "run_names": "SELECT 'k_' || g || '_' || s AS key, 'vol_adj_k_' || k || '_' || s AS model, s || '_logit' AS fitted FROM (VALUES ('0.25', '0.25'), ('0.5', '0.5'), ('1', '1.0')) a(g, k), (VALUES ('price_only'), ('price_calendar')) b(s)",
    "first_values": f"SELECT {_D.format('l_shipdate::DATE')} AS l_shipdate, round(arg_min(l_discount, l_orderkey * 10 + l_linenumber) FILTER (l_discount > 0.05), 6) AS high, round(arg_min(l_quantity, l_orderkey * 10 + l_linenumber) FILTER (l_quantity < 10), 6) AS low FROM lineitem GROUP BY 1",
    "cell_weights": """WITH c AS (SELECT c_mktsegment, c_acctbal AS x, c_nationkey * 2 + 1.0 AS la, (c_custkey * 5) % 720 / 2.0 AS lo FROM customer), o AS (SELECT *, greatest(sin(radians(least(la + 1, 40.25))) - sin(radians(greatest(la - 1, 11.5))), 0) AS a,
  list_sum(list_transform([-360, 0, 360], lambda k: greatest(least(lo + 1.25 + k, 199.5) - greatest(lo - 1.25 + k, 170), 0))) AS b FROM c), w AS (SELECT c_mktsegment, x, a * b AS w FROM o WHERE least(la + 1, 40.25) > greatest(la - 1, 11.5)), k AS (SELECT c_mktsegment, sum(w * x) / sum(w) AS m, sum(w * x * x) / sum(w) AS q2, count(*) AS n_valid FROM w WHERE w > 0 AND x IS NOT NULL GROUP BY 1) SELECT c_mktsegment, round(m, 4) AS mean, round(sqrt(greatest(q2 - m * m, 0)), 4) AS std, n_valid FROM k""",
    "demo_shapes": "SELECT 'prices' AS name, 262 AS n, '2020-01-01' AS first, '2020-12-31' AS last, 0 AS bad UNION ALL SELECT 'weather', 52, '2020-01-03', '2020-12-25', 0",
    "metrics_pivot": f"WITH {_FC} SELECT lead_day, " + ", ".join(f"round(avg(v) FILTER (year(decision_date) = {y}), 6) AS y{y}" for y in range(1995, 2002)) + " FROM fc GROUP BY 1",
    "climatology_one_out": f"WITH {_FC}, k AS (SELECT *, {_SD.format('decision_date')} AS sd FROM fc), c AS (SELECT a.decision_date, a.lead_day, count(b.v) AS climo_n, avg(b.v) AS m, stddev_samp(b.v) AS s FROM k a LEFT JOIN k b ON a.lead_day = b.lead_day AND b.decision_date <> a.decision_date AND least(abs(a.sd - b.sd), 365 - abs(a.sd - b.sd)) <= 5 GROUP BY 1, 2) "
    f"SELECT {_D.format('decision_date')} AS decision_date, lead_day, climo_n, CASE WHEN climo_n >= 5 THEN round(m, 6) END AS climo_mean, CASE WHEN climo_n >= 5 THEN round(s, 6) END AS climo_std FROM c",
    "month_folders": "WITH q AS (SELECT row_id, article_id, gkg_date AT TIME ZONE 'UTC' AS g FROM news_headlines) SELECT row_id, article_id, year(g)::INT AS year, month(g)::INT AS month FROM q WHERE g >= TIMESTAMP '2023-02-10' AND g < TIMESTAMP '2023-07-01' ORDER BY g, article_id",
    "date_window": "SELECT bar_id, strftime(date, '%Y-%m-%d') AS date, strftime(loaded_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS loaded FROM daily_prices WHERE date BETWEEN DATE '2023-03-01' AND DATE '2023-03-31'",
    "fetch_manifest": "SELECT CASE WHEN source_file IN (SELECT source_file FROM report_scores WHERE source_file IS NOT NULL) THEN 'exists' ELSE 'missing' END AS status, count(*) AS n FROM (SELECT DISTINCT source_file FROM wwcb_core_text) GROUP BY 1",
    "lead_sets": " UNION ALL ".join(f"SELECT '{n}' AS set_name, unnest(range({len(c)}))::INT AS position, unnest({c}) AS column_name" for x in (7, 14) for base in [[*[f"price_return_lag_{k}d" for k in (1, 2, 5, 10, 21)], *[f"price_vol_{k}d" for k in (5, 10, 21, 63)], *[f"price_momentum_{k}d" for k in (5, 10, 21, 63)], "month", "quarter", "weekofyear_sin", "weekofyear_cos", "dayofweek_sin", "dayofweek_cos", "is_planting_season", "is_pollination_season", "is_harvest_season", "is_winter_storage_season"]]
        for fc, pr in [([f"weather_{k}_l{x}" for k in ("heat_forecast_z", "dryness_forecast_z", "heat_x_dryness")], [f"weather_{k}_l{x}" for k in ("heat_projected_change", "dryness_projected_change", "projected_heat_x_dryness")])] for n, c in ((f"lead{x:02d}_price_calendar", base), (f"lead{x:02d}_forecast_anom", base + fc), (f"lead{x:02d}_forecast_anom_projected_change", base + fc + pr))),
    "panel_weather": f"WITH {_BARS}, w AS (SELECT DISTINCT series, {_FRI.format('date')} AS week FROM bars), x AS (SELECT {_FRI.format("(l_shipdate + INTERVAL 336 MONTH)::DATE")} AS week, avg(l_quantity) AS q, avg(l_discount) AS c FROM lineitem GROUP BY 1), t AS (SELECT {_FRI.format('try_cast(report_date AS DATE)')} AS week, string_agg(national_ag_summary, ' ' ORDER BY bulletin_id) AS t FROM wwcb_core_text WHERE national_ag_summary IS NOT NULL AND try_cast(report_date AS DATE) IS NOT NULL GROUP BY 1) SELECT series, {_D.format('week')} AS week, round(q, 6) AS weather_quantity, round(c, 6) AS weather_discount, length(coalesce(t, ''))::INT AS text_length, quarter(week)::INT AS calendar_quarter FROM w LEFT JOIN x USING (week) LEFT JOIN t USING (week)",
    "normal_bars": "SELECT strftime(date, '%Y-%m-%d') AS date, round(open, 6) AS open, NULL::DOUBLE AS high, NULL::DOUBLE AS low, round(close, 6) AS close, round(close, 6) AS adj_close, volume::BIGINT AS volume FROM daily_prices WHERE close IS NOT NULL",
}
