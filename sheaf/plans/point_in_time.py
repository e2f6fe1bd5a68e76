"""Queries p1 to p3 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators.as_known import KnownState, as_known, utc_day
from sheaf.operators.rolling import trailing_totals
from sheaf.operators.stamps import stamp_instants
from sheaf.runtime import read, stored

SCORES = [f"ai_{x}" for x in ("moisture_stress", "heat_stress", "excess_rain_risk", "planting_delay_risk", "harvest_delay_risk", "yield_risk", "crop_condition_trend")]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each headline with the bulletin of its district that was in force and public at its seendate."""
    news, bulletins = read(spark, sf_dir, "news_headlines"), read(spark, sf_dir, "wwcb_core_text")
    public = bulletins.select("district", "week", "report_date", "revision", "bulletin_id", F.datediff(F.col("report_date").try_cast("date"), F.lit("1970-01-01").cast("date")).alias("public_day"))
    rank = [F.col("week"), F.col("report_date"), F.col("revision"), -F.col("bulletin_id")]
    state = KnownState(spark)
    try:
        last = news.agg(F.max(utc_day(F.col("seendate")))).first()[0]
        state.extend(public, "district", "public_day", rank, F.col("bulletin_id"), last)
        return stored(as_known(news, "row_id", "district", utc_day(F.col("seendate")), state, "bulletin_id"), "p1")
    finally:
        state.drop()


def p1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_found with the scores of the bulletin's file (files delivered twice are scored once)."""
    files = read(spark, sf_dir, "wwcb_core_text").select("bulletin_id", "source_file")
    scores = read(spark, sf_dir, "report_scores").groupBy("source_file").agg(F.min_by(F.struct(*SCORES), "bulletin_id").alias("s"))
    scored = files.join(scores, "source_file").select("bulletin_id", "s.*")
    return p1_found(spark, sf_dir).join(scored, "bulletin_id", "left").select("row_id", "bulletin_id", *SCORES)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stamp that denotes an instant, as microseconds since 1970 UTC."""
    return stamp_instants(read(spark, sf_dir, "raw_stamps"), read(spark, sf_dir, "feeds"), "raw_id", ["seendate", "gkg_date", "report_date", "week_ending"])


def p3_totals(spark: SparkSession, sf_dir: str, columns: list[str], aggregates: tuple[str, ...]) -> DataFrame:
    """Aggregates over the trailing 7 and 30 calendar days."""
    return trailing_totals(read(spark, sf_dir, "daily_prices"), "symbol", "date", ["loaded_at", "bar_id"], columns, [7, 30], aggregates)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_totals(spark, sf_dir, ["volume"], ("sum",)).select("symbol", F.date_format("date", "yyyy-MM-dd").alias("on_day"), F.col("volume_sum_7").alias("volume_7d"), F.col("volume_sum_30").alias("volume_30d"))


def p3_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [F.round(F.col(f"{c}_{k}_{w}"), 6).alias(f"{n}_{k}_{w}d") for c, n in (("close", "close"), ("price_log_return", "ret")) for k in ("sum", "avg") for w in (7, 30)]
    return p3_totals(spark, sf_dir, ["close", "price_log_return"], ("sum", "avg", "max", "min")).select("symbol", F.date_format("date", "yyyy-MM-dd").alias("on_day"), *cols, F.col("close_max_30").alias("close_max_30d"), F.col("close_min_7").alias("close_min_7d"))


QUERIES = {"p1_found": p1_found, "p1_scores": p1_scores, "p2_found": p2_found, "p3_found": p3_found, "p3_averages": p3_averages}

_P1 = """
 SELECT n.row_id, arg_max(b.bulletin_id, (coalesce(b.week, ''), b.report_date, b.revision, -b.bulletin_id)) AS bulletin_id
 FROM news_headlines n JOIN wwcb_core_text b ON b.district = n.district AND b.report_date <= strftime(n.seendate AT TIME ZONE 'UTC', '%Y-%m-%d')
 GROUP BY n.row_id"""
_DAYS = """
 WITH best AS (SELECT symbol, date, arg_max({'v': volume, 'c': close, 'r': price_log_return}, (coalesce(loaded_at, TIMESTAMPTZ '1900-01-01 00:00:00+00'), bar_id)) AS x FROM daily_prices WHERE symbol IS NOT NULL AND date IS NOT NULL GROUP BY symbol, date),
 days AS (SELECT symbol, unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM best GROUP BY symbol),
 bars AS (SELECT days.symbol, d, x.v::BIGINT AS v, CASE WHEN isnan(x.c) THEN NULL ELSE x.c END AS c, CASE WHEN isnan(x.r) THEN NULL ELSE x.r END AS r FROM days LEFT JOIN best ON best.symbol = days.symbol AND best.date = d)"""
_OVER = "OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
ORACLE = {
    "p1_found": _P1,
    "p1_scores": f"WITH f AS ({_P1}), s AS (SELECT source_file, arg_min(row({', '.join(SCORES)}), bulletin_id) AS s FROM report_scores GROUP BY source_file), b AS (SELECT bulletin_id, source_file FROM wwcb_core_text) "
    + "SELECT f.row_id, f.bulletin_id, " + ", ".join(f"s.s[{i + 1}] AS {c}" for i, c in enumerate(SCORES)) + " FROM f JOIN b USING (bulletin_id) LEFT JOIN s USING (source_file)",
    "p3_found": _DAYS + f" SELECT symbol, strftime(d, '%Y-%m-%d') AS on_day, coalesce(sum(v) {_OVER.format(n=6)}, 0)::BIGINT AS volume_7d, coalesce(sum(v) {_OVER.format(n=29)}, 0)::BIGINT AS volume_30d FROM bars",
    "p3_averages": _DAYS + " SELECT symbol, strftime(d, '%Y-%m-%d') AS on_day, " + ", ".join(f"round(coalesce(sum({c}) {_OVER.format(n=w - 1)}, 0), 6) AS {n}_sum_{w}d, round(avg({c}) {_OVER.format(n=w - 1)}, 6) AS {n}_avg_{w}d" for c, n in (("c", "close"), ("r", "ret")) for w in (7, 30))
    + f", max(c) {_OVER.format(n=29)} AS close_max_30d, min(c) {_OVER.format(n=6)} AS close_min_7d FROM bars",
}
