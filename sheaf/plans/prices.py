"""Queries over price series and backtests, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.functions.calendar import calendar_columns, daily_calendar_columns, in_month_day_window
from sheaf.operators import backtest as B
from sheaf.operators import folds as V
from sheaf.operators import panel as P
from sheaf.operators import series as S
from sheaf.runtime import read

SPLIT = "2023-06-30"
DAY = "yyyy-MM-dd"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and dates as text, for comparison across engines."""
    def one(c: str, t: str):
        return F.round(F.col(c), digits).alias(c) if t == "double" else F.date_format(c, DAY).alias(c) if t == "date" else F.col(c)

    return df.select(*[one(c, t) for c, t in df.dtypes])


def bars(s: SparkSession, d: str) -> DataFrame:
    return S.daily_bars(read(s, d, "daily_prices"))


def weeks(s: SparkSession, d: str) -> DataFrame:
    return S.weekly_bars(bars(s, d))


def features(s: SparkSession, d: str) -> DataFrame:
    return S.weekly_features(weeks(s, d))


def backtested(s: SparkSession, d: str) -> DataFrame:
    df = features(s, d).withColumn("position", B.position_from_return(F.col("price_momentum_4w"), shorts=True))
    return B.strategy(df, "position", "target_log_return_next", ["series"], "week")


def daily_backtested(s: SparkSession, d: str) -> DataFrame:
    df = S.daily_features(bars(s, d))
    pos = F.when(F.col("price_momentum_5d") > 0.003, 1.0).when(F.col("price_momentum_5d") < -0.003, -1.0).otherwise(0.0)
    w = Window.partitionBy("series").orderBy("date")
    df = df.withColumn("position", pos).withColumn("turnover", F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0))))
    return df.withColumn("strategy_return", F.coalesce(F.col("position") * F.col("target_next_1d_return"), F.lit(0.0)) - F.col("turnover") * 5 / 1e4)


def predicted(s: SparkSession, d: str) -> DataFrame:
    """A deterministic forecast to try metrics on: the mean of the last returns."""
    return features(s, d).withColumn("pred", (F.col("price_lag_return_1w") + F.col("price_lag_return_2w")) / 2).withColumn("prob", B.logistic(F.col("pred") * 50))


def folded(s: SparkSession, d: str, rolling: int | None = None) -> DataFrame:
    df = features(s, d).filter("target_log_return_next is not null")
    return V.assigned(df, V.fold_table(df, "week", SPLIT, 13, 13, rolling), "week")


def fold_counts(s: SparkSession, d: str, rolling: int | None = None) -> DataFrame:
    x = folded(s, d, rolling).groupBy("series", "fold").agg(F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test"), F.max(F.when(F.col("role") == "train", F.col("week"))).alias("train_end"), F.min(F.when(F.col("role") == "test", F.col("week"))).alias("test_start"))
    return rounded(x)


RIDGE = ["price_log_return", "price_lag_return_1w", "price_lag_return_4w", "price_rolling_vol_4w", "price_momentum_4w"]


def horizons(s: SparkSession, d: str) -> DataFrame:
    x = features(s, d)
    out = None
    for h in (1, 4, 13):
        one = S.horizon_targets(x, h).withColumn("horizon", F.lit(h))
        out = one if out is None else out.unionByName(one)
    return out


def yearly(s: SparkSession, d: str) -> DataFrame:
    """Train mean of all years before each test year, and the out-of-sample R2 of a zero forecast against it."""
    x = S.daily_features(bars(s, d)).filter("target_return is not null").withColumn("yr", F.year("date"))
    per = x.groupBy("series", "yr").agg(F.count(F.lit(1)).alias("n"), F.sum("target_return").alias("s"))
    w = Window.partitionBy("series").orderBy("yr").rowsBetween(Window.unboundedPreceding, -1)
    means = per.select("series", "yr", F.sum("n").over(w).alias("train_n"), (F.sum("s").over(w) / F.sum("n").over(w)).alias("train_mean")).filter("train_n >= 60")
    e0 = F.col("target_return") - F.col("train_mean")
    return x.join(means, ["series", "yr"]).groupBy("series", "yr", "train_n").agg(F.first("train_mean").alias("train_mean"), F.count(F.lit(1)).alias("n"), (1 - F.try_divide(F.avg(F.col("target_return") * F.col("target_return")), F.avg(e0 * e0))).alias("oos_r2"))


def fold_quantile(s: SparkSession, d: str) -> DataFrame:
    """Share of high volatility in each test fold, above its training window's 70 % quantile."""
    x = folded(s, d).withColumn("vol", F.abs("target_log_return_next"))
    q = x.filter("role = 'train'").groupBy("series", "fold").agg(F.percentile("vol", F.lit(0.7)).alias("q"))
    return x.filter("role = 'test'").join(q, ["series", "fold"]).groupBy("series", "fold").agg(F.first("q").alias("threshold"), F.count_if(F.col("vol") >= F.col("q")).alias("n_high"), F.count(F.lit(1)).alias("n"))


def model_rows(s: SparkSession, d: str, kind: str, alpha: float | None = 1.0, columns: list[str] = RIDGE) -> DataFrame:
    target, classes = {"ridge": ("target_log_return_next", ()), "logit": ("target_up_next", (0, 1)), "classes": ("cls", (-1, 0, 1))}[kind]
    x = features(s, d).withColumn("cls", S.band_class(F.col("target_log_return_next"), 0.02))
    folds = V.fold_table(x.filter("target_log_return_next is not null"), "week", SPLIT, 13, 13)
    return V.walk_forward(x, ["series"], [V.Model(kind, tuple(columns), target, kind, alpha, classes)], "week", folds).drop("model")


def classed(s: SparkSession, d: str) -> DataFrame:
    return predicted(s, d).select("series", S.band_class(F.col("target_log_return_next"), 0.02).alias("y"), S.band_class(F.col("pred"), 0.01).alias("p"))


def volatility(s: SparkSession, d: str) -> DataFrame:
    """Next week's absolute return against the last four weeks' deviation; high is above the series' 70 % quantile."""
    x = features(s, d).select("series", F.abs("target_log_return_next").alias("y"), F.col("price_rolling_vol_4w").alias("p")).filter("y is not null and p is not null")
    return B.volatility_metrics(x.join(x.groupBy("series").agg(F.percentile("y", F.lit(0.7)).alias("q")), "series"), ["series"], "y", "p", "q")


def baseline(s: SparkSession, d: str) -> str:
    """The first series, as the run to compare with."""
    return bars(s, d).agg(F.min("series")).first()[0] or ""


def equity(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("series").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    x = daily_backtested(s, d)
    line = x.select("series", "date", F.exp(F.sum(F.ln(1 + F.col("strategy_return"))).over(w)).alias("equity"))
    return x.groupBy("series").agg(F.date_sub(F.min("date"), 1).alias("date")).withColumn("equity", F.lit(1.0)).unionByName(line)


QUERIES = {
    "daily_bars": lambda s, d: rounded(bars(s, d)),
    "weekly_resample": lambda s, d: rounded(weeks(s, d)),
    "weekly_price_features": lambda s, d: rounded(features(s, d)),
    "calendar_features": lambda s, d: rounded(bars(s, d).select("date").distinct().select("date", *[c.alias(n) for n, c in (calendar_columns(F.col("date")) | daily_calendar_columns(F.col("date"))).items()])),
    "horizon_targets": lambda s, d: rounded(horizons(s, d)),
    "class_targets": lambda s, d: features(s, d).select(S.band_class(F.col("target_log_return_next"), 0.02).alias("fixed"), S.scaled_class(F.col("target_log_return_next"), F.col("price_rolling_vol_12w"), 0.5).alias("scaled")).groupBy("fixed", "scaled").agg(F.count(F.lit(1)).alias("n")),
    "daily_price_features": lambda s, d: rounded(S.daily_features(bars(s, d))),
    "season_window": lambda s, d: bars(s, d).filter(in_month_day_window(F.col("date"), (11, 15), (2, 10))).groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 4).alias("closes")),
    "trailing_mean": lambda s, d: rounded(bars(s, d).select("series", "date", F.round(S.trailing_mean_before(bars(s, d), "close", 7), 6).alias("before"))),
    "momentum_backtest": lambda s, d: rounded(backtested(s, d).select("series", "week", "position", "turnover", "strategy_log_return", "cum_strategy_return", "drawdown")),
    "backtest_summary": lambda s, d: rounded(B.weekly_summary(backtested(s, d), ["series"], "target_log_return_next", "position")),
    "best_run": lambda s, d: B.weekly_summary(backtested(s, d), ["series"], "target_log_return_next", "position").filter("sharpe is not null").agg(F.max_by("series", F.struct("sharpe", "series")).alias("best"), F.round(F.max("sharpe"), 6).alias("sharpe"), F.every(F.col("total_return") < 0).alias("all_lose")),
    "daily_summary": lambda s, d: rounded(B.daily_summary(daily_backtested(s, d), ["series"], "strategy_return", "date", "position", "turnover")),
    "equity_curve": lambda s, d: rounded(equity(s, d)),
    "regression_metrics": lambda s, d: rounded(B.regression_metrics(predicted(s, d), ["series"], "target_log_return_next", "pred")),
    "spearman": lambda s, d: rounded(B.spearman(predicted(s, d), ["series"], "target_log_return_next", "pred")),
    "binary_metrics": lambda s, d: rounded(B.binary_metrics(predicted(s, d), ["series"], "target_up_next", "prob")),
    "roc_points": lambda s, d: rounded(B.roc_points(predicted(s, d).withColumn("prob", F.round("prob", 2)), ["series"], "target_up_next", "prob")),
    "confusion_matrix": lambda s, d: B.confusion(predicted(s, d).select("series", S.band_class(F.col("target_log_return_next"), 0.02).alias("y"), S.band_class(F.col("pred"), 0.01).alias("p")), ["series"], "y", "p", [-1, 0, 1]),
    "class_metrics": lambda s, d: rounded(B.class_metrics(classed(s, d), ["series"], "y", "p", [-1, 0, 1])),
    "label_counts": lambda s, d: P.label_counts(classed(s, d).filter("y is not null and p is not null"), ["series"], "y", [-2, -1, 0, 1, 2]),
    "volatility_metrics": lambda s, d: rounded(volatility(s, d)),
    "against_mean": lambda s, d: rounded(B.against_mean(predicted(s, d).withColumn("known", F.lit(0.001)), ["series"], "target_log_return_next", "pred", "known")),
    "against_baseline": lambda s, d: rounded(B.against_baseline(B.regression_metrics(predicted(s, d), ["series"], "target_log_return_next", "pred").select("series", "r2", "rmse"), "series", baseline(s, d), ["r2", "rmse"])),
    "sorted_runs": lambda s, d: rounded(B.weekly_summary(backtested(s, d), ["series"], "target_log_return_next", "position").orderBy(F.desc_nulls_last("n_traded"), "total_return", "series").select("series", "n_traded", "total_return")),
    "sampled_cost": lambda s, d: rounded(P.sampled_cost(bars(s, d).groupBy(F.trunc("date", "month").alias("month")).agg(F.count(F.lit(1)).alias("rows")), "month", "rows")),
    "folds_expanding": lambda s, d: fold_counts(s, d),
    "folds_rolling": lambda s, d: fold_counts(s, d, 20),
    "folds_yearly": lambda s, d: rounded(yearly(s, d)),
    "fold_quantile": lambda s, d: rounded(fold_quantile(s, d)),
    "fold_scaled": lambda s, d: rounded(V.standardised(folded(s, d), ["series", "fold"], ["price_momentum_12w", "price_rolling_vol_4w"]).filter("role = 'test'").select("series", "fold", "week", "price_momentum_12w", "price_rolling_vol_4w"), 5),
    "ridge_one_feature": lambda s, d: rounded(model_rows(s, d, "ridge", columns=["price_log_return"]).select("series", "fold", "week", "y_pred", "n_train"), 5),
    "ridge_walk_forward": lambda s, d: rounded(model_rows(s, d, "ridge")),
    "ridge_grid_walk_forward": lambda s, d: rounded(model_rows(s, d, "ridge", None)),
    "logit_walk_forward": lambda s, d: rounded(model_rows(s, d, "logit")),
    "three_class_walk_forward": lambda s, d: rounded(model_rows(s, d, "classes")),
}

_BARS = """bars AS (SELECT symbol AS series, date, x.c AS close, x.v AS volume FROM (
  SELECT symbol, date, arg_max({'c': close, 'v': volume::BIGINT}, (loaded_at, bar_id)) AS x FROM daily_prices WHERE symbol IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2) WHERE x.c IS NOT NULL AND NOT isnan(x.c))"""
_WEEKS = _BARS + """, weeks AS (SELECT series, (date + ((12 - dayofweek(date)) % 7)::INT)::DATE AS week, arg_max(close, date) AS close, sum(volume)::BIGINT AS volume FROM bars GROUP BY 1, 2)"""
_W = "OVER (PARTITION BY series ORDER BY week{})"
_ROWS = lambda n: _W.format(f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW")
_W0 = _W.format("")
_FEAT = _WEEKS + f""", f0 AS (SELECT *, CASE WHEN close > 0 THEN ln(close) END AS price_log_close, CASE WHEN volume > 0 THEN ln(volume) END AS lv FROM weeks),
 f1 AS (SELECT *, price_log_close - lag(price_log_close) {_W0} AS price_log_return FROM f0),
 feat AS (SELECT series, week, close, volume, price_log_close, price_log_return, {', '.join(f'lag(price_log_return, {k}) {_W0} AS price_lag_return_{k}w' for k in (1, 2, 4, 12))},
  {', '.join(f'CASE WHEN count(price_log_return) {_ROWS(n)} = {n} THEN stddev_samp(price_log_return) {_ROWS(n)} END AS price_rolling_vol_{n}w' for n in (4, 12))},
  {', '.join(f'price_log_close - lag(price_log_close, {n}) {_W0} AS price_momentum_{n}w' for n in (4, 12))}, lv - lag(lv, 4) {_W0} AS price_volume_change_4w,
  lead(price_log_return) {_W0} AS target_log_return_next, (lead(price_log_return) {_W0} > 0)::INT AS target_up_next FROM f1)"""
_BT = _FEAT + f""", b0 AS (SELECT *, CASE WHEN price_momentum_4w > 0.003 THEN 1.0::DOUBLE WHEN price_momentum_4w < -0.003 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS position FROM feat),
 b1 AS (SELECT *, abs(position - coalesce(lag(position) {_W0}, 0)) AS turnover FROM b0), b2 AS (SELECT *, coalesce(position * target_log_return_next, 0) - turnover * 5 / 1e4 AS strategy_log_return FROM b1),
 b3 AS (SELECT *, exp(sum(strategy_log_return) {_W.format(' ROWS UNBOUNDED PRECEDING')}) AS wealth FROM b2),
 bt AS (SELECT *, wealth - 1 AS cum_strategy_return, wealth / max(wealth) {_W.format(' ROWS UNBOUNDED PRECEDING')} - 1 AS drawdown FROM b3)"""
_SUM = _BT + """, summary AS (SELECT series, count(*) AS n, exp(sum(strategy_log_return)) - 1 AS total_return, exp(52 * avg(strategy_log_return)) - 1 AS annual_return, stddev_pop(strategy_log_return) * sqrt(52) AS annual_vol,
  avg(strategy_log_return) / nullif(stddev_pop(strategy_log_return), 0) * sqrt(52) AS sharpe, exp(sum(coalesce(target_log_return_next, 0))) - 1 AS benchmark_return, min(drawdown) AS max_drawdown, avg(position) AS mean_position, avg(turnover) AS mean_turnover,
  count(*) FILTER (position <> 0) AS n_traded, avg((target_log_return_next > 0)::INT) FILTER (position <> 0) AS hit_rate_traded, avg(target_log_return_next) FILTER (position <> 0) AS mean_return_traded FROM bt GROUP BY series)"""
_D = "OVER (PARTITION BY series ORDER BY date{})"
_D0 = _D.format("")
_DROWS = lambda n: _D.format(f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW")
_DAILY = _BARS + f""", d0 AS (SELECT *, CASE WHEN close > 0 THEN ln(close) END AS lc FROM bars), d1 AS (SELECT *, close / nullif(lag(close) {_D0}, 0) - 1 AS return_1d, lc - lag(lc) {_D0} AS log_return_1d FROM d0),
 d2 AS (SELECT series, date, close, return_1d, log_return_1d, lead(close) {_D0} / nullif(close, 0) - 1 AS target_next_1d_return, lead(close, 5) {_D0} / nullif(close, 0) - 1 AS target_return,
  {', '.join(f'lag(return_1d, {k}) {_D0} AS price_return_lag_{k}d' for k in (1, 2, 5, 10, 21))}, {', '.join(f'CASE WHEN count(log_return_1d) {_DROWS(n)} = {n} THEN stddev_samp(log_return_1d) {_DROWS(n)} END AS price_vol_{n}d' for n in (5, 10, 21, 63))},
  {', '.join(f'lc - lag(lc, {n}) {_D0} AS price_momentum_{n}d' for n in (5, 10, 21, 63))} FROM d1),
 daily AS (SELECT *, CASE WHEN target_return <= -0.02 THEN -1 WHEN target_return >= 0.02 THEN 1 ELSE 0 END AS target_class FROM d2)"""
_DBT = _DAILY + f""", e0 AS (SELECT *, CASE WHEN price_momentum_5d > 0.003 THEN 1.0::DOUBLE WHEN price_momentum_5d < -0.003 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS position FROM daily),
 e1 AS (SELECT *, abs(position - coalesce(lag(position) {_D0}, 0)) AS turnover FROM e0), dbt AS (SELECT *, coalesce(position * target_next_1d_return, 0) - turnover * 5 / 1e4 AS r FROM e1)"""
_PRED = _FEAT + """, p0 AS (SELECT *, (price_lag_return_1w + price_lag_return_2w) / 2 AS pred FROM feat), predicted AS (SELECT *, 1 / (1 + exp(-greatest(least(pred * 50, 35), -35))) AS prob FROM p0 WHERE pred IS NOT NULL)"""
_CLS = "q AS (SELECT series, CASE WHEN target_log_return_next <= -0.02 THEN -1 WHEN target_log_return_next >= 0.02 THEN 1 ELSE 0 END AS y, CASE WHEN pred <= -0.01 THEN -1 WHEN pred >= 0.01 THEN 1 ELSE 0 END AS p FROM predicted WHERE target_log_return_next IS NOT NULL AND pred IS NOT NULL)"
_FOLD = lambda roll: _FEAT + f""", panel AS (SELECT * FROM feat WHERE target_log_return_next IS NOT NULL), ends AS (SELECT min(week) AS lo, max(week) AS hi FROM panel WHERE week > DATE '{SPLIT}'),
 folds AS (SELECT k AS fold, (lo + (91 * k)::INT)::DATE AS test_from, (lo + (91 * k + 84)::INT)::DATE AS test_to, hi FROM ends, range(0, 100000) r(k) WHERE lo + (91 * k)::INT <= hi),
 folded AS (SELECT p.*, f.fold, CASE WHEN p.week < f.test_from THEN 'train' ELSE 'test' END AS role FROM panel p JOIN folds f ON p.week <= f.test_to{f" AND p.week >= f.test_from - {7 * roll}" if roll else ''})"""  # noqa: E731


def _r(names: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in names)


_T = "strftime({0}, '%Y-%m-%d') AS {0}"
_FEATURE_DOUBLES = ["close", "price_log_close", "price_log_return", *[f"price_lag_return_{k}w" for k in (1, 2, 4, 12)], "price_rolling_vol_4w", "price_rolling_vol_12w", "price_momentum_4w", "price_momentum_12w", "price_volume_change_4w", "target_log_return_next"]
_DAILY_DOUBLES = ["close", "return_1d", "log_return_1d", "target_next_1d_return", "target_return", *[f"price_return_lag_{k}d" for k in (1, 2, 5, 10, 21)], *[f"price_vol_{n}d" for n in (5, 10, 21, 63)], *[f"price_momentum_{n}d" for n in (5, 10, 21, 63)]]
_COUNTS = " SELECT series, fold, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test, strftime(max(week) FILTER (role = 'train'), '%Y-%m-%d') AS train_end, strftime(min(week) FILTER (role = 'test'), '%Y-%m-%d') AS test_start FROM folded GROUP BY 1, 2"
_HOR = lambda h: f"SELECT series, {_T.format('week')}, CASE WHEN count(price_log_return) {_W.format(f' ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING')} = {h} THEN round(sum(price_log_return) {_W.format(f' ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING')}, 6) END AS target_return, CASE WHEN count(price_log_return) {_W.format(f' ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING')} = {h} THEN round(sqrt(sum(price_log_return * price_log_return) {_W.format(f' ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING')}), 6) END AS target_vol, {h} AS horizon FROM feat"
_STAT = lambda c: f"coalesce({c}, median({c}) FILTER (role = 'train') OVER (PARTITION BY series, fold))"
_SCALE = lambda c: f"round(({c} - avg({c}) FILTER (role = 'train') OVER (PARTITION BY series, fold)) / CASE WHEN stddev_pop({c}) FILTER (role = 'train') OVER (PARTITION BY series, fold) > 0 THEN stddev_pop({c}) FILTER (role = 'train') OVER (PARTITION BY series, fold) ELSE 1 END, 5) AS {c}"

ORACLE = {
    "daily_bars": f"WITH {_BARS} SELECT series, {_T.format('date')}, round(close, 6) AS close, volume FROM bars",
    "weekly_resample": f"WITH {_WEEKS} SELECT series, {_T.format('week')}, round(close, 6) AS close, volume FROM weeks",
    "weekly_price_features": f"WITH {_FEAT} SELECT series, {_T.format('week')}, volume, {_r(_FEATURE_DOUBLES)}, target_up_next FROM feat",
    "calendar_features": f"WITH {_BARS}, d AS (SELECT DISTINCT date FROM bars) SELECT {_T.format('date')}, month(date) AS calendar_month, quarter(date) AS calendar_quarter, week(date) AS calendar_week_of_year, round(sin(2 * pi() * week(date) / 52), 6) AS calendar_week_sin, round(cos(2 * pi() * week(date) / 52), 6) AS calendar_week_cos, "
    "(month(date) IN (4, 5))::INT AS calendar_is_planting_season, (month(date) IN (6, 7, 8))::INT AS calendar_is_pollination_weather_season, (month(date) IN (9, 10, 11))::INT AS calendar_is_harvest_season, (month(date) IN (12, 1, 2))::INT AS calendar_is_winter_storage_season, "
    "month(date) AS month, quarter(date) AS quarter, round(sin(2 * pi() * week(date) / 52), 6) AS weekofyear_sin, round(cos(2 * pi() * week(date) / 52), 6) AS weekofyear_cos, round(sin(2 * pi() * (isodow(date) - 1) / 5), 6) AS dayofweek_sin, round(cos(2 * pi() * (isodow(date) - 1) / 5), 6) AS dayofweek_cos, "
    "(month(date) IN (4, 5))::INT AS is_planting_season, (month(date) IN (7, 8))::INT AS is_pollination_season, (month(date) IN (9, 10, 11))::INT AS is_harvest_season, (month(date) IN (12, 1, 2))::INT AS is_winter_storage_season FROM d",
    "horizon_targets": f"WITH {_FEAT} " + " UNION ALL ".join(_HOR(h) for h in (1, 4, 13)),
    "class_targets": f"WITH {_FEAT} SELECT CASE WHEN target_log_return_next IS NULL THEN NULL WHEN target_log_return_next <= -0.02 THEN -1 WHEN target_log_return_next >= 0.02 THEN 1 ELSE 0 END AS fixed, CASE WHEN target_log_return_next IS NULL OR price_rolling_vol_12w IS NULL THEN NULL WHEN target_log_return_next < -0.5 * price_rolling_vol_12w THEN -1 WHEN target_log_return_next > 0.5 * price_rolling_vol_12w THEN 1 ELSE 0 END AS scaled, count(*) AS n FROM feat GROUP BY 1, 2",
    "daily_price_features": f"WITH {_DAILY} SELECT series, {_T.format('date')}, {_r(_DAILY_DOUBLES)}, target_class FROM daily",
    "season_window": f"WITH {_BARS} SELECT series, count(*) AS n, round(sum(close), 4) AS closes FROM bars WHERE month(date) * 100 + day(date) >= 1115 OR month(date) * 100 + day(date) <= 210 GROUP BY series",
    "trailing_mean": f"WITH {_BARS} SELECT series, {_T.format('date')}, round(avg(close) {_D.format(' ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING')}, 6) AS before FROM bars",
    "momentum_backtest": f"WITH {_BT} SELECT series, {_T.format('week')}, {_r(['position', 'turnover', 'strategy_log_return', 'cum_strategy_return', 'drawdown'])} FROM bt",
    "backtest_summary": f"WITH {_SUM} SELECT series, n, n_traded, {_r(['total_return', 'annual_return', 'annual_vol', 'sharpe', 'benchmark_return', 'max_drawdown', 'mean_position', 'mean_turnover', 'hit_rate_traded', 'mean_return_traded'])} FROM summary",
    "best_run": f"WITH {_SUM} SELECT arg_max(series, (sharpe, series)) AS best, round(max(sharpe), 6) AS sharpe, bool_and(total_return < 0) AS all_lose FROM summary WHERE sharpe IS NOT NULL",
    "daily_summary": f"WITH {_DBT}, q AS (SELECT *, exp(sum(ln(1 + r)) {_D.format(' ROWS UNBOUNDED PRECEDING')}) AS wealth FROM dbt), q2 AS (SELECT *, wealth / max(wealth) {_D.format(' ROWS UNBOUNDED PRECEDING')} - 1 AS down FROM q), t AS (SELECT series, count(*) AS n, exp(sum(ln(1 + r))) - 1 AS total_return, stddev_samp(r) * sqrt(252) AS annual_vol, avg(r) / nullif(stddev_samp(r), 0) * sqrt(252) AS sharpe, min(down) AS max_drawdown, avg(turnover) AS mean_turnover, avg(position) AS mean_position, avg((position = 0)::INT) AS cash_share FROM q2 GROUP BY series) SELECT series, n, round(total_return, 6) AS total_return, round(pow(1 + total_return, 252.0 / n) - 1, 6) AS annual_return, {_r(['annual_vol', 'sharpe', 'max_drawdown', 'mean_turnover', 'mean_position', 'cash_share'])} FROM t",
    "equity_curve": f"WITH {_DBT} SELECT series, {_T.format('date')}, round(exp(sum(ln(1 + r)) {_D.format(' ROWS UNBOUNDED PRECEDING')}), 6) AS equity FROM dbt UNION ALL SELECT series, strftime(min(date) - 1, '%Y-%m-%d'), 1.0 FROM dbt GROUP BY series",
    "regression_metrics": f"WITH {_PRED} SELECT series, count(*) AS n, round(avg(abs(target_log_return_next - pred)), 6) AS mae, round(sqrt(avg(pow(target_log_return_next - pred, 2))), 6) AS rmse, round(1 - sum(pow(target_log_return_next - pred, 2)) / nullif(sum(pow(target_log_return_next, 2)) - count(*) * pow(avg(target_log_return_next), 2), 0), 6) AS r2, round(avg((sign(target_log_return_next) = sign(pred))::INT), 6) AS direction_accuracy, round(corr(target_log_return_next, pred), 6) AS corr FROM predicted WHERE target_log_return_next IS NOT NULL GROUP BY series",
    "spearman": f"WITH {_PRED}, q AS (SELECT * FROM predicted WHERE target_log_return_next IS NOT NULL), rk AS (SELECT series, rank() OVER (PARTITION BY series ORDER BY target_log_return_next) + (count(*) OVER (PARTITION BY series, target_log_return_next) - 1) / 2.0 AS a, rank() OVER (PARTITION BY series ORDER BY pred) + (count(*) OVER (PARTITION BY series, pred) - 1) / 2.0 AS b FROM q) SELECT series, round(corr(a, b), 6) AS spearman FROM rk GROUP BY series",
    "binary_metrics": f"WITH {_PRED}, q AS (SELECT series, target_up_next AS t, prob, (prob >= 0.5)::INT AS h, greatest(least(prob, 1 - 1e-6), 1e-6) AS p, rank() OVER (PARTITION BY series ORDER BY prob) + (count(*) OVER (PARTITION BY series, prob) - 1) / 2.0 AS r FROM predicted WHERE target_up_next IS NOT NULL) SELECT series, count(*) AS n, round(avg((t = h)::INT), 6) AS accuracy, round((count(*) FILTER (t = 1 AND h = 1) / nullif(count(*) FILTER (t = 1), 0) + count(*) FILTER (t = 0 AND h = 0) / nullif(count(*) FILTER (t = 0), 0)) / 2, 6) AS balanced_accuracy, round(2 * count(*) FILTER (t = 1 AND h = 1) / nullif(2 * count(*) FILTER (t = 1 AND h = 1) + count(*) FILTER (t <> h), 0), 6) AS f1, round(avg(CASE WHEN t = 1 THEN -ln(p) ELSE -ln(1 - p) END), 6) AS log_loss, round((sum(r) FILTER (t = 1) - count(*) FILTER (t = 1) * (count(*) FILTER (t = 1) + 1) / 2) / nullif(count(*) FILTER (t = 1) * count(*) FILTER (t = 0), 0), 6) AS roc_auc FROM q GROUP BY series",
    "roc_points": f"WITH {_PRED}, q AS (SELECT series, round(prob, 2) AS threshold, count(*) FILTER (target_up_next = 1) AS p, count(*) FILTER (target_up_next = 0) AS n FROM predicted WHERE target_up_next IS NOT NULL GROUP BY 1, 2) SELECT series, threshold, round(sum(p) OVER (PARTITION BY series ORDER BY threshold DESC) / nullif(sum(p) OVER (PARTITION BY series), 0), 6) AS tpr, round(sum(n) OVER (PARTITION BY series ORDER BY threshold DESC) / nullif(sum(n) OVER (PARTITION BY series), 0), 6) AS fpr FROM q",
    "confusion_matrix": f"WITH {_PRED}, q AS (SELECT series, CASE WHEN target_log_return_next <= -0.02 THEN -1 WHEN target_log_return_next >= 0.02 THEN 1 ELSE 0 END AS y, CASE WHEN pred <= -0.01 THEN -1 WHEN pred >= 0.01 THEN 1 ELSE 0 END AS p FROM predicted WHERE target_log_return_next IS NOT NULL) SELECT series, " + ", ".join(f"count(*) FILTER (y = {a} AND p = {b}) AS " + f"n_{a}_{b}".replace("-", "m") for a in (-1, 0, 1) for b in (-1, 0, 1)) + " FROM q GROUP BY series",
    "folds_expanding": f"WITH {_FOLD(None)}{_COUNTS}",
    "folds_rolling": f"WITH {_FOLD(20)}{_COUNTS}",
    "folds_yearly": f"WITH {_DAILY}, x AS (SELECT series, year(date) AS yr, target_return AS t FROM daily WHERE target_return IS NOT NULL), ys AS (SELECT DISTINCT series, yr FROM x), m AS (SELECT ys.series, ys.yr, count(*) AS train_n, avg(o.t) AS train_mean FROM ys JOIN x o ON o.series = ys.series AND o.yr < ys.yr GROUP BY 1, 2 HAVING count(*) >= 60) SELECT x.series, x.yr, m.train_n, round(m.train_mean, 6) AS train_mean, count(*) AS n, round(1 - avg(x.t * x.t) / nullif(avg(pow(x.t - m.train_mean, 2)), 0), 6) AS oos_r2 FROM x JOIN m ON m.series = x.series AND m.yr = x.yr GROUP BY x.series, x.yr, m.train_n, m.train_mean",
    "fold_quantile": f"WITH {_FOLD(None)}, q AS (SELECT series, fold, quantile_cont(abs(target_log_return_next), 0.7) AS q FROM folded WHERE role = 'train' GROUP BY 1, 2) SELECT series, fold, round(q, 6) AS threshold, count(*) FILTER (abs(target_log_return_next) >= q) AS n_high, count(*) AS n FROM folded JOIN q USING (series, fold) WHERE role = 'test' GROUP BY series, fold, q",
    "fold_scaled": f"WITH {_FOLD(None)}, a AS (SELECT series, fold, week, role, {_STAT('price_momentum_12w')} AS price_momentum_12w, {_STAT('price_rolling_vol_4w')} AS price_rolling_vol_4w FROM folded), b AS (SELECT series, fold, week, role, {_SCALE('price_momentum_12w')}, {_SCALE('price_rolling_vol_4w')} FROM a) SELECT series, fold, {_T.format('week')}, price_momentum_12w, price_rolling_vol_4w FROM b WHERE role = 'test'",
    "ridge_one_feature": f"WITH {_FOLD(None)}, a AS (SELECT series, fold, week, role, target_log_return_next AS y, {_STAT('price_log_return')} AS x0 FROM folded), b AS (SELECT *, (x0 - avg(x0) FILTER (role = 'train') OVER w) / CASE WHEN stddev_pop(x0) FILTER (role = 'train') OVER w > 0 THEN stddev_pop(x0) FILTER (role = 'train') OVER w ELSE 1 END AS x FROM a WINDOW w AS (PARTITION BY series, fold)), m AS (SELECT series, fold, count(*) AS n_train, avg(y) AS my, (sum(x * y) - count(*) * avg(x) * avg(y)) / (sum(x * x) - count(*) * avg(x) * avg(x) + 1) AS k FROM b WHERE role = 'train' GROUP BY 1, 2 HAVING count(*) >= 20) SELECT series, fold, {_T.format('week')}, round(my + k * x, 5) AS y_pred, n_train FROM b JOIN m USING (series, fold) WHERE role = 'test'",
    "class_metrics": f"WITH {_PRED}, {_CLS}, m AS (SELECT series, count(*) AS n, avg((y = p)::INT) AS accuracy, {', '.join(f'count(*) FILTER (y = {c}) AS n_{t}, count(*) FILTER (p = {c}) AS s_{t}, count(*) FILTER (y = {c} AND p = {c}) AS b_{t}' for c, t in ((-1, 'm1'), (0, '0'), (1, '1')))} FROM q GROUP BY series), k AS (SELECT *, {', '.join(f'b_{t} / nullif(n_{t}, 0) AS recall_{t}, coalesce(2 * b_{t} / nullif(n_{t} + s_{t}, 0), 0) AS f_{t}' for t in ('m1', '0', '1'))} FROM m) SELECT series, n, n_m1, n_0, n_1, {_r(['accuracy', 'recall_m1', 'recall_0', 'recall_1'])}, round(list_avg(list_filter([recall_m1, recall_0, recall_1], lambda x: x IS NOT NULL)), 6) AS balanced_accuracy_present, round((f_m1 + f_0 + f_1) / 3, 6) AS macro_f1, round((n_m1 + n_1) / n, 6) AS event_rate, n_m1 > 0 AND n_1 > 0 AS has_both_ends FROM k",
    "label_counts": f"WITH {_PRED}, {_CLS}, g AS (SELECT DISTINCT series FROM q) SELECT g.series, l.y, (SELECT count(*) FROM q WHERE q.series = g.series AND q.y = l.y) AS n FROM g, (VALUES (-2), (-1), (0), (1), (2)) l(y)",
    "volatility_metrics": f"WITH {_FEAT}, x AS (SELECT series, abs(target_log_return_next) AS y, price_rolling_vol_4w AS p FROM feat WHERE target_log_return_next IS NOT NULL AND price_rolling_vol_4w IS NOT NULL), x1 AS (SELECT *, quantile_cont(y, 0.7) OVER (PARTITION BY series) AS q, rank() OVER (PARTITION BY series ORDER BY y) + (count(*) OVER (PARTITION BY series, y) - 1) / 2.0 AS a, rank() OVER (PARTITION BY series ORDER BY p) + (count(*) OVER (PARTITION BY series, p) - 1) / 2.0 AS b FROM x) SELECT series, count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg(pow(y - p, 2))), 6) AS rmse, round(1 - sum(pow(y - p, 2)) / nullif(sum(y * y) - count(*) * avg(y) * avg(y), 0), 6) AS r2, round(avg((sign(y) = sign(p))::INT), 6) AS direction_accuracy, round(corr(y, p), 6) AS corr, round(corr(a, b), 6) AS spearman, round(avg((y >= q)::INT), 6) AS high_share, round(avg(((y >= q) = (p >= q))::INT), 6) AS high_accuracy, round(count(*) FILTER (y >= q AND p >= q) / nullif(count(*) FILTER (y >= q), 0), 6) AS high_recall FROM x1 GROUP BY series",
    "against_mean": f"WITH {_PRED} SELECT series, count(*) AS n, round(1 - avg(pow(target_log_return_next - pred, 2)) / nullif(avg(pow(target_log_return_next - 0.001, 2)), 0), 6) AS oos_r2, round(CASE WHEN stddev_pop(pred) > 0 AND stddev_pop(target_log_return_next) > 0 THEN corr(target_log_return_next, pred) END, 6) AS corr, round(avg((sign(target_log_return_next) = sign(pred))::INT), 6) AS direction_accuracy FROM predicted WHERE target_log_return_next IS NOT NULL GROUP BY series",
    "against_baseline": f"WITH {_PRED}, m AS (SELECT series, sqrt(avg(pow(target_log_return_next - pred, 2))) AS rmse, 1 - sum(pow(target_log_return_next - pred, 2)) / nullif(sum(pow(target_log_return_next, 2)) - count(*) * pow(avg(target_log_return_next), 2), 0) AS r2 FROM predicted WHERE target_log_return_next IS NOT NULL GROUP BY series), b AS (SELECT * FROM m WHERE series = (SELECT min(series) FROM bars)) SELECT m.series, round(m.r2, 6) AS r2, round(m.rmse, 6) AS rmse, round(m.r2 - b.r2, 6) AS r2_delta, round(m.rmse - b.rmse, 6) AS rmse_delta, (SELECT bool_and(r2 < 0) FROM m) AS all_r2_negative, (SELECT bool_and(rmse < 0) FROM m) AS all_rmse_negative FROM m LEFT JOIN b ON true",
    "sorted_runs": f"WITH {_SUM} SELECT series, n_traded, round(total_return, 6) AS total_return FROM summary ORDER BY n_traded DESC NULLS LAST, total_return, series",
    "sampled_cost": f"WITH {_BARS}, m AS (SELECT date_trunc('month', date) AS month, count(*) AS c FROM bars GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY month) AS i, count(*) OVER () AS n FROM m), s AS (SELECT * FROM k WHERE i IN (1, n // 2 + 1, n)) SELECT max(n)::INT AS n_units, count(*)::INT AS n_sampled, round(avg(c), 6) AS mean_cost, round(avg(c) * max(n), 6) AS total_cost FROM s",
}
