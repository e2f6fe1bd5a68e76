"""Walk-forward drivers over feature sets, targets and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.functions.calendar import calendar_columns, friday
from sheaf.operators import backtest as B
from sheaf.operators import folds as V
from sheaf.operators import news as N
from sheaf.operators import panel as P
from sheaf.operators import series as S
from sheaf.plans.prices import SPLIT, bars, features, rounded
from sheaf.plans.reports import feature_panel
from sheaf.runtime import read, stored


def weekly_numbers(s: SparkSession, d: str) -> DataFrame:
    """Weekly features of each series with the blocks of numbers: calendar, weather, scores, report words, news."""
    more = feature_panel(s, d).drop("close", "volume", "n_reports")
    shipped = read(s, d, "lineitem").select(friday(F.add_months(F.to_date("l_shipdate"), 336)).alias("week"), "l_quantity", "l_discount")
    weather = shipped.groupBy("week").agg(F.avg("l_quantity").alias("weather_quantity"), F.avg("l_discount").alias("weather_discount"))
    x = features(s, d).withColumns(calendar_columns(F.col("week")))
    return x.join(more, ["series", "week"], "left").join(weather, "week", "left")


def weekly_texts(s: SparkSession, d: str) -> DataFrame:
    """(week, report_text): all bulletins' texts of a week."""
    return N.joined_text(read(s, d, "wwcb_core_text").withColumn("week", friday(F.col("report_date").try_cast("date"))).filter("week is not null"), ["week"], "national_ag_summary", ["bulletin_id"]).drop("report_count")


def weekly_panel(s: SparkSession, d: str) -> DataFrame:
    """Weekly features of each series with all blocks: calendar, weather, scores, report words and text, news."""
    return weekly_numbers(s, d).join(weekly_texts(s, d), "week", "left").na.fill("", ["report_text"])


def run(panel: DataFrame, models: list[V.Model], order: str = "week", folds: DataFrame | None = None, least: int = 20, texts: DataFrame | None = None) -> DataFrame:
    folds = V.fold_table(panel.filter(F.col(models[0].target).isNotNull()), order, SPLIT) if folds is None else folds
    # predictions are read by several metrics, fits are made once
    return stored(V.walk_forward(panel, ["series"], models, order, folds, least, texts), "predictions")


def fitted_counts(x: DataFrame) -> DataFrame:
    return x.groupBy("series", "model").agg(F.min("n_train").alias("n_train_min"), F.max("n_train").alias("n_train_max"), F.countDistinct("fold").alias("n_folds"))


def traded(x: DataFrame, position, panel: DataFrame) -> DataFrame:
    y = x.join(panel.select("series", "week", "target_log_return_next"), ["series", "week"], "left").withColumn("position", position)
    return B.weekly_summary(B.strategy(y, "position", "target_log_return_next", ["series", "model"], "week"), ["series", "model"], "target_log_return_next", "position").drop("n")


def direction_models(s: SparkSession, d: str) -> DataFrame:
    """Up or down next week: each trained set with a logistic and a boosted model, its metrics and its backtest."""
    # a week's text is that of all series: as a column it would stand there once a series
    panel = stored(weekly_numbers(s, d), "panel")
    models = []
    for c in P.configurations(set=P.TRAINED_SETS, kind=["logit", "boosted_up"]):
        own, text = P.feature_set(panel.columns, c["set"])
        models.append(V.Model(P.model_key(c["set"], c["kind"]), tuple(own), "target_up_next", c["kind"], classes=(0, 1), text=text))
    x = run(panel, models, texts=weekly_texts(s, d))
    by = ["series", "model"]
    return rounded(B.binary_metrics(x, by, "y_true", "y_pred").join(fitted_counts(x), by).join(traded(x, B.position_from_probability(F.col("y_pred")), panel), by))


def return_models(s: SparkSession, d: str) -> DataFrame:
    """Next week's return by ridge and boosting over prices with and without the calendar, its errors and its backtest."""
    panel = stored(weekly_panel(s, d), "panel")
    models = [V.Model(P.model_key(c["set"], c["kind"]), tuple(P.feature_set(panel.columns, c["set"])[0]), "target_log_return_next", c["kind"]) for c in P.configurations(set=["price_only", "price_calendar"], kind=["ridge", "boosted"])]
    x = run(panel, models)
    by = ["series", "model"]
    return rounded(B.regression_metrics(x, by, "y_true", "y_pred").join(fitted_counts(x), by).join(traded(x, B.position_from_return(F.col("y_pred")), panel), by))


def threshold_models(s: SparkSession, d: str) -> DataFrame:
    """Three classes by bands of k times the trailing volatility, for several k and sets."""
    panel = stored(weekly_panel(s, d), "panel")
    runs = P.configurations(k=[0.25, 0.5, 0.75, 1.0], set=["price_only", "price_calendar"])
    panel = panel.withColumns({f"cls_{r['k']}".replace(".", "_"): S.scaled_class(F.col("target_log_return_next"), F.col("price_rolling_vol_12w"), r["k"]) for r in runs})
    models = [V.Model(P.threshold_key(r["k"], r["set"]), tuple(P.feature_set(panel.columns, r["set"])[0]), f"cls_{r['k']}".replace(".", "_"), "classes") for r in runs]
    x = run(panel, models)
    return rounded(B.class_metrics(x, ["series", "model"], "y_true", "y_pred", [-1, 0, 1]).join(fitted_counts(x), ["series", "model"]))


def volatility_models(s: SparkSession, d: str) -> DataFrame:
    """Next week's absolute return by ridge; high above the 70 % quantile of what the fold was trained on."""
    panel = stored(weekly_panel(s, d).withColumn("target_vol", F.abs("target_log_return_next")), "panel")
    folds = V.fold_table(panel.filter("target_vol is not null"), "week", SPLIT)
    x = run(panel, [V.Model(n, tuple(P.feature_set(panel.columns, n)[0]), "target_vol") for n in ("price_only", "price_calendar")], folds=folds)
    q = V.assigned(panel.select("series", "week", "target_vol"), folds, "week").filter("role = 'train'").groupBy("series", "fold").agg(F.percentile("target_vol", F.lit(0.7)).alias("q"))
    return rounded(B.volatility_metrics(x.join(q, ["series", "fold"]), ["series", "model"], "y_true", "y_pred", "q"))


YEAR_ROWS = 756  # training days a year's model needs


def yearly_models(s: SparkSession, d: str, least: int = YEAR_ROWS) -> DataFrame:
    """The five-day return of each year by ridge chosen on splits of all years before it, against their mean."""
    panel = S.daily_features(bars(s, d))
    own = tuple(c for c in panel.columns if c.startswith(("price_return_lag_", "price_vol_", "price_momentum_")))
    x = run(panel, [V.Model("price", own, "target_return", alpha=None)], "date", V.year_folds(panel.filter("target_return is not null"), "date"), least)
    by = ["series", "model", "fold"]
    w = Window.partitionBy(*by).orderBy("date")
    x = x.join(panel.select("series", "date", "target_next_1d_return"), ["series", "date"]).withColumn("position", B.position_from_return(F.col("y_pred"), 5, 0, True)).withColumn("turnover", F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0))))
    x = x.withColumn("r", F.coalesce(F.col("position") * F.col("target_next_1d_return"), F.lit(0.0)) - F.col("turnover") * 5 / 1e4)
    return rounded(B.against_mean(x, by, "y_true", "y_pred", "train_mean").join(B.daily_summary(x, by, "r", "date", "position", "turnover").drop("n"), by).join(x.groupBy(*by).agg(F.avg("alpha").alias("alpha"), F.max("n_train").alias("n_train")), by))


QUERIES = {
    "direction_models": direction_models, "return_models": return_models, "threshold_models": threshold_models, "volatility_models": volatility_models,
    # the tables hold two years, so a first year's days have to do
    "yearly_models": lambda s, d: yearly_models(s, d, 150),
}
ORACLE: dict[str, str] = {}
