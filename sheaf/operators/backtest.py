"""Positions, returns and their summaries; metrics of forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def logistic(x: Column, most: float = 35.0) -> Column:
    """1 / (1 + e^-x) of x cut off on both sides; null stays null."""
    return F.when(x.isNotNull(), 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(most)), F.lit(-most)))))


def position_from_probability(p_up: Column, long: float = 0.55, short: float | None = None) -> Column:
    out = F.when(p_up >= long, 1.0)
    return (out.when(p_up <= short, -1.0) if short is not None else out).otherwise(0.0)


def position_from_classes(p_down: Column, p_up: Column, long: float, short: float | None = None) -> Column:
    """Of three classes' probabilities; a short signal comes before a long one."""
    out = F.when(p_down >= short, -1.0).when(p_up >= long, 1.0) if short is not None else F.when(p_up >= long, 1.0)
    return out.otherwise(0.0)


def position_from_return(predicted: Column, cost_bps: float = 5, buffer_bps: float = 25, shorts: bool = False) -> Column:
    edge = (cost_bps + buffer_bps) / 1e4
    out = F.when(predicted > edge, 1.0)
    return (out.when(predicted < -edge, -1.0) if shorts else out).otherwise(0.0)


def strategy(df: DataFrame, position: str, realised: str, by: list[str], order: str, cost_bps: float = 5, include_initial: bool = False) -> DataFrame:
    """turnover, strategy_log_return, cum_strategy_return and drawdown of positions, row by row within each run.

    The peak starts with the first row's wealth; include_initial starts it with 1.
    """
    w = Window.partitionBy(*by).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("turnover", F.abs(F.col(position) - F.coalesce(F.lag(position).over(w), F.lit(0.0))))
    out = out.withColumn("strategy_log_return", F.coalesce(F.col(position) * F.col(realised), F.lit(0.0)) - F.col("turnover") * cost_bps / 1e4)
    out = out.withColumn("wealth", F.exp(F.sum("strategy_log_return").over(run)))
    peak = F.max("wealth").over(run)
    peak = F.greatest(peak, F.lit(1.0)) if include_initial else peak
    return out.withColumn("cum_strategy_return", F.col("wealth") - 1).withColumn("drawdown", F.col("wealth") / peak - 1)


def weekly_summary(df: DataFrame, by: list[str], realised: str, position: str) -> DataFrame:
    """Log-return summary with 52 periods a year and the population deviation."""
    r = F.col("strategy_log_return")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.exp(F.sum(r)) - 1).alias("total_return"), (F.exp(52 * F.avg(r)) - 1).alias("annual_return"), (F.stddev_pop(r) * 52**0.5).alias("annual_vol"), (F.try_divide(F.avg(r), F.stddev_pop(r)) * 52**0.5).alias("sharpe"),
        (F.exp(F.sum(F.coalesce(F.col(realised), F.lit(0.0)))) - 1).alias("benchmark_return"), F.min("drawdown").alias("max_drawdown"), F.avg(position).alias("mean_position"), F.avg("turnover").alias("mean_turnover"),
        F.count_if(F.col(position) != 0).alias("n_traded"), F.avg(F.when(F.col(position) != 0, (F.col(realised) > 0).cast("int"))).alias("hit_rate_traded"), F.avg(F.when(F.col(position) != 0, F.col(realised))).alias("mean_return_traded"),
    )


def daily_summary(df: DataFrame, by: list[str], simple: str, order: str, position: str, turnover: str) -> DataFrame:
    """Simple-return summary with 252 periods a year and the sample deviation; a missing return counts as 0, one of -1 or less ends all wealth.

    The peak starts with the first row's wealth.
    """
    run = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    r = F.coalesce(F.col(simple), F.lit(0.0))
    x = df.withColumn("__lost", F.max((r <= -1).cast("int")).over(run)).withColumn("__wealth", F.when(F.col("__lost") == 1, 0.0).otherwise(F.exp(F.sum(F.when(r > -1, F.ln(1 + r))).over(run))))
    x = x.withColumn("__down", F.col("__wealth") / F.max("__wealth").over(run) - 1)
    total = F.when(F.max("__lost") == 1, 0.0).otherwise(F.exp(F.sum(F.when(r > -1, F.ln(1 + r))))) - 1
    return x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), total.alias("total_return"), (F.pow(1 + total, 252 / F.count(F.lit(1))) - 1).alias("annual_return"), (F.stddev_samp(r) * 252**0.5).alias("annual_vol"), (F.try_divide(F.avg(r), F.stddev_samp(r)) * 252**0.5).alias("sharpe"),
        F.min("__down").alias("max_drawdown"), F.avg(turnover).alias("mean_turnover"), F.avg(position).alias("mean_position"), F.avg((F.col(position) == 0).cast("int")).alias("cash_share"),
    )


def regression_metrics(df: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    e = F.col(y) - F.col(p)
    sse, mean = F.sum(e * e), F.avg(y)
    sst = F.sum(F.col(y) * F.col(y)) - F.count(y) * mean * mean
    return df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(sse, sst)).alias("r2"), F.avg((F.signum(y) == F.signum(p)).cast("int")).alias("direction_accuracy"), F.corr(y, p).alias("corr"))


def average_rank(x: str, by: list[str]) -> Column:
    """Ranks with ties at their mean."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2


def spearman(df: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    some = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    return some.withColumns({"__y": average_rank(y, by), "__p": average_rank(p, by)}).groupBy(*by).agg(F.corr("__y", "__p").alias("spearman"))


def confusion(df: DataFrame, by: list[str], y: str, p: str, labels: list[int]) -> DataFrame:
    """Counts of each true and predicted class, zeros included."""
    cells = [F.count_if((F.col(y) == a) & (F.col(p) == b)).alias(f"n_{a}_{b}".replace("-", "m")) for a in labels for b in labels]
    return df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by).agg(*cells)


def class_metrics(df: DataFrame, by: list[str], y: str, p: str, labels: list[int]) -> DataFrame:
    """Accuracy, recall of each class and its mean over the classes there are, macro F1 (an absent class counts 0), counts and the share of rows off the middle label."""
    some = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    tag = lambda c: str(c).replace("-", "m")
    true, said, both = ({c: F.count_if(t(c)) for c in labels} for t in (lambda c: F.col(y) == c, lambda c: F.col(p) == c, lambda c: (F.col(y) == c) & (F.col(p) == c)))
    recall = {c: F.try_divide(both[c], true[c]) for c in labels}
    there = F.filter(F.array(*recall.values()), lambda x: x.isNotNull())
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    f1 = F.array(*[F.coalesce(F.try_divide(2.0 * both[c], true[c] + said[c]), F.lit(0.0)) for c in labels])
    ends = [labels[0], labels[-1]]
    return some.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(y) == F.col(p)).cast("int")).alias("accuracy"), F.try_divide(total(there), F.size(there)).alias("balanced_accuracy_present"), (total(f1) / len(labels)).alias("macro_f1"),
        *[recall[c].alias(f"recall_{tag(c)}") for c in labels], *[true[c].alias(f"n_{tag(c)}") for c in labels], F.avg(F.col(y).isin(ends).cast("int")).alias("event_rate"), ((true[ends[0]] > 0) & (true[ends[1]] > 0)).alias("has_both_ends"),
    )


def volatility_metrics(df: DataFrame, by: list[str], y: str, p: str, threshold: str) -> DataFrame:
    """Errors, rank correlation, and how well high values (at or above each row's threshold) are told."""
    high = df.withColumns({"__hy": (F.col(y) >= F.col(threshold)).cast("int"), "__hp": (F.col(p) >= F.col(threshold)).cast("int")})
    shares = high.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by).agg(
        F.avg("__hy").alias("high_share"), F.avg((F.col("__hy") == F.col("__hp")).cast("int")).alias("high_accuracy"), F.try_divide(F.count_if((F.col("__hy") == 1) & (F.col("__hp") == 1)), F.count_if(F.col("__hy") == 1)).alias("high_recall"),
    )
    return regression_metrics(df, by, y, p).join(spearman(df, by, y, p), by, "left").join(shares, by, "left")


def against_mean(df: DataFrame, by: list[str], y: str, p: str, mean: str) -> DataFrame:
    """Out-of-sample R2 against a mean known beforehand, correlation (null without variance) and the share of right signs."""
    some = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    square = lambda c: F.avg((F.col(y) - F.col(c)) * (F.col(y) - F.col(c)))
    return some.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (1 - F.try_divide(square(p), square(mean))).alias("oos_r2"), F.when((F.stddev_pop(y) > 0) & (F.stddev_pop(p) > 0), F.corr(y, p)).alias("corr"), F.avg((F.signum(y) == F.signum(p)).cast("int")).alias("direction_accuracy"))


def against_baseline(metrics: DataFrame, key: str, baseline: str, columns: list[str]) -> DataFrame:
    """metrics with <column>_delta against the baseline's row and, in every row, whether all runs have a negative value."""
    base = metrics.filter(F.col(key) == baseline).select(*[F.col(c).alias(f"__{c}") for c in columns]).limit(1)
    whole = Window.partitionBy(F.lit(1))  # one row a run
    out = metrics.join(F.broadcast(base), how="left")  # one row
    return out.select(*metrics.columns, *[(F.col(c) - F.col(f"__{c}")).alias(f"{c}_delta") for c in columns], *[F.every(F.col(c) < 0).over(whole).alias(f"all_{c}_negative") for c in columns])


def binary_metrics(df: DataFrame, by: list[str], y: str, prob: str) -> DataFrame:
    """Accuracy, balanced accuracy, F1, log-loss and area under the ROC curve (by average ranks)."""
    some = df.filter(F.col(y).isNotNull() & F.col(prob).isNotNull()).withColumn("__r", average_rank(prob, by)).withColumn("__h", (F.col(prob) >= 0.5).cast("int"))
    t, h = F.col(y), F.col("__h")
    p = F.greatest(F.least(F.col(prob), F.lit(1 - 1e-6)), F.lit(1e-6))
    tp, fp, fn, tn = (F.count_if((t == a) & (h == b)) for a, b in ((1, 1), (0, 1), (1, 0), (0, 0)))
    pos, neg = F.count_if(t == 1), F.count_if(t == 0)
    return some.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((t == h).cast("int")).alias("accuracy"), ((F.try_divide(tp, pos) + F.try_divide(tn, neg)) / 2).alias("balanced_accuracy"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.avg(-F.when(t == 1, F.ln(p)).otherwise(F.ln(1 - p))).alias("log_loss"), F.try_divide(F.sum(F.when(t == 1, F.col("__r"))) - pos * (pos + 1) / 2, pos * neg).alias("roc_auc"),
    )


def roc_points(df: DataFrame, by: list[str], y: str, score: str) -> DataFrame:
    """True and false positive rates at each distinct score, from the highest down."""
    at = df.filter(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(*by, score).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n"))
    run = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    return at.select(*by, F.col(score).alias("threshold"), F.try_divide(F.sum("p").over(run), F.sum("p").over(whole)).alias("tpr"), F.try_divide(F.sum("n").over(run), F.sum("n").over(whole)).alias("fpr"))
