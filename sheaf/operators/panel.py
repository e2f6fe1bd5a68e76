"""Named column sets of feature panels, run keys and label counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The blocks of each named set, in order; a star adds the free text.
FEATURE_SETS = {
    "price_only": "price", "price_gdelt": "price gdelt", "price_calendar": "price calendar", "price_calendar_gdelt": "price calendar gdelt", "price_calendar_weather": "price calendar weather",
    "price_calendar_text": "price calendar text *", "price_calendar_weather_text": "price calendar weather text *", "price_ai": "price ai", "price_ai_gdelt": "price ai gdelt", "price_calendar_ai": "price calendar ai",
    "price_calendar_ai_gdelt": "price calendar ai gdelt", "price_calendar_weather_ai": "price calendar weather ai", "price_calendar_weather_text_ai": "price calendar weather text ai *",
    "A_price": "price", "A_price_calendar": "price calendar", "B_price_weather": "price weather", "C_price_weather_text": "price weather text *",
}
TRAINED_SETS = ["A_price", "B_price_weather", "C_price_weather_text"]
DAILY_CALENDAR = ["month", "quarter", "weekofyear_sin", "weekofyear_cos", "dayofweek_sin", "dayofweek_cos", "is_planting_season", "is_pollination_season", "is_harvest_season", "is_winter_storage_season"]


def block(columns: list[str], name: str) -> list[str]:
    """Columns of a block: those with its prefix, without the log price; text is sorted and has the number of reports."""
    own = [c for c in columns if c.startswith(f"{name}_") and c != "price_log_close"]
    return sorted({*own, *({"report_count"} & set(columns))}) if name == "text" else own


def feature_set(columns: list[str], name: str) -> tuple[list[str], str | None]:
    """(numeric columns, free text column or None) of a named set."""
    if name not in FEATURE_SETS:
        raise ValueError(f"unknown feature set {name}; there are {', '.join(FEATURE_SETS)}")
    blocks = FEATURE_SETS[name].split()
    return [c for b in blocks if b != "*" for c in block(columns, b)], "report_text" if "*" in blocks else None


def lead_sets(columns: list[str], lead: int) -> dict[str, list[str]]:
    """The three sets of a forecast lead, each with all of the last: prices and calendar, the forecast, its change from the initial state."""
    own = [c for c in columns if c.startswith(("price_return_lag_", "price_vol_", "price_momentum_"))] + [c for c in DAILY_CALENDAR if c in columns]
    steps = {
        "price_calendar": [],
        "forecast_anom": ["heat_forecast_z", "dryness_forecast_z", "heat_x_dryness"],
        "forecast_anom_projected_change": ["heat_projected_change", "dryness_projected_change", "projected_heat_x_dryness"],
    }
    out = {}
    for name, more in steps.items():
        own = own + [f"weather_{m}_l{lead}" for m in more]
        if missing := [c for c in own if c not in columns]:
            raise KeyError(f"lead {lead}, {name}: no {missing}")
        out[f"lead{lead:02d}_{name}"] = own
    return out


def threshold_key(k: float, set_name: str) -> str:
    return f"k_{k:g}_{set_name}"


def threshold_model(k: float, set_name: str) -> str:
    return f"vol_adj_k_{k}_{set_name}"


def model_key(set_name: str, estimator: str) -> str:
    return f"{set_name}_{estimator}"


def configurations(**axes: list) -> list[dict]:
    """Every combination of the values of some axes, in order: what a driver of models runs over."""
    out: list[dict] = [{}]
    for name, values in axes.items():
        out = [{**x, name: v} for x in out for v in values]
    return out


def label_counts(df: DataFrame, by: list[str], label: str, labels: list) -> DataFrame:
    """(by, label, n): rows of each label, 0 for a label that a group doesn't have; other labels don't count."""
    kind = df.schema[label].dataType
    groups = df.select(*by).distinct().withColumn(label, F.explode(F.array(*[F.lit(x).cast(kind) for x in labels])))
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    return groups.join(counts, [*by, label], "left").na.fill(0, ["n"])


def flattened(df: DataFrame, column: str) -> DataFrame:
    """df with the fields of a struct column as columns of their own, <column>_<field>."""
    return df.select(*[c for c in df.columns if c != column], *[F.col(f"{column}.{f.name}").alias(f"{column}_{f.name}") for f in df.schema[column].dataType.fields])


def sampled_cost(cells: DataFrame, unit: str, cost: str) -> DataFrame:
    """(n_units, n_sampled, mean_cost, total_cost): what all units cost, by the mean of the first, the middle and the last."""
    one = cells.agg(F.array_sort(F.collect_list(F.struct(unit, cost))).alias("x"))  # one row a unit, such as a month
    at = F.array_distinct(F.array(F.lit(1), F.floor(F.size("x") / 2).cast("int") + 1, F.size("x")))
    picked = F.transform(at, lambda i: F.element_at("x", i)[cost].cast("double"))
    mean = F.aggregate(picked, F.lit(0.0), lambda a, v: a + v) / F.size(picked)
    return one.filter(F.size("x") > 0).select(F.size("x").alias("n_units"), F.size(picked).alias("n_sampled"), mean.alias("mean_cost"), (mean * F.size("x")).alias("total_cost"))
