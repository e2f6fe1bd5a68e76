"""Queries over lead-indexed forecasts and grids, on line items and customers as stand-ins, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.calendar import circular_distance, season_day
from sheaf.operators import climate as C
from sheaf.plans.prices import rounded
from sheaf.runtime import read

LEADS = [30, 60, 90, 130]


def forecasts(s: SparkSession, d: str) -> DataFrame:
    """(decision_date, valid_date, lead_day, v, w): means of what was decided on a day for a lead."""
    o = read(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("decision_date"))
    i = read(s, d, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("valid_date"), "l_quantity", "l_discount")
    x = i.join(o, i.l_orderkey == o.o_orderkey).withColumn("lead_day", C.lead_bucket(F.datediff("valid_date", "decision_date"), LEADS)).filter("lead_day is not null")
    return x.groupBy("decision_date", "lead_day").agg(F.avg("l_quantity").alias("v"), F.avg("l_discount").alias("w"), F.count(F.lit(1)).alias("n"))


def observed(s: SparkSession, d: str) -> DataFrame:
    """Three daily series, full-outer-joined on the date."""
    i = read(s, d, "lineitem").select(F.to_date("l_shipdate").alias("date"), "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    one = lambda flag, c, name: i.filter(F.col("l_returnflag") == flag).groupBy("date").agg(F.avg(c).alias(name))
    return one("A", "l_quantity", "t2m_obs").join(one("R", "l_extendedprice", "spfh_obs"), "date", "full").join(one("N", "l_discount", "precip_obs"), "date", "full")


def climo(s: SparkSession, d: str) -> DataFrame:
    return C.climatology(forecasts(s, d), ["lead_day"], "decision_date", "v")


def climo_one_out(s: SparkSession, d: str) -> DataFrame:
    """Climatology of all other days, later ones too."""
    return C.climatology(forecasts(s, d), ["lead_day"], "decision_date", "v", expanding=False).select("decision_date", "lead_day", "climo_n", "climo_mean", "climo_std")


def pivoted(s: SparkSession, d: str) -> DataFrame:
    return C.pivot_leads(forecasts(s, d), "decision_date", "lead_day", LEADS, ["v", "w"])


def heat(s: SparkSession, d: str) -> DataFrame:
    x = pivoted(s, d).join(observed(s, d).select(F.col("date").alias("decision_date"), F.col("t2m_obs").alias("h0"), F.col("precip_obs").alias("p0")), "decision_date", "left")
    out = C.heat_dryness(x, LEADS, "v", "w", "h0", "p0")
    return out.select("decision_date", *[f"{n}_l{x}" for n in ("heat", "dryness", "heat_x_dryness", "heat_change", "dryness_change", "projected_heat_x_dryness") for x in LEADS])


def grid(s: SparkSession, d: str) -> DataFrame:
    """Area-weighted moments of the customers of each segment, latitude and longitude made of their keys."""
    lat, lon = F.col("c_nationkey") + 25.0, F.pmod(F.col("c_custkey") * 7, F.lit(360)).cast("double")
    c = read(s, d, "customer").withColumns({"lat": lat, "lon": lon}).filter(C.in_box(F.col("lat"), F.col("lon"), 49, -104, 27, 30))
    band = C.overlap(F.col("lat") - 0.5, F.col("lat") + 0.5, 27.25, 45.75)
    return C.weighted_moments(c, ["c_mktsegment"], F.when(F.col("c_acctbal") > -900, F.col("c_acctbal")), F.cos(F.radians("lat")) * band)


def coverage(s: SparkSession, d: str) -> DataFrame:
    """Every valid day and lead of a span, with the forecast where there is one."""
    days, leads = C.calendar_grid(F.col("lo"), F.col("hi"), LEADS)
    span = read(s, d, "lineitem").agg(F.to_date(F.min("l_shipdate")).alias("lo"), F.to_date(F.max("l_shipdate")).alias("hi"))
    cells = span.select(F.explode(days).alias("valid_date")).select("valid_date", F.explode(leads).alias("lead_day")).withColumn("decision_date", F.expr("date_sub(valid_date, lead_day)"))
    x = cells.join(forecasts(s, d), ["decision_date", "lead_day"], "left")
    return x.groupBy("lead_day").agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("v").isNotNull()).alias("there"), F.avg("v").alias("mean_v"))


def covered(s: SparkSession, d: str) -> DataFrame:
    x = pivoted(s, d)
    cols = [f"v_l{k}" for k in LEADS]
    share = F.size(F.filter(F.array(*cols), lambda v: v.isNotNull())) / len(LEADS)
    return x.select("decision_date", C.row_mean(cols).alias("mean_v"), share.alias("coverage")).filter("coverage >= 0.5")


QUERIES = {
    "forecast_long": lambda s, d: rounded(forecasts(s, d)),
    "observed_outer": lambda s, d: rounded(observed(s, d)),
    "season_days": lambda s, d: rounded(read(s, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct().select("date", season_day(F.col("date")).alias("season_day"), circular_distance(season_day(F.col("date")), F.lit(10)).alias("off"))),
    "climatology": lambda s, d: rounded(climo(s, d)),
    "lead_pivot": lambda s, d: rounded(pivoted(s, d)),
    "lead_means": lambda s, d: rounded(covered(s, d)),
    "heat_dryness": lambda s, d: rounded(heat(s, d)),
    "area_weighted": lambda s, d: rounded(grid(s, d), 4),
    "lead_coverage": lambda s, d: rounded(coverage(s, d)),
}
_FC = f"""fc AS (SELECT o_orderdate::DATE AS decision_date, CASE {' '.join(f"WHEN l_shipdate::DATE - o_orderdate::DATE <= {x} THEN {x}" for x in LEADS)} END AS lead_day, avg(l_quantity) AS v, avg(l_discount) AS w, count(*) AS n
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate::DATE - o_orderdate::DATE <= {LEADS[-1]} GROUP BY 1, 2)"""
_OB = "ob AS (SELECT l_shipdate::DATE AS date, avg(l_quantity) FILTER (l_returnflag = 'A') AS t2m_obs, avg(l_extendedprice) FILTER (l_returnflag = 'R') AS spfh_obs, avg(l_discount) FILTER (l_returnflag = 'N') AS precip_obs FROM lineitem WHERE l_returnflag IN ('A', 'R', 'N') GROUP BY 1)"
_SD = "(dayofyear({0}) - CASE WHEN ((year({0}) % 4 = 0 AND year({0}) % 100 <> 0) OR year({0}) % 400 = 0) AND dayofyear({0}) >= 60 THEN 1 ELSE 0 END)"
_DT = "strftime({0}, '%Y-%m-%d') AS {0}"
_PV = _FC + ", pv AS (SELECT decision_date, " + ", ".join(f"max({v}) FILTER (lead_day = {x}) AS {v}_l{x}" for v in ("v", "w") for x in LEADS) + " FROM fc GROUP BY 1)"
_RAD = math.pi / 180
ORACLE = {
    "forecast_long": f"WITH {_FC} SELECT {_DT.format('decision_date')}, lead_day, round(v, 6) AS v, round(w, 6) AS w, n FROM fc",
    "observed_outer": f"WITH {_OB} SELECT {_DT.format('date')}, round(t2m_obs, 6) AS t2m_obs, round(spfh_obs, 6) AS spfh_obs, round(precip_obs, 6) AS precip_obs FROM ob",
    "season_days": f"WITH q AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders) SELECT {_DT.format('date')}, {_SD.format('date')} AS season_day, least(abs({_SD.format('date')} - 10), 365 - abs({_SD.format('date')} - 10)) AS off FROM q",
    "climatology": f"WITH {_FC}, k AS (SELECT *, {_SD.format('decision_date')} AS sd FROM fc), c AS (SELECT a.decision_date, a.lead_day, count(b.v) AS climo_n, avg(b.v) AS m, stddev_samp(b.v) AS s FROM k a LEFT JOIN k b ON a.lead_day = b.lead_day AND b.decision_date < a.decision_date AND least(abs(a.sd - b.sd), 365 - abs(a.sd - b.sd)) <= 5 GROUP BY 1, 2) "
    f"SELECT strftime(f.decision_date, '%Y-%m-%d') AS decision_date, f.lead_day, round(v, 6) AS v, round(w, 6) AS w, n, climo_n, CASE WHEN climo_n >= 5 THEN round(m, 6) END AS climo_mean, CASE WHEN climo_n >= 5 THEN round(s, 6) END AS climo_std, CASE WHEN climo_n >= 5 THEN round(v - m, 6) END AS anomaly, CASE WHEN climo_n >= 5 AND s > 0 THEN round((v - m) / s, 6) END AS z FROM fc f JOIN c USING (decision_date, lead_day)",
    "lead_pivot": f"WITH {_PV} SELECT {_DT.format('decision_date')}, " + ", ".join(f"round({v}_l{x}, 6) AS {v}_l{x}" for v in ("v", "w") for x in LEADS) + " FROM pv",
    "lead_means": f"WITH {_PV}, q AS (SELECT decision_date, list_avg(list_filter([{', '.join(f'v_l{x}' for x in LEADS)}], lambda x: x IS NOT NULL)) AS m, len(list_filter([{', '.join(f'v_l{x}' for x in LEADS)}], lambda x: x IS NOT NULL)) / 4.0 AS c FROM pv) SELECT {_DT.format('decision_date')}, round(m, 6) AS mean_v, c AS coverage FROM q WHERE c >= 0.5",
    "heat_dryness": f"WITH {_PV}, {_OB}, q AS (SELECT pv.*, t2m_obs AS h0, precip_obs AS p0 FROM pv LEFT JOIN ob ON date = decision_date) SELECT {_DT.format('decision_date')}, " + ", ".join(f"round(v_l{x}, 6) AS heat_l{x}, round(-w_l{x}, 6) AS dryness_l{x}, round(v_l{x} * -w_l{x}, 6) AS heat_x_dryness_l{x}, round(v_l{x} - h0, 6) AS heat_change_l{x}, round(-w_l{x} + p0, 6) AS dryness_change_l{x}, round((v_l{x} - h0) * (-w_l{x} + p0), 6) AS projected_heat_x_dryness_l{x}" for x in LEADS) + " FROM q",
    "area_weighted": f"WITH q AS (SELECT c_mktsegment, CASE WHEN c_acctbal > -900 THEN c_acctbal END AS x, cos((c_nationkey + 25.0) * {_RAD}) * greatest(least(c_nationkey + 25.5, 45.75) - greatest(c_nationkey + 24.5, 27.25), 0) AS w FROM customer WHERE c_nationkey + 25 BETWEEN 27 AND 49 AND ((c_custkey * 7) % 360 >= 256 OR (c_custkey * 7) % 360 <= 30)), k AS (SELECT c_mktsegment, sum(w * x) / sum(w) AS m, sum(w * x * x) / sum(w) AS q2, count(*) AS n_valid FROM q WHERE x IS NOT NULL AND w > 0 GROUP BY 1) SELECT c_mktsegment, round(m, 4) AS mean, round(sqrt(greatest(q2 - m * m, 0)), 4) AS std, n_valid FROM k",
    "lead_coverage": f"WITH {_FC}, g AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS valid_date FROM (SELECT min(l_shipdate)::DATE AS lo, max(l_shipdate)::DATE AS hi FROM lineitem)), c AS (SELECT valid_date, l.lead_day FROM g, (SELECT unnest({LEADS}) AS lead_day) l) SELECT c.lead_day, count(*) AS expected, count(v) AS there, round(avg(v), 6) AS mean_v FROM c LEFT JOIN fc ON fc.lead_day = c.lead_day AND fc.decision_date = c.valid_date - c.lead_day GROUP BY 1",
}
