from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheaf.operators.as_known import KnownState, as_known, utc_day
from sheaf.operators.rolling import over_windows, trailing_totals

VERSION = "who string, day int, a int, id long, event_id string"


def known(spark, events, versions, loads=1, path=None):
    e = spark.createDataFrame(events, "n long, who string, at timestamp, entity string").withColumn("period", F.lit("clash"))
    v = spark.createDataFrame(versions, VERSION)
    last = e.agg(F.max(utc_day(F.col("at")))).first()[0]
    state = KnownState(spark, path, 7)
    for k in range(loads):
        # the state reaches further from load to load, and is taken up anew
        reach = None if last is None else last * (k + 1) // loads
        state.extend(v.filter(F.pmod("id", F.lit(loads)) == k), "who", "day", [F.col("a"), -F.col("id")], F.col("id"), reach)
        state = KnownState.open(spark, state.path)
    out = sorted((r.n, r.got) for r in as_known(e, "n", "who", utc_day(F.col("at")), state, "got").collect())
    state.drop()
    return out


def test_as_known_against_brute_force(spark):
    rng = np.random.default_rng(5)
    versions = [(f"e{rng.integers(4) if rng.random() < 0.6 else 0}", int(rng.integers(0, 90)) if rng.random() < 0.95 else None, int(rng.integers(6)) if rng.random() < 0.9 else None, i, None) for i in range(150)]
    events = [(i, f"e{rng.integers(5)}" if rng.random() < 0.9 else None, datetime(1970, 1, 1) + timedelta(hours=int(rng.integers(-100, 2600))) if rng.random() < 0.9 else None, None) for i in range(300)]
    want = []
    for n, who, at, _ in events:
        if who is not None and at is not None:
            seen = [v for v in versions if v[0] == who and v[1] is not None and v[1] <= (at - datetime(1970, 1, 1)).days]
            if seen:
                want.append((n, max(seen, key=lambda v: (-1 if v[2] is None else v[2], -v[3]))[3]))
    assert known(spark, events, versions) == sorted(want)
    assert known(spark, events, versions, 3) == sorted(want)


def test_state_before_any_event(spark):
    v = spark.createDataFrame([("x", 3, 1, 1, None), ("x", 30, 2, 2, None)], VERSION)
    ask = lambda s: s.extend(v.limit(0), "who", "day", [F.col("a")], F.col("id"), 40)
    state = ask(KnownState(spark, None, 7).extend(v, "who", "day", [F.col("a")], F.col("id"), None))
    e = spark.createDataFrame([(1, "x", 2), (2, "x", 8), (3, "x", 40)], "n long, who string, day int")
    assert sorted((r.n, r.got) for r in as_known(e, "n", "who", F.col("day"), state, "got").collect()) == [(2, 1), (3, 2)]


def test_as_known_edges(spark):
    noon = datetime(1970, 1, 11, 12)
    assert known(spark, [], []) == [] == known(spark, [(1, "x", noon, None)], [])
    same = [("x", 10, 1, 7, None)] * 3
    assert known(spark, [(1, "x", noon, None), (1, "x", noon, None), (2, "x", datetime(1970, 1, 10), None)], same) == [(1, 7), (1, 7)]
    assert known(spark, [(1, "x", datetime(1971, 1, 1), None)], same) == [(1, 7)]  # long after the last change


@pytest.mark.parametrize("op,identity", [(np.add, 0.0), (np.maximum, -np.inf), (np.minimum, np.inf)])
@pytest.mark.parametrize("n,width", [(0, 3), (1, 1), (5, 7), (50, 7), (64, 30), (31, 1)])
def test_two_stack(op, identity, n, width):
    v = np.random.default_rng(n).normal(size=(3, n))
    want = np.array([[op.reduce(x[max(0, i - width + 1) : i + 1]) for i in range(n)] for x in v]).reshape(3, n)
    assert np.allclose(over_windows(v, width, op, identity), want)


def test_any_associative_operation():
    """The last value pushed that isn't 0: neither commutative nor invertible."""
    last = lambda a, b: np.where(b != 0, b, a)
    v = np.array([[1, 0, 0, 2, 0, 0, 0, 3.0]])
    assert over_windows(v, 3, last, 0.0).tolist() == [[1, 1, 1, 2, 2, 2, 0, 3]]


def test_long_windows(spark):
    rows = [("e", date(2015, 1, 1) + timedelta(days=i), i) for i in range(0, 2000, 3)]
    got = trailing_totals(spark.createDataFrame(rows, "e string, d date, v long"), "e", "d", ["v"], ["v"], [900], ("sum", "avg")).toPandas().sort_values("d")
    want = [sum(v for v in range(0, 2000, 3) if i - 900 < v <= i) for i in range(len(got))]
    assert got.v_sum_900.tolist() == want and "v_n_900" not in got


def test_trailing_totals(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if rng.random() < 0.5 else f"s{rng.integers(3)}", date(2020, 1, 1) + timedelta(days=int(rng.integers(1500))), int(rng.integers(100)) if rng.random() < 0.9 else None, float(rng.normal()) if rng.random() < 0.8 else None, i // 2, i) for i in range(900)]
    rows += [(None, date(2020, 1, 1), 1, 1.0, 1, 1), ("x", None, 1, 1.0, 1, 1), ("one", date(1969, 12, 30), None, float("nan"), 1, 1)] + rows[:20]
    df = spark.createDataFrame(rows, "entity string, day date, v int, x double, seen int, id int").withColumn("chunk", F.lit("clash"))
    got = trailing_totals(df, "entity", "day", ["seen", "id"], ["v", "x"], [7, 30]).toPandas().sort_values(["entity", "day"]).reset_index(drop=True)
    assert "clash" not in got.astype(str).to_numpy()
    bars = pd.DataFrame(rows, columns=["entity", "day", "v", "x", "seen", "id"]).dropna(subset=["entity", "day"]).sort_values(["seen", "id"]).drop_duplicates(["entity", "day"], keep="last")
    want = []
    for k, g in bars.groupby("entity"):
        g = g.set_index(pd.to_datetime(g.day)).sort_index()
        g = g.reindex(pd.date_range(g.index[0], g.index[-1]))
        w = pd.DataFrame({"entity": k, "day": g.index.date, "v_sum_7": g.v.rolling(7, min_periods=1).sum().fillna(0), "x_avg_30": g.x.rolling(30, min_periods=1).mean(), "x_max_7": g.x.rolling(7, min_periods=1).max(), "v_n_30": g.v.rolling(30, min_periods=1).count()})
        want.append(w)
    want = pd.concat(want).sort_values(["entity", "day"]).reset_index(drop=True)
    assert len(got) == len(want) and (got.day == want.day).all()
    for c in ["v_sum_7", "x_avg_30", "x_max_7", "v_n_30"]:
        assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True), c
    assert trailing_totals(df.limit(0), "entity", "day", ["seen"], ["v"], [7]).count() == 0
