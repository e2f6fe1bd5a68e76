import math
from datetime import date, datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheaf.functions import bulletin as BU
from sheaf.functions import text as X
from sheaf.functions.calendar import friday, in_month_day_window, season_day
from sheaf.operators import backtest as B
from sheaf.operators import climate as C
from sheaf.operators import folds as V
from sheaf.operators import news as N
from sheaf.operators import panel as P
from sheaf.operators import series as S
from sheaf.operators.boosting import boosted
from sheaf.plans import bulletins as Q
from sheaf.plans import models as M
from sheaf.sources import tables as T
from sheaf.sources.demo import week_anomaly
from sheaf.sources.html import anchors, last_page

CLOSES = [20.0, 21.0, 19.0, 22.5, 23.0, 22.0, 24.0, 25.0, 23.5, 26.0, 27.5, 26.5, 28.0, 30.0]


def weeks(spark, closes=CLOSES):
    return spark.createDataFrame([("a", date(2022, 3, 4) + timedelta(weeks=i), float(c), 5000 + i) for i, c in enumerate(closes)], "series string, date date, close double, volume long")


def test_weekly_labels(spark):
    rows = S.weekly_features(S.weekly_bars(weeks(spark))).orderBy("week").collect()
    logs = [math.log(b / a) for a, b in zip(CLOSES, CLOSES[1:], strict=False)]
    assert [r.target_log_return_next for r in rows[:-1]] == pytest.approx(logs) and rows[-1].target_log_return_next is None
    assert [r.target_up_next for r in rows[:4]] == [1, 0, 1, 1]
    assert rows[3].price_lag_return_1w == pytest.approx(logs[1]) and rows[5].price_lag_return_4w == pytest.approx(logs[0])
    assert rows[3].price_rolling_vol_4w is None and rows[4].price_rolling_vol_4w == pytest.approx(np.std(logs[:4], ddof=1))


def test_horizon(spark):
    returns = [0.005, -0.015, 0.025, 0.035, -0.045, 0.0]
    df = spark.createDataFrame([("a", date(2022, 3, 4) + timedelta(weeks=i), r) for i, r in enumerate(returns)], "series string, week date, price_log_return double")
    rows = S.horizon_targets(df, 3).orderBy("week").collect()
    assert rows[1].target_return == pytest.approx(sum(returns[2:5])) and rows[1].target_vol == pytest.approx(math.sqrt(sum(r * r for r in returns[2:5])))
    assert rows[3].target_return is None


def test_classes_and_positions(spark):
    x = spark.createDataFrame([(v,) for v in (-0.31, -0.3, -0.1, 0.29, 0.3, None)], "v double")
    assert [r[0] for r in x.select(S.band_class(F.col("v"), 0.3)).collect()] == [-1, -1, 0, 0, 1, None]
    assert [r[0] for r in x.select(S.scaled_class(F.col("v"), F.lit(0.6), 0.5)).collect()] == [-1, 0, 0, 0, 0, None]
    p = spark.createDataFrame([(v,) for v in (0.1, 0.3, 0.61, 0.6)], "p double")
    assert [r[0] for r in p.select(B.position_from_probability(F.col("p"), 0.6, 0.3)).collect()] == [-1, -1, 1, 1]
    assert p.select(B.position_from_classes(F.lit(0.8), F.lit(0.7), 0.6, 0.6)).first()[0] == -1


def test_backtest(spark):
    df = spark.createDataFrame([("m", i, p, r) for i, (p, r) in enumerate([(0.0, 0.5), (-1.0, -0.02), (1.0, 0.03), (1.0, None)])], "model string, week int, position double, r double")
    rows = B.strategy(df, "position", "r", ["model"], "week", 20).orderBy("week").collect()
    assert [r.turnover for r in rows] == [0, 1, 2, 0] and [r.strategy_log_return for r in rows] == pytest.approx([0, 0.018, 0.026, 0])
    s = B.weekly_summary(B.strategy(df, "position", "r", ["model"], "week", 20), ["model"], "r", "position").first()
    assert s.total_return == pytest.approx(math.exp(0.044) - 1) and s.n_traded == 3 and s.max_drawdown == 0
    lost = spark.createDataFrame([("m", i, r, 1.0, 0.0) for i, r in enumerate([0.1, -1.0, 0.5])], "m string, day int, r double, p double, t double")
    d = B.daily_summary(lost, ["m"], "r", "day", "p", "t").first()
    assert d.total_return == -1 and d.max_drawdown == -1 and d.cash_share == 0


def test_class_metrics(spark):
    df = spark.createDataFrame([("m", y, p) for y, p in [(-1, -1), (-1, 0), (0, 0), (0, 0), (None, 1)]], "m string, y int, p int")
    r = B.class_metrics(df, ["m"], "y", "p", [-1, 0, 1]).first()
    assert r.accuracy == 0.75 and r.balanced_accuracy_present == 0.75 and r.recall_1 is None and r.n_1 == 0 and r.event_rate == 0.5 and not r.has_both_ends
    assert r.macro_f1 == pytest.approx((2 / 3 + 4 / 5 + 0) / 3)
    assert {(x.y, x.n) for x in P.label_counts(df.filter("y is not null"), ["m"], "y", [-1, 0, 1]).collect()} == {(-1, 2), (0, 2), (1, 0)}
    assert B.class_metrics(df.limit(0), ["m"], "y", "p", [-1, 0, 1]).count() == 0


def test_calendar(spark):
    days = pd.date_range("1999-11-01", "2004-03-31")
    df = spark.createDataFrame([(d.date(),) for d in days], "d date")
    rows = df.select("d", friday(F.col("d")).alias("f"), season_day(F.col("d")).alias("s"), in_month_day_window(F.col("d"), (12, 1), (2, 10)).alias("w")).collect()
    for r in rows:
        assert r.f.weekday() == 4 and 0 <= (r.f - r.d).days < 7
        assert r.s == (r.d.replace(year=2001, day=28 if (r.d.month, r.d.day) == (2, 29) else r.d.day) - date(2001, 1, 1)).days + 1
        assert r.w == ((r.d.month, r.d.day) >= (12, 1) or (r.d.month, r.d.day) <= (2, 10))


def test_climatology_against_loop(spark):
    rng = np.random.default_rng(0)
    rows = [(1 + i % 2, date(2000, 1, 1) + timedelta(days=int(rng.integers(0, 1500))), float(rng.normal()) if rng.random() < 0.9 else None) for i in range(300)]
    got = C.climatology(spark.createDataFrame(rows, "lead int, day date, x double"), ["lead"], "day", "x", 10, 3).collect()
    sd = lambda d: (d.replace(year=2001, day=28 if (d.month, d.day) == (2, 29) else d.day) - date(2001, 1, 1)).days + 1
    for r in got:
        v = [x for lead, d, x in rows if lead == r.lead and x is not None and d < r.day and min(abs(sd(d) - sd(r.day)), 365 - abs(sd(d) - sd(r.day))) <= 5]
        assert r.climo_n == len(v)
        assert (r.climo_mean is None) == (len(v) < 3) and (len(v) < 3 or r.climo_mean == pytest.approx(np.mean(v)))
        assert r.climo_std is None or r.climo_std == pytest.approx(np.std(v, ddof=1), abs=1e-6)


def test_folds_and_models(spark):
    rng = np.random.default_rng(1)
    rows = [("a", date(2020, 1, 3) + timedelta(weeks=i), float(rng.normal()), None if i % 9 == 0 else float(rng.normal())) for i in range(90)]
    rows = [(s, w, x, z, 0.5 * x + 0.1 * rng.normal()) for s, w, x, z in rows]
    df = spark.createDataFrame(rows, "series string, week date, x double, z double, y double")
    folds = V.fold_table(df, "week", "2020-12-31", 13, 13)
    met = V.assigned(df, folds, "week")
    ends = met.groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("week"))).alias("a"), F.min(F.when(F.col("role") == "test", F.col("week"))).alias("b"), F.count_if(F.col("role") == "train").alias("n")).orderBy("fold").collect()
    assert len(ends) == 3 and all(r.a < r.b for r in ends) and ends[0].n < ends[1].n
    df = df.withColumn("up", (F.col("y") > 0).cast("int")).withColumn("note", F.when(F.col("up") == 1, "good rain fell").otherwise("hail"))
    models = [V.Model("ridge", ("x", "z"), "y"), V.Model("grid", ("x", "z"), "y", alpha=None), V.Model("up", ("x",), "up", "logit", classes=(0, 1)), V.Model("tree", ("x", "z"), "y", "boosted"), V.Model("tree_up", ("x",), "up", "boosted_up"), V.Model("text", (), "up", "logit", classes=(0, 1), text="note")]
    out = V.walk_forward(df, ["series"], models, "week", folds).toPandas()
    of = {m: out[out.model == m] for m in out.model.unique()}
    assert set(of) == {m.name for m in models} and {len(x) for x in of.values()} == {len(out) // len(models)}
    assert min(np.corrcoef(of[m].y_true, of[m].y_pred)[0, 1] for m in ("ridge", "grid", "tree")) > 0.8
    assert min(((of[m].y_pred > 0.5) == (of[m].y_true > 0)).mean() for m in ("up", "tree_up", "text")) > 0.8
    assert of["grid"].alpha.notna().all() and of["tree"].alpha.isna().all()
    with pytest.raises(Exception, match="repeated key"):
        V.walk_forward(df.unionByName(df), ["series"], models[:1], "week", folds).collect()
    years = V.walk_forward(df, ["series"], models[:1], "week", V.year_folds(df, "week")).toPandas()
    assert set(years.fold) == {2021} and years.n_train.iloc[0] == 52
    x, y = rng.normal(size=(50, 3)), rng.normal(size=50)
    a = np.hstack([np.ones((50, 1)), x])
    assert np.allclose(V.ridge(x, y, 2.0)(x), a @ np.linalg.solve(a.T @ a + 2 * np.diag([0, 1, 1, 1]), a.T @ y))
    assert V.fold_table(df.limit(0), "week", "2020-12-31").count() == 0
    far = spark.createDataFrame([(date(1900, 1, 5),), (date(2400, 1, 5),)], "week date")
    assert V.fold_table(far, "week", "1899-01-01", 1, 1).count() == (date(2400, 1, 5) - date(1900, 1, 5)).days // 7 + 1


def test_leading_terms_of_sets_of_dates():
    rng = np.random.default_rng(5)
    dates, names = 11, [f"t{k:03d}" for k in rng.permutation(900)]
    counts = rng.poisson(1.5 / (1 + np.arange(900) / 20)[:, None] * rng.random((900, dates)))
    k, at = np.nonzero(counts)
    masks = rng.random((40, dates)) < 0.4
    masks[0], masks[1] = False, True
    keep = V._leading(np.array(names, dtype=object)[k], at, counts[k, at], np.packbits(masks, axis=1), dates, 7)
    want = set()
    for m in masks:
        total = counts[:, m].sum(axis=1)
        want |= {t for n, t in sorted((-n, t) for n, t in zip(total, names, strict=True) if n)[:7]}
    assert {names[j] for j in k[keep]} == want and set(k[keep]).isdisjoint(k[~keep])


def test_shared_texts_as_in_a_column(spark):
    rng = np.random.default_rng(6)
    weeks = [date(2020, 1, 3) + timedelta(weeks=i) for i in range(60)]
    words = [f"w{k}" for k in range(60)]
    said = {w: " ".join(rng.choice(words, 25, p=np.arange(60, 0, -1) / 1830)) for w in weeks if w.day != 3}
    # series with different weeks lead to different terms
    rows = [(f"s{k}", w, float(rng.normal()), int(rng.random() < 0.5), said.get(w, "")) for k in range(6) for i, w in enumerate(weeks) if (i + k) % (k + 2)]
    full = spark.createDataFrame(rows, "series string, week date, x double, up int, note string")
    texts = spark.createDataFrame(list(said.items()), "week date, note string")
    folds = V.fold_table(full, "week", "2020-09-30", 13, 13)
    models = [V.Model("text", ("x",), "up", "logit", classes=(0, 1), text="note", terms=5), V.Model("plain", ("x",), "up", "logit", classes=(0, 1))]
    by = ["series", "fold", "model", "week"]
    want = V.walk_forward(full, ["series"], models, "week", folds).toPandas().sort_values(by, ignore_index=True)
    got = V.walk_forward(full.drop("note"), ["series"], models, "week", folds, texts=texts).toPandas().sort_values(by, ignore_index=True)
    assert len(want) and want[by].equals(got[by]) and np.allclose(want.y_pred, got.y_pred, rtol=0, atol=1e-12)
    none = V.walk_forward(full.drop("note"), ["series"], models, "week", folds, texts=texts.limit(0)).toPandas()
    assert len(none) == len(want)


def test_a_weeks_text_is_not_copied_to_each_series(spark, monkeypatch):
    written = {}

    def kept(df, name, scratch=None):
        written[name] = df.columns
        return df

    monkeypatch.setattr(M, "stored", kept)
    M.direction_models(spark, "/root/testdata/sf0.001")
    assert "report_text" not in written["panel"]


def test_week_anomalies_are_summed_in_the_order_of_arrival(spark, tmp_path):
    # 0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 differ in the last bit
    closes = [(1, 3, 0.1), (2, 2, 0.2), (3, 5, 0.3), (4, 4, 0.7), (5, 1, 0.6)]
    for turn in (1, -1):
        rows = [(k * turn, "a", date(2023, 3, 5 + day), 1.0, c, 10, datetime(2023, 4, 1)) for k, day, c in closes]
        # a later correction leaves the day where it came first
        rows.append((9, "a", date(2023, 3, 5 + 4), 1.0, 0.9, 10, datetime(2023, 5, 1)))
        d = str(tmp_path / f"d{turn}")
        spark.createDataFrame(rows, "bar_id long, symbol string, date date, open double, close double, volume long, loaded_at timestamp").repartition(3).write.parquet(f"{d}/daily_prices.parquet")
        total = 0.0
        for c in [0.1, 0.2, 0.3, 0.9, 0.6][::turn]:
            total += c
        x = Q.bars(spark, d).join(spark.createDataFrame([(date(2023, 3, 5 + day), k * turn) for k, day, _ in closes], "date date, came long"), "date")
        got = {r.date.day - 5: r.a for r in x.select("date", week_anomaly(x, "close", "date", ["series"], "came").alias("a")).collect()}
        assert got == {day: (0.9 if day == 4 else c) - total / 5 for _, day, c in closes}
        assert {r.anomaly for r in Q.anomalies(spark, d).collect()} == {round(v, 6) for v in got.values()}


def test_week_anomalies_as_sql_on_one_thread(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute("SET threads=1")
    con.execute(f"CREATE VIEW daily_prices AS SELECT * FROM '{d}/daily_prices.parquet'")
    want = con.execute(Q.ORACLE["week_anomalies"]).fetchall()
    assert sorted(map(tuple, Q.anomalies(spark, d).collect())) == sorted(want)


def test_boosting_beats_the_mean():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4))
    y = np.where(x[:, 0] > 0.3, 2.0, -1.0) * (x[:, 1] > 0) + 0.1 * rng.normal(size=600)
    got = boosted(x[:400], y[:400])(x[400:])
    assert np.mean((got - y[400:]) ** 2) < 0.15 * np.var(y[400:])
    p = boosted(x[:400], (y[:400] > 0.5).astype(float), classes=True)(x[400:])
    assert ((p > 0.5) == (y[400:] > 0.5)).mean() > 0.9 and p.min() >= 0 and p.max() <= 1
    assert np.allclose(boosted(np.zeros((50, 0)), y[:50])(np.zeros((3, 0))), y[:50].mean())
    assert np.allclose(boosted(np.ones((50, 2)), y[:50])(np.ones((3, 2))), y[:50].mean())
    # with 30 rows a leaf and one cut the two sides' means are approached
    step = np.repeat([0.0, 1.0], 30)[:, None]
    assert np.allclose(boosted(step, step[:, 0] * 4)(np.array([[0.0], [1.0]])), [0, 4], atol=0.05)


def test_feature_sets():
    columns = ["week", "price_log_close", "price_log_return", "text_kw_rain", "report_count", "report_text", "ai_x", "weather_y"]
    assert P.feature_set(columns, "price_only") == (["price_log_return"], None)
    assert P.feature_set(columns, "price_calendar_weather_text_ai") == (["price_log_return", "weather_y", "report_count", "text_kw_rain", "ai_x"], "report_text")
    with pytest.raises(ValueError, match="unknown feature set"):
        P.feature_set(columns, "x")
    own = ["price_vol_5d", "month", *[f"weather_{n}_l7" for n in ("heat_forecast_z", "dryness_forecast_z", "heat_x_dryness", "heat_projected_change", "dryness_projected_change", "projected_heat_x_dryness")]]
    sets = P.lead_sets(own, 7)
    assert [len(x) for x in sets.values()] == [2, 5, 8] and list(sets)[0] == "lead07_price_calendar"
    with pytest.raises(KeyError):
        P.lead_sets(own[:-1], 7)
    assert P.threshold_key(0.5, "a") == "k_0.5_a" and P.threshold_key(1.0, "a") == "k_1_a" and len(P.configurations(a=[1, 2], b=[3, 4, 5])) == 6


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.keyword_count(F.lit("Yield yield yields, rain"), "yield")) == 2
    assert one(X.slug_title(F.lit("https://h.example/2024/corn-prices_rise-again.html?x=1"))) == "corn prices rise again" and one(X.slug_title(F.lit("https://h.example/a"))) is None
    ends = {"Corn  up 20240506 00012": "Corn up", "Corn up 2024 05 06": "Corn up", "Corn up idUSL5N1ABC": "Corn up", "Corn up 123456": "Corn up", "Corn up 12345": "Corn up 12345", "Record corn bids": "Record corn bids", "Rain brings refuge": "Rain brings refuge", "A%20b &amp; %C3%A9": "A b & é"}
    assert {k: one(X.clean_headline(F.lit(k))) for k in ends} == ends and one(X.clean_headline(F.lit(None).cast("string"))) is None
    assert one(X.page_title(F.lit("<A/><PAGE_TITLE> Up &lt; down\n</PAGE_TITLE>"))) == "Up < down" and one(X.page_title(F.lit("none"))) is None
    assert one(X.any_word(F.lit("a c.rn b"), ["c.rn"])) and not one(X.any_word(F.lit("a corn b"), ["c.rn"])) and not one(X.any_word(F.lit("a"), []))
    assert one(X.report_text(F.lit(None).cast("string"), F.lit("x  y"), F.lit(""))) == "[WEATHER HIGHLIGHTS]\n\n[CORN SECTION]\nx y\n\n[CORN PROGRESS TABLE]"
    scores = {k: one(c) for k, c in X.rule_scores(F.lit("Planting ran behind after wet weeks, harvest was fine, good to excellent above last year")).items()}
    assert [k for k, v in scores.items() if v == 1] == ["ai_excess_rain_risk", "ai_planting_delay_risk", "ai_harvest_delay_risk"] and scores["ai_crop_condition_trend"] == -1
    assert one(X.prompt("{a}: {b}.", {"a": F.lit(1), "b": F.lit(None).cast("string")})) == "1: ."
    assert one(X.reply_text(F.lit('{"output": [{"content": [{"type": "output_text", "text": "a"}, {"type": "b", "text": "c"}]}, {}]}'))) == "a" and one(X.reply_text(F.lit("{}"))) is None
    assert one(X.check_scores(F.lit('{"answer": {"ai_a": 2, "b": 1}}'), {"ai_a": (0, 3)}, "ai_"))["ai_a"] == 2
    for bad in ('{"ai_a": 4}', "{}", '{"ai_a": 1, "ai_b": 1}'):
        with pytest.raises(Exception, match="ai_a"):
            spark.range(1).select(X.check_scores(F.lit(bad), {"ai_a": (0, 3)}, "ai_")["ai_a"]).collect()
    assert one(X.json_object(F.lit('x ```json\n{"a": 1}\n``` y'))) == '{"a": 1}'
    assert one(X.shortened(F.lit("a" * 100), 10)) == "a" * 10 + "\n\n[TRUNCATED]" and one(X.shortened(F.lit("abc"), 0)) == "abc"
    assert one(X.normal_space(F.lit(" a \tb \r\n\n\n\n c "))) == "a b\n\nc"
    assert one(last_page(F.lit('<a href="?page=2">2</a><a href="/l?x=1&page=289">'))) == 289 and one(last_page(F.lit("none"))) == 0
    page = spark.createDataFrame([(1, '<a href="/x.pdf">A &amp;  B</a><a href="/x.pdf">again</a><a href="y.txt">c</a><a>none</a>'), (2, None)], "page long, html string")
    assert [(r.url, r.label) for r in anchors(page, "page", "html", "https://h.example/l/", ".pdf").collect()] == [("https://h.example/x.pdf", "A & B")]


def test_sources_and_sinks(spark, tmp_path):
    p = str(tmp_path / "t.parquet")
    df = spark.createDataFrame([("2024-01-05", 1.5), ("bad", 2.5)], "week string, x double")
    assert not T.table_exists(spark, p)
    T.write_csv(df, str(tmp_path / "t.csv"))
    assert T.table_exists(spark, p) and [r.week for r in T.read_table(spark, p, "week string, x double").orderBy("x").collect()] == [date(2024, 1, 5), None]
    T.write_table(df, p)
    T.write_json(df, str(tmp_path / "j"))
    assert T.read_table(spark, p).count() == 2 == spark.read.json(str(tmp_path / "j")).count()
    m, root = spark.createDataFrame([(date(2024, 1, 5), 1), (date(2024, 2, 5), 2)], "d date, v int"), str(tmp_path / "m")
    T.write_months(m, root, "d")
    T.write_months(m.withColumn("v", F.col("v") + 10).unionByName(spark.createDataFrame([(date(2024, 3, 1), 3)], m.schema)), root, "d")
    assert sorted(r.v for r in T.read_months(spark, root).collect()) == [1, 2, 3]
    pd.DataFrame({"Date": ["2024-01-02 00:00:00", "x", "2024-01-01"], "Adj Close": ["1.5", "2", "z"]}).to_csv(tmp_path / "p.csv", index=False)
    assert [(r.date, r.close) for r in T.read_price_csv(spark, str(tmp_path / "p.csv")).collect()] == [(date(2024, 1, 2), 1.5)]


def test_more_sources(spark, tmp_path):
    p = str(tmp_path / "t.parquet")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert T.replace_with_backup(df, p) is None
    with pytest.raises(FileExistsError):
        T.replace_with_backup(df, p)
    kept = T.replace_with_backup(spark.read.parquet(p).filter("k = 1"), p, overwrite=True)
    assert spark.read.parquet(p).count() == 1 and spark.read.parquet(kept).count() == 2
    assert T.append_missing(df, p, ["k"], lambda x: x) == 1 and T.append_missing(df, p, ["k"], lambda x: x) == 0 and spark.read.parquet(p).count() == 2
    T.save_metrics(spark, str(tmp_path / "m.json"), {"a": float("nan"), "b": 1})
    assert T.load_metrics(spark, str(tmp_path / "m.json"))["b"] == 1
    meta = T.run_metadata(spark, {"in": p}, {"alpha": 1}, {"out": df})
    assert meta["results"]["out"] == {"rows": 2, "columns": ["k", "v"]}
    for n in ("b.pdf", "a.pdf", "c.txt"):
        (tmp_path / "f").mkdir(exist_ok=True)
        (tmp_path / "f" / n).write_bytes(b"x")
    assert [r.path[-5:] for r in T.find_files(spark, str(tmp_path / "f")).collect()] == ["a.pdf", "b.pdf"] and T.find_files(spark, str(tmp_path / "f" / "a.pdf")).count() == 1
    raw = spark.createDataFrame([("2024-01-03", 1.5, 7), ("2024-01-02", 2.5, 8), ("2024-01-04", None, 9)], "Date string, Close double, Volume long")
    bars = T.normal_bars(raw).collect()
    assert [(r.close, r.adj_close, r.volume, r.open) for r in bars] == [(2.5, 2.5, 8, None), (1.5, 1.5, 7, None)]
    with pytest.raises(ValueError):
        T.normal_bars(raw.drop("Date"))
    raw.write.parquet(str(tmp_path / "bars.parquet"))
    assert T.load_prices(spark, str(tmp_path / "bars.parquet"), "2024-01-03", "2024-01-09").count() == 1
    assert T.load_prices(spark, "", "2024-01-01", "2024-01-31", demo=True).count() == 23
    with pytest.raises(FileNotFoundError):
        T.load_prices(spark, str(tmp_path / "none.parquet"), "2024-01-01", "2024-01-31")


def test_bulletin(spark):
    text = "MAY 5, 2026\nMay 5, 2026   Weekly Weather and Crop Bulletin   1\nMay 1 – 2, 2026\nA \nRain fell.      Inside\nMore of it.\n(Continued on page 3)\f\f3 Weekly Weather and Crop Bulletin May 5, 2026\n(continued from Front Cover) dry later\nAs the week began\fWeekly National Agricultural Summary provided by x\nHIGHLIGHTS\nWarm.\nCorn: up   right\nEmerged by May.\n9 behind the 5-year average.\nnot this\n\fCorn Percent Planted\n a   1\nSoybeans percent planted"
    x = spark.createDataFrame([(text,), (None,), ("",), ("A\n" * 20_000,)], "t string")
    t = F.col("t")
    rows = x.select(BU.report_date(t).alias("d"), BU.week_ending(t).alias("w"), BU.weather_highlights(t).alias("h"), BU.national_summary(t).alias("n"), BU.crop_column(t).alias("c"), BU.crop_paragraph(BU.national_summary(t)).alias("p"), BU.crop_table(t).alias("b")).collect()
    r = rows[0]
    assert (r.d, r.w) == (date(2026, 5, 5), date(2026, 5, 2)) and r.h == "Rain fell.\nMore of it.\n\ndry later"
    assert r.c == "Corn: up\nEmerged by May.\n9 behind the 5-year average." and r.p.startswith("Corn: up right") and r.b == "Corn Percent Planted\na 1" and r.n.startswith("Warm.")
    assert all((y.d, y.w, y.h, y.n, y.c, y.p, y.b) == (None, None, "", "", "", "", "") for y in rows[1:])
    days = {"Sept. 5, 2023": date(2023, 9, 5), "on Jan 3 2024 txt": date(2024, 1, 3), "February 30, 2024": None, "Foo 3, 2024": None}
    one = lambda c: spark.range(1).select(c).first()[0]
    assert {k: one(BU.label_date(F.lit(k))) for k in days} == days and one(BU.label_date(F.lit("none"), F.lit("x March 4, 2022"))) == date(2022, 3, 4)


def test_news_rows(spark):
    rows = [('{"articles": [{"title": " T ", "url": "u", "seendate": "20240105T101500Z"}, {"title": "", "url": "x"}, {"title": "b", "url": "c", "date": "bad"}]}',), ('{"results": [], "data": [{"title": "T", "url": "u", "datetime": "2024-02-01"}]}',), ("broken",), (None,)]
    out = N.article_rows(spark.createDataFrame(rows, "reply string").withColumn("q", F.lit("q")), "reply", "q").collect()
    assert len(out) == 1 and out[0].title == "T" and out[0].week in (date(2024, 1, 5), date(2024, 2, 2))
    pages = spark.createDataFrame([("Corn futures up", "u1", "", "Iowa, United States"), ("Cornell farm news", "u2", "crop", "Iowa"), ("Drought grows", "u3", "FARM", "Ohio"), ("Drought grows", "u3", "FARM", "Ohio"), ("Drought grows", "u4", "none", "Ohio"), ("Corn up", "u5", "", "Paris"), (" ", "u6", "", "Iowa"), (None, "u7", "", "Iowa")], "title string, url string, themes string, places string").withColumn("at", F.lit(1))
    ask = lambda **k: {(r.url, r.match_type) for r in N.headline_query(pages, F.col("title"), "url", "themes", "places", "at", ["at", "url"], **k).collect()}
    assert ask() == {("u1", "direct_corn"), ("u3", "weather_ag")} and ask(expanded=False) == {("u1", "direct_corn")} and len(ask(most=1)) == 1
    old = spark.createDataFrame([("h", "u", "n")], "headline string, source_url string, source_name string")
    assert set(N.without_repeats(N.with_aliases(old)).columns) == {"title", "url", "domain", "article_id"}


def test_unique_key(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "k int, v int")
    with pytest.raises(Exception, match="repeated key"):
        S.unique_key(df, ["k"]).collect()


def test_weekly_stream(spark, tmp_path):
    from sheaf.streaming.weekly import weekly_stream

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    stream = weekly_stream(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), "ts", "event_type", "value")
    q = stream.writeStream.format("memory").queryName("weekly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.week, r.event_type): r.n for r in spark.table("weekly").collect()}
    want = src.groupBy(friday(F.to_date("ts")).alias("week"), "event_type").count().collect()
    assert got == {(r.week, r.event_type): r["count"] for r in want}
