import math
from datetime import date

import numpy as np
import pytest
from conftest import panel_of
from pyspark.sql import functions as F

from stockcast.config import Config
from stockcast.models import ets, gbt, sarima
from stockcast.operators import calendar, explore, features, fit, folds, order, panel, registry, scoring

ONE = Config(n_folds=1, min_train_days=300)


def forecasts(spark, values, cfg=ONE, methods=folds.BENCHMARKS):
    df = panel_of(spark, values)
    last = df.agg(F.max("date")).first()[0]
    rows = folds.walk_forward(df, cfg, last, methods).orderBy("horizon").collect()
    return {m: [r["forecast"] for r in rows if r["method"] == m] for m in methods}


def test_constant_series(spark):
    made = forecasts(spark, [10] * 407)
    assert all(np.allclose(v, 10) for v in made.values())


def test_ramp(spark):
    made = forecasts(spark, range(1, 408))
    assert made["naive"] == [400] * 7
    assert made["drift"] == list(range(401, 408))
    assert made["seasonal_naive"] == list(range(394, 401))
    assert made["seasonal_naive_364"] == list(range(37, 44))
    assert made["moving_average_28"] == [np.mean(range(373, 401))] * 7


def test_horizon_beyond_season(spark):
    made = forecasts(spark, range(1, 39), Config(horizon=10, n_folds=1, min_train_days=10), ("seasonal_naive",))
    assert made["seasonal_naive"] == [22, 23, 24, 25, 26, 27, 28, 22, 23, 24]


def test_scale(spark):
    df = panel_of(spark, [1, 2, 4, 7, 11, 16, 0, 0, 0, 0, 0, 0, 0])
    last = df.agg(F.max("date")).first()[0]
    for lag, want in ((1, math.sqrt(55 / 5)), (2, math.sqrt(164 / 4))):
        cfg = Config(n_folds=1, min_train_days=1, rmsse_scale_lag=lag)
        assert folds.naive_scale(df, cfg, last).first()["scale"] == pytest.approx(want)


def prediction(spark, rows):
    """rows: (forecast, actual, closure)."""
    data = [("s", "i", "st", 0, date(2000, 1, 1), "normal", "m", "benchmark", k + 1, date(2000, 1, 2 + k), float(a), None if f is None else float(f), 2.0, c, False, False) for k, (f, a, c) in enumerate(rows)]
    return spark.createDataFrame(data, "id string, item_id string, store_id string, fold long, origin date, week_kind string, method string, kind string, horizon int, target_date date, actual double, forecast double, scale double, closure boolean, holiday_window boolean, fallback boolean")


def test_fold_errors(spark):
    r = scoring.score_folds(prediction(spark, [(12, 10, False), (7, 10, False), (10, 10, False), (99, 10, True)])).first()
    assert r["rmse"] == pytest.approx(math.sqrt(13 / 3)) and r["mae"] == pytest.approx(5 / 3) and r["bias"] == pytest.approx(-1 / 3)
    assert r["rmsse"] == pytest.approx(r["rmse"] / 2) and r["n_days"] == 3 and not r["unscored"]


def test_missing_forecast_voids_the_fold(spark):
    rows = prediction(spark, [(1, 1, False)] * 6 + [(None, 1, False)])
    r = scoring.score_folds(rows).first()
    assert r["unscored"] and r["rmse"] is None and r["rmsse"] is None
    assert order.weekly_totals(rows).first()["forecast"] is None


def test_week_kind_is_checked(spark):
    with pytest.raises(ValueError):
        scoring.weeks(None, "rainy")
    with pytest.raises(ValueError):
        scoring.improvement_over(spark.createDataFrame([("naive",)], "method string"), "other")


def test_pinball(spark):
    r = spark.range(1).select(order.pinball(F.lit(10.0), F.lit(0.0), F.lit(0.9)).alias("a"), order.pinball(F.lit(0.0), F.lit(10.0), F.lit(0.9)).alias("b")).first()
    assert r["a"] == pytest.approx(18) and r["b"] == pytest.approx(2)


def test_calibration_uses_earlier_folds_only(spark):
    rows = [("s", "m", k, date(2000, 1, 1 + k), float(k - 10)) for k in range(20)]
    df = spark.createDataFrame(rows, "id string, method string, fold long, origin date, error double")
    found = {r["tau"]: r["offset"] for r in order.calibrate(df, date(2000, 1, 11)).collect()}
    assert found == pytest.approx({t: float(np.quantile(np.arange(-10, 0), t)) for t in order.TAUS})
    late = order.calibrate_expanding(df, date(2000, 1, 11)).filter("fold = 19 and tau = 0.5").first()
    assert late["n_calib"] == 13 and late["offset"] == pytest.approx(np.median(np.arange(-10, 3)))  # weeks over by the origin


def test_holiday_window(spark):
    rows = spark.createDataFrame([(3, 30), (2, 30), (1, 30), (0, 0), (30, 1), (30, 2)], "days_to_holiday int, days_since_holiday int")
    assert [r[0] for r in rows.select(calendar.in_holiday_window()).collect()] == [False, True, True, True, True, False]


def test_demand_classes(spark):
    rows = spark.createDataFrame([(1.0, 0.1), (1.0, 0.6), (1.5, 0.1), (1.5, 0.6), (None, 0.1)], "adi double, cv2 double")
    assert [r[0] for r in rows.select(explore.demand_class(F.col("adi"), F.col("cv2"))).collect()] == ["smooth", "erratic", "intermittent", "lumpy", "unclassifiable"]


def test_closure_fill_looks_back_only(spark):
    df = panel_of(spark, range(100)).withColumn("k", F.datediff("date", F.lit("1999-01-04").cast("date")))
    df = df.withColumn("closure", F.col("k") == 70).withColumn("days_to_holiday", F.when(F.col("k").between(62, 63), 1).otherwise(30))
    assert panel.impute_closures(df).filter("k = 70").first()["sales"] == 49.0
    later = df.withColumn("sales", F.when(F.col("k") > 70, 9999.0).otherwise(F.col("sales")))
    assert panel.impute_closures(later).filter("k = 70").first()["sales"] == 49.0


def test_grid_assertion(spark):
    df = panel_of(spark, range(30))
    panel.assert_daily_grid(df)
    with pytest.raises(ValueError):
        panel.assert_daily_grid(df.filter("sales <> 7"))
    with pytest.raises(ValueError):
        panel.assert_daily_grid(df.union(df.filter("sales = 7")))


def test_join_rejects_repeated_keys(spark):
    facts, dim = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="repeats"):
        panel.join_dimension(facts, dim, ["k"]).collect()


def test_unmapped_state_fails(spark):
    df = spark.createDataFrame([("ZZ", 1, 0, 0)], "state_id string, snap_CA int, snap_TX int, snap_WI int")
    with pytest.raises(Exception, match="no benefit flag"):
        calendar.snap_flag(df).collect()


def test_empty_selection_fails(spark):
    with pytest.raises(ValueError):
        panel.select_series(panel_of(spark, [1]), Config(item_ids=("none",)))


def test_supervised_rows_never_see_past_the_origin(spark):
    values = [float(v) for v in np.random.default_rng(1).integers(0, 50, 120)]
    df = panel_of(spark, values)
    rows = features.supervised(df, 7).orderBy("origin_date", "horizon").collect()
    day0 = date(1999, 1, 4)
    assert len(rows) == (120 - 56 - 7) * 7
    for r in rows[::37]:
        i, h = (r["origin_date"] - day0).days, r["horizon"]
        seen = values[: i + 1]
        assert r["lag_7"] == seen[-7] and r["roll_mean_28"] == pytest.approx(np.mean(seen[-28:])) and r["roll_std_7"] == pytest.approx(np.std(seen[-7:], ddof=1))
        same = [v for k, v in enumerate(seen) if k % 7 == (i + h) % 7]
        assert r["dow_mean_4"] == pytest.approx(np.mean(same[-4:])) and r["target"] == values[i + h]


def test_leak_assertion(spark):
    good = spark.createDataFrame([("s", 0, date(2000, 1, 5), date(2000, 1, 5), date(2000, 1, 6))], "id string, fold int, origin date, last_history date, first_target date")
    folds.assert_no_leakage(good)
    with pytest.raises(ValueError):
        folds.assert_no_leakage(good.withColumn("first_target", F.col("origin")))


def test_registry_keeps_the_first_row(spark):
    old = spark.createDataFrame([("a", 1, "n1")], "run_id string, recorded_at int, note string")
    new = spark.createDataFrame([("a", 2, "n2"), ("b", 3, ""), ("b", 4, "")], "run_id string, recorded_at int, note string")
    assert [(r["run_id"], r["recorded_at"]) for r in registry.new_runs(old, new).collect()] == [("b", 3)]
    assert registry.add_notes(old, new).first()["note"] == "n1 | n2"
    assert registry.runs(old, "recorded_at >= :t", {"t": 1}).count() == 1


def test_chi_square_tail():
    assert explore.chi2_survival(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert explore.chi2_survival(18.307038053275146, 10) == pytest.approx(0.05, rel=1e-9)


def test_ets_follows_level_trend_and_season():
    t = np.arange(200)
    y = 20 + 0.1 * t + 5 * np.sin(2 * np.pi * t / 7)
    want = 20 + 0.1 * np.arange(200, 207) + 5 * np.sin(2 * np.pi * np.arange(200, 207) / 7)
    assert np.abs(ets.fit_forecast(y, 7) - want).max() < 0.5


def test_sarima_selects_and_forecasts():
    rng = np.random.default_rng(3)
    e, y = rng.normal(0, 1, 500), np.zeros(500)
    for t in range(1, 500):
        y[t] = 0.8 * y[t - 1] + e[t]
    order_ = sarima.select(y + 50, 7, False)
    assert order_[0] >= 1
    assert np.isfinite(sarima.Fit(y + 50, order_, 7, False).forecast(7)).all()
    assert len(sarima.grid(True)) == 36 and len(sarima.grid(False)) == 16


def test_trees_learn_and_are_deterministic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 4))
    x[::50, 2] = np.nan
    y = np.where(x[:, 0] > 0, 5.0, 1.0) + 0.1 * rng.normal(size=1500)
    is_fit = np.arange(1500) < 1200
    s = gbt.Settings(rounds=80, eta=0.2, depth=3)
    a, b = (gbt.Model(gbt.Loss(), s).fit(x, y, is_fit).predict(x[1200:]) for _ in range(2))
    assert (a == b).all() and np.mean((a - y[1200:]) ** 2) < 0.1
    low, high = (gbt.Model(gbt.Loss("pinball", t), s).fit(x, y, is_fit).predict(x[1200:]) for t in (0.1, 0.9))
    assert np.mean(y[1200:] <= low) < 0.3 < 0.7 < np.mean(y[1200:] <= high)
    counts = rng.poisson(np.exp(0.5 + (x[:, 0] > 0)), 1500).astype(float)
    assert (gbt.Model(gbt.Loss("poisson"), s).fit(x, counts, is_fit).predict(x[1200:]) > 0).all()


def test_fitted_methods_run_on_a_panel(spark):
    rng = np.random.default_rng(5)
    values = np.maximum(0, 30 + 6 * np.sin(2 * np.pi * np.arange(460) / 7) + rng.normal(0, 2, 460))
    df = panel_of(spark, values)
    last = df.agg(F.max("date")).first()[0]
    cfg = Config(n_folds=2)
    made = fit.run(df, cfg, last, ("seasonal_naive", "ets", "xgboost"), gbt.Settings(rounds=30, eta=0.2, depth=3))
    summary = {r["method"]: r for r in scoring.summarise(scoring.score_folds(made)).collect()}
    assert set(summary) == {"seasonal_naive", "ets", "xgboost"}
    assert all(r["n_folds"] == 2 and r["n_unscored"] == 0 for r in summary.values())
    assert summary["ets"]["rmsse_mean"] < summary["seasonal_naive"]["rmsse_mean"] * 1.1
    with pytest.raises(ValueError):
        fit.run(df, cfg, last, ("prophecy",))


def test_one_shuffle_by_series(spark, sf):
    plan = features.with_origin_features(panel_of(spark, range(100)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(id") <= 1 and "BatchEvalPython" not in plan
