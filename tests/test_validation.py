"""Models against independent formulas, and what must hold for any sound harness: noise floor, shuffled target, parity."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockcast.config import Config
from stockcast.models import ets, gbt, sarima
from stockcast.operators import fit, order, scoring

from conftest import panel_of

NOISE = 2.0
QUICK = gbt.Settings(rounds=300, eta=0.1, depth=4, bins=64)


def synthetic(spark, n_series=2, days=520, shuffled=False):
    """Level, weekly wave and a slow rise plus noise of a known size."""
    out = None
    for k in range(n_series):
        rng = np.random.default_rng(10 + k)
        t = np.arange(days)
        y = np.maximum(0, 20 + 6 * k + 4 * np.sin(2 * np.pi * t / 7) + 3 * t / days + rng.normal(0, NOISE, days))
        df = panel_of(spark, rng.permutation(y) if shuffled else y, series=f"s{k}").withColumns({"item_id": F.lit("i"), "store_id": F.lit(f"st{k}")})
        out = df if out is None else out.unionByName(df)
    return out


def errors(made):
    """Root mean square error by method."""
    return {r["method"]: r["e"] for r in made.groupBy("method").agg(F.sqrt(F.avg(F.pow(F.col("forecast") - F.col("actual"), F.lit(2.0)))).alias("e")).collect()}


@pytest.mark.parametrize(("step", "pool"), [(7, None), (1, "item_id")])
def test_no_method_beats_the_noise(spark, step, pool):
    df = synthetic(spark).cache()
    last = df.agg(F.max("date")).first()[0]
    cfg = Config(n_folds=6, fold_step=step, pool_by=pool)
    found = errors(fit.run(df, cfg, last, ("ets", "xgboost", "xgboost_rel", "moving_average_28"), QUICK))
    assert all(e / NOISE >= 0.9 for e in found.values()) and found["ets"] / NOISE < 1.5 and found["xgboost"] / NOISE < 1.7


@pytest.mark.parametrize("pool", [None, "item_id"])
def test_nothing_is_learned_from_a_shuffled_target(spark, pool):
    df = synthetic(spark, shuffled=True).cache()
    last = df.agg(F.max("date")).first()[0]
    found = errors(fit.run(df, Config(n_folds=6, pool_by=pool), last, ("mean", "ets", "xgboost"), QUICK))
    assert all(found[m] / found["mean"] >= 0.95 for m in ("ets", "xgboost"))


def test_partitions_and_reruns_do_not_matter(spark):
    df = synthetic(spark, 3, 420)
    last = df.agg(F.max("date")).first()[0]
    cfg, results = Config(n_folds=3), []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", "4", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        made = fit.run(df.repartition(int(parts)), cfg, last, ("seasonal_naive", "ets", "arma", "xgboost"), replace(QUICK, rounds=20))
        results.append(sorted((r["id"], r["fold"], r["method"], r["horizon"], r["forecast"]) for r in made.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2] and len(results[0]) == 3 * 3 * 4 * 7


def test_calibrated_quantiles_cover_what_they_say(spark):
    df = synthetic(spark, 3, 1100)
    last = df.agg(F.max("date")).first()[0]
    cfg = Config(n_folds=80)
    weekly = order.weekly_totals(fit.run(df, cfg, last, ("moving_average_28",)))
    start = cfg.origins(last)[40]
    scored = order.score_quantiles(order.quantile_forecasts(weekly, order.calibrate(weekly, start), start))
    for r in order.summarise_quantiles(scored).collect():
        assert abs(r["coverage"] - r["tau"]) <= 0.12


def test_smoothing_follows_the_recursion():
    rng = np.random.default_rng(4)
    y = 10 + np.tile([0, 1, 2, 3, 2, 1, 0], 20) + rng.normal(0, 0.5, 140)
    a, b, g = 0.3, 0.1, 0.2
    level, trend, season, total = y[:7].mean(), (y[7:14].mean() - y[:7].mean()) / 7, list(y[:7] - y[:7].mean()), 0.0
    for t in range(7, 140):
        s = season[t % 7]
        total += (y[t] - level - trend - s) ** 2
        new = a * (y[t] - s) + (1 - a) * (level + trend)
        season[t % 7] = g * (y[t] - new) + (1 - g) * s
        trend = b * (new - level) + (1 - b) * trend
        level = new
    found = ets._errors(y, 7, *(np.array([x]) for x in (a, b, g)))
    assert found[0][0] == pytest.approx(total) and found[1][0] == pytest.approx(level) and found[2][0] == pytest.approx(trend) and found[3][:, 0] == pytest.approx(season)


def test_an_autoregression_forecasts_by_its_closed_form():
    rng = np.random.default_rng(3)
    e, y = rng.normal(0, 1, 800), np.zeros(800)
    for t in range(1, 800):
        y[t] = 0.8 * y[t - 1] + e[t]
    y += 50
    found = sarima.Fit(y, (1, 0, 0, 0), 7, False).forecast(5)
    x, z = y[:-1] - y[:-1].mean(), y[1:] - y[1:].mean()
    phi = float(x @ z / (x @ x))
    want = y.mean() + phi ** np.arange(1, 6) * (y[-1] - y.mean())
    assert np.abs(found - want).max() < 0.15


def test_one_split_is_the_best_one():
    rng = np.random.default_rng(7)
    x, y = rng.integers(0, 12, (300, 3)).astype(float), rng.normal(size=300)
    y += 2 * (x[:, 1] > 4)
    s = gbt.Settings(rounds=1, no_tail_rounds=1, eta=1.0, depth=1, rows=1.1, columns=1.0, l2=1e-9, min_weight=5)
    model = gbt.Model(gbt.Loss(), s).fit(x, y, np.ones(300, bool))
    best = min(((((y[m] - y[m].mean()) ** 2).sum() + ((y[~m] - y[~m].mean()) ** 2).sum(), c, t) for c in range(3) for t in range(11) for m in [x[:, c] <= t] if 5 <= m.sum() <= 295))
    m = x[:, best[1]] <= best[2]
    assert model.predict(x) == pytest.approx(np.where(m, y[m].mean(), y[~m].mean()), rel=1e-6)


def test_losses_equal_their_formulas():
    y, f = np.array([1.0, 4.0, 0.0]), np.array([2.0, 1.0, 0.5])
    assert gbt.Loss("pinball", 0.9).value(y, f) == pytest.approx(np.mean([0.1 * 1, 0.9 * 3, 0.1 * 0.5]))
    step = 1e-6
    for kind in ("squared", "poisson"):
        loss = gbt.Loss(kind)
        g, _ = loss.gradient(y, f)
        slope = [(loss.value(y[k : k + 1], f[k : k + 1] + step) - loss.value(y[k : k + 1], f[k : k + 1] - step)) / (2 * step) for k in range(3)]
        assert g * (2 if kind == "squared" else 1) == pytest.approx(slope, rel=1e-4)


def test_a_fitted_benchmark_may_be_compared_with(spark):
    df = synthetic(spark, 1, 400)
    last = df.agg(F.max("date")).first()[0]
    scores = scoring.score_folds(fit.run(df, Config(n_folds=2), last, ("naive", "ets"))).cache()
    assert [r["method"] for r in scoring.improvement_over(scores, "ets").collect()] == ["naive"]
    with pytest.raises(ValueError):
        scoring.improvement_over(scores, "unknown")
