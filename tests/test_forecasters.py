"""Series methods: order choice, start values, intermittent demand, each against its definition."""

from __future__ import annotations

from collections import Counter
from datetime import date, timedelta

import numpy as np
import pytest
from conftest import panel_of
from pyspark.sql import functions as F

from stockcast.config import Config
from stockcast.models import ets, sarima
from stockcast.operators import asof, explore, fit, intermittent, order, sketches
from stockcast.plans.catalog import QUERIES


def simulated(seed, n=1100, ar=0.7, ma=0.4, seasonal=-0.6):
    """A (1, 0, 1)(0, 1, 1) process with season 7."""
    e = np.random.default_rng(seed).normal(size=n + 60)
    w, y = np.zeros(n + 60), np.full(n + 60, 100.0)
    for t in range(10, n + 60):
        w[t] = ar * w[t - 1] + e[t] + ma * e[t - 1] + seasonal * (e[t - 7] + ma * e[t - 8])
        y[t] = w[t] + y[t - 7]
    return y[60:]


def test_white_noise_has_no_order_in_any_unit():
    found = Counter()
    for seed in range(12):
        y = 10 * np.random.default_rng(seed).normal(size=500)
        order = sarima.select(y, 7, False)
        assert sarima.select(y / 100, 7, False) == order == sarima.select(1000 * y + 5, 7, False)
        found[order] += 1
    assert found[0, 0, 0, 0] > 6


def test_a_simulated_process_is_recovered():
    orders = Counter(sarima.select(simulated(seed), 7, True) for seed in range(4))
    assert orders[1, 1, 0, 1] >= 2
    found = sarima.Fit(simulated(1, 3000), (1, 1, 0, 1), 7, True).params
    assert found[:3] == pytest.approx([0.7, 0.4, -0.6], abs=0.06)


def test_errors_follow_the_product_of_polynomials():
    y = simulated(2, 300)
    m = sarima.Fit(y, (2, 1, 1, 1), 7, True)
    (a1, a2), (s1,), (b1,), (t1,), (mean,) = m._split(m.params)
    u = (y[7:] - y[:-7]) / m.scale - mean
    v = lambda x, t: x[t] if t >= 0 else 0.0
    e = []
    for t in range(len(u)):
        ar = a1 * v(u, t - 1) + a2 * v(u, t - 2) + s1 * v(u, t - 7) - s1 * a1 * v(u, t - 8) - s1 * a2 * v(u, t - 9)
        e.append(u[t] - ar - b1 * v(e, t - 1) - t1 * v(e, t - 7) - b1 * t1 * v(e, t - 8))
    assert m.e == pytest.approx(np.array(e), abs=1e-8)
    w = a1 * u[-1] + a2 * u[-2] + s1 * u[-7] - s1 * a1 * u[-8] - s1 * a2 * u[-9] + b1 * e[-1] + t1 * e[-7] + b1 * t1 * e[-8]
    assert m.forecast(1)[0] == pytest.approx((w + mean) * m.scale + y[-7])


def test_derivatives_are_those_of_the_errors():
    y = simulated(3, 200)
    m = sarima.Fit(y, (1, 2, 1, 1), 7, True, np.random.default_rng(0).integers(0, 2, (200, 3)).astype(float))
    for k in range(len(m.params)):
        step = np.zeros(len(m.params))
        step[k] = 1e-6
        up, down = (m._errors(m.z, m.params + s)[0][m.start :] for s in (step, -step))
        assert m._errors(m.z, m.params)[1][:, k] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_regressors_that_never_change_are_left_out():
    x = np.zeros((400, 3))
    x[::10, 0] = 1
    y = 50 + 8 * x[:, 0] + np.random.default_rng(1).normal(size=400)
    m = sarima.Fit(y, (0, 0, 0, 0), 7, False, x)
    ahead = np.zeros((7, 3))
    ahead[2, 0] = 1
    assert m.forecast(7, ahead, ahead)[2] - m.forecast(7, ahead, ahead)[1] == pytest.approx(8, abs=0.6)


def test_no_order_at_all_is_an_error(spark):
    with pytest.raises(ValueError):
        sarima.select(np.arange(12.0), 7, True)
    df = panel_of(spark, [5.0, 3.0] * 12)
    last = df.agg(F.max("date")).first()[0]
    with pytest.raises(Exception, match="no order could be fitted"):
        fit.series_orders(df, Config(n_folds=1, min_train_days=10), last, "arima_plain").collect()


def test_orders_are_of_the_first_scored_origin(spark):
    early, late = np.random.default_rng(2).normal(20, 3, 300), np.random.default_rng(3).normal(20, 3, 120)
    df = panel_of(spark, early).unionByName(panel_of(spark, late, start="1999-07-03", series="late")).unionByName(panel_of(spark, late[:30], start="1999-10-01", series="never"))
    last = df.agg(F.max("date")).first()[0]
    cfg = Config(n_folds=10, min_train_days=90)
    found = {r["id"] for r in fit.series_orders(df, cfg, last, "arma").collect()}
    assert found == {"s", "late"}
    made = fit.series_forecasts(df, cfg, last, "arma").groupBy("id").agg(F.min("fold").alias("fold")).collect()
    first = {r["id"]: r["fold"] for r in made}
    assert first["s"] == 0 and cfg.origins(last)[first["late"]] >= df.filter("id = 'late'").agg(F.min("date")).first()[0] + timedelta(days=89) and "never" not in first


def test_start_values_are_the_best_ones():
    rng = np.random.default_rng(5)
    y = 30 + np.tile([0, 4, 1, 3, 6, 9, 2], 30) + 0.05 * np.arange(210) + rng.normal(0, 2, 210)
    weights = [np.array([v]) for v in (0.2, 0.05, 0.1)]
    starts, totals = ets.best_starts(y, 7, *weights)
    assert ets._errors(y, 7, *weights, starts)[0] == pytest.approx(totals)
    assert totals[0] < ets._errors(y, 7, *weights)[0][0] and starts[0, 2:].sum() == pytest.approx(ets.first_values(y, 7)[2:].sum(), abs=1e-6)
    for k in range(9):
        for step in (-0.3, 0.3):
            moved = starts.copy()
            moved[0, k] += step
            if k >= 2:
                moved[0, 2 + (k - 1) % 7] -= step
            assert ets._errors(y, 7, *weights, moved)[0][0] >= totals[0]


def test_the_search_never_ends_above_the_grid_with_first_values():
    rng = np.random.default_rng(6)
    for k in range(6):
        y = np.maximum(0, 20 + 5 * np.sin(2 * np.pi * np.arange(300) / 7 + k) + np.cumsum(rng.normal(0, 0.4 * k, 300)) + rng.normal(0, 3, 300))
        grid = [v.ravel() for v in np.meshgrid(*[np.linspace(0.001, 0.999, 9)] * 3, indexing="ij")]
        assert ets.search(y, 7)[2] <= ets._errors(y, 7, *grid)[0].min()


def brute_rates(sales, sizes=0.1, odds=0.05):
    z = p = d = None
    q = 1.0
    for y in sales:
        if y > 0:
            z, p = (y, q) if z is None else (z + sizes * (y - z), p + sizes * (q - p))
        if d is None:
            d = 1 / q if y > 0 else None
        else:
            d += odds * ((y > 0) - d)
        q = 1.0 if y > 0 else q + 1
    return (0.0, 0.0, 0.0) if z is None else (z / p, z / p * (1 - sizes / 2), d * z)


def test_intermittent_rates_follow_the_recursion(spark):
    rng = np.random.default_rng(7)
    sales = {"a": np.where(rng.random(120) < 0.2, rng.integers(1, 9, 120), 0), "b": np.zeros(120), "c": np.where(np.arange(120) >= 100, 3, 0)}
    df = None
    for name, values in sales.items():
        one = panel_of(spark, values, series=name)
        df = one if df is None else df.unionByName(one)
    last = df.agg(F.max("date")).first()[0]
    cfg = Config(n_folds=4, min_train_days=30)
    made = {(r["id"], r["fold"], r["method"], r["horizon"]): r["forecast"] for r in intermittent.forecasts(df, cfg, last).collect()}
    assert len(made) == 3 * 4 * 3 * 7
    for name, values in sales.items():
        for fold, origin in enumerate(cfg.origins(last)):
            n = 120 - (last - origin).days
            for method, want in zip(intermittent.METHODS, brute_rates(values[:n]), strict=True):
                assert made[name, fold, method, 1] == made[name, fold, method, 7] == pytest.approx(want)
    rows = intermittent.predictions(df, cfg, last)
    routed = intermittent.routed(rows, explore.series_stats(df, cfg.holdout_start(last)), {"intermittent": "tsb", "unclassifiable": "croston", "smooth": "croston", "lumpy": "croston_sba", "erratic": "tsb"})
    assert {r["method"] for r in routed.collect()} == {"routed"} and routed.count() == rows.count() // 3
    with pytest.raises(ValueError):
        intermittent.forecasts(df, cfg, last, ("other",))
    assert intermittent.forecasts(df.filter("false"), cfg, last).count() == 0


def test_the_tail_of_chi_square_equals_its_fractions(spark):
    rows = [(float(q), d) for d in (1, 2, 3, 7, 14, 29, 30) for q in (0, 0.01, 0.5, 3.84, 10, 29.1, 80, 400, 3000)] + [(None, 3), (1.0, None)]
    df = spark.createDataFrame(rows, "q double, d int")
    for r in df.select("q", "d", explore.chi2_tail(F.col("q"), F.col("d")).alias("p")).collect():
        assert r["p"] is None if r["q"] is None or r["d"] is None else r["p"] == pytest.approx(explore.chi2_survival(r["q"], r["d"]), abs=1e-12)


def test_as_of_rows_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    keys = lambda n: [None if v == 9 else "hot" if v < 6 else f"k{v}" for v in rng.integers(0, 10, n).tolist()]
    left = [(k, None if t == 0 else t, n) for k, t, n in zip(keys(300), rng.integers(0, 900, 300).tolist(), range(300), strict=True)] + [("hot", 400, 7)] * 3 + [("alone", 5, 1)]
    right = [(k, None if t == 0 else t, float(v)) for k, t, v in zip(keys(120), rng.integers(0, 900, 120).tolist(), rng.integers(0, 50, 120).tolist(), strict=True)] + [("hot", 400, 3.0), ("hot", 400, 99.0), ("hot", 400, None)]
    day = "date_add(date'1999-01-01', t)"
    a = spark.createDataFrame(left, "id string, t int, n long").selectExpr("id", f"{day} as at", "n")
    b = spark.createDataFrame(right, "id string, t int, v double").selectExpr("id", f"{day} as since", "v")
    found = Counter((r["id"], r["at"], r["n"], r["since"], r["v"]) for r in asof.asof_join(a, b, ("id",), "at", "since", ("v",), bucket_days=30).collect())
    want = Counter()
    rows = [(r["id"], r["since"], r["v"]) for r in b.collect() if r["id"] is not None and r["since"] is not None]
    for r in a.collect():
        fit_ = [(since, v is not None, v or 0, v) for k, since, v in rows if k == r["id"] and r["at"] is not None and since <= r["at"]]
        best = max(fit_, key=lambda x: x[:3], default=None)
        want[r["id"], r["at"], r["n"], best and best[0], best and best[3]] += 1
    assert found == want and sum(x[3] is not None for x in want) > 100
    assert asof.asof_join(a.filter("false"), b, ("id",), "at", "since", ("v",)).count() == 0
    assert asof.asof_join(a, b.filter("false"), ("id",), "at", "since", ("v",)).filter("since is not null").count() == 0
    with pytest.raises(ValueError):
        asof.asof_join(a.withColumn("v", F.lit(1)), b, ("id",), "at", "since", ("v",))


@pytest.mark.parametrize(("cell_rows", "least", "counted"), [(0, False, False), (0, True, True), (150, True, False), (10**6, True, True)])
def test_as_of_rows_are_the_same_however_keys_are_dealt(spark, cell_rows, least, counted):
    rng = np.random.default_rng(10)
    keys = lambda n: [None if v == 9 else 1 if v < 6 else v for v in rng.integers(0, 10, n).tolist()]
    left = list(zip(keys(300), [t or None for t in rng.integers(0, 400, 300).tolist()], range(300), strict=True))
    right = list(zip(keys(200), [t or None for t in rng.integers(0, 400, 200).tolist()], [v or None for v in rng.integers(0, 9, 200).tolist()], strict=True)) + [(1, 50, 3), (1, 50, 7), (1, 50, None)]
    day = "date_add(date'1999-01-01', t)"
    a = spark.createDataFrame(left, "id int, t int, n long").selectExpr("id", f"{day} as at", "n").repartition(3)
    b = spark.createDataFrame(right, "id long, t int, v long").selectExpr("id", f"cast({day} as timestamp) as since", "v")
    made = asof.asof_join(a, b, ("id",), "at", "since", ("v",), 30, least, a.select("id").unionByName(b.select("id")) if counted else None, cell_rows)
    assert [(f.name, f.dataType.simpleString()) for f in made.schema] == [("id", "int"), ("at", "date"), ("n", "bigint"), ("since", "timestamp"), ("v", "bigint")]
    start, want = date(1999, 1, 1), Counter()
    for k, t, n in left:
        before = [(since, v is not None, (-v if least else v) if v else 0, v) for i, since, v in right if k is not None and i == k and t and since and since <= t]
        best = max(before, key=lambda x: x[:3], default=None)
        want[k, t and start + timedelta(t), n, best and start + timedelta(best[0]), best and best[3]] += 1
    assert Counter((r["id"], r["at"], r["n"], r["since"] and r["since"].date(), r["v"]) for r in made.collect()) == want and sum(x[4] is not None for x in want) > 100


def test_an_as_of_join_shuffles_its_rows_once(spark, sf):
    plan = QUERIES["price_as_of"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    scans, shuffles = plan.count("FileScan parquet"), plan.count("Exchange hashpartitioning")
    assert scans == 3 and shuffles <= 3  # lines with orders, then both sides by key


def test_sketched_offsets_have_the_ranks_they_should(spark):
    rng = np.random.default_rng(9)
    rows = [("a" if k % 3 else "b", "m", k % 25, float(v)) for k, v in enumerate(rng.gamma(2, 5, 6000))] + [("c", "m", 3, 1.5), ("c", "m", 4, None)]
    df = spark.createDataFrame(rows, "id string, method string, fold long, error double").selectExpr("*", "date_add(date'1999-01-01', cast(7 * fold as int)) as origin")
    start = df.filter("fold = 10").first()["origin"]
    worst = 0.0
    found = sketches.expanding(sketches.error_sketches(df), start).collect()
    for r in found:
        past = sorted(v for i, _, fold, v in rows if i == r["id"] and v is not None and fold < r["fold"])
        assert r["n_calib"] == len(past)
        worst = max(worst, abs(sum(v <= r["offset"] for v in past) / len(past) - r["tau"]) - 1 / len(past))
    assert len(found) == 2 * 15 * 4 and worst < 1.9 / sketches.SIZE * 2
    small = df.filter("fold < 13")
    exact = sketches.calibrated(small, start, most_exact=10_000)
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, order.calibrate_expanding(small, start).collect()))
    assert {r["n_calib"] for r in sketches.calibrated(small, start, most_exact=10).collect()} == {r["n_calib"] for r in exact.collect()}
    assert sketches.expanding(sketches.error_sketches(df.filter("false")), start).count() == 0
