"""Quantile leaves, and pools fitted by distributed sums against the model that fits in one task."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockcast.config import Config
from stockcast.models import gbt
from stockcast.operators import fit

from test_validation import synthetic

FEW = gbt.Settings(rounds=4, eta=0.3, depth=3, bins=32, patience=2, no_tail_rounds=3, min_weight=3)


@pytest.mark.parametrize("tau", [0.3, 0.5, 0.7])
def test_quantile_leaves_reach_the_range_of_the_target(tau):
    x = np.linspace(0, 1, 3000)[:, None]
    y = 1000 * x[:, 0]
    found = gbt.Model(gbt.Loss("pinball", tau), gbt.Settings(rounds=300)).fit(x, y, np.random.default_rng(1).random(3000) < 0.8).predict(x)
    assert np.ptp(found) > 900 and np.abs(found - y).mean() < 30


@pytest.mark.parametrize("unit", [1.0, 1000.0])
def test_quantiles_cover_held_out_rows_in_any_unit(unit):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 4))
    y = unit * (10 + 4 * x[:, 0] + (1 + (x[:, 1] > 0)) * rng.normal(size=6000))
    is_fit = np.arange(4000) < 3000
    for tau in (0.1, 0.3, 0.5, 0.7, 0.9):
        found = gbt.Model(gbt.Loss("pinball", tau), gbt.Settings(rounds=400)).fit(x[:4000], y[:4000], is_fit).predict(x[4000:])
        assert abs(np.mean(y[4000:] <= found) - tau) <= 0.08


def test_leaf_quantiles_are_those_of_each_leaf():
    rng = np.random.default_rng(3)
    node, rest = rng.integers(0, 9, 200), rng.normal(size=200)
    node[node == 4] = 3
    found = gbt.quantile_leaves(node, rest, 10, 0.3, 0.5)
    assert found == pytest.approx([0.5 * np.quantile(rest[node == k], 0.3) if (node == k).any() else 0 for k in range(10)])


def test_sums_of_sisters_give_the_same_tree_as_counting_both():
    rng = np.random.default_rng(4)
    x, g = np.round(rng.normal(size=(500, 5)), 1), rng.normal(size=500)
    x[rng.random((500, 5)) < 0.1] = np.nan
    binner = gbt.Binner.of(x, 16)
    codes, columns, s = binner(x), np.array([0, 2, 3]), gbt.Settings(depth=4, min_weight=3)
    (levels, value), leaf = gbt.grow(codes, g, np.ones(500), binner, columns, s)
    chosen, node = gbt.Chosen(binner, columns), np.zeros(500, np.int64)
    for depth, (column, limit) in enumerate(levels):
        whole = gbt.best_splits(gbt.histogram(chosen.codes(codes), node, 1 << depth, chosen.total, g, np.ones(500)), chosen, s)
        assert (whole[0] == column).all() and (whole[1] == limit).all()
        node = gbt.descend(node, codes, column, limit)
    assert (node == leaf).all() and value == pytest.approx(-np.bincount(node, g, 16) / (np.bincount(node, minlength=16) + s.l2) * s.eta)
    assert gbt.apply((levels, value), codes) == pytest.approx(value[leaf])


def forecasts(made):
    return {(r["id"], r["fold"], r["method"], r["horizon"]): (r["forecast"], r["fallback"]) for r in made.collect()}


@pytest.mark.parametrize("method", ["xgboost", "xgboost_rel_recent", "xgboost_poisson", "xgboost_quantile"])
def test_pools_by_sums_equal_pools_in_one_task(spark, method):
    df = synthetic(spark, 4, 420).withColumn("item_id", F.when(F.col("id").endswith("1"), "odd").otherwise("rest"))
    last = df.agg(F.max("date")).first()[0]
    cfg = Config(n_folds=2, fold_step=21, pool_by="item_id", min_train_days=100)
    whole = forecasts(fit.tree_forecasts(df, cfg, last, method, FEW))
    spread = forecasts(fit.tree_forecasts(df, cfg, last, method, FEW, pool_rows=0))
    assert whole.keys() == spread.keys() and len(whole) == 4 * 2 * 7 * (4 if method == "xgboost_quantile" else 1)
    for k, (value, fallback) in whole.items():
        assert spread[k] == (pytest.approx(value, rel=1e-6, abs=1e-6), fallback)
    assert len({round(v, 3) for v, _ in whole.values()}) > 10


def test_folds_without_history_fall_back(spark):
    df = synthetic(spark, 2, 127)
    last = df.agg(F.max("date")).first()[0]
    cfg = Config(n_folds=10, pool_by="item_id", min_train_days=1)
    spread = forecasts(fit.tree_forecasts(df, cfg, last, "xgboost", FEW, pool_rows=0))
    whole = forecasts(fit.tree_forecasts(df, cfg, last, "xgboost", FEW))
    assert spread.keys() == whole.keys() and any(f for _, f in whole.values())
    assert all(spread[k][1] == whole[k][1] and spread[k][0] == pytest.approx(whole[k][0], rel=1e-6, abs=1e-6) for k in whole)
