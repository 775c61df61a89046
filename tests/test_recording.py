"""Runs on record: identity, verdicts, recording, backfill, refresh and the command lines."""

from __future__ import annotations

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockcast import recording, run
from stockcast.config import Config
from stockcast.operators import fit, folds, registry
from stockcast.sources import files

from conftest import panel_of


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(1)
    values = np.maximum(0, 30 + 6 * np.sin(2 * np.pi * np.arange(420) / 7) + rng.normal(0, 2, 420))
    df = panel_of(spark, values).cache()
    return df, df.agg(F.max("date")).first()[0], Config(n_folds=3)


def test_record_is_idempotent_and_backfill_finds_the_rest(spark, small, tmp_path, capsys):
    df, last, cfg = small
    root, kept = str(tmp_path / "registry"), str(tmp_path / "predictions")
    ids = recording.record(df, cfg, last, ("seasonal_naive", "naive"), root, kept, "first")
    runs, scores = recording.tables(spark, root)
    assert sorted(r["run_id"] for r in runs.collect()) == sorted(ids) and scores.count() == 6
    before = {r["run_id"]: r["recorded_at"] for r in runs.collect()}
    assert recording.record(df, cfg, last, ("naive",), root, kept, "second") == [ids[1]]
    runs, scores = recording.tables(spark, root)
    rows = {r["run_id"]: r for r in runs.collect()}
    assert {k: r["recorded_at"] for k, r in rows.items()} == before and scores.count() == 6
    assert rows[ids[1]]["note"] == "first | second" and rows[ids[0]]["note"] == "first"
    assert rows[ids[0]]["win_vs_ref"] is None and rows[ids[1]]["n_scored"] == 3 and rows[ids[1]]["win_vs_ref"] is not None

    other = Config(n_folds=2)  # the same method and code under another config is another run
    recording.cached(df, other, last, "naive", kept, recording.digests()["naive"])
    new = recording.backfill(df, last, root, kept)
    assert new == [files.cache_name(other, "naive", recording.digests()["naive"])] and recording.backfill(df, last, root, kept) == []
    runs, _ = recording.tables(spark, root)
    assert {r["source"] for r in runs.filter(F.col("run_id") == new[0]).collect()} == {"backfill"}
    assert all(r["predecessor"] is None for r in registry.predecessors(runs).collect())

    assert recording.refresh(spark, root) == 0
    assert recording.refresh(spark, root, {"naive": "old"}) == 3 and recording.refresh(spark, root) == 3
    for argv, code in ((["list"], 0), (["last"], 0), (["refresh"], 0), (["show", ids[0]], 0), (["show", "x"], 1), (["compare", ids[0]], 1), (["compare", ids[1], ids[0]], 0), (["nothing"], 2)):
        assert recording.main(["--registry", root, *argv]) == code
    assert "SN7" in capsys.readouterr().out


def test_changed_actuals_are_refused(spark, small, tmp_path):
    df, last, cfg = small
    recording.cached(df, cfg, last, "mean", str(tmp_path), "c")
    with pytest.raises(ValueError):
        recording.cached(df.withColumn("sales", F.col("sales") + 1), cfg, last, "mean", str(tmp_path), "c")


def test_verdicts(spark):
    folds_ = [("a", k, 1.0) for k in range(10)] + [("same", k, 1.0) for k in range(10)] + [("worse", k, 1.0 if k < 6 else 1.4) for k in range(10)] + [("noise", k, 1.001 if k % 2 else 0.999) for k in range(10)]
    rows = [(r, "s", date(2024, 1, 1 + k), v, 0.0) for r, k, v in folds_]
    df = spark.createDataFrame(rows, "run_id string, id string, origin date, rmsse double, bias double")
    pairs = spark.createDataFrame([("a", x) for x in ("same", "worse", "noise")], "run_a string, run_b string")
    assert {r["run_b"]: r["verdict"] for r in registry.compare_runs(df, pairs).collect()} == {"same": "IDENTICAL", "worse": "CHECK", "noise": "ok"}
    assert "IDENTICAL" in registry.format_comparison(registry.compare_runs(df, pairs).filter("run_b = 'same'").first().asDict())


def test_predecessors_need_the_same_config_and_an_earlier_time(spark):
    rows = [("r1", "ets", "A", date(2024, 1, 1)), ("r2", "ets", "B", date(2024, 1, 2)), ("r3", "ets", "A", date(2024, 1, 3)), ("r4", "ets", "A", date(2024, 1, 3)), ("r5", "arima", "A", date(2024, 1, 4))]
    df = spark.createDataFrame(rows, "run_id string, method string, config_json string, recorded_at date")
    assert {r["run_id"]: r["predecessor"] for r in registry.predecessors(df).collect()} == {"r1": None, "r2": None, "r3": "r1", "r4": "r1", "r5": None}


def test_config_equality(spark):
    rows = [('{"a": "1", "b": "2"}', '{"b": "2", "a": "1"}', True), ('{"a": "1", "gone": "x"}', '{"a": "1"}', True), ('{"a": "1"}', '{"a": "2"}', False), ('{"a": "1"}', '{"b": "2"}', True)]
    df = spark.createDataFrame(rows, "x string, y string, want boolean")
    assert df.filter(registry.same_config(F.col("x"), F.col("y")) != F.col("want")).count() == 0


def test_methods_come_in_the_order_asked_for(small):
    df, last, cfg = small
    made = folds.walk_forward(df, cfg, last, ("naive", "mean"))
    found = [r["method"] for r in fit.in_order(made, ("naive", "mean")).collect()]
    assert found == ["naive"] * 21 + ["mean"] * 21


def test_command_line_rejects_what_it_does_not_know(tmp_path, capsys):
    assert run.main(["--data", "x", "--methods", "prophecy"]) == 2
    assert run.main(["--data", "x", "--registry", str(tmp_path)]) == 2


def test_a_series_without_an_order_is_an_error(spark, small, monkeypatch):
    df, last, cfg = small
    monkeypatch.setattr(fit, "series_orders", lambda *a: spark.createDataFrame([], "id string, p int, q int, sp int, sq int"))
    with pytest.raises(Exception, match="no order"):
        fit.series_forecasts(df, cfg, last, "arma", n_series=1).collect()
