from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import panel_of

from stockcast.config import Config
from stockcast.operators import folds, panel, registry
from stockcast.sources import files
from stockcast.streaming import hourly


@pytest.fixture()
def inputs(spark, tmp_path):
    days = [date(2000, 12, 1) + timedelta(days=k) for k in range(60)]
    cal = [(f"d_{k + 1}", d, d.isocalendar().week + 100 * d.year, 0, d.month, d.year, "Christmas" if (d.month, d.day) == (12, 25) else None, None, None, None, int(d.day <= 10), 0, 0) for k, d in enumerate(days)]
    spark.createDataFrame(cal, files.CALENDAR).coalesce(1).write.option("header", True).csv(str(tmp_path / "calendar"))
    rows = [("a_CA1", "a", "x", "y", "CA1", "CA", *range(60)), ("b_CA1", "b", "x", "y", "CA1", "CA", *[5] * 60)]
    spark.createDataFrame(rows, ", ".join([*(f"{c} string" for c in files.SALES_IDS), *(f"d_{k + 1} int" for k in range(60))])).coalesce(1).write.option("header", True).csv(str(tmp_path / "sales"))
    prices = sorted({("CA1", "a", c[2], 2.5) for c in cal if c[1] >= date(2000, 12, 11)})
    spark.createDataFrame(prices, files.PRICES).coalesce(1).write.option("header", True).csv(str(tmp_path / "prices"))
    return [f(spark, str(tmp_path / n)) for f, n in ((files.read_sales, "sales"), (files.read_calendar, "calendar"), (files.read_prices, "prices"))]


def test_panel_from_files(spark, inputs):
    df = panel.assert_daily_grid(files.panel_from_files(*inputs)).cache()
    assert {r["id"] for r in df.select("id").distinct().collect()} == {"a_CA1"}  # b is never priced
    assert df.agg(F.min("date")).first()[0] == date(2000, 12, 11)
    closed = df.filter("closure").collect()
    assert [(r["date"], r["sales"]) for r in closed] == [(date(2000, 12, 25), (17 + 10) / 2)]
    assert df.filter("snap = 1").count() == 20 - 10
    with pytest.raises(ValueError):
        files.panel_from_files(*inputs, Config(item_ids=("z",)))


def test_cache_and_sidecars(spark, inputs, tmp_path):
    root, cfg = str(tmp_path / "cache"), Config(n_folds=2, store_ids=("CA1",))
    df = files.panel_from_files(*inputs)
    assert files.cached(spark, f"{root}/p", lambda: df).count() == files.cached(spark, f"{root}/p", lambda: 1 / 0).count()
    small = Config(n_folds=2, min_train_days=10)
    made = folds.walk_forward(df, small, df.agg(F.max("date")).first()[0], ("naive",))
    code = files.code_digest(folds.benchmarks)
    assert files.read_predictions(spark, root + "/m", cfg, "naive", code) is None
    files.write_predictions(made, root + "/m", cfg, "naive", code)
    found = files.sidecars(spark, root + "/m").first()
    assert files.config_of(found["config"]) == cfg and (found["method"], found["code"]) == ("naive", code)
    back = files.check_actuals(files.read_predictions(spark, root + "/m", cfg, "naive", code), df)
    assert back.count() == made.count() == 14
    with pytest.raises(ValueError):
        files.check_actuals(back, df.withColumn("sales", F.col("sales") + 1))
    assert found["run_id"] == files.cache_name(cfg, "naive", code) and found["written_at"] is not None
    for name, missing in ((files.cache_name(Config(n_folds=3), "naive", code), 1), (found["run_id"], 0)):
        assert files.not_recorded(files.sidecars(spark, root + "/m"), spark.createDataFrame([(name,)], "run_id string")).count() == missing
    assert files.supervised_cached(spark, root, df.limit(3), cfg, "v1").count() == 0
    rows = panel_of(spark, range(120), series="7")
    matrix = files.supervised_cached(spark, root, rows, cfg, "v1")
    assert matrix.count() == files.supervised_cached(spark, root, rows, cfg, "v1").count() > 0 and matrix.schema["id"].dataType == T.StringType()
    files.export_by(matrix.select("id", "horizon", "target"), ("id", "horizon"), f"{root}/out")
    assert spark.read.option("header", True).csv(f"{root}/out").count() == matrix.count()
    assert files.config_of({"n_folds": "3", "gone": "1"}) == Config(n_folds=3)


def test_digest_ignores_docstrings():
    def one(x):
        """This."""
        return x + 1

    first = files.code_digest(one)

    def one(x):  # noqa: F811
        return x + 1

    assert files.code_digest(one) == first


def test_typed_rows_and_markdown(spark):
    df = spark.createDataFrame([("r", "s", "1", "2000-01-01", "normal", "1.5", None, "0", "2", "false")], "run_id string, id string, fold string, origin string, week_kind string, rmse string, mae string, bias string, rmsse string, unscored string")
    assert files.typed(df, "run_id string, fold int, rmse double, unscored boolean").schema.simpleString().endswith("unscored:boolean>")
    assert [len(T._parse_datatype_string(x).fields) for x in (registry.RUN, registry.FOLD_SCORE)] == [37, 15]
    assert "| r | s |" in files.markdown(df.select("run_id", "id"))


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    ordered = events.orderBy("ts")
    half = ordered.agg(F.expr("percentile_approx(ts, 0.5)")).first()[0]
    folder = str(tmp_path / "events")
    events.filter(F.col("ts") <= F.lit(half)).coalesce(1).write.parquet(f"{folder}/1")
    events.filter(F.col("ts") > F.lit(half)).coalesce(1).write.parquet(f"{folder}/2")
    stream = hourly.hourly_totals(hourly.read_stream(spark, f"{folder}/*", ", ".join(f"`{n}` {k}" for n, k in events.dtypes)))
    q = stream.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    key = lambda r: (r["hour"], r["event_type"], r["n"], round(r["total"] or 0, 6))
    assert sorted(map(key, spark.table("hours").collect())) == sorted(map(key, hourly.hourly_totals(events).collect()))
