"""Walk-forward evaluation as windows and one equi join: fold layout, benchmarks at the origins, actuals.

History facts are window values at the origin's row, so no row is copied per fold; each fold's targets are
the origin row's exploded horizon joined to the panel on (id, date).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from . import calendar
from .panel import by_series, rows_between

BENCHMARKS = ("mean", "naive", "seasonal_naive", "drift", "moving_average_28", "seasonal_naive_364")
KEYS = ("id", "item_id", "store_id", "fold", "origin", "week_kind", "method", "kind")


def layout(spark: SparkSession, cfg: Config, last: date) -> DataFrame:
    """(fold, origin): one row per fold."""
    first = cfg.origins(last)[0]
    return spark.range(cfg.n_folds).select(F.col("id").alias("fold"), F.date_add(F.lit(first), (F.col("id") * cfg.fold_step).cast("int")).alias("origin"))


def fold_of(day: Column, cfg: Config, last: date) -> Column:
    """The fold whose origin a day is, or null."""
    gap = F.datediff(day, F.lit(cfg.origins(last)[0]))
    return F.when((gap >= 0) & (gap % cfg.fold_step == 0) & (gap <= (cfg.n_folds - 1) * cfg.fold_step), (gap / cfg.fold_step).cast("long"))


def seasonal_lag(horizon: int, season: int) -> int:
    """Days before the origin of the value that a seasonal forecast for the horizon repeats."""
    return season - 1 - (horizon - 1) % season


def benchmark_columns(cfg: Config) -> dict[str, Column]:
    """Window values at the origin's row that the benchmarks need, all over one ordering of the series."""
    w = by_series()
    whole = w.rowsBetween(Window.unboundedPreceding, 0)
    h = range(1, cfg.horizon + 1)
    return {
        "n_history": F.count("*").over(whole),
        "_mean": F.avg("sales").over(whole),
        "_first": F.first("sales").over(whole),
        "_ma28": F.avg("sales").over(rows_between(28)),
        "_season": F.array(*(F.lag("sales", seasonal_lag(k, cfg.season)).over(w) for k in h)),
        "_year": F.array(*(F.lag("sales", 364 - k).over(w) for k in h)),
    }


def benchmarks(cfg: Config) -> dict[str, Column]:
    """Forecast by method, from a row with the window values of its origin, sales (at the origin) and horizon."""
    at = F.col("horizon").cast("int")
    season = F.when(F.col("n_history") >= cfg.season, F.element_at("_season", at)).otherwise(F.col("sales"))
    slope = F.try_divide(F.col("sales") - F.col("_first"), F.col("n_history") - 1)
    return {
        "mean": F.col("_mean"),
        "naive": F.col("sales"),
        "seasonal_naive": season,
        "drift": F.when(F.col("n_history") < 2, F.col("sales")).otherwise(F.col("sales") + F.col("horizon") * slope),
        "moving_average_28": F.col("_ma28"),
        "seasonal_naive_364": F.when(F.col("n_history") >= 364, F.element_at("_year", at)).otherwise(season),
    }


def naive_scale(df: DataFrame, cfg: Config, last: date) -> DataFrame:
    """(id, scale): root mean square of the lagged difference before the holdout; null for short series."""
    d = F.col("sales") - F.lag("sales", cfg.rmsse_scale_lag).over(by_series())
    before = df.filter(F.col("date") < F.lit(cfg.holdout_start(last)))
    return before.withColumn("_d", d).groupBy("id").agg(F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("scale"))


def origin_rows(panel: DataFrame, cfg: Config, last: date) -> DataFrame:
    """One row per series and fold, with history facts, the scale and the benchmarks' window values."""
    w = by_series()
    d = F.col("sales") - F.lag("sales", cfg.rmsse_scale_lag).over(w)
    facts = panel.withColumn("_d2", d * d).withColumns(benchmark_columns(cfg))
    if cfg.rmsse_scale_window == "per_fold":
        scale = F.sqrt(F.avg("_d2").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        before = F.when(F.col("date") < F.lit(cfg.holdout_start(last)), F.col("_d2"))
        scale = F.sqrt(F.avg(before).over(Window.partitionBy("id")))
    facts = facts.withColumn("scale", scale).withColumn("fold", fold_of(F.col("date"), cfg, last))
    return facts.filter("fold is not null").withColumnRenamed("date", "origin")


def fold_targets(panel: DataFrame, cfg: Config, last: date) -> DataFrame:
    """Eligible folds with their targets: one row per (id, fold, horizon), the actual and its day's facts.

    A fold counts if its history has min_train_days rows and all test_window targets exist.
    """
    origins = origin_rows(panel, cfg, last).drop("closure", "is_holiday", "days_to_holiday", "days_since_holiday", "event_name_1", "event_name_2", "snap", "is_filled")
    spread = origins.filter(F.col("n_history") >= cfg.min_train_days).withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(cfg.test_window))))
    spread = spread.withColumn("target_date", F.date_add("origin", F.col("horizon")))
    actual = panel.select(F.col("id"), F.col("date").alias("target_date"), F.col("sales").alias("actual"), "closure", calendar.in_holiday_window().alias("holiday_window"))
    whole = Window.partitionBy("id", "fold")
    joined = spread.join(actual, ["id", "target_date"])
    joined = joined.withColumn("_n", F.count("*").over(whole)).filter(F.col("_n") == cfg.test_window)
    return joined.withColumn("week_kind", F.when(F.bool_or("holiday_window").over(whole), "holiday").otherwise("normal"))


def walk_forward(panel: DataFrame, cfg: Config, last: date, methods: tuple[str, ...] = BENCHMARKS) -> DataFrame:
    """Predictions of the benchmarks, long: one row per (id, fold, method, horizon)."""
    if unknown := set(methods) - set(BENCHMARKS):
        raise ValueError(f"unknown methods {sorted(unknown)}")
    made = benchmarks(cfg)
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), made[m].alias("forecast")) for m in methods)))
    rows = fold_targets(panel, cfg, last).withColumn("_f", each)
    return rows.select(
        "id", "item_id", "store_id", "fold", "origin", "week_kind", F.col("_f.method").alias("method"), F.lit("benchmark").alias("kind"), "horizon", "target_date",
        "actual", F.col("_f.forecast").alias("forecast"), "scale", "closure", "holiday_window", F.lit(False).alias("fallback"),
    )


def assert_no_leakage(folds: DataFrame) -> DataFrame:
    """Rows (id, fold, last_history, first_target) fail if history passes the origin or a target does not."""
    bad = folds.filter((F.col("last_history") > F.col("origin")) | (F.col("first_target") <= F.col("origin"))).limit(1).collect()
    if bad:
        raise ValueError(f"fold {bad[0]['fold']} of {bad[0]['id']} sees beyond its origin")
    return folds
