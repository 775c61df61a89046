"""Fold scores, and the tables made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import BENCHMARKS, KEYS

REFERENCE = "seasonal_naive"
WEEK_KINDS = ("normal", "holiday")


def score_folds(predictions: DataFrame) -> DataFrame:
    """One row per (id, fold, method): rmse, mae, bias (forecast - actual), rmsse, and why a fold is unscored.

    Closed days are left out. A missing forecast voids all metrics of the fold; a missing or zero scale
    voids rmsse. n_days counts the days left.
    """
    e = F.col("forecast") - F.col("actual")
    whole = F.count(e) == F.count("*")
    scale = F.first("scale")
    rows = predictions.filter(~F.col("closure")).groupBy(*KEYS).agg(
        F.when(whole, F.sqrt(F.avg(e * e))).alias("rmse"), F.when(whole, F.avg(F.abs(e))).alias("mae"), F.when(whole, F.avg(e)).alias("bias"),
        F.when(whole & (scale > 0), F.sqrt(F.avg(e * e)) / scale).alias("rmsse"), F.bool_or("fallback").alias("fallback"), F.count("*").alias("n_days"), F.avg("actual").alias("mean_actual"),
    )
    return rows.withColumn("unscored", F.col("rmsse").isNull())


def weeks(scores: DataFrame, kind: str | None) -> DataFrame:
    if kind is not None and kind not in WEEK_KINDS:
        raise ValueError(f"week_kind must be None or one of {WEEK_KINDS}")
    return scores if kind is None else scores.filter(F.col("week_kind") == kind)


def rmsse_by_store(scores: DataFrame, kind: str | None = None) -> DataFrame:
    """(store_id, method, rmsse, store_level, method_level): means; levels order stores and methods."""
    cells = weeks(scores, kind).groupBy("store_id", "method").agg(F.avg("rmsse").alias("rmsse"), F.avg("mean_actual").alias("_level"))
    return cells.select("store_id", "method", "rmsse", F.avg("_level").over(Window.partitionBy("store_id")).alias("store_level"), F.avg("rmsse").over(Window.partitionBy("method")).alias("method_level"))


def paired(scores: DataFrame, others: tuple[str, ...]) -> DataFrame:
    """Every method's folds beside those of other methods: (id, fold, method, m, other, b), both scored."""
    left = scores.filter("rmsse is not null").select("id", "fold", "method", F.col("rmsse").alias("m"))
    right = scores.filter(F.col("method").isin(*others) & F.col("rmsse").isNotNull()).select("id", "fold", F.col("method").alias("other"), F.col("rmsse").alias("b"))
    return left.join(right, ["id", "fold"]).filter("method <> other")


def win_rates(scores: DataFrame, kind: str | None = None, benchmarks: tuple[str, ...] = BENCHMARKS) -> DataFrame:
    """(method, one column per benchmark): share of paired folds that the method wins; null against itself."""
    won = paired(weeks(scores, kind), benchmarks).groupBy("method").pivot("other", list(benchmarks))
    return won.agg(F.avg((F.col("m") < F.col("b")).cast("double")))


def gain() -> Column:
    """Percent by which m is less than b, null where b is not above 0."""
    return F.when(F.col("b") > 0, (F.col("b") - F.col("m")) / F.col("b") * 100)


def gain_columns() -> list[Column]:
    quartile = F.percentile("gain", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [
        F.avg((F.col("m") < F.col("b")).cast("double")).alias("win_rate"), F.avg("gain").alias("gain_mean"), quartile[0].alias("gain_q1"), quartile[1].alias("gain_median"),
        quartile[2].alias("gain_q3"), F.count("*").alias("n_folds"), F.count_if(F.col("gain").isNull()).alias("n_undefined"),
    ]


def improvement_over(scores: DataFrame, benchmark: str = REFERENCE, kind: str | None = None) -> DataFrame:
    """Win rate and gain of each method over one benchmark, on folds where both are scored."""
    if benchmark not in BENCHMARKS and scores.filter(F.col("method") == benchmark).isEmpty():
        raise ValueError(f"unknown benchmark {benchmark!r}")
    return paired(weeks(scores, kind), (benchmark,)).withColumn("gain", gain()).groupBy("method").agg(*gain_columns())


def summarise(scores: DataFrame, by: tuple[str, ...] = ("method", "kind")) -> DataFrame:
    """One row per method, or other keys (one called n_folds comes out as _n_folds): mean and median rmsse, bias, counts (n_folds includes unscored ones, n_valid not), and by week kind."""
    by_kind = []
    for k in WEEK_KINDS:
        of = F.when(F.col("week_kind") == k, F.col("rmsse"))
        by_kind += [F.avg(of).alias(f"rmsse_{k}"), F.count(of).alias(f"n_{k}")]
    return scores.groupBy(*(F.col(c).alias("_n_folds" if c == "n_folds" else c) for c in by)).agg(
        F.avg("rmsse").alias("rmsse_mean"), F.percentile("rmsse", F.lit(0.5)).alias("rmsse_median"), F.avg("bias").alias("bias_mean"), F.count("*").alias("n_folds"),
        F.count("rmsse").alias("n_valid"), F.count_if("unscored").alias("n_unscored"), F.count_if("fallback").alias("n_fallback"), *by_kind,
    )


def rmsse_by_horizon(predictions: DataFrame) -> DataFrame:
    """Root mean square scaled error by method and horizon, pooled over series."""
    e = F.try_divide(F.col("forecast") - F.col("actual"), F.when(F.col("scale") > 0, F.col("scale")))
    return predictions.filter(~F.col("closure")).groupBy("method", "kind", "horizon").agg(F.sqrt(F.avg(e * e)).alias("rmsse"))


def bias_by_store(scores: DataFrame) -> DataFrame:
    return scores.groupBy("store_id").pivot("method", list(BENCHMARKS)).agg(F.avg("bias"))


def weekly_absolute_error(predictions: DataFrame, by_store: bool = False) -> DataFrame:
    """Mean over folds of the absolute error of the week's total, in units."""
    totals = predictions.filter(~F.col("closure")).groupBy("id", "store_id", "fold", "method").agg(F.abs(F.sum("forecast") - F.sum("actual")).alias("e"))
    return totals.groupBy(*(["store_id"] if by_store else []), "method").agg(F.avg("e").alias("weekly_mae"), F.count("*").alias("n_weeks"))


def pair(scores: DataFrame, a: str, b: str) -> DataFrame:
    """One row: method a against b - share of folds won, median gain, and series won on mean rmsse."""
    folds = paired(scores.filter(F.col("method").isin(a, b)), (b,)).withColumn("gain", gain())
    series = folds.groupBy("id").agg((F.avg("m") < F.avg("b")).cast("long").alias("won")).agg(F.sum("won").alias("series_won"), F.count("*").alias("n_series"))
    head = folds.agg(F.avg((F.col("m") < F.col("b")).cast("double")).alias("win_rate"), F.percentile("gain", F.lit(0.5)).alias("gain_median"), F.count("*").alias("n_folds"))
    return head.join(F.broadcast(series)).select(F.lit(a).alias("method"), F.lit(b).alias("other"), "win_rate", "gain_median", "n_folds", "series_won", "n_series")


def pairs(scores: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """pair() for many pairs in one pass."""
    test = F.lit(False)
    for a, b in wanted:
        test = test | ((F.col("method") == a) & (F.col("other") == b))
    folds = paired(scores, tuple(sorted({b for _, b in wanted}))).filter(test).withColumn("gain", gain())
    series = folds.groupBy("method", "other", "id").agg((F.avg("m") < F.avg("b")).cast("long").alias("won")).groupBy("method", "other").agg(F.sum("won").alias("series_won"), F.count("*").alias("n_series"))
    head = folds.groupBy("method", "other").agg(F.avg((F.col("m") < F.col("b")).cast("double")).alias("win_rate"), F.percentile("gain", F.lit(0.5)).alias("gain_median"), F.count("*").alias("n_folds"))
    return head.join(series, ["method", "other"])


def ladder(scores: DataFrame, rungs: tuple[str, ...]) -> DataFrame:
    """Each rung against the one before and against the first."""
    wanted = list(zip(rungs[1:], rungs[:-1], strict=True))
    return pairs(scores, wanted + [(r, rungs[0]) for r in rungs[2:]])


def matrix(scores: DataFrame, methods: tuple[str, ...], baselines: tuple[str, ...]) -> DataFrame:
    """All methods against all baselines."""
    return pairs(scores, [(m, b) for m in methods for b in baselines if m != b])


def scores_by_class(scores: DataFrame, classes: DataFrame) -> DataFrame:
    """Mean rmsse by demand class and method; classes has one row per id."""
    return scores.join(classes.select("id", "demand_class"), "id").groupBy("demand_class", "method").agg(F.avg("rmsse").alias("rmsse"), F.count("rmsse").alias("n_valid"))


def forecast_difference(a: DataFrame, b: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """One row: shared rows, share of equal forecasts, largest difference, and the span of days that differ."""
    both = a.select("id", "fold", "horizon", "target_date", F.col("forecast").alias("fa")).join(b.select("id", "fold", "horizon", F.col("forecast").alias("fb")), ["id", "fold", "horizon"])
    d = F.abs(F.col("fa") - F.col("fb"))
    same = d <= tolerance
    return both.agg(
        F.count("*").alias("n_rows"), F.avg(same.cast("double")).alias("identical_share"), F.max(d).alias("max_abs_diff"),
        F.min(F.when(~same, F.col("target_date"))).alias("first_diff"), F.max(F.when(~same, F.col("target_date"))).alias("last_diff"),
    )


def scale_change(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, scale_a, scale_b, change_pct): how much a series' scale moved between two prediction tables."""
    of = [x.groupBy("id").agg(F.min("scale").alias(f"scale_{n}")) for x, n in ((a, "a"), (b, "b"))]
    return of[0].join(of[1], "id").withColumn("change_pct", (F.try_divide("scale_b", "scale_a") - 1) * 100)


def identity_gate(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two prediction tables have the same keys, the rows only in one, and their largest difference."""
    keys = ["id", "fold", "method", "horizon"]
    both = a.select(*keys, F.col("forecast").alias("fa"), F.lit(1).alias("ina")).join(b.select(*keys, F.col("forecast").alias("fb"), F.lit(1).alias("inb")), keys, "full")
    return both.agg(
        F.count_if(F.col("inb").isNull()).alias("only_a"), F.count_if(F.col("ina").isNull()).alias("only_b"), F.max(F.abs(F.col("fa") - F.col("fb"))).alias("max_abs_diff"),
    ).withColumn("verdict", F.when((F.col("only_a") + F.col("only_b")) > 0, "ROW MISMATCH").when(F.col("max_abs_diff") <= 1e-9, "IDENTICAL").otherwise("DIFFERENT"))
