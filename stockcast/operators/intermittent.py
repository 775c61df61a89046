"""Forecasts of items that sell on few days: Croston's method, its corrected form, and the smoothing of sizes and odds.

A series is folded once, day by day, by an ``aggregate`` over its sorted array; the state of the days that are a fold's origin is
kept, so all folds share the fold. Sizes z and intervals p are smoothed on days with sales, the odds d of a sale on every day from
the first sale on. A group is one series; its array has one small entry a day.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from . import fit
from .folds import fold_of

#: Smoothing of sizes and intervals, and of the odds of a sale.
SIZES, ODDS = 0.1, 0.05
METHODS = ("croston", "croston_sba", "tsb")
#: Which method serves which class of demand.
ROUTES = {"smooth": "moving_average_28", "erratic": "mean", "intermittent": "croston_sba", "lumpy": "tsb", "unclassifiable": "mean"}


def states(panel: DataFrame, cfg: Config, last: date, sizes: float = SIZES, odds: float = ODDS) -> DataFrame:
    """(id, fold, z, p, d): smoothed size and interval of sales and odds of one, at each fold's origin; null before the first sale."""
    day = F.struct("date", F.col("sales").cast("double").alias("sales"), fold_of(F.col("date"), cfg, last).alias("fold"))
    series = panel.groupBy("id").agg(F.array_sort(F.collect_list(day)).alias("days"))
    double = F.lit(None).cast("double")
    start = F.struct(double.alias("z"), double.alias("p"), double.alias("d"), F.lit(1.0).alias("q"), F.array().cast("array<struct<fold: bigint, z: double, p: double, d: double>>").alias("kept"))

    def smoothed(old: Column, new: Column, weight: float) -> Column:
        return F.when(old.isNull(), new).otherwise(old + weight * (new - old))

    def step(s: Column, x: Column) -> Column:
        sold = x["sales"] > 0
        z = F.when(sold, smoothed(s["z"], x["sales"], sizes)).otherwise(s["z"])
        p = F.when(sold, smoothed(s["p"], s["q"], sizes)).otherwise(s["p"])
        d = F.when(s["d"].isNull(), F.when(sold, 1 / s["q"])).otherwise(smoothed(s["d"], sold.cast("double"), odds))
        q = F.when(sold, F.lit(1.0)).otherwise(s["q"] + 1)
        kept = F.when(x["fold"].isNotNull(), F.concat(s["kept"], F.array(F.struct(x["fold"].alias("fold"), z.alias("z"), p.alias("p"), d.alias("d"))))).otherwise(s["kept"])
        return F.struct(z.alias("z"), p.alias("p"), d.alias("d"), q.alias("q"), kept.alias("kept"))

    return series.select("id", F.inline(F.aggregate("days", start, step, lambda s: s["kept"])))


def forecasts(panel: DataFrame, cfg: Config, last: date, methods: tuple[str, ...] = METHODS, sizes: float = SIZES, odds: float = ODDS) -> DataFrame:
    """(id, fold, method, horizon, forecast, fallback): the same rate on every day ahead; 0 before the first sale."""
    if unknown := set(methods) - set(METHODS):
        raise ValueError(f"unknown methods {sorted(unknown)}")
    rate = F.col("z") / F.col("p")
    made = {"croston": rate, "croston_sba": rate * (1 - sizes / 2), "tsb": F.col("d") * F.col("z")}
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.coalesce(made[m], F.lit(0.0)).alias("forecast")) for m in methods)))
    rows = states(panel, cfg, last, sizes, odds).select("id", "fold", each.alias("m"))
    return rows.select("id", "fold", "m.method", F.explode(F.sequence(F.lit(1), F.lit(cfg.test_window))).alias("horizon"), "m.forecast", F.lit(False).alias("fallback"))


def predictions(panel: DataFrame, cfg: Config, last: date, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """The forecasts beside actuals, in the form of walk_forward."""
    return fit.predictions(panel, cfg, last, forecasts(panel, cfg, last, methods))


def routed(predictions: DataFrame, stats: DataFrame, routes: dict[str, str] = ROUTES, name: str = "routed") -> DataFrame:
    """Of each series the rows of the method that its demand class is routed to, as one method."""
    method = F.create_map(*(F.lit(x) for pair in routes.items() for x in pair))[F.col("demand_class")]
    chosen = stats.select("id", method.alias("method"))
    return predictions.join(chosen, ["id", "method"], "left_semi").withColumn("method", F.lit(name))
