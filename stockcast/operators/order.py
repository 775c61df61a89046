"""From forecasts to order quantiles: weekly totals, calibrated offsets, pinball scores.

Signs: an error here is actual - forecast; a bias elsewhere is forecast - actual.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import KEYS
from .scoring import weeks

TAUS = (0.3, 0.5, 0.7, 0.9)
DAY_KEYS = ("id", "store_id", "fold", "origin", "week_kind", "horizon", "target_date")
#: The families of fitted quantile methods, by the level in their name.
QUANTILE_METHODS = {"xgboost_q30": 0.3, "xgboost_q50": 0.5, "xgboost_q70": 0.7, "xgboost_q90": 0.9}
FAMILY = "xgboost"


def weekly_totals(predictions: DataFrame) -> DataFrame:
    """Sums per (id, fold, method) without closed days; null if a forecast is missing."""
    whole = F.count("forecast") == F.count("*")
    rows = predictions.filter(~F.col("closure")).groupBy(*KEYS).agg(F.sum("actual").alias("actual"), F.when(whole, F.sum("forecast")).alias("forecast"), F.count("*").alias("n_days"), F.first("scale").alias("scale"))
    return rows.withColumn("error", F.col("actual") - F.col("forecast"))


def weekly_bias(weekly: DataFrame) -> DataFrame:
    return weekly.groupBy("method", "kind").agg(
        (-F.avg("error")).alias("bias"), F.stddev_samp("error").alias("sd"), F.avg((F.col("error") > 0).cast("double")).alias("share_under"), F.count("error").alias("n_weeks"),
    )


def _each_level(rows: DataFrame, keys: tuple[str, ...], taus: tuple[float, ...]) -> DataFrame:
    """One row per level from an array of quantiles _q."""
    each = rows.select(*keys, "n_calib", F.posexplode("_q").alias("_k", "offset"))
    return each.select(*keys, F.element_at(F.array(*map(F.lit, taus)), F.col("_k") + 1).alias("tau"), "offset", "n_calib")


def calibrate(weekly: DataFrame, scored_from: date, taus: tuple[float, ...] = TAUS, keys: tuple[str, ...] = ("id", "method")) -> DataFrame:
    """(keys, tau, offset, n_calib): interpolated quantiles of the errors of folds before scored_from."""
    past = weekly.filter((F.col("origin") < F.lit(scored_from)) & F.col("error").isNotNull())
    rows = past.groupBy(*keys).agg(F.percentile("error", F.array(*map(F.lit, taus))).alias("_q"), F.count("*").alias("n_calib"))
    return _each_level(rows, keys, taus)


def calibrate_expanding(weekly: DataFrame, scored_from: date, test_window: int = 7, taus: tuple[float, ...] = TAUS) -> DataFrame:
    """(id, method, fold, tau, offset, n_calib) for folds from scored_from on, from the errors of all earlier
    folds whose week is over at the fold's origin."""
    day = F.datediff("origin", F.lit("1970-01-01").cast("date"))
    over = Window.partitionBy("id", "method").orderBy("_day").rangeBetween(Window.unboundedPreceding, -test_window)
    rows = weekly.filter("error is not null").withColumn("_day", day)
    rows = rows.withColumn("_q", F.percentile("error", F.array(*map(F.lit, taus))).over(over)).withColumn("n_calib", F.count("*").over(over))
    rows = rows.filter((F.col("origin") >= F.lit(scored_from)) & (F.col("n_calib") > 0))
    return _each_level(rows, ("id", "method", "fold"), taus)


def quantile_forecasts(weekly: DataFrame, offsets: DataFrame, scored_from: date) -> DataFrame:
    """Scored weeks with q = forecast + offset for each level; q is not clipped."""
    keys = ["id", "method", "fold"] if "fold" in offsets.columns else ["id", "method"]
    scored = weekly.filter(F.col("origin") >= F.lit(scored_from))
    return scored.join(offsets, keys).withColumn("q", F.col("forecast") + F.col("offset"))


def pinball(actual: Column, q: Column, tau: Column) -> Column:
    """Pinball loss, twice the usual, so that the median's is the absolute error."""
    d = actual - q
    return F.when(d >= 0, 2 * tau * d).otherwise(2 * (1 - tau) * -d)


def score_quantiles(rows: DataFrame) -> DataFrame:
    """Adds pinball, pinball_rel (over the series' mean actual in these rows), covered, shortfall and surplus."""
    loss = pinball(F.col("actual"), F.col("q"), F.col("tau"))
    level = F.avg("actual").over(Window.partitionBy("id"))
    zero = F.lit(0.0)
    return rows.withColumns({
        "pinball": loss, "pinball_rel": F.try_divide(loss, level), "covered": F.col("actual") <= F.col("q"),
        "shortfall": F.greatest(F.col("actual") - F.col("q"), zero), "surplus": F.greatest(F.col("q") - F.col("actual"), zero),
    })


def summarise_quantiles(scored: DataFrame, week_kind: str | None = None, by: tuple[str, ...] = ("method", "kind", "tau")) -> DataFrame:
    return weeks(scored, week_kind).groupBy(*by).agg(
        F.avg("pinball").alias("pinball"), F.avg("pinball_rel").alias("pinball_rel"), F.avg(F.col("covered").cast("double")).alias("coverage"),
        F.avg("shortfall").alias("shortfall"), F.avg("surplus").alias("surplus"), F.count("*").alias("n"),
    )


def tau_lines(summary: DataFrame, method: str) -> DataFrame:
    """(tau, pinball_rel, coverage) of one method, by level."""
    return summary.filter(F.col("method") == method).select("tau", "pinball_rel", "coverage").orderBy("tau")


def ranking_by_tau(summary: DataFrame, by: str = "method", taus: tuple[float, ...] = TAUS) -> DataFrame:
    """(by, one column per level): mean relative pinball; the 0.5 column orders the methods."""
    named = summary.withColumn("_t", F.concat(F.lit("q"), F.round(F.col("tau") * 100).cast("int").cast("string")))
    return named.groupBy(by).pivot("_t", [f"q{round(t * 100)}" for t in taus]).agg(F.avg("pinball_rel"))


def daily_calibrated(predictions: DataFrame, scored_from: date, methods: tuple[str, ...], taus: tuple[float, ...] = TAUS) -> DataFrame:
    """Daily quantiles from point forecasts: offsets by (id, method, horizon, tau)."""
    rows = predictions.filter(~F.col("closure") & F.col("method").isin(*methods)).withColumn("error", F.col("actual") - F.col("forecast"))
    offsets = calibrate(rows, scored_from, taus, ("id", "method", "horizon"))
    scored = rows.filter(F.col("origin") >= F.lit(scored_from)).join(offsets, ["id", "method", "horizon"])
    return scored.select(*DAY_KEYS, "method", "kind", "tau", "actual", "forecast", (F.col("forecast") + F.col("offset")).alias("q"), F.lit("calibrated").alias("source"))


def daily_native(predictions: DataFrame, levels: dict[str, float] = QUANTILE_METHODS, family: str = FAMILY) -> DataFrame:
    """Daily quantiles that methods forecast themselves, one method per level."""
    tau = F.create_map(*[F.lit(x) for pair in levels.items() for x in pair])[F.col("method")]
    rows = predictions.filter(~F.col("closure") & F.col("method").isin(*levels)).withColumn("tau", tau)
    return rows.select(*DAY_KEYS, F.lit(family).alias("method"), "kind", "tau", "actual", F.lit(None).cast("double").alias("forecast"), F.col("forecast").alias("q"), F.lit("fitted").alias("source"))


def weekly_native(daily: DataFrame) -> DataFrame:
    """Weekly rows from daily quantiles: sums per fold and level."""
    keys = ["id", "store_id", "fold", "origin", "week_kind", "method", "kind", "tau"]
    return daily.groupBy(*keys).agg(F.sum("actual").alias("actual"), F.when(F.count("q") == F.count("*"), F.sum("q")).alias("q"), F.count("*").alias("n_days"))


def order_band(quantiles: DataFrame) -> DataFrame:
    """(id, method, origin, day, week_kind, actual, one column per level): the band around each week's total."""
    named = quantiles.withColumn("_t", F.concat(F.lit("q"), F.round(F.col("tau") * 100).cast("int").cast("string")))
    rows = named.groupBy("id", "method", "origin", "week_kind", "actual").pivot("_t", [f"q{round(t * 100)}" for t in TAUS]).agg(F.avg("q"))
    return rows.withColumn("day", F.date_add("origin", 1))
