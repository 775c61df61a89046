"""Calibration from mergeable quantile sketches, for keys with more errors than a window should hold.

The errors of a key and day become one sketch of bounded size, in the tasks that read them; the sketches of earlier days are merged as a
window moves over a key's days. So a key costs its days, not its errors, and sketches of different days, runs or series may be merged
later on. A sketch of size k is exact up to k errors; beyond, the rank of a quantile is off by some 1.9 / k of all errors (with odds of 99 %).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import TAUS, _each_level, calibrate_expanding

SIZE = 400


def error_sketches(weekly: DataFrame, keys: tuple[str, ...] = ("id", "method"), size: int = SIZE) -> DataFrame:
    """(keys, fold, origin, sketch, n): one sketch of the errors of each key and fold."""
    rows = weekly.filter(F.col("error").isNotNull())
    return rows.groupBy(*keys, "fold", "origin").agg(F.kll_sketch_agg_double("error", F.lit(size)).alias("sketch"), F.count("*").alias("n"))


def expanding(sketches: DataFrame, scored_from: date, keys: tuple[str, ...] = ("id", "method"), test_window: int = 7, taus: tuple[float, ...] = TAUS, size: int = SIZE) -> DataFrame:
    """(keys, fold, tau, offset, n_calib): least errors of at least that rank among those of folds whose week is over at the fold's origin."""
    over = Window.partitionBy(*keys).orderBy("_day").rangeBetween(Window.unboundedPreceding, -test_window)
    rows = sketches.withColumn("_day", F.unix_date("origin"))
    rows = rows.withColumns({"_merged": F.kll_merge_agg_double("sketch", F.lit(size)).over(over), "n_calib": F.sum("n").over(over)})
    rows = rows.filter((F.col("origin") >= F.lit(scored_from)) & (F.col("n_calib") > 0))
    return _each_level(rows.withColumn("_q", F.kll_sketch_get_quantile_double("_merged", F.array(*map(F.lit, taus)))), (*keys, "fold"), taus)


def calibrated(weekly: DataFrame, scored_from: date, most_exact: int, keys: tuple[str, ...] = ("id", "method"), test_window: int = 7, taus: tuple[float, ...] = TAUS, size: int = SIZE) -> DataFrame:
    """Expanding offsets, interpolated from all errors where no key has more than most_exact of them, else from sketches."""
    largest = weekly.filter(F.col("error").isNotNull()).groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= most_exact and keys == ("id", "method"):
        return calibrate_expanding(weekly, scored_from, test_window, taus)
    return expanding(error_sketches(weekly, keys, size), scored_from, keys, test_window, taus, size)
