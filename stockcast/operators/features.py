"""Leak-free forecast features: everything is known on the origin's day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import calendar
from .panel import by_series, rows_between

#: Lags counted from the origin (1 is the origin's own day), rolling windows, weekday occurrences, days before the first origin.
LAGS, WINDOWS, OCCURRENCES, MIN_HISTORY = (1, 2, 3, 7, 14, 21, 28), (7, 28, 56), (4, 8), 56
#: Fixed value: days over which a training row's weight halves.
HALF_LIFE = 365
ORIGIN_FEATURES = tuple(f"lag_{k}" for k in LAGS) + tuple(f"roll_{s}_{w}" for w in WINDOWS for s in ("mean", "std")) + ("trend_7_56",)
TARGET_FEATURES = ("dow", "is_weekend", "day_of_month", "month", "day_of_year", "snap", "is_event", "is_holiday", "days_to_holiday", "days_since_holiday")
WEEKDAY_FEATURES = tuple(f"dow_mean_{k}" for k in OCCURRENCES)


def origin_features() -> dict[str, Column]:
    """Lags and rolling statistics ending at the row's day."""
    out = {f"lag_{k}": F.lag("sales", k - 1).over(by_series()) for k in LAGS}
    for w in WINDOWS:
        out[f"roll_mean_{w}"] = F.avg("sales").over(rows_between(w))
        out[f"roll_std_{w}"] = F.stddev_samp("sales").over(rows_between(w))
    out["trend_7_56"] = F.try_divide(F.avg("sales").over(rows_between(7)), F.avg("sales").over(rows_between(56))) - 1
    return out


def weekday_means() -> dict[str, Column]:
    """Mean of the last occurrences of the row's weekday, the row included."""
    w = Window.partitionBy("id", F.weekday("date")).orderBy("date")
    return {f"dow_mean_{k}": F.avg("sales").over(w.rowsBetween(-(k - 1), 0)) for k in OCCURRENCES}


def with_origin_features(df: DataFrame) -> DataFrame:
    return df.withColumns(origin_features())


def with_weekday_means(df: DataFrame) -> DataFrame:
    return df.withColumns(weekday_means())


def supervised(panel: DataFrame, horizon: int, use_price: bool = False) -> DataFrame:
    """Training rows: (id, origin_date, horizon) with features, target_date and target.

    Origins are rows with MIN_HISTORY rows before them and a full horizon after. The weekday means are those of
    the target's weekday, read at its last occurrence by the origin. Two equi joins on (id, date).
    """
    whole = Window.partitionBy("id")
    rows = panel.withColumns(origin_features()).withColumns({"_i": F.row_number().over(by_series()) - 1, "_n": F.count("*").over(whole)})
    rows = rows.filter((F.col("_i") >= MIN_HISTORY) & (F.col("_i") <= F.col("_n") - horizon - 1))
    origins = rows.select("id", "item_id", "store_id", F.col("date").alias("origin_date"), *ORIGIN_FEATURES)
    spread = origins.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    spread = spread.withColumn("target_date", F.date_add("origin_date", F.col("horizon")))
    back = (F.ceil(F.col("horizon") / 7) * 7 - F.col("horizon")).cast("int")
    spread = spread.withColumn("_seen", F.date_sub("origin_date", back))
    day = calendar.day_features()
    target = panel.select("id", F.col("date").alias("target_date"), F.col("sales").alias("target"), *(day[c].alias(c) if c in day else F.col(c) for c in TARGET_FEATURES), *(["sell_price"] if use_price else []))
    means = panel.withColumns(weekday_means()).select("id", F.col("date").alias("_seen"), *WEEKDAY_FEATURES)
    return spread.join(target, ["id", "target_date"]).join(means, ["id", "_seen"]).drop("_seen")


def relative_target(rows: DataFrame) -> DataFrame:
    """Adds the target's distance from its origin's 28-day level."""
    return rows.withColumn("relative", F.col("target") - F.col("roll_mean_28"))


def recency_weight(rows: DataFrame, origin: Column) -> DataFrame:
    """Adds weight, halved for each HALF_LIFE days between target and origin."""
    return rows.withColumn("weight", F.pow(F.lit(0.5), F.datediff(origin, "target_date") / HALF_LIFE))


def trainable(rows: DataFrame, origin: Column) -> DataFrame:
    """Rows whose target is known at the origin."""
    return rows.filter(F.col("target_date") <= origin)


def fit_and_tail(rows: DataFrame, origin: Column, tail_days: int = 90) -> DataFrame:
    """Marks the rows to fit on; the others, the last tail_days by target, decide when to stop."""
    return rows.withColumn("is_fit", F.col("target_date") <= F.date_sub(origin, tail_days))


def regressors(df: DataFrame) -> DataFrame:
    """Adds the regressors of the seasonal model: is_holiday, pre_holiday, snap."""
    return df.withColumns({"x_holiday": F.col("is_holiday").cast("double"), "x_pre_holiday": F.col("days_to_holiday").between(1, calendar.BEFORE).cast("double"), "x_snap": F.col("snap").cast("double")})
