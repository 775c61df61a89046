"""The gapless daily panel: grid, joins with checked keys, launch trim, closure fill, grid check."""

from __future__ import annotations

import warnings
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..sources import retail
from . import calendar

IDS = ("id", "item_id", "store_id", "state_id")


def by_series() -> Window:
    return Window.partitionBy("id").orderBy("date")


def unpivot_sales(wide: DataFrame, ids: list[str], prefix: str = "d_") -> DataFrame:
    """One row per series and day column (d, sales) from one row per series."""
    days = [c for c in wide.columns if c.startswith(prefix)]
    return wide.unpivot(ids, days, "d", "sales")


def select_series(df: DataFrame, cfg: Config) -> DataFrame:
    """Filters by the config's items, stores, department and category; an empty result is an error."""
    out = df
    for name, values in (("item_id", cfg.item_ids), ("store_id", cfg.store_ids)):
        out = out.filter(F.col(name).isin(*values)) if values else out
    for name in ("dept_id", "cat_id"):
        out = out.filter(F.col(name) == getattr(cfg, name)) if getattr(cfg, name) else out
    if cfg.subset() and out.isEmpty():
        raise ValueError(f"no series match {cfg.subset()}")
    return out


def join_dimension(facts: DataFrame, dimension: DataFrame, keys: list[str], small: bool = False) -> DataFrame:
    """Left join that fails if a key repeats in the dimension; small marks one bounded by the calendar."""
    n = F.count("*").over(Window.partitionBy(*keys))
    checked = dimension.withColumn("_n", n).withColumn("_one", F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{keys} repeats in the dimension")).cast("int"))).filter("_one is null")
    checked = checked.drop("_n", "_one")
    return facts.join(F.broadcast(checked) if small else checked, keys, "left")


def fill_grid(sales: DataFrame, last: date) -> DataFrame:
    """Every day from a series' first sale to the last date of all; days without a sale get 0 and is_filled."""
    spans = sales.groupBy(*IDS).agg(F.min("date").alias("_first"))
    days = spans.select(*IDS, F.explode(F.sequence("_first", F.lit(last))).alias("date"))
    joined = days.join(sales.select("id", "date", "sales"), ["id", "date"], "left")
    return joined.select(*IDS, "date", F.coalesce("sales", F.lit(0.0)).alias("sales"), F.col("sales").isNull().alias("is_filled"))


def trim_prelaunch(df: DataFrame, report: bool = False) -> DataFrame:
    """Rows from a series' first priced day on; series that never have a price go (with a warning if report)."""
    launch = F.min(F.when(F.col("sell_price").isNotNull(), F.col("date"))).over(Window.partitionBy("id"))
    if report:
        n = df.groupBy("id").agg(F.count("sell_price").alias("n")).filter("n = 0").count()
        if n:
            warnings.warn(f"{n} series never have a price and are dropped", stacklevel=2)
    return df.withColumn("_launch", launch).filter(F.col("date") >= F.col("_launch")).drop("_launch")


def impute_closures(df: DataFrame) -> DataFrame:
    """Sales of closed days become the mean of the same weekday 1 to 4 weeks before, without closed days and
    holiday windows; 0 if none is left. Needs a gapless grid. Other rows keep their sales."""
    ok = F.when(~F.col("closure") & ~calendar.in_holiday_window(), F.col("sales"))
    back = [F.lag("_ok", 7 * k).over(by_series()) for k in range(1, 5)]
    total = sum((F.coalesce(b, F.lit(0.0)) for b in back), F.lit(0.0))
    count = sum((b.isNotNull().cast("int") for b in back), F.lit(0))
    filled = F.coalesce(F.try_divide(total, count), F.lit(0.0))
    return df.withColumn("_ok", ok).withColumn("sales", F.when(F.col("closure"), filled).otherwise(F.col("sales"))).drop("_ok")


def grid_gaps(df: DataFrame) -> DataFrame:
    """Rows whose date is not the day after the series' previous row, repeated days included."""
    return df.withColumn("gap", F.datediff("date", F.lag("date").over(by_series()))).filter("gap <> 1").select("id", "date", F.col("gap").cast("long").alias("gap"))


def assert_daily_grid(df: DataFrame) -> DataFrame:
    bad = grid_gaps(df).limit(1).collect()
    if bad:
        raise ValueError(f"series {bad[0]['id']} has a gap or a repeated day at {bad[0]['date']}")
    return df


def load_panel(spark: SparkSession, sf_dir: str, kind: str = "dense", price: bool = False, trim: bool = False, impute: bool = True, cfg: Config | None = None, span: tuple[date, date] | None = None) -> DataFrame:
    """Sales on the full grid with calendar facts; closed days sell 0 and are imputed.

    Columns: id, item_id, dept_id, cat_id, store_id, state_id, date, sales, is_filled, event names, holiday
    distances, closure, snap, and sell_price if asked for. span: first and last day, if they are known.
    """
    rows = retail.lines(spark, sf_dir, kind)
    if cfg is not None:
        rows = select_series(rows.withColumns({"dept_id": F.col("item_id"), "cat_id": F.col("item_id")}), cfg).drop("dept_id", "cat_id")
    first, last = span or retail.date_span(spark, sf_dir)
    days = calendar.holiday_distance(calendar.day_frame(spark, first, last + timedelta(days=40)))
    df = fill_grid(retail.daily_sales(rows), last).join(F.broadcast(days), "date")
    df = calendar.snap_flag(df).withColumn("sales", F.when(F.col("closure"), 0.0).otherwise(F.col("sales")))
    df = df.withColumns({"dept_id": F.col("item_id"), "cat_id": F.col("item_id")})
    if price or trim:
        prices = retail.weekly_prices(rows)
        df = join_dimension(df.withColumn("week", F.trunc("date", "week")), prices, ["id", "week"]).drop("week")
    if trim:
        df = trim_prelaunch(df)
    return impute_closures(df) if impute else df


def profile(df: DataFrame) -> DataFrame:
    """One row: series, rows, first and last day, share of filled days, closed days, share of zero sales."""
    return df.agg(
        F.countDistinct("id").alias("n_series"), F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.round(F.avg(F.col("is_filled").cast("double")), 6).alias("filled_share"), F.count_if("closure").alias("n_closed"),
        F.round(F.avg((F.col("sales") == 0).cast("double")), 6).alias("zero_share"),
    )


def rows_between(back: int) -> Window:
    """The last rows of a series up to the current one."""
    return by_series().rowsBetween(-(back - 1), 0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, ints as longs: the form in which results are compared.

    Plain arithmetic, and a cut a little off the half, so that ties and last bits do not decide.
    """
    scale = 10.0**digits
    out: list[Column] = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append((F.floor(c * scale + 0.5001) / scale if kind == "double" else c.cast("long") if kind in ("int", "smallint", "tinyint") else c).alias(name))
    return df.select(*out)
