"""Profiles of demand: classes, runs of zeros, event effects, outliers, autocorrelation, price and calendar patterns."""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import by_series

#: Cuts between demand classes.
ADI_CUT, CV2_CUT = 1.32, 0.49
ROLL, LEAST, SPREAD = 28, 14, 4.0
EVENT_OFFSETS = (-2, -1, 0, 1)


def demand_class(adi: Column, cv2: Column) -> Column:
    slow, wild = adi >= ADI_CUT, cv2 >= CV2_CUT
    return (
        F.when(adi.isNull() | cv2.isNull(), "unclassifiable").when(~slow & ~wild, "smooth").when(~slow, "erratic").when(~wild, "intermittent").otherwise("lumpy")
    )


def zero_runs(df: DataFrame) -> DataFrame:
    """(id, max_zero_run): the longest run of days without sales, 0 if none."""
    place = F.row_number().over(by_series()) - F.row_number().over(Window.partitionBy("id", F.col("sales") == 0).orderBy("date"))
    runs = df.withColumn("_run", F.when(F.col("sales") == 0, place)).groupBy("id", "_run").agg(F.count("*").alias("n"))
    return runs.groupBy("id").agg(F.coalesce(F.max(F.when(F.col("_run").isNotNull(), F.col("n"))), F.lit(0)).alias("max_zero_run"))


def series_stats(df: DataFrame, cutoff: date) -> DataFrame:
    """One row per series from the days before cutoff; adi is days per day with sales, cv2 of the sizes of sales."""
    past = df.filter(F.col("date") < F.lit(cutoff))
    sold = F.when(F.col("sales") > 0, F.col("sales"))
    stats = past.groupBy("id", "item_id", "store_id").agg(
        F.count("*").alias("n_days"), F.avg("sales").alias("mean_sales"), F.avg((F.col("sales") == 0).cast("double")).alias("zero_rate"),
        F.try_divide(F.count("*").cast("double"), F.count(sold)).alias("adi"), F.pow(F.try_divide(F.stddev_samp(sold), F.avg(sold)), F.lit(2.0)).alias("cv2"),
    )
    return stats.join(zero_runs(past), "id").withColumn("demand_class", demand_class(F.col("adi"), F.col("cv2")))


def stats_summary(stats: DataFrame) -> DataFrame:
    """(item_id, n_series, least_mean, most_mean, least_zero, most_zero, n_classes, classes): ranges and classes of an item's series."""
    return stats.groupBy("item_id").agg(
        F.count("*").alias("n_series"), F.min("mean_sales").alias("least_mean"), F.max("mean_sales").alias("most_mean"), F.min("zero_rate").alias("least_zero"), F.max("zero_rate").alias("most_zero"),
        F.countDistinct("demand_class").alias("n_classes"), F.array_join(F.sort_array(F.collect_set("demand_class")), ", ").alias("classes"),
    )


def zero_rates(stats: DataFrame) -> DataFrame:
    """(store_id, item_id, zero_rate, mean_sales, place): series that have a place on the class map, the busiest first."""
    finite = F.col("adi").isNotNull() & F.col("cv2").isNotNull() & (F.abs("adi") < float("inf")) & (F.abs("cv2") < float("inf"))
    place = F.row_number().over(Window.orderBy(F.desc("mean_sales"), "id"))  # one row per series
    return stats.filter(finite).select("store_id", "item_id", "zero_rate", "mean_sales", place.alias("place")).orderBy("place")


def worst_zero_runs(df: DataFrame, n: int = 5) -> DataFrame:
    """The n series with the longest runs of days without sales."""
    return zero_runs(df).orderBy(F.desc("max_zero_run"), "id").limit(n)


def class_table(stats: DataFrame, stores: list[str]) -> DataFrame:
    """(item_id, one column per store) of demand classes."""
    return stats.groupBy("item_id").pivot("store_id", stores).agg(F.first("demand_class"))


def event_effects(df: DataFrame, cutoff: date) -> DataFrame:
    """(event, m2, m1, day, p1, n_years, max_deviation): sales around events relative to ordinary weeks.

    A day's baseline is the mean of the same weekday 1 to 4 weeks either side, event days left out. Ratios are
    averaged over series per occurrence, then over occurrences. Closed days count as missing.
    """
    past = df.filter(F.col("date") < F.lit(cutoff)).withColumn("y", F.when(~F.col("closure"), F.col("sales")))
    plain = F.when(F.col("event_name_1").isNull() & F.col("event_name_2").isNull(), F.col("y"))
    w = by_series()
    around = [f("_plain", 7 * k).over(w) for k in range(1, 5) for f in (F.lag, F.lead)]
    total, count = sum((F.coalesce(a, F.lit(0.0)) for a in around), F.lit(0.0)), sum((a.isNotNull().cast("int") for a in around), F.lit(0))
    ratio = F.try_divide(F.col("y"), F.try_divide(total, count))
    ratios = past.withColumn("_plain", plain).withColumn("ratio", ratio).select("id", F.col("date").alias("day"), "ratio")
    days = past.select("date", "event_name_1", "event_name_2").distinct()
    names = days.select("date", F.col("event_name_1").alias("event")).union(days.select("date", "event_name_2")).filter("event is not null")
    spread = names.withColumn("offset", F.explode(F.array(*map(F.lit, EVENT_OFFSETS)))).withColumn("day", F.date_add("date", F.col("offset")))
    per_day = spread.join(ratios, "day").groupBy("event", "date", "offset").agg(F.avg("ratio").alias("ratio"))
    at = {"m2": -2, "m1": -1, "day": 0, "p1": 1}
    means = per_day.groupBy("event").agg(*(F.avg(F.when(F.col("offset") == k, F.col("ratio"))).alias(n) for n, k in at.items()), F.countDistinct("date").alias("n_years"))
    return means.withColumn("max_deviation", F.greatest(*(F.abs(F.col(n) - 1) for n in at)))


def event_run_up(effects: DataFrame) -> DataFrame:
    """(event, run_up, day, max_deviation): the larger of the two days before, beside the day itself."""
    return effects.select("event", F.greatest("m2", "m1").alias("run_up"), "day", "max_deviation")


def outliers(df: DataFrame, roll: int = ROLL, k: float = SPREAD) -> DataFrame:
    """Adds center, mad and is_outlier: far from the centred running median, by the running median of distances."""
    w = by_series().rowsBetween(-(roll // 2), roll - roll // 2 - 1)
    half = F.lit(0.5)

    def median(c: str) -> Column:
        return F.when(F.count(c).over(w) >= LEAST, F.percentile(c, half).over(w))

    out = df.withColumn("center", median("sales")).withColumn("_r", F.abs(F.col("sales") - F.col("center"))).withColumn("mad", median("_r"))
    far = (F.col("mad") > 0) & (F.col("_r") > k * 1.4826 * F.col("mad"))
    return out.withColumn("is_outlier", F.coalesce(far, F.lit(False))).drop("_r")


def outlier_counts(marked: DataFrame) -> DataFrame:
    """(id, n_outliers, n_spikes, n_zeros)."""
    hit = F.col("is_outlier")
    return marked.groupBy("id").agg(F.count_if(hit).alias("n_outliers"), F.count_if(hit & (F.col("sales") > F.col("center"))).alias("n_spikes"), F.count_if(hit & (F.col("sales") == 0)).alias("n_zeros"))


def acf(df: DataFrame, lags: int, value: str = "sales") -> DataFrame:
    """(id, lag, r, n): sample autocorrelation about the whole mean over the whole sum of squares; r of lag 0 is 1."""
    whole = Window.partitionBy("id")
    c = df.withColumn("_c", F.col(value) - F.avg(value).over(whole))
    products = [F.sum(F.col("_c") * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(lags + 1)]
    sums = c.withColumns({f"_l{k}": F.lag("_c", k).over(by_series()) for k in range(lags + 1)}).groupBy("id").agg(*products, F.count("*").alias("n"))
    each = F.posexplode(F.array(*(F.try_divide(f"_s{k}", "_s0") for k in range(lags + 1))))
    return sums.select("id", "n", each.alias("lag", "r"))


def chi2_tail(q: Column, degrees: Column) -> Column:
    """chi2_survival as an expression, for up to 200 degrees: one less the series of the incomplete gamma, within 1e-14."""
    a, x = degrees / 2, q / 2
    odd = degrees % 2 == 1
    factors = F.transform(F.sequence(F.lit(0), F.ceil(a).cast("int") - 1), lambda k: F.log(k + F.when(odd, 0.5).otherwise(1.0)))
    log_gamma = F.aggregate(factors, F.when(odd, 0.5 * math.log(math.pi)).otherwise(0.0), lambda s, v: s + v)  # of a + 1
    first = F.exp(a * F.log(x) - x - log_gamma)
    start = F.struct(first.alias("term"), first.alias("total"))
    terms = F.sequence(F.lit(1), F.ceil(x + 12 * F.sqrt(x) + 60).cast("int"))
    total = F.aggregate(terms, start, lambda s, k: F.struct((s["term"] * x / (a + k)).alias("term"), (s["total"] + s["term"] * x / (a + k)).alias("total")), lambda s: s["total"])
    return F.when(x <= 0, 1.0).when(x > 700, 0.0).when(x.isNotNull() & degrees.isNotNull(), F.greatest(F.lit(0.0), 1 - total))


def ljung_box(acf_rows: DataFrame, season: int = 7) -> DataFrame:
    """(id, lags, q, p): the statistic at lag max(1, min(2 * season, n / 5)), and the odds of a greater one in noise."""
    m = F.greatest(F.lit(1), F.least(F.lit(2 * season), F.floor(F.col("n") / 5)))
    used = acf_rows.filter((F.col("lag") >= 1) & (F.col("lag") <= m))
    return used.groupBy("id", "n").agg(F.max("lag").alias("lags"), (F.col("n") * (F.col("n") + 2) * F.sum(F.col("r") * F.col("r") / (F.col("n") - F.col("lag")))).alias("q")).drop("n").withColumn("p", chi2_tail(F.col("q"), F.col("lags")))


def chi2_survival(q: float, degrees: int) -> float:
    """Probability that a chi-square value exceeds q, by the series or continued fraction of the incomplete gamma."""
    a, x = degrees / 2, q / 2
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h * scale


def noise_bound(n: int) -> float:
    return 1.96 / math.sqrt(n)


def profile(df: DataFrame, by: str) -> DataFrame:
    """(id, by, mean_sales): by is weekday (Monday 0) or month."""
    key = {"dow": F.weekday("date"), "month": F.month("date")}[by]
    return df.groupBy("id", "store_id", key.alias(by)).agg(F.avg("sales").alias("mean_sales"))


def indexed_profile(df: DataFrame, by: str = "dow") -> DataFrame:
    """(by, index): each series' profile over the mean of its own cells, averaged over series."""
    cells = profile(df, by).withColumn("index", F.try_divide("mean_sales", F.avg("mean_sales").over(Window.partitionBy("id"))))
    return cells.groupBy(by).agg(F.avg("index").alias("index"))


def snap_lift(df: DataFrame) -> DataFrame:
    """(id, off, on, lift_pct): mean sales without and with benefits."""
    off, on = (F.avg(F.when(F.col("snap") == k, F.col("sales"))) for k in (0, 1))
    return df.groupBy("id").agg(off.alias("off"), on.alias("on")).withColumn("lift_pct", (F.try_divide("on", "off") - 1) * 100)


def price_weeks(df: DataFrame) -> DataFrame:
    """(id, week, sell_price, mean_sales): weeks with a price."""
    return df.groupBy("id", F.trunc("date", "week").alias("week")).agg(F.min("sell_price").alias("sell_price"), F.avg("sales").alias("mean_sales")).filter("sell_price is not null")


def price_spells(df: DataFrame) -> DataFrame:
    """(id, sell_price, first_day, last_day, n_days): when each price held."""
    return df.filter("sell_price is not null").groupBy("id", "sell_price").agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count("*").alias("n_days"))


def rolling_level(df: DataFrame) -> DataFrame:
    """Adds level: the 28-day mean, null below 14 days."""
    w = by_series().rowsBetween(-(ROLL - 1), 0)
    return df.withColumn("level", F.when(F.count("sales").over(w) >= LEAST, F.avg("sales").over(w)))


def year_overlay(df: DataFrame) -> DataFrame:
    """(id, year, day_of_year, level)."""
    return rolling_level(df).filter("level is not null").select("id", F.year("date").alias("year"), F.dayofyear("date").alias("day_of_year"), "level")


def monthly_level(predictions: DataFrame) -> DataFrame:
    """(id, method, month, actual, forecast): means by month of the target, closed days left out."""
    return predictions.filter(~F.col("closure")).groupBy("id", "method", F.trunc("target_date", "month").alias("month")).agg(F.avg("actual").alias("actual"), F.avg("forecast").alias("forecast"))


def residuals(predictions: DataFrame) -> DataFrame:
    """(id, date, residual) of one-day-ahead forecasts (forecast - actual), with its method."""
    return predictions.filter((F.col("horizon") == 1) & ~F.col("closure")).select("id", "method", F.col("target_date").alias("date"), (F.col("forecast") - F.col("actual")).alias("residual"))


def residual_histogram(rows: DataFrame) -> DataFrame:
    """(method, bin, n): equal bins from least to largest residual, min(15, max(5, n / 4)) of them."""
    range_ = rows.groupBy(F.col("method").alias("_m")).agg(F.min("residual").alias("lo"), F.max("residual").alias("hi"), F.least(F.lit(15), F.greatest(F.lit(5), F.floor(F.count("*") / 4))).alias("bins"))
    place = F.least(F.floor((F.col("residual") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")), F.col("bins") - 1)
    at = F.when(F.col("hi") > F.col("lo"), place).otherwise(0)
    return rows.join(F.broadcast(range_), F.col("method") == F.col("_m")).groupBy("method", at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def folds_overlap(predictions: DataFrame) -> bool:
    """Whether a series' target day occurs in more than one fold."""
    return not predictions.groupBy("id", "method", "target_date").count().filter("count > 1").limit(1).isEmpty()


def forecast_line(predictions: DataFrame, first: date, last: date, horizon: int | None = None) -> DataFrame:
    """Rows of targets from first to last; one horizon (1 if folds overlap and none is given)."""
    if horizon is None and folds_overlap(predictions):
        horizon = 1
    rows = predictions.filter(F.col("target_date").between(F.lit(first), F.lit(last)))
    return rows.filter(F.col("horizon") == horizon) if horizon else rows
