"""The daily calendar: events, distance to major holidays, closures, benefit-day flags."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Events with a day of the year.
YEARLY_EVENTS = {"NewYear": "01-01", "ValentinesDay": "02-14", "StPatricksDay": "03-17", "IndependenceDay": "07-04", "Halloween": "10-31", "Christmas": "12-25"}
#: Events on a weekday of a month: (month, weekday with Monday 0, which one).
WEEKDAY_EVENTS = {"Thanksgiving": (11, 3, 4), "LaborDay": (9, 0, 1)}
#: A day with a second event.
SECOND_EVENTS = {"2000-07-04": "FoundersDay"}
#: The holidays that move demand; the one on which stores close; days before and after in its window; the longest distance told.
MAJOR = ("Christmas", "NewYear", "ValentinesDay", "IndependenceDay", "Thanksgiving", "LaborDay", "Easter")
CLOSING, BEFORE, AFTER, FARTHEST = "Christmas", 2, 1, 30
#: The days of the month on which benefits are paid, by state.
BENEFIT_DAYS = {"CA": tuple(range(1, 11)), "TX": tuple(range(2, 15, 2)), "WI": tuple(range(3, 16, 3))}


def easter(year: Column) -> Column:
    """Easter Sunday of a year, by the Gregorian computus."""
    century, golden = F.floor(year / 100), year % 19
    epact = (century - F.floor(century / 4) - F.floor((8 * century + 13) / 25) + 19 * golden + 15) % 30
    moon = epact - F.floor(epact / 28) * (1 - F.floor(29 / (epact + 1)) * F.floor((21 - golden) / 11))  # days from 21 March to the full moon
    weekday = (year + F.floor(year / 4) + moon + 2 - century + F.floor(century / 4)) % 7
    return F.date_add(F.make_date(year, F.lit(3), F.lit(28)), (moon - weekday).cast("int"))


def event_names(day: Column) -> Column:
    """The name of a day's first event, or null; any year."""
    out = F.when(day == easter(F.year(day)), "Easter")
    for name, (month, weekday, which) in WEEKDAY_EVENTS.items():
        out = out.when((F.month(day) == month) & (F.weekday(day) == weekday) & (F.ceil(F.dayofmonth(day) / 7) == which), name)
    for name, month_day in YEARLY_EVENTS.items():
        out = out.when(F.date_format(day, "MM-dd") == month_day, name)
    return out


def day_frame(spark: SparkSession, first: date, last: date) -> DataFrame:
    """(date, event_name_1, event_name_2, snap_CA, snap_TX, snap_WI), one row per day."""
    days = spark.range((last - first).days + 1).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("date"))
    second = F.when(F.lit(False), F.lit(None).cast("string"))
    for when, name in SECOND_EVENTS.items():
        second = second.when(F.col("date") == F.lit(when).cast("date"), name)
    flags = [F.dayofmonth("date").isin(*days_).cast("int").alias(f"snap_{s}") for s, days_ in BENEFIT_DAYS.items()]
    return days.select("date", event_names(F.col("date")).alias("event_name_1"), second.alias("event_name_2"), *flags)


def holiday_distance(days: DataFrame) -> DataFrame:
    """Adds is_holiday, days_to_holiday, days_since_holiday and closure to (date, event_name_1, event_name_2, ...).

    The windows run over one row per day of the calendar, whatever the number of series.
    """
    major = F.coalesce(F.col("event_name_1").isin(*MAJOR), F.lit(False)) | F.coalesce(F.col("event_name_2").isin(*MAJOR), F.lit(False))
    of = F.when(F.col("_major"), F.col("date"))
    past = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.orderBy("date").rowsBetween(0, Window.unboundedFollowing)

    def near(days_away: Column) -> Column:
        return F.least(F.coalesce(days_away, F.lit(FARTHEST)), F.lit(FARTHEST)).cast("int")

    return (
        days.withColumn("_major", major)
        .withColumn("is_holiday", F.col("_major").cast("int"))
        .withColumn("days_to_holiday", near(F.datediff(F.first(of, ignorenulls=True).over(ahead), F.col("date"))))
        .withColumn("days_since_holiday", near(F.datediff(F.col("date"), F.last(of, ignorenulls=True).over(past))))
        .withColumn("closure", F.coalesce(F.col("event_name_1") == CLOSING, F.lit(False)) | F.coalesce(F.col("event_name_2") == CLOSING, F.lit(False)))
        .drop("_major")
    )


def in_holiday_window() -> Column:
    return (F.col("days_to_holiday") <= BEFORE) | (F.col("days_since_holiday") <= AFTER)


def day_features() -> dict[str, Column]:
    """Calendar features of the row's date; Monday is day 0."""
    return {
        "dow": F.weekday("date"),
        "is_weekend": (F.weekday("date") >= 5).cast("int"),
        "day_of_month": F.dayofmonth("date"),
        "month": F.month("date"),
        "day_of_year": F.dayofyear("date"),
        "is_event": F.col("event_name_1").isNotNull().cast("int"),
    }


def snap_flag(df: DataFrame) -> DataFrame:
    """Picks the flag of the row's own state as snap and drops the others; fails on a state without a flag."""
    known = [c.removeprefix("snap_") for c in df.columns if c.startswith("snap_")]
    pick = F.raise_error(F.concat(F.lit("no benefit flag for state "), F.coalesce(F.col("state_id"), F.lit("null"))))
    out = F.when(F.lit(False), F.lit(0))
    for s in known:
        out = out.when(F.col("state_id") == s, F.col(f"snap_{s}"))
    return df.withColumn("snap", out.otherwise(pick.cast("int"))).drop(*(f"snap_{s}" for s in known))
