"""As-of joins: to each row of one side the latest row of the other that is not later, by key and time.

Both sides stand in one stream, which is shuffled once, by key; the value at each row is then the last one seen in the sorted stream.
Keys of many rows are dealt by time bucket, too, so that a key with most of the rows is spread over its buckets. Such a bucket begins with
the last row of the right side before it, which a window over the buckets of a key, not over its rows, carries forward. To find those keys,
rows are counted by a hash of few values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Days of a bucket.
BUCKET_DAYS = 32
#: Hash values that keys are counted by, and the most rows of one whose keys are not dealt by time.
CELLS, CELL_ROWS = 1 << 16, 1 << 17


def asof_join(
    left: DataFrame, right: DataFrame, by: tuple[str, ...], left_on: str, right_on: str, values: tuple[str, ...], bucket_days: int = BUCKET_DAYS,
    least: bool = False, counted: DataFrame | None = None, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """left with the columns right_on and values of right's latest row of the same key that is not later; null if there is none.

    Times are dates or timestamps. Of right rows at one time, the one with the greatest values counts, or, if least, the one with the least
    that aren't null. Rows of left without key or time keep nulls, and rows of right without them match nothing; rows of left that are
    equal stay as many as they are. Names that both sides have, but for the key, must not clash.

    counted: a frame with the columns by, of left's types, that has about as many rows of each key as the sides have; it is read to find the
    keys of many rows, where that is cheaper than reading both sides. It says how rows are dealt, not what is found.
    """
    if clash := {right_on, *values} & set(left.columns):
        raise ValueError(f"both sides have {sorted(clash)}")
    usable = lambda t: F.col(t).isNotNull() & ~F.greatest(F.lit(False), *(F.col(k).isNull() for k in by))
    right = right.filter(usable(right_on)).select(*by, right_on, *values)
    cell = F.pmod(F.xxhash64(*by), F.lit(CELLS))
    keys = right.select(*by).unionByName(left.filter(usable(left_on)).select(*by)) if counted is None else counted.select(*by).dropna()
    hot = [r["_cell"] for r in keys.groupBy(cell.alias("_cell")).count().filter(F.col("count") > cell_rows).collect()]
    days = F.floor(F.unix_date(F.col("_asof_time").cast("date")) / bucket_days).cast("int")
    bucket = F.when(cell.isin(hot), days).otherwise(0) if hot else F.lit(0)

    def stream(asked: DataFrame) -> DataFrame:
        return right.withColumn("_asof_time", F.col(right_on)).unionByName(asked, allowMissingColumns=True)

    # rows without key or time stay spread as they are; no right row comes before them wherever they are
    rows = stream(left.withColumns({"_asof_time": F.when(usable(left_on), F.col(left_on)), "_asof_spread": F.when(~usable(left_on), F.spark_partition_id())}))
    rows = rows.withColumn("_asof_bucket", F.coalesce("_asof_spread", bucket)).drop("_asof_spread")
    found = F.when(F.col(right_on).isNotNull(), F.struct(right_on, *values))
    if hot:
        # the last row of right before each bucket that either side has rows in
        ends = stream(left.filter(usable(left_on)).select(*by, F.col(left_on).alias("_asof_time"))).filter(cell.isin(hot)).withColumn("_asof_bucket", days)
        if least and values:
            first = F.min(F.struct(*(x for k, v in enumerate(values) for x in (F.col(v).isNull().alias(f"_{k}"), F.col(v).alias(f"_v{k}"))))).alias("_least")
            ends = ends.groupBy(*by, "_asof_bucket", right_on).agg(first).select(*by, "_asof_bucket", right_on, *(F.col(f"_least._v{k}").alias(v) for k, v in enumerate(values)))
        ends = ends.groupBy(*by, "_asof_bucket").agg(F.max(found).alias("_last"))
        before = Window.partitionBy(*by).orderBy("_asof_bucket").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).filter("_carried is not null").select(*by, "_asof_bucket", "_carried.*")
        rows = rows.unionByName(carried.withColumn("_asof_time", F.col(right_on)), allowMissingColumns=True)
    best = [F.col(v).desc_nulls_first() if least else F.col(v).asc_nulls_first() for v in values]
    order = Window.partitionBy(*by, "_asof_bucket").orderBy("_asof_time", F.col(right_on).isNull(), *best).rowsBetween(Window.unboundedPreceding, 0)
    # dealt before the rows found are put together, so that they are shuffled as single columns
    seen = rows.repartition(*by, "_asof_bucket").withColumn("_asof_seen", F.last(found, ignorenulls=True).over(order)).filter(F.col(right_on).isNull())
    return seen.select(*(F.col(f.name).cast(f.dataType) if f.name in by else F.col(f.name) for f in left.schema), *(F.col(f"_asof_seen.{c}").alias(c) for c in (right_on, *values)))
