"""Ordered-series helpers that stay parallel when one key is very large."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, keys, ts: str, order_extra, value: str, out: str,
                bucket_seconds: int = 86400) -> DataFrame:
    """Cumulative sum of ``value`` per ``keys`` in ``(ts, *order_extra)`` order.

    Two-level prefix sum so that no task holds a whole key: a running sum
    inside each (key, time bucket) window, plus the total of all earlier
    buckets of the key (a window over the small per-bucket totals), joined
    back on (key, bucket) -- the partitioning the big side already has.
    Use an exact type (integer/decimal) for results that do not depend on
    the summation order.
    """
    keys = list(keys)
    order = [ts, *order_extra]
    b = df.withColumn("_rb", F.floor(F.unix_seconds(F.col(ts)) / F.lit(bucket_seconds)))
    tot = b.groupBy(*keys, "_rb").agg(F.sum(value).alias("_bt"))
    wk = Window.partitionBy(*keys).orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*keys, "_rb", F.coalesce(F.sum("_bt").over(wk), F.lit(0)).alias("_off"))
    wi = Window.partitionBy(*keys, "_rb").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = b.withColumn("_in", F.sum(value).over(wi))
    return (inner.join(off, [*keys, "_rb"], "left")
                 .withColumn(out, F.col("_in") + F.col("_off"))
                 .drop("_rb", "_in", "_off"))
