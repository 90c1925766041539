"""Running counts and order statistics that do not funnel a key through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, keys: list[str], ts: str, value: Column, name: str,
                tie: list[str] | None = None, bucket: str = "HOUR") -> DataFrame:
    """Sum of ``value`` over the earlier rows of the key (the row itself excluded).

    Two levels: inside (key, time bucket), plus the totals of the earlier buckets.  Only the
    bucket totals, one row per key and bucket, are ordered per key.
    """
    b = df.withColumn("__b", F.date_trunc(bucket, F.col(ts))).withColumn("__v", value)
    totals = b.groupBy(*keys, "__b").agg(F.sum("__v").alias("__t"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o"))
    inner = (Window.partitionBy(*keys, "__b").orderBy(ts, *(tie or []))
             .rowsBetween(Window.unboundedPreceding, -1))
    return (
        b.withColumn("__i", F.coalesce(F.sum("__v").over(inner), F.lit(0)))
        .join(offsets, [*keys, "__b"])
        .withColumn(name, F.col("__i") + F.col("__o"))
        .drop("__b", "__v", "__i", "__o")
    )


def value_at_rank(df: DataFrame, keys: list[str], value: str, ratio: float, name: str) -> DataFrame:
    """Exact ``sorted[min(n-1, floor(n*ratio))]`` per key.

    Equal values are counted first.  A monotone bucket of the value (leading bits of its
    magnitude) narrows the search, so only the distinct values of one bucket are ordered.
    """
    v = F.col(value).cast("double")
    magnitude = F.floor(F.log2(F.abs(v) + 1) * 64)
    counted = (
        df.where(F.col(value).isNotNull())
        .select(*keys, v.alias("__v"),
                F.when(v < 0, -magnitude - 1).otherwise(magnitude).alias("__b"))
        .groupBy(*keys, "__b", "__v").agg(F.count(F.lit(1)).alias("__n"))
    )
    buckets = counted.groupBy(*keys, "__b").agg(F.sum("__n").alias("__m"))
    every = Window.partitionBy(*keys)
    upto = every.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("__m").over(every)
    placed = buckets.select(
        *keys, "__b", F.sum("__m").over(upto).alias("__end"), F.col("__m"),
        F.least(total - 1, F.floor(total * F.lit(ratio))).alias("__rank"))
    target = placed.where(
        (F.col("__end") - F.col("__m") <= F.col("__rank")) & (F.col("__rank") < F.col("__end"))
    ).select(*keys, "__b", (F.col("__rank") - F.col("__end") + F.col("__m")).alias("__in"))
    inside = (Window.partitionBy(*keys, "__b").orderBy("__v")
              .rowsBetween(Window.unboundedPreceding, 0))
    return (
        counted.join(target, [*keys, "__b"])
        .withColumn("__c", F.sum("__n").over(inside))
        .where((F.col("__c") - F.col("__n") <= F.col("__in")) & (F.col("__in") < F.col("__c")))
        .select(*keys, F.col("__v").alias(name))
    )
