"""Running sums over a whole table without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(df: DataFrame, bucket: Column, order: tuple, **values: Column) -> DataFrame:
    """Adds, for each name, the sum of its value over the rows up to and with this one, in the order of (bucket, *order), which
    has to be total. Each bucket is summed on its own; only the table of buckets, one row each, is summed in one place, so a
    bucket should be a share of the order such as a day or a step of a score."""
    at = df.withColumn("_bucket", bucket)
    sums = at.groupBy("_bucket").agg(*[F.sum(v).alias(f"_{n}") for n, v in values.items()])
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_bucket", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in values])
    within = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = at.join(before, "_bucket")
    return out.select(*df.columns, *[(F.col(f"_{n}") + F.sum(v).over(within)).alias(n) for n, v in values.items()])
