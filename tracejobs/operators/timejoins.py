"""Joins on time: near in time (interval), nearest in time (as-of)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Pairs of rows of equal keys whose times are at most ``seconds`` apart, the right one's columns under r_.

    Time is cut into buckets of that length and the right rows are dealt to three of them, so it is an equi-join on
    the keys and the bucket; a busy key is split by its buckets.
    """
    bucket = F.floor(F.unix_micros("time") / (seconds * 1_000_000))
    r = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys], F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    near = F.abs(F.unix_micros("time") - F.unix_micros("r_time")) <= seconds * 1_000_000
    return left.withColumn("bucket", bucket).join(r, [*keys, "bucket"]).where(near).drop("bucket")


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], order: str, seconds: int = 3600) -> DataFrame:
    """(keys, left's order, r_ the order of the right row nearest in time or null): the earlier one if two are as near; a null key has none.

    Time is cut into buckets of that length. Two running windows go over each bucket's rows, one each way in time; what
    lies before and after a bucket is carried to it by windows over the buckets alone. So a busy key is many tasks, and the
    longest window holds a row for each bucket.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    bucket = F.floor(F.unix_micros("time") / (seconds * 1_000_000)).alias("_bucket")
    shape = lambda df, side: df.where(known).select(*keys, bucket, F.unix_micros("time").alias("t"), F.col(order).alias("o"), F.lit(side).alias("side"))
    both = shape(right, 0).unionByName(shape(left, 1))
    point = F.when(F.col("side") == 0, F.struct("t", "o"))
    edges = both.groupBy(*keys, "_bucket").agg(F.min(point).alias("first"), F.max(point).alias("last"))
    of_key = Window.partitionBy(*keys).orderBy("_bucket")
    carried = edges.select(
        *keys, "_bucket", F.last("last", ignorenulls=True).over(of_key.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"), F.first("first", ignorenulls=True).over(of_key.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
    )
    w = Window.partitionBy(*keys, "_bucket").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(point, ignorenulls=True)
    both = both.withColumn("before", seen.over(w.orderBy("t", "side", "o"))).withColumn("after", seen.over(w.orderBy(F.desc("t"), "side", F.desc("o"))))
    rows = both.where("side = 1").join(carried, [*keys, "_bucket"]).withColumn("before", F.coalesce("before", "earlier")).withColumn("after", F.coalesce("after", "later"))
    earlier = F.col("after").isNull() | (F.col("t") - F.col("before.t") <= F.col("after.t") - F.col("t"))
    found = rows.select(*keys, F.col("o").alias(order), F.when(earlier, F.col("before.o")).otherwise(F.col("after.o")).alias(f"r_{order}"))
    lost = left.where(~known).select(*keys, order, F.lit(None).cast(dict(right.dtypes)[order]).alias(f"r_{order}"))
    return found.unionByName(lost)


def places_in_time(df: DataFrame, keys: list[str], order: list[str], name: str, seconds: int = 3600) -> DataFrame:
    """df with each row's place in its key's order of time, then ``order``, from 0: counted in buckets of time, put together over the buckets alone."""
    bucketed = df.withColumn("_bucket", F.floor(F.unix_micros("time") / (seconds * 1_000_000)))
    n = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = n.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("time", *order)) - 1
    return bucketed.withColumn("_in", inside).join(before, [*keys, "_bucket"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_bucket", "_in", "_before")
