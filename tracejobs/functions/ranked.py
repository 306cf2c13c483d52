"""Exact order statistics of groups, from counted values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_stats(df: DataFrame, keys: list[str], value: Column, quantiles: dict[str, float], trimmed: dict[str, float] | None = None) -> DataFrame:
    """Per group of keys: n, and the named linear quantiles and trimmed means (that part off each end) of the values that are no null.

    Equal values are counted before the shuffle, and the window runs over different values only.
    """
    counted = df.select(*keys, value.cast("double").alias("_v")).where("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    own = Window.partitionBy(*keys)
    upto = F.sum("_c").over(own.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("_u", upto).withColumn("_n", F.sum("_c").over(own))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_u") > rank) & (F.col("_u") - F.col("_c") <= rank), F.col("_v")))

    columns = [F.max("_n").alias("n")]
    for name, q in quantiles.items():
        place = F.lit(q) * (F.col("_n") - 1)
        columns += [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}"), F.max(place - F.floor(place)).alias(f"_part_{name}")]
    for name, part in (trimmed or {}).items():
        off = F.floor(F.col("_n") * part)
        kept = F.greatest(F.lit(0), F.least(F.col("_u"), F.col("_n") - off) - F.greatest(F.col("_u") - F.col("_c"), off))
        columns.append(F.try_divide(F.sum(kept * F.col("_v")), F.sum(kept)).alias(name))
    out = ranked.groupBy(*keys).agg(*columns)
    linear = [(F.col(f"_lo_{q}") + (F.col(f"_hi_{q}") - F.col(f"_lo_{q}")) * F.col(f"_part_{q}")).alias(q) for q in quantiles]
    return out.select(*keys, "n", *linear, *(trimmed or {}))


def band_stats(df: DataFrame, keys: list[str], value: Column, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Per group: for each band of ranks [floor(lo * n), floor(hi * n)) of the sorted values, or all of them where it is empty, <band>_n, <band>_mean and <band>_p99 (linear).

    Equal values are counted before the shuffle, as in order_stats.
    """
    counted = df.select(*keys, value.cast("double").alias("_v")).where("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    own = Window.partitionBy(*keys)
    ranked = counted.withColumn("_u", F.sum("_c").over(own.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(own))
    columns = []
    for name, (lo, hi) in bands.items():
        first, end = F.floor(F.col("_n") * lo), F.floor(F.col("_n") * hi)
        whole = first >= end
        first, end = F.when(whole, 0).otherwise(first), F.when(whole, F.col("_n")).otherwise(end)
        kept = F.greatest(F.lit(0), F.least(F.col("_u"), end) - F.greatest(F.col("_u") - F.col("_c"), first))
        place = first + F.lit(0.99) * (end - first - 1)
        at = lambda rank: F.max(F.when((F.col("_u") > rank) & (F.col("_u") - F.col("_c") <= rank), F.col("_v")))
        part = F.max(place - F.floor(place))
        low, high = at(F.floor(place)), at(F.ceil(place))
        columns += [F.sum(kept).alias(f"{name}_n"), F.try_divide(F.sum(kept * F.col("_v")), F.sum(kept)).alias(f"{name}_mean"), (low + (high - low) * part).alias(f"{name}_p99")]
    return ranked.groupBy(*keys).agg(*columns)
