"""Reports over many cases: rankings, samplers, judged answers and datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracejobs.operators.evaluate import top_k

TOPS = ["top1", "top3", "top5", "avg3", "avg5", "mrr"]


def hits(answers: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """answers with a column hit: whether labels has their keys."""
    known = labels.select(*keys).distinct().withColumn("_known", F.lit(True))
    return answers.join(known, keys, "left").withColumn("hit", F.coalesce("_known", F.lit(False))).drop("_known")


def mean_by(scores: DataFrame, keys: list[str], values: list[str], digits: int = 3) -> DataFrame:
    """Means of the values by group, in long form: a row for each group of keys. Decimals are added up exactly, doubles in the order of rows."""
    return scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), *[F.round(F.try_divide(F.sum(v).cast("double"), F.count(v)), digits).alias(v) for v in values])


def algorithm_means(rankings: DataFrame, attributes: DataFrame, keys: list[str], digits: int = 3) -> DataFrame:
    """Means of top_k by algorithm and by the cases' attributes (datapack, keys); a case without attributes counts under null."""
    scores = top_k(rankings).join(attributes, "datapack", "left")
    # scores have six decimals at most; as decimals, their sums and means that are ties do not depend on the order of rows
    scores = scores.withColumns({v: F.col(v).cast("decimal(18,6)") for v in TOPS})
    return mean_by(scores, [*keys, "algorithm"], TOPS, digits)


def nested_bucket(value: Column, limits: tuple[int, ...] = (1, 3, 5)) -> Column:
    """The first limit that the value does not exceed, as ``<=limit``, else ``>last``."""
    out = F.lit(f">{limits[-1]}")
    for limit in reversed(limits):
        out = F.when(value <= limit, f"<={limit}").otherwise(out)
    return out


def run_counts(runs: DataFrame, keys: list[str], error: str) -> DataFrame:
    """Per group: different datapacks, and those with an error."""
    one = runs.groupBy(*keys, "datapack").agg(F.max(F.col(error).isNotNull()).alias("failed"))
    return one.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if("failed").alias("errors"))


def summary(rows: DataFrame, keys: list[str], values: list[str], digits: int = 6) -> DataFrame:
    """Mean, sample deviation, minimum and maximum of each value by group."""
    each = lambda v: (F.round(F.avg(v), digits).alias(f"{v}_mean"), F.round(F.stddev_samp(v), digits).alias(f"{v}_std"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[x for v in values for x in each(v)])


def rank_shares(rows: DataFrame, metric: str, rank: str, most: int = 5) -> DataFrame:
    """For r from 1 to ``most``: each metric's share among all rows of rank r or better."""
    upto = rows.where(F.col(rank) <= most).withColumn("r", F.explode(F.sequence(F.col(rank).cast("int"), F.lit(most))))
    n = upto.groupBy("r", metric).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("r")), 6))  # as many rows as metrics


def pivoted(rows: DataFrame, row: str, column: str, names: list[str], value: Column) -> DataFrame:
    """One row for each ``row``, one column for each of the names."""
    return rows.groupBy(row).pivot(column, names).agg(value)


def shared_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def value_distribution(wide: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, metric, value, n) of the wide columns' values."""
    long = wide.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(keys, values, "metric", "value")
    return shared_counts(long, [*keys, "metric", "value"])


def levels_accuracy(samples: DataFrame) -> DataFrame:
    """Accuracy by level, and overall (level null); samples without a verdict count in the overall denominator only."""
    good, known = F.count_if("correct"), F.count_if(F.col("correct").isNotNull())
    by = samples.groupBy("level").agg(F.count(F.lit(1)).alias("n"), good.alias("right"), F.round(F.try_divide(good, known), 6).alias("accuracy"))
    return by.unionByName(samples.agg(F.lit(None).cast(dict(samples.dtypes)["level"]).alias("level"), F.count(F.lit(1)).alias("n"), good.alias("right"), F.round(F.try_divide(good, F.count(F.lit(1))), 6).alias("accuracy")))


def top_per_group(rows: DataFrame, keys: list[str], value: str, tie: str, most: int) -> DataFrame:
    """The ``most`` rows of each group with the largest values, ranked; ties by ``tie``. Spark keeps that many of a group before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc(value), tie)
    return rows.where(F.col(value).isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def filled_matrix(metrics: DataFrame, keys: list[str], time: str, metric: str, value: str) -> DataFrame:
    """(keys, time, metric, value) on the grid of a group's times and metrics: means, filled backward, then forward."""
    known = metrics.groupBy(*keys, time, metric).agg(F.avg(value).alias("mean"))
    grid = known.select(*keys, time).distinct().join(known.select(*keys, metric).distinct(), keys)
    rows = grid.join(known, [*keys, time, metric], "left")
    series = Window.partitionBy(*keys, metric).orderBy(time)
    after = F.first("mean", ignorenulls=True).over(series.rowsBetween(0, Window.unboundedFollowing))
    before = F.last("mean", ignorenulls=True).over(series.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(*keys, time, metric, F.round(F.coalesce(after, before), 6).alias("value"))


def tool_usage(messages: DataFrame) -> DataFrame:
    """Per conversation: different assistant calls whose reply succeeded or failed (any success wins), and the bonus for them.

    bonus: 0.2 times the part that succeeded, less for failures (1 - tanh of their number) and for a number of calls far
    from ten (1 - tanh of the distance over ten); 0 without a success.
    """
    calls = messages.where("role = 'assistant'").select("conv_id", "call").distinct()
    replies = messages.where("role <> 'assistant'").groupBy("conv_id", "call").agg(F.max("ok").alias("ok"))
    both = calls.join(replies, ["conv_id", "call"])
    total = F.col("succeeded") + F.col("failed")
    bonus = 0.2 * F.try_divide(F.col("succeeded"), total) * (1 - F.tanh(F.col("failed").cast("double"))) * (1 - F.tanh(F.abs(total - 10) / 10))
    return both.groupBy("conv_id").agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed")).withColumn("bonus", F.round(F.coalesce(bonus, F.lit(0.0)), 6))


def split_cases(cases: DataFrame, stratum: str, key: str, ratio: float, previous: DataFrame | None = None, limit: int = 0, seed: int = 0) -> DataFrame:
    """cases (stratum, key) with a column part, train or test; those of ``previous`` (key) are left out.

    Of a stratum of n cases min(ceil(ratio * n), cap) are for training, drawn in a seeded order. The cap is the least, from
    the size of the smallest stratum on, with which at least ratio of all cases are for training. With a limit below
    the number of cases, the first floor(limit * ratio) for training stay and the first limit - that for testing,
    in the order of strata and draws.

    The cap is found from how often each size occurs, so that only one number comes to the driver.
    """
    cases = cases.select(stratum, key)
    if previous is not None:
        cases = cases.join(previous.select(key).distinct(), key, "left_anti")
    sizes = cases.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")).withColumn("most", F.ceil(F.col("n") * ratio))
    by = sizes.groupBy("most").agg(F.count(F.lit(1)).alias("strata"), F.sum("n").alias("cases"), F.min("n").alias("least"))
    order = Window.orderBy("most")  # over different sizes only
    below = F.coalesce(F.sum(F.col("strata") * F.col("most")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum("strata").over(order.rowsBetween(0, Window.unboundedFollowing))
    target = F.sum("cases").over(Window.partitionBy()) * ratio
    steps = by.select("most", F.min("least").over(Window.partitionBy()).alias("least"), F.ceil((target - below) / open_).alias("cap"))
    cap = steps.agg(F.greatest(F.min(F.when(F.col("cap") <= F.col("most"), F.col("cap"))), F.min("least"))).first()[0] or 0
    drawn = cases.withColumn("draw", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("draw", key))
    rows = drawn.withColumn("place", place).join(sizes.select(stratum, "most"), stratum)
    rows = rows.withColumn("part", F.when(F.col("place") <= F.least("most", F.lit(cap)), "train").otherwise("test"))
    if limit and cases.count() > limit:
        train = int(limit * ratio)
        first = lambda part, n: rows.where(F.col("part") == part).orderBy(stratum, "place").limit(n)
        rows = first("train", train).unionByName(first("test", limit - train))
    return rows.select(stratum, key, "part")
