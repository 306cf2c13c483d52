"""Evaluation of rankings and of judged answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracejobs.functions.quantiles import ratio

RUN = ["algorithm", "datapack"]


def top_k(rankings: DataFrame) -> DataFrame:
    """Per run: top1, top3, top5, avg3, avg5 and mrr from the first hit among five answers; 0 without one."""
    best = rankings.groupBy(*RUN).agg(F.min(F.when(F.col("hit") & (F.col("rank") <= 5), F.col("rank"))).alias("best"))
    tops = [F.when(F.col("best") <= k, 1.0).otherwise(0.0) for k in range(1, 6)]
    mean = lambda xs: sum(xs[1:], xs[0]) / len(xs)
    return best.select(*RUN, tops[0].alias("top1"), tops[2].alias("top3"), tops[4].alias("top5"), F.round(mean(tops[:3]), 6).alias("avg3"), F.round(mean(tops), 6).alias("avg5"), F.round(F.coalesce(F.lit(1.0) / F.col("best"), F.lit(0.0)), 6).alias("mrr"))


def accuracy_at_k(rankings: DataFrame, most: int = 5) -> DataFrame:
    """Per algorithm: AC@k, its count, and Avg@k for k up to ``most``; a run counts once however many hits it has."""
    best = rankings.groupBy(*RUN).agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("best"))
    ks = range(1, most + 1)
    out = best.groupBy("algorithm").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("best") <= k).alias(f"n{k}") for k in ks])
    ac = [F.col(f"n{k}") / F.col("total") for k in ks]
    return out.select("algorithm", "total", *[F.round(a, 6).alias(f"ac_{k}") for k, a in zip(ks, ac)], *[F.col(f"n{k}").alias(f"count_{k}") for k in ks], *[F.round(sum(ac[1:k], ac[0]) / k, 6).alias(f"avg_{k}") for k in ks])


def mean_reciprocal_rank(rankings: DataFrame) -> DataFrame:
    """Per algorithm, over runs that have a hit."""
    best = rankings.where("hit").groupBy(*RUN).agg(F.min("rank").alias("best"))
    return best.groupBy("algorithm").agg(F.round(F.avg(F.lit(1.0) / F.col("best")), 6).alias("mrr"))


def precision_at_k(rankings: DataFrame, most: int = 5) -> DataFrame:
    """Per algorithm: mean P@k and MAP@k; 0 where a run has no answer so far."""
    ks = range(1, most + 1)
    run = rankings.groupBy(*RUN).agg(*[F.count_if(F.col("hit") & (F.col("rank") <= k)).alias(f"h{k}") for k in ks])
    p = {k: F.col(f"h{k}") / k for k in ks}
    return run.groupBy("algorithm").agg(*[F.round(F.avg(p[k]), 9).alias(f"p_{k}") for k in ks], *[F.round(F.avg(sum([p[i] for i in range(2, k + 1)], p[1]) / k), 9).alias(f"map_{k}") for k in ks])


def average_runtime(rankings: DataFrame) -> DataFrame:
    return rankings.groupBy(*RUN).agg(F.max("runtime").alias("runtime")).groupBy("algorithm").agg(F.round(F.avg("runtime"), 6).alias("avg_runtime"), F.count(F.lit(1)).alias("runs"))


def common_failures(rankings: DataFrame, k: int, least: int) -> DataFrame:
    """Datapacks that at least so many algorithms fail at top k."""
    run = rankings.groupBy(*RUN).agg(F.max(F.coalesce(F.col("hit") & (F.col("rank") <= k), F.lit(False)).cast("int")).alias("good"))
    return run.groupBy("datapack").agg(F.count_if(F.col("good") == 0).alias("failures")).where(F.col("failures") >= least)


def outcome(rankings: DataFrame) -> DataFrame:
    """Runs by algorithm and outcome: top1, top3, top5 or failure."""
    t = top_k(rankings)
    kind = F.when(F.col("top1") > 0, "top1").when(F.col("top3") > 0, "top3").when(F.col("top5") > 0, "top5").otherwise("failure")
    return t.groupBy("algorithm", kind.alias("outcome")).agg(F.count(F.lit(1)).alias("runs"))


def pass_at_k(samples: DataFrame, k: int) -> DataFrame:
    """Per level: the part of questions that one of the first k attempts answers."""
    first = samples.withColumn("attempt", F.row_number().over(Window.partitionBy("question").orderBy("sample_id"))).where(F.col("attempt") <= k)
    per = first.groupBy("question").agg(F.max(F.col("correct").cast("int")).alias("good"), F.min("level").alias("level"))
    return per.groupBy("level").agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg("good"), 6).alias("pass_at_k"))


def calibration(samples: DataFrame, bins: int = 5) -> DataFrame:
    """Per confidence bin (0 to 100): samples, accuracy, mean confidence, and its weighted error."""
    at = F.least(F.floor(F.col("confidence") / (100 / bins)), F.lit(bins - 1)).cast("long")
    per = samples.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("int")).alias("acc"), F.avg(F.col("confidence") / 100).alias("conf"))
    total = F.sum("n").over(Window.partitionBy())  # one row a bin
    return per.select("bin", "n", F.round("acc", 6).alias("accuracy"), F.round("conf", 6).alias("mean_confidence"), F.round(F.abs(F.col("acc") - F.col("conf")) * ratio(F.col("n"), total), 6).alias("weighted_error"))


def ranking_rollup(rankings: DataFrame) -> DataFrame:
    """Runs, hits at 1, mean reciprocal rank of the runs with a hit, and runtime by (algorithm, dataset) and by algorithm, from one pass over the runs."""
    runs = rankings.groupBy("algorithm", "dataset", "datapack").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("best"), F.max("runtime").alias("t"))
    sets = runs.groupingSets([["algorithm", "dataset"], ["algorithm"]], "algorithm", "dataset")
    return sets.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("best") <= 1).alias("count_1"), F.round(F.avg(1 / F.col("best")), 6).alias("mrr"), F.round(F.avg("t"), 6).alias("avg_runtime"))


#: The levels of performance(): what is grouped by besides the algorithm.
LEVELS = {"datapack": ["dataset", "datapack"], "dataset": ["dataset"], "algorithm": [], "sampler": ["sampler"], "sampler_dataset": ["sampler", "dataset"]}


def performance(rankings: DataFrame, most: int = 5) -> DataFrame:
    """All levels of LEVELS at once, from one pass over the runs: level, algorithm, sampler, dataset, datapack (null where not grouped by), and the scores.

    rankings: (algorithm, sampler, dataset, datapack, rank, hit, runtime). total: runs; count_k and ac_k: runs with a hit among the
    first k; avg_k: the mean of ac_1 to ac_k; mrr: over runs with a hit; p_k, map_k: mean precision and its mean over 1 to k;
    avg_runtime. What is undefined is 0.
    """
    ks, keys = range(1, most + 1), ["algorithm", "sampler", "dataset", "datapack"]
    hits = [F.count_if(F.col("hit") & (F.col("rank") <= k)).alias(f"h{k}") for k in ks]
    runs = rankings.groupBy(*keys).agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("best"), F.max("runtime").alias("t"), *hits)
    ids = {sum(1 << (3 - keys.index(k)) for k in keys if k != "algorithm" and k not in by): level for level, by in LEVELS.items()}
    named = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    # whole numbers are added up and divided once, so that the scores do not depend on the order of rows
    n = F.count(F.lit(1))
    ac, p = {k: F.count_if(F.col("best") <= k) / n for k in ks}, {k: F.sum(f"h{k}") / (k * n) for k in ks}
    mean = lambda of, k: sum([of[i] for i in range(2, k + 1)], of[1]) / k
    scores = [F.count_if(F.col("best") <= k).alias(f"count_{k}") for k in ks] + [F.round(x(k), 6).alias(f"{n}_{k}") for n, x in (("ac", lambda k: ac[k]), ("avg", lambda k: mean(ac, k)), ("p", lambda k: p[k]), ("map", lambda k: mean(p, k))) for k in ks]
    sets = runs.groupingSets([["algorithm", *by] for by in LEVELS.values()], *keys)
    out = sets.agg(F.grouping_id().cast("int").alias("_id"), F.count(F.lit(1)).alias("total"), *scores, zero(F.round(F.avg(1 / F.col("best")), 6)).alias("mrr"), zero(F.round(F.avg("t"), 6)).alias("avg_runtime"))
    return out.select(F.element_at(named, F.col("_id")).alias("level"), *[c for c in out.columns if c != "_id"])


def latest(runs: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """Per key the row of the latest time, null times last, ties by the greater ``tie``: an aggregate, so map tasks reduce first."""
    rest = [c for c in runs.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(time).isNotNull(), F.col(time), F.col(tie)))
    return runs.groupBy(*keys).agg(best.alias("best")).select(*keys, *[F.col("best")[c].alias(c) for c in rest])
