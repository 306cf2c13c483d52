"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

DataFrame functions only. The mix is as large as its input. Its blocks of BLOCK words go to sources by highest
quotients weight / (2 * seat - 1); a source's blocks go to its shards the same way; within a shard the documents
lie in a seeded order, and the quota takes blocks from a seeded start onwards, round and round, so that a
document's share is the overlap of two intervals and no block needs a row of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracejobs.llm.common import WORD, small, store

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
BLOCK = 16
SHARD_DOCS = 4096
#: Sources are broadcast up to this number.
SMALL_SOURCES = 100_000


def unit(seed: int, *parts: Column) -> Column:
    """A number below 2**32 that follows from the seed and the parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """sources (source, size) with a double target: the sum of sizes shared by weight, at most repeats times a size.

    Weights go round by the sources' code points, null last. What is above a cap is shared again by weight until
    none is: sources fill up in the order of cap / weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("w", w).withColumn("cap", (F.col("size") * repeats).cast("double"))
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    s = s.withColumn("full", F.col("cap") / F.col("w") <= F.col("level"))
    s = s.withColumn("share", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(Window.partitionBy())["level"])
    return s.select(*sources.columns, F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * F.col("share")).alias("target"))


def apportion(df: DataFrame, group: list[str], weight: str, seats: Column, order: list[Column]) -> DataFrame:
    """df with a column quota: by Sainte-Lague, ``seats`` (equal within a group) shared by weight.

    Only the seats near a row's proportional part are ranked: the divisor that gives all seats moves a part by
    at most its share of half the rows, so two windows of candidates a row are enough, and their number is
    linear in the rows. Ties go by ``order``, then to the lower seat. Rows without weight get none.
    """
    own = Window.partitionBy(*group)
    total, rows = F.sum(weight).over(own), F.count(F.lit(1)).over(own)
    part = F.when(total > 0, F.col(weight) / total)
    s = df.withColumn("_seats", seats).withColumn("_part", F.coalesce(part, F.lit(0.0))).withColumn("_around", F.ceil(F.col("_part") * rows) + 1)
    s = s.withColumn("_sure", F.greatest(F.lit(0), F.floor(F.col("_part") * F.col("_seats")) - F.col("_around")).cast("long"))
    s = s.withColumn("_last", F.when(F.col(weight) > 0, F.floor(F.col("_part") * F.col("_seats")) + F.col("_around") + 1).otherwise(0).cast("long"))
    s = s.withColumn("_left", F.col("_seats") - F.sum("_sure").over(own))
    near = F.when(F.col("_last") > F.col("_sure"), F.sequence(F.col("_sure") + 1, F.col("_last")))
    seat = s.select(*df.columns, "_sure", "_left", F.explode_outer(near).alias("_seat"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy((F.col(weight) / (2 * F.col("_seat") - 1)).desc_nulls_last(), *order, F.col("_seat")))
    won = F.count_if(F.col("_seat").isNotNull() & (F.col("_rank") <= F.col("_left")))
    return seat.withColumn("_rank", rank).groupBy(*df.columns, "_sure").agg(won.alias("_won")).select(*df.columns, (F.col("_sure") + F.col("_won")).alias("quota"))


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """How much [a, b) and [c, d) share."""
    return F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c)).cast("long")


def mix(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
    seed: int = 0,
    weights: tuple[float, ...] = WEIGHTS,
    repeats: int = MAX_REPEATS,
    block: int = BLOCK,
    shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """One row per document: key, size, source_size, target, taken, and first_word: where a part begins.

    size: the words of the text, 0 for null. taken: the words that the mix takes, ``taken // size`` whole copies
    and then ``taken % size`` words from first_word on, back to the text's start after its end. A null source
    is a source of its own, the last. A shard has about ``shard_docs`` documents of one source, so that no
    window holds a whole source. Rows that repeat a key and a text are rows of their own. An empty table gives
    an empty one; sources without words have target 0. Other columns of any name are ignored.
    """
    counted, _ = store(
        docs.select(
            F.col(key).alias("key"), F.col(source).alias("source"),
            F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        ),
        "sizes",
    )
    sources, _ = store(
        targets(counted.groupBy("source").agg(F.sum("size").alias("size"), F.ceil(F.count(F.lit(1)) / shard_docs).alias("n_shards")), weights, repeats),
        "sources",
    )
    at = small(sources.select(F.col("source").alias("s"), "n_shards"), SMALL_SOURCES)
    dealt = counted.join(at, F.col("source").eqNullSafe(F.col("s"))).withColumn("draw", unit(seed, F.col("key"), F.col("size")))
    dealt = dealt.select("key", "source", "size", "draw", (F.col("draw") % F.col("n_shards")).alias("shard"))
    stream = Window.partitionBy("source", "shard").orderBy("draw", F.col("key").asc_nulls_last(), "size")
    placed, _ = store(dealt.withColumn("end", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0))), "placed")

    shards = placed.groupBy("source", "shard").agg(F.max("end").alias("words")).withColumn("blocks", F.ceil(F.col("words") / block))
    everything = Window.partitionBy()
    seats = F.round(F.sum("target").over(everything) / block).cast("long")
    won = apportion(sources, [], "target", seats, [F.col("source").asc_nulls_last()])
    won = won.select(F.col("source").alias("s"), F.col("size").alias("source_size"), "target", "quota")
    s = shards.join(small(store(won, "quotas")[0], SMALL_SOURCES), F.col("source").eqNullSafe(F.col("s")))
    s = s.select("source", "shard", "words", "blocks", "source_size", "target", F.col("quota").alias("seats"))
    s = apportion(s, ["source"], "blocks", F.col("seats"), [F.col("shard")])
    s = s.withColumn("quota", F.least(F.col("quota"), F.col("blocks") * repeats))
    n = F.greatest(F.col("blocks"), F.lit(1))
    s = s.select(
        F.col("source").alias("s"), F.col("shard").alias("h"), "words", "source_size", "target",
        F.floor(F.col("quota") / n).alias("passes"), (F.col("quota") % n * block).alias("more"),
        (unit(seed, F.col("source"), F.col("shard")) % n * block).alias("start"), (n * block).alias("round"),
    )
    plan, _ = store(s, "plan")
    both = placed.join(small(plan, SMALL_SOURCES), F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h")))
    a, b = F.col("end") - F.col("size"), F.col("end")
    one = overlap(a, b, F.col("start"), F.col("start") + F.col("more"))
    two = overlap(a, b, F.lit(0), F.col("start") + F.col("more") - F.col("round"))
    taken = F.col("passes") * F.col("size") + one + two
    first = F.when(one > 0, F.greatest(F.col("start") - a, F.lit(0))).otherwise(0)
    return both.select(F.col("key").alias(key), "size", "source_size", "target", taken.cast("long").alias("taken"), first.cast("long").alias("first_word"))
