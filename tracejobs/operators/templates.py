"""Templates of log messages: a tree of fixed depth by length and first word, and merging of similar messages at its leaves.

The result depends on the messages alone, not on their order or how they are dealt over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracejobs.operators.rounds import cut

ANY = "<*>"
#: What stands for a parameter wherever it occurs, in this order.
MASKS = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d+)?\b",
    r"\b0x[0-9a-fA-F]+\b",
    r"\b(?=[0-9a-f]*\d)[0-9a-f]{12,}\b",
    r"(?<![A-Za-z0-9_])[-+]?\d+(\.\d+)?(?![A-Za-z0-9_])",
)
#: Part of a template's words that a message must share to join it, and how many patterns of a leaf meet at once.
ALIKE, PIECE = 0.4, 4096


def pattern_of(message: Column) -> Column:
    """A message with its parameters masked and its white space made single blanks; an empty or null message has none."""
    text = F.trim(F.regexp_replace(message, r"\s+", " "))
    for mask in MASKS:
        text = F.regexp_replace(text, mask, ANY)
    return F.when(text != "", text)


def merge_patterns(texts: list[str], weights: list[int], alike: float = ALIKE) -> list[str]:
    """The template of each of some patterns with the same number of words.

    Patterns come by falling weight, then text; each joins the template it shares most words with (the earliest of
    those), if that is at least the part ``alike``; words that differ become parameters. A parameter is no shared word.
    """
    if not texts:
        return []
    words = [t.split(" ") for t in texts]
    names = {w: i for i, w in enumerate(dict.fromkeys(w for row in words for w in row), 1)}
    names[ANY] = 0
    codes = np.array([[names[w] for w in row] for row in words], "int64")
    order = sorted(range(len(texts)), key=lambda i: (-weights[i], texts[i]))
    found, n, of = np.empty_like(codes), 0, np.empty(len(texts), "int64")
    for i in order:
        shared = ((found[:n] == codes[i]) & (codes[i] != 0)).sum(axis=1)
        best = int(shared.argmax()) if n else -1
        if n and (shared[best] >= alike * codes.shape[1] or (found[best] == codes[i]).all()):
            found[best][found[best] != codes[i]] = 0
        else:
            best, n = n, n + 1
            found[best] = codes[i]
        of[i] = best
    spelt = {i: w for w, i in names.items()}
    texts_of = [" ".join(spelt[c] for c in row) for row in found[:n].tolist()]
    return [texts_of[x] for x in of.tolist()]


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"length": pdf["length"], "head": pdf["head"], "text": pdf["text"], "template": merge_patterns(pdf["text"].tolist(), pdf["n"].tolist())})


def templates(patterns: DataFrame, piece: int = PIECE) -> DataFrame:
    """(pattern, template) for each of the patterns (pattern, n), n being how often it occurs.

    Leaves are by the number of words and the first word, if it is no parameter. A leaf of more than ``piece`` patterns is dealt
    into pieces by hash; the templates of pieces meet again, under another hash, until a leaf is one piece or
    its templates merge no further, so that no task ever holds more than about a piece.
    """
    head = F.substring_index("pattern", " ", 1)
    own = cut(patterns.select("pattern", F.col("pattern").alias("text"), F.size(F.split("pattern", " ")).alias("length"), F.when(head.contains(ANY), ANY).otherwise(head).alias("head"), "n"))
    seed, before = 0, None
    while True:
        texts = own.groupBy("length", "head", "text").agg(F.sum("n").alias("n"))
        sizes = cut(texts.groupBy("length", "head").agg(F.count(F.lit(1)).alias("texts")))
        now = sizes.agg(F.sum("texts"), F.max("texts")).first()
        if before is not None and now[0] == before:
            break
        dealt = texts.join(sizes, ["length", "head"]).withColumn("piece", F.pmod(F.xxhash64("text", F.lit(seed)), F.ceil(F.col("texts") / piece)))
        merged = dealt.groupBy("length", "head", "piece").applyInPandas(_merge, "length int, head string, text string, template string")
        own = cut(own.join(merged, ["length", "head", "text"]).select("pattern", F.col("template").alias("text"), "length", "head", "n"))
        if (now[1] or 0) <= piece:
            break
        seed, before = seed + 1, now[0]
    return own.select("pattern", F.col("text").alias("template"))


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """df, whose values of ``column`` are different, with each value's place in their order, from 1: counted range by range, without one task for all."""
    placed = cut(df.repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    before = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each task
    inside = placed.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(column)))
    return inside.join(F.broadcast(before), "_part").withColumn(name, (F.col("_in") + F.coalesce("_before", F.lit(0))).cast("long")).drop("_part", "_in", "_n", "_before")


def mine_templates(messages: DataFrame, message: str = "message", piece: int = PIECE) -> DataFrame:
    """(pattern, template, template_id) of all messages: ids are the places of the templates' texts in their order.

    Equal messages, and those that differ by parameters that the masks know, are one pattern and are counted on the map side.
    Null and empty messages have no template.
    """
    patterns = messages.select(pattern_of(F.col(message)).alias("pattern")).where("pattern IS NOT NULL").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    found = cut(templates(patterns, piece))
    return found.join(numbered(found.select("template").distinct(), "template", "template_id"), "template").select("pattern", "template", "template_id")


def with_templates(logs: DataFrame, mined: DataFrame, message: str = "message") -> DataFrame:
    """logs with template_id and log_template, null for messages that have none."""
    known = mined.select(F.col("pattern").alias("_pattern"), "template_id", F.col("template").alias("log_template"))
    return logs.withColumn("_pattern", pattern_of(F.col(message))).join(known, "_pattern", "left").drop("_pattern")
