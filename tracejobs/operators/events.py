"""Traces as sets of event pairs, and how well sampled traces stand for all by these sets.

A span's events are its start, its logs' templates by time, an error, a slowness, and its end; a trace's set has each
two that follow one another, and from each parent's end to each child's start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracejobs.functions.quantiles import ratio
from tracejobs.operators.joins import KEY
from tracejobs.operators.rounds import cut

NAME = ["datapack", "service_name", "span_name"]
#: Patterns of a block in pairwise comparison, on average: all blocks are sent to half of the others, so they are few and large.
BLOCK = 32768
#: Counts of a strip of a block's patterns against all of another's.
CELLS = 1 << 20


def slow_limits(sli: DataFrame) -> DataFrame:
    """(datapack, service_name, span_name, limit_ms): the mean of the p90s of a roll-up, which should hold the normal phase only."""
    return sli.groupBy(*NAME).agg(F.avg("duration_p90").alias("limit_ms"))


def _is_root(entrance: str | None) -> Column:
    root = F.coalesce(F.col("parent_span_id"), F.lit("")) == ""
    return root if entrance is None else root & (F.col("service_name") == entrance)


def log_chains(logs: DataFrame) -> DataFrame:
    """(trace_id, said): of each trace id, the first and last log token of each span and the distinct pairs of those that follow one another.

    Logs are ordered by a window over a span, which spills however many a span has; what is left of a span is its
    different pairs of templates.
    """
    rows = logs.where("template IS NOT NULL AND span_id IS NOT NULL").select(*KEY, "span_id", "time", F.concat(F.lit("L:"), F.col("template").cast("string")).alias("token"))
    following = F.lead("token").over(Window.partitionBy(*KEY, "span_id").orderBy("time", "token"))
    place = F.struct("time", "token")
    pair = F.when(F.col("b").isNotNull(), F.struct(F.col("token").alias("a"), "b"))
    spans = rows.withColumn("b", following).groupBy(*KEY, "span_id").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.collect_set(pair).alias("pairs"))
    return spans.groupBy("trace_id").agg(F.collect_list(F.struct("datapack", F.col("span_id").alias("at"), F.struct(F.col("first.token").alias("first"), F.col("last.token").alias("last"), "pairs").alias("told"))).alias("said"))


def event_pairs(spans: DataFrame, logs: DataFrame, limits: DataFrame, entrance: str | None = None) -> DataFrame:
    """Distinct (datapack, trace_id, a, b) of events that follow one another, of traces with a root (of the entrance, if one is named).

    logs: (datapack, trace_id, span_id, time, template); a null template or span is no event, equal times are in the
    order of templates. limits: a row an operation, sent to all tasks. Tokens: S start, L log, E error, P slower than the limit,
    F end. A trace without a root has no pairs. A span, its logs and its children's starts meet by a group over its id, so
    that spans dealt by their trace stay where they are; logs come by trace id. Spans of one trace that repeat an id are
    chains of their own.
    """
    of_trace = Window.partitionBy(*KEY)
    own = spans.withColumns({"op": F.concat_ws("_", "service_name", "span_name"), "rooted": F.max(_is_root(entrance)).over(of_trace), "one": F.row_number().over(of_trace.orderBy("span_id"))})
    own = own.join(F.broadcast(limits), NAME, "left").join(log_chains(logs), "trace_id", "left")
    token = lambda letter: F.concat(F.lit(f"{letter}:"), "op")
    slow = (F.col("limit_ms") > 0) & (F.col("duration") / 1e6 > F.col("limit_ms"))
    fixed = F.array_compact(F.array(token("S"), F.when(F.col("status_code") == "Error", token("E")), F.when(slow, token("P")), token("F")))
    kinds = {"fixed": "array<string>", "start": "string", "told": "struct<first:string,last:string,pairs:array<struct<a:string,b:string>>>"}
    row = lambda at, **of: F.struct(at.alias("at"), *[of.get(k, F.lit(None).cast(t)).alias(k) for k, t in kinds.items()])
    chains = F.when(F.col("one") == 1, F.transform(F.filter("said", lambda x: x["datapack"] == F.col("datapack")), lambda x: row(x["at"], told=x["told"].cast(kinds["told"]))))
    rows = F.concat(F.array_compact(F.array(row(F.col("span_id"), fixed=fixed), F.when(F.col("parent_span_id") != "", row(F.col("parent_span_id"), start=token("S"))))), F.coalesce(chains, F.array().cast(f"array<struct<at:string,{','.join(f'{k}:{t}' for k, t in kinds.items())}>>")))
    known = F.col("rooted") & F.col("datapack").isNotNull() & F.col("trace_id").isNotNull()
    met = own.select(*KEY, F.inline(F.when(known, rows))).groupBy(*KEY, "at").agg(F.collect_set("fixed").alias("fixed"), F.collect_set(F.when(F.col("at").isNotNull(), F.col("start"))).alias("starts"), F.max("told.first").alias("first"), F.max("told.last").alias("last"), F.flatten(F.collect_list("told.pairs")).alias("pairs"))
    span = met.select(*KEY, F.explode("fixed").alias("f"), "starts", "first", "last", "pairs")
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    f, first, none = F.col("f"), F.col("first"), F.array().cast("array<struct<a:string,b:string>>")
    begins = F.when(first.isNull(), F.array(pair(F.get(f, F.lit(0)), F.get(f, F.lit(1))))).otherwise(F.array(pair(F.get(f, F.lit(0)), first), pair(F.col("last"), F.get(f, F.lit(1)))))
    goes_on = F.transform(F.sequence(F.lit(1), F.size(f) - 2), lambda i: pair(F.get(f, i), F.get(f, i + 1)))
    called = F.transform("starts", lambda x: pair(F.element_at(f, -1), x))
    found = F.concat(begins, F.when(F.size(f) > 2, goes_on).otherwise(none), F.coalesce("pairs", none), called)
    return span.select(*KEY, F.inline(found)).distinct()


def _signature() -> list[Column]:
    code = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "a", "b"))
    return [F.struct(F.count(F.lit(1)).alias("n"), code(0).alias("x"), code(1).alias("y")).alias("pattern")]


def signatures(pairs: DataFrame) -> DataFrame:
    """(datapack, trace_id, pattern): a hash of each trace's set of pairs: its size and 128 bits that do not depend on the order, summed up on the map side."""
    return pairs.groupBy(*KEY).agg(*_signature())


def _marked(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """rows with a column ``chosen``: whether their trace is sampled. Joined by the trace id alone, so that rows dealt by it stay where they are."""
    by_id = samples.select(*KEY).groupBy("trace_id").agg(F.collect_set("datapack").alias("sampled_in"))
    return rows.join(by_id, "trace_id", "left").withColumn("chosen", F.coalesce(F.array_contains("sampled_in", F.col("datapack")), F.lit(False))).drop("sampled_in")


def event_coverage(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """Per datapack: different event pairs and trace patterns, those of sampled traces, their parts, the entropy of the sampled patterns and how many a sampled trace brings.

    samples: (datapack, trace_id); repeated ones count once. The entropy is in bits, 0 for a single pattern.
    """
    marked = _marked(pairs, samples)
    # a pair's or a pattern's rows are folded to one before anything is counted
    by_pair = marked.groupBy("datapack", "a", "b").agg(F.max("chosen").alias("s")).groupBy("datapack").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("s").alias("sampled_pairs"))
    patterns = _marked(signatures(pairs), samples).groupBy("datapack", "pattern").agg(F.count_if("chosen").alias("c"))
    sampled = samples.select(*KEY).distinct().groupBy("datapack").agg(F.count(F.lit(1)).alias("traces"))
    c = F.col("c").cast("double")
    by = patterns.groupBy("datapack").agg(F.count(F.lit(1)).alias("patterns"), F.count_if(F.col("c") > 0).alias("sampled_patterns"), F.sum("c").alias("n"), F.sum(F.when(c > 0, c * F.log2(F.when(c > 0, c)))).alias("clogc"))
    entropy = F.when(F.col("sampled_patterns") > 1, F.log2(F.col("n").cast("double")) - F.col("clogc") / F.col("n")).otherwise(0.0)
    out = by_pair.join(by, "datapack").join(sampled, "datapack", "left")
    return out.select(
        "datapack", "pairs", "sampled_pairs", F.round(ratio(F.col("sampled_pairs"), F.col("pairs")), 6).alias("event_coverage"), "patterns", "sampled_patterns", F.round(ratio(F.col("sampled_patterns"), F.col("patterns")), 6).alias("pattern_coverage"),
        F.round(entropy, 6).alias("entropy"), F.round(ratio(F.col("sampled_patterns"), F.col("traces")), 6).alias("benefit_cost"),
    )


def anomaly_scores(spans: DataFrame, logs: DataFrame, limits: DataFrame, samples: DataFrame, entrance: str | None = None) -> DataFrame:
    """Per datapack: the mean score of sampled traces that have a root, and how many there are.

    A trace's score: 5 for each span in error, 1, 2 or 3 if its root takes at least 1.5, 3 or 5 times its limit, and 1 for
    each warning and 2 for each error in its logs. A trace's first root by time and id counts.
    """
    chosen = samples.select(*KEY).distinct()
    own = spans.join(chosen, KEY, "left_semi")
    root = F.min(F.when(_is_root(entrance), F.struct("time", "span_id", "service_name", "span_name", "duration")))
    traces = own.groupBy(*KEY).agg(root.alias("root"), F.count_if(F.col("status_code") == "Error").alias("errors")).where("root IS NOT NULL")
    times = F.try_divide(F.col("root.duration") / 1e6, F.col("limit_ms"))
    slow = F.when(times >= 5, 3.0).when(times >= 3, 2.0).when(times >= 1.5, 1.0).otherwise(0.0)
    said = logs.groupBy(*KEY).agg(F.sum(F.when(F.col("level").isin("WARN", "WARNING"), 1).when(F.col("level").isin("ERROR", "SEVERE"), 2).otherwise(0)).alias("said"))
    both = traces.withColumns({"service_name": F.col("root.service_name"), "span_name": F.col("root.span_name")}).join(limits, NAME, "left").join(said, KEY, "left")
    score = F.col("errors") * 5.0 + slow + F.coalesce("said", F.lit(0))
    return both.groupBy("datapack").agg(F.count(F.lit(1)).alias("traces"), F.round(F.avg(score), 6).alias("score"))


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of Jaccard similarities over the pairs of patterns of two blocks (each pair once within one block).

    The right block is an inverted list; the left one goes over it in strips of at most CELLS counts, so that only event pairs
    that both sides have cost anything.
    """
    for batch in batches:
        for i in range(batch.num_rows):
            (a, na), (b, nb) = (_rows(batch[c][i]) for c in ("left", "right"))
            same, total, wide = batch["same"][i].as_py(), 0.0, max(1, len(b))
            items = np.concatenate([np.zeros(0, "int64"), *b])
            order = np.argsort(items, kind="stable")
            items, owner = items[order], np.repeat(np.arange(len(b)), nb)[order]
            strip = max(1, CELLS // wide)
            for lo in range(0, len(a), strip):
                mine = np.concatenate([np.zeros(0, "int64"), *a[lo : lo + strip]])
                row = np.repeat(np.arange(len(na[lo : lo + strip])), na[lo : lo + strip])
                first = np.searchsorted(items, mine, side="left")
                n = np.searchsorted(items, mine, side="right") - first
                met = owner[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
                shared = np.bincount(np.repeat(row, n) * wide + met)
                at = np.nonzero(shared)[0]
                left, right, shared = lo + at // wide, at % wide, shared[at].astype("float64")
                alike = shared / (na[left] + nb[right] - shared)
                total += float(alike[right > left].sum() if same else alike.sum())
            yield pa.RecordBatch.from_pydict({"datapack": [batch["datapack"][i].as_py()], "alike": pa.array([total], pa.float64())})


def _rows(cell: pa.ListScalar) -> tuple[list[np.ndarray], np.ndarray]:
    lists = cell.values
    flat, starts = lists.flatten().to_numpy(), np.cumsum([0, *(len(x) for x in lists)])
    return [flat[s:e] for s, e in zip(starts, starts[1:])], np.diff(starts)


def mean_dissimilarity(pairs: DataFrame, samples: DataFrame, block: int = BLOCK) -> DataFrame:
    """(datapack, patterns, dissimilarity): the mean Jaccard distance over all pairs of different patterns of sampled traces, 0 for fewer than two.

    Different patterns are dealt into blocks of bounded size; blocks meet by number, and each meeting gives one sum, so
    that no pair of patterns ever is a row, whatever event pairs they share. Sums are of similarities: pairs without a
    common event pair add nothing to them and are counted in closed form.
    """
    own = _marked(pairs, samples).where("chosen")
    traces = own.groupBy(*KEY).agg(*_signature(), F.array_sort(F.collect_set(F.xxhash64("a", "b"))).alias("items"))
    items = cut(traces.groupBy("datapack", "pattern").agg(F.min("items").alias("items")))
    n = items.groupBy("datapack").agg(F.count(F.lit(1)).alias("patterns"))
    dealt = items.join(n, "datapack").withColumn("blocks", F.ceil(F.col("patterns") / block)).withColumn("block", F.pmod(F.xxhash64("pattern"), F.col("blocks")))
    blocks = cut(dealt.groupBy("datapack", "block").agg(F.max("blocks").alias("blocks"), F.collect_list("items").alias("rows")))
    left = blocks.select("datapack", F.col("block").alias("own"), F.col("rows").alias("left"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("block"))
    met = left.join(blocks.select("datapack", "block", F.col("rows").alias("right")), ["datapack", "block"]).select("datapack", (F.col("own") == F.col("block")).alias("same"), "left", "right")
    alike = met.mapInArrow(_block_sums, "datapack string, alike double").groupBy("datapack").agg(F.sum("alike").alias("alike"))
    every = F.col("patterns") * (F.col("patterns") - 1) / 2
    return n.join(alike, "datapack").select("datapack", "patterns", F.round(F.when(every > 0, 1 - F.col("alike") / F.when(every > 0, every)).otherwise(0.0), 6).alias("dissimilarity"))
