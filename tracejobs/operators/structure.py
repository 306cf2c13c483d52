"""The shape of traces: levels, paths and their coverage."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracejobs.operators.rounds import cut

KEY = ["datapack", "trace_id"]
#: Traces of at most so many spans are gone through whole, by one task each; longer ones by joins.
WHOLE = 100_000


def tree_levels(spans: DataFrame, start: Column, carry, most: int | None = None) -> DataFrame:
    """(datapack, trace_id, span_id, level, carried): roots are level 1, spans that no root reaches level 1 too.

    carried: ``start`` of each span, put together from the root down by ``carry`` (of what is above, and below), which must be
    associative; a span that no root reaches has its own. Every span points to its parent, and in a round to the one
    that its ancestor points to, so that a round doubles the steps: as many joins as the logarithm of the deepest
    level, each on the trace and the pointer, cut by a checkpoint. Spans in a cycle of parents still point somewhere when
    that many rounds as the longest trace could need are over. A level beyond ``most``, if that is given, raises an error.
    """
    root = F.coalesce("parent_span_id", F.lit("")) == ""
    own = spans.select(*KEY, "span_id", F.when(~root, F.col("parent_span_id")).alias("up"), root.alias("reached"), F.lit(1).alias("level"), start.alias("carried"), start.alias("own"))
    state = cut(own.repartition(*KEY))
    longest = state.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(longest.bit_length() + 1):
        open_ = state.where("up IS NOT NULL")
        if open_.isEmpty():
            break
        above = state.select(*KEY, F.col("span_id").alias("up"), F.col("up").alias("next"), F.col("reached").alias("at_root"), F.col("level").alias("more"), F.col("carried").alias("upper"), F.lit(True).alias("known"))
        met = open_.join(above, [*KEY, "up"], "left")
        moved = met.select(*KEY, "span_id", F.col("next").alias("up"), F.coalesce("at_root", F.lit(False)).alias("reached"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"), F.when(F.col("known"), carry(F.col("upper"), F.col("carried"))).otherwise(F.col("carried")).alias("carried"), "own")
        state = cut(state.where("up IS NULL").unionByName(moved))
    found = F.col("up").isNull() & F.col("reached")
    out = state.select(*KEY, "span_id", F.when(found, F.col("level")).otherwise(1).alias("level"), F.when(found, F.col("carried")).otherwise(F.col("own")).alias("carried"))
    if most is not None and not out.where(F.col("level") > most).isEmpty():
        raise ValueError(f"a trace is deeper than {most} levels")
    return out


def _chains(ids: np.ndarray, ups: np.ndarray) -> list[tuple[int, int]]:
    """(place, level) of a trace whose ids repeat, a row for each chain of parents, as the joins of tree_levels have them."""
    state = [(i, own, up, up < 0, 1) for i, (own, up) in enumerate(zip(ids.tolist(), ups.tolist()))]
    for _ in range(len(ids).bit_length() + 1):
        at = defaultdict(list)
        for row in state:
            at[row[1]].append(row)
        moved = []
        for row in state:
            if row[2] < 0:
                moved.append(row)
            else:
                moved += [(row[0], row[1], up, reached, row[4] + level) for _, _, up, reached, level in at[row[2]]] or [(row[0], row[1], -1, False, row[4])]
        state = moved
    return [(i, level if up < 0 and reached else 1) for i, _, up, reached, level in state]


def _whole_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of whole traces (datapack, trace_id, spans, ups, labels): the level of each span, all traces of a batch by pointer doubling at once."""
    for batch in batches:
        spans, ups, labels = (batch.column(c) for c in ("spans", "ups", "labels"))
        sizes = np.diff(spans.offsets.to_numpy())
        spans, labels, ups = spans.flatten(), labels.flatten(), ups.flatten()
        n, trace = len(spans), np.repeat(np.arange(len(sizes)), sizes)
        code = pa.concat_arrays([spans, ups]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        width = int(code.max(initial=0)) + 2
        ids, wanted = trace * width + code[:n] + 1, trace * width + code[n:] + 1
        order = np.argsort(ids, kind="stable")
        sorted_ids, child = ids[order], code[n:] >= 0
        place = np.minimum(np.searchsorted(sorted_ids, wanted), max(0, n - 1))
        # two more places: n is above the roots, n + 1 above spans whose parent lacks
        above = np.where(child, np.where(sorted_ids[place] == wanted, order[place], n + 1), n) if n else np.zeros(0, np.int64)
        above, far = np.append(above, [n, n + 1]), np.append(np.ones(n, np.int64), [0, 0])
        for _ in range(int(sizes.max(initial=0)).bit_length() + 1):
            far, above = far + far[above], above[above]
        level, rows = np.where(above[:n] == n, far[:n], 1), np.arange(n)
        again = np.unique(trace[order[1:]][(sorted_ids[1:] == sorted_ids[:-1]) & (code[order[1:]] >= 0)])
        if len(again):
            starts = np.cumsum(sizes) - sizes
            parts = [(rows[~np.isin(trace, again)], level[~np.isin(trace, again)])]
            for t in again:
                own = slice(starts[t], starts[t] + sizes[t])
                found = np.array(_chains(code[:n][own], code[n:][own]), np.int64)
                parts.append((found[:, 0] + starts[t], found[:, 1]))
            rows, level = (np.concatenate(x) for x in zip(*parts))
            sizes = np.bincount(trace[rows], minlength=len(sizes))
            order = np.argsort(rows, kind="stable")
            rows, level = rows[order], level[order]
            spans, labels = spans.take(pa.array(rows)), labels.take(pa.array(rows))
        ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, x) for x in (spans, labels, pa.array(level, pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column("datapack"), batch.column("trace_id"), *lists], ["datapack", "trace_id", "spans", "labels", "levels"])


def whole_levels(spans: DataFrame) -> DataFrame:
    """(datapack, trace_id, spans, labels, levels) a row a trace, levels as tree_levels has them. A trace is held by one task, where it lies already if spans are dealt by trace."""
    label = F.concat("service_name", F.lit(":"), "span_name")
    child = (F.col("parent_span_id") != "") & F.col("datapack").isNotNull() & F.col("trace_id").isNotNull()  # a null key joins with nothing
    rows = spans.groupBy(*KEY).agg(F.collect_list(F.struct(F.col("span_id").cast("string").alias("span"), F.when(child, F.col("parent_span_id").cast("string")).alias("up"), label.alias("label"))).alias("rows"))
    kinds = dict(spans.dtypes)
    named = rows.select(*KEY, F.col("rows.span").alias("spans"), F.col("rows.up").alias("ups"), F.col("rows.label").alias("labels"))
    return named.mapInArrow(_whole_levels, f"datapack {kinds['datapack']}, trace_id {kinds['trace_id']}, spans array<string>, labels array<string>, levels array<int>")


def _by_length(spans: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(spans of traces of at most WHOLE, those of longer ones or None); counting needs no more than the keys."""
    longest = spans.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if longest <= WHOLE:
        return spans, None
    counted = spans.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*KEY)))
    return counted.where(F.col("_n") <= WHOLE).drop("_n"), counted.where(F.col("_n") > WHOLE).drop("_n")


def _long_levels(spans: DataFrame, most: int | None = None) -> DataFrame:
    label = F.concat("service_name", F.lit(":"), "span_name")
    return tree_levels(spans, label, lambda above, own: own, most).select(*KEY, "span_id", F.col("carried").alias("label"), "level")


def levels(spans: DataFrame, most: int | None = None) -> DataFrame:
    """(datapack, trace_id, span_id, label, level), as tree_levels has them; traces of at most WHOLE spans without a join."""
    short, long = _by_length(spans)
    out = whole_levels(short).select(*KEY, F.inline(F.arrays_zip("spans", "labels", "levels"))).toDF(*KEY, "span_id", "label", "level")
    out = out.withColumn("span_id", F.col("span_id").cast(dict(spans.dtypes)["span_id"]))
    out = out if long is None else out.unionByName(_long_levels(long))
    if most is not None and not out.where(F.col("level") > most).isEmpty():
        raise ValueError(f"a trace is deeper than {most} levels")
    return out


def depth(spans: DataFrame) -> DataFrame:
    """Each trace's deepest level."""
    short, long = _by_length(spans)
    out = whole_levels(short).select(*KEY, F.array_max("levels").alias("depth"))
    return out if long is None else out.unionByName(_long_levels(long).groupBy(*KEY).agg(F.max("level").alias("depth")))


def path_encoding(spans: DataFrame, distinct_labels: bool = False) -> DataFrame:
    """Each trace's labels by level, sorted within a level, joined by arrows; optionally each label once a level."""
    pairs = F.struct("level", "label")
    encoded = lambda collected: F.array_join(F.transform(F.array_sort(F.array_distinct(collected) if distinct_labels else collected), lambda x: x["label"]), " -> ").alias("encoding")
    short, long = _by_length(spans)
    out = whole_levels(short).select(*KEY, encoded(F.zip_with("levels", "labels", lambda level, label: F.struct(level.alias("level"), label.alias("label")))))
    if long is None:
        return out
    return out.unionByName(_long_levels(long).groupBy(*KEY).agg((F.collect_set(pairs) if distinct_labels else F.collect_list(pairs)).alias("pairs")).select(*KEY, encoded(F.col("pairs"))))


def path_coverage(spans: DataFrame, samples: DataFrame, distinct_labels: bool = True) -> DataFrame:
    """Per datapack: the part of its different path encodings that sampled traces have."""
    coded = path_encoding(spans, distinct_labels).withColumn("code", F.xxhash64("encoding")).drop("encoding")
    chosen = coded.join(samples.select(*KEY).distinct().withColumn("chosen", F.lit(True)), KEY, "left")
    out = chosen.groupBy("datapack").agg(F.count_distinct("code").alias("paths"), F.count_distinct(F.when(F.col("chosen"), F.col("code"))).alias("sampled_paths"))
    return out.withColumn("coverage", F.round(F.col("sampled_paths") / F.col("paths"), 6))
