"""Online forms: detection with state, joins of two streams, sampling and a running score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SERIES = ["datapack", "service_name", "metric"]
_FOUND = "datapack string, service_name string, metric string, seq long, value double, kind string, mean double, confidence double"


class TrendProcessor(StatefulProcessor):
    """Keeps a series' last ``length`` values, and tells of a value that leaves their mean by more than ``sigmas`` of their deviations.

    The state is a list of at most ``length`` numbers a series. Values of a batch are taken by time, then number, within
    each chunk that Spark hands over; what comes late in a later batch is taken as it comes. A null value is
    neither judged nor kept.
    """

    def __init__(self, length: int, sigmas: float) -> None:
        self.length, self.sigmas = length, sigmas

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [v[0] for v in self.last.get()] if self.last.exists() else []
        for pdf in rows:
            found = []
            for seq, value in pdf.dropna(subset=["value"]).sort_values(["time", "seq"], kind="stable")[["seq", "value"]].itertuples(index=False):
                if len(kept) == self.length:
                    mean, sd = float(np.mean(kept)), float(np.std(kept))
                    if sd > 0 and abs(value - mean) > self.sigmas * sd:
                        found.append((*key, int(seq), float(value), "spike" if value > mean else "drop", mean, min(1.0, abs(value - mean) / sd / self.sigmas)))
                kept = [*kept, float(value)][-self.length :]
            yield pd.DataFrame(found, columns=[*SERIES, "seq", "value", "kind", "mean", "confidence"])
        self.last.put([(v,) for v in kept])

    def close(self) -> None:
        pass


def trend_stream(metrics: DataFrame, length: int = 10, sigmas: float = 2.0) -> DataFrame:
    """Spikes and drops of a stream of metrics (datapack, service_name, metric, time, seq, value), as detect.trend_detector finds them in a table.

    Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass.
    """
    rows = metrics.select(*SERIES, "time", "seq", "value")
    return rows.groupBy(*SERIES).transformWithStateInPandas(TrendProcessor(length, sigmas), outputStructType=_FOUND, outputMode="append", timeMode="none")


def log_span_stream(spans: DataFrame, logs: DataFrame, seconds: int = 1, late: str = "2 minutes") -> DataFrame:
    """Each log with the spans of its pod whose start is at most so many seconds away; both sides' state ends with the watermark.

    spans: (pod, time, trace_id, span_id), logs: (pod, time, log_id).
    """
    s = spans.select(F.col("pod").alias("s_pod"), F.col("time").alias("s_time"), "trace_id", "span_id").withWatermark("s_time", late)
    o = logs.select("pod", F.col("time").alias("l_time"), "log_id").withWatermark("l_time", late)
    near = F.expr(f"pod = s_pod AND l_time >= s_time - INTERVAL {seconds} SECONDS AND l_time <= s_time + INTERVAL {seconds} SECONDS")
    return o.join(s, near).select("pod", "log_id", "trace_id", "span_id")


def scoreboard(judged: DataFrame) -> DataFrame:
    """For complete mode: per algorithm, how many samples are right, wrong and without a verdict so far, and their mean F1.

    judged: (algorithm, correct, f1).
    """
    return judged.groupBy("algorithm").agg(
        F.count_if("correct").alias("right"), F.count_if(~F.col("correct")).alias("wrong"), F.count_if(F.col("correct").isNull()).alias("unknown"), F.round(F.avg("f1"), 6).alias("mean_f1"),
    )
