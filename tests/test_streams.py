"""Streams give what the same job gives over the table, in several batches."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracejobs.operators import detect, sampling
from tracejobs.sources import fixtures as fx
from tracejobs.streaming import online, rollups

SF = "/root/testdata/sf0.001"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def stream(spark, tmp_path):
    """A stream of a table's rows, one file a batch in the order given, and its end as a table."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def source(df, name, order=None, files=3):
        path = str(tmp_path / name)
        rows = df.withColumn("_file", F.ntile(files).over(Window.orderBy(*(order or df.columns)))).cache()
        for i in range(files):
            rows.where(F.col("_file") == i + 1).drop("_file").coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)

    def run(df, mode="append"):
        name = f"t{abs(hash(str(tmp_path)))}"
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        return spark.table(name)

    yield source, run
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_trend_is_batch(spark, stream):
    source, run = stream
    metrics = fx.metrics(spark, SF).where("service_name IN ('svc-1', 'svc-2')").withColumn("datapack", F.lit("d"))
    wanted = detect.trend_detector(metrics, 10, 2.0)
    found = run(online.trend_stream(source(metrics, "m", ["time", "seq"]), 10, 2.0))
    cols = ["datapack", "service_name", "metric", "seq", "value", "kind", F.round("mean", 6), F.round("confidence", 6)]
    assert rows(found, *cols) == rows(wanted, *cols) != []


def test_log_spans_join(spark, stream):
    source, run = stream
    at = lambda data, schema: spark.createDataFrame(data, schema).withColumn("time", F.timestamp_seconds("time"))
    spans = at([("p", 100, 1, "a"), ("p", 102, 1, "b"), ("q", 100, 2, "c"), ("p", 500, 3, "d")], "pod string, time long, trace_id long, span_id string")
    logs = at([("p", 101, 7), ("p", 99, 8), ("q", 105, 9), (None, 100, 10)], "pod string, time long, log_id long")
    found = run(online.log_span_stream(source(spans, "s", ["time"], 2), source(logs, "l", ["time"], 2)))
    assert rows(found, "log_id", "span_id") == [(7, "a"), (7, "b"), (8, "a")]


def test_scoreboard(spark, stream):
    source, run = stream
    judged = spark.createDataFrame([("x", True, 1.0), ("x", False, 0.5), ("x", None, None), ("y", True, 0.25)], "algorithm string, correct boolean, f1 double")
    assert rows(run(online.scoreboard(source(judged, "j")), "complete"), "algorithm", "right", "wrong", "unknown", "mean_f1") == [("x", 1, 1, 1, 0.75), ("y", 1, 0, 0, 0.25)]


def test_online_sampling_is_batch(spark, stream):
    source, run = stream
    spans = fx.spans(spark, SF)
    wanted = rows(sampling.online(spans, 0.3), "trace_id", "span_id")
    assert rows(run(sampling.online(source(spans, "sp"), 0.3)), "trace_id", "span_id") == wanted != []


def test_windows_are_batch(spark, stream):
    source, run = stream
    spans = fx.spans(spark, SF)
    keys = ["datapack", "time", "service_name", "span_name"]
    exact = spans.groupBy("datapack", F.window("time", "30 days")["start"].alias("time"), "service_name", "span_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status_code") == "Error").alias("e"), F.sort_array(F.collect_list(F.col("duration") / 1e6)).alias("all"))
    found = run(rollups.sli_stream(source(spans, "sp", ["time"]), "30 days", "1 second"), "complete")
    assert rows(found, *keys, "total_count", "error_count") == rows(exact, *keys, "n", "e")
    # approximate quantiles are values of their windows, at the rank they should have
    both = found.join(exact, keys)
    assert both.where(~F.expr("array_position(all, duration_p50) BETWEEN floor(0.5 * n) AND floor(0.5 * n) + 1")).count() == 0


def test_sliding_error_rate(spark, stream):
    source, run = stream
    spans = spark.createDataFrame([("d", "s", 5, 500), ("d", "s", 14, 200), ("d", "s", 300, 404)], "datapack string, service_name string, time long, http_status int").withColumn("time", F.timestamp_seconds("time"))
    found = run(rollups.error_rate_stream(source(spans, "sp", ["time"]), "20 seconds", "10 seconds", "1 second"), "complete")
    got = {(int(r.time.timestamp()), r.error_rate) for r in found.withColumn("time", F.col("time")).collect()}
    assert got == {(-10, 100.0), (0, 50.0), (10, 0.0), (290, 100.0), (300, 100.0)}


def test_traces_close_after_a_gap(spark, stream):
    source, run = stream
    data = [("d", 1, "a", "", 10, 50, "Ok"), ("d", 1, "b", "a", 20, 20, "Error"), ("d", 2, "c", "", 15, 7, "Ok"), ("d", 3, "e", "", 500, 1, "Ok"), ("d", 4, "f", "", 900, 1, "Ok")]
    spans = spark.createDataFrame(data, "datapack string, trace_id long, span_id string, parent_span_id string, time long, duration long, status_code string").withColumn("time", F.timestamp_seconds("time"))
    found = run(rollups.assemble_traces(source(spans, "sp", ["time"], 5), "30 seconds", "10 seconds"))
    # trace 4 is still open when the stream ends
    assert rows(found, "trace_id", "spans", "errors", "root_duration") == [(1, 2, 1, 50), (2, 1, 0, 7), (3, 1, 0, 1)]


def test_repeats_go(spark, stream):
    source, run = stream
    spans = spark.createDataFrame([(1, "a", 10), (1, "a", 12), (1, "b", 12), (2, "a", 13), (1, "a", 14)], "trace_id long, span_id string, time long").withColumn("time", F.timestamp_seconds("time"))
    assert rows(run(rollups.without_repeats(source(spans, "sp", ["time"], 5))), "trace_id", "span_id") == [(1, "a"), (1, "b"), (2, "a")]
