"""Exports are read and brought to the standard tables; what does not fit is refused."""

import json

import pytest
from pyspark.sql import functions as F

from tracejobs.sources import telemetry as tm


def test_read_signal_of_folders(spark, tmp_path):
    for pack, period, v in (("a b", "normal", 1), ("a b", "abnormal", 2), ("c", "normal", 3)):
        spark.createDataFrame([(v,)], "v int").write.parquet(str(tmp_path / pack / f"{period}_logs.parquet"))
    spark.createDataFrame([(4, "x")], "v int, more string").write.parquet(str(tmp_path / "c" / "abnormal_logs.parquet"))
    spark.createDataFrame([(9,)], "v int").write.parquet(str(tmp_path / "c" / "normal_traces.parquet"))
    rows = tm.read_signal(spark, str(tmp_path), "logs").collect()
    assert {(r.datapack, r.period, r.v, r.more) for r in rows} == {("a b", "normal", 1, None), ("a b", "abnormal", 2, None), ("c", "normal", 3, None), ("c", "abnormal", 4, "x")}
    assert {r.v for r in tm.read_signal(spark, str(tmp_path), "logs", ["c"], ("normal",)).collect()} == {3}


RAW = "Timestamp timestamp, TraceId string, SpanId string, ParentSpanId string, SpanName string, SpanKind string, ServiceName string, ResourceAttributes string, SpanAttributes string, Duration long, StatusCode string"


def test_standard_traces(spark):
    row = lambda i, service, attributes, duration=5: (None, "t", str(i), None, f"GET /a/{i}", "Server", service, json.dumps({"pod.name": "p", "service.name": service}), attributes, duration, "Ok")
    raw = spark.createDataFrame([row(1, "loadgenerator", json.dumps({"http.method": "PUT", "http.request.method": "GET", "http.status_code": "204"})), row(2, "web", '{"http.response.status_code": "no", "http.response_content_length": "12"}'), row(3, "web", None), row(4, "web", "{broken")], RAW)
    out = tm.standard_traces(raw, lambda c: F.regexp_replace(c, r"\d", "N"))
    tm.validate(out, "traces")
    got = {r.span_id: r for r in out.collect()}
    assert (got["1"].span_name, got["2"].span_name) == ("GET /a/N", "GET /a/2")
    assert [got[i]["attr.http.request.method"] for i in "1234"] == ["GET", None, None, None]
    assert [got[i]["attr.http.response.status_code"] for i in "1234"] == [204, None, None, None]
    assert got["2"]["attr.http.response.content_length"] == 12 and got["1"]["attr.k8s.service.name"] == "loadgenerator"
    assert tm.standard_traces(raw.withColumn("Duration", F.col("SpanId").cast("long")), longest_ns=3).count() == 0  # one trace, one long span
    assert tm.standard_traces(raw, longest_ns=5).count() == 4


def test_validation(spark):
    good = spark.createDataFrame([], "time timestamp, metric string, value double, service_name string, `attr.x` int, datapack string")
    tm.validate(good, "metrics")
    for bad, told in ((good.drop("value"), "missing column: value"), (good.withColumn("value", F.lit(1)), "column value is int"), (good.withColumn("odd", F.lit(1)), "unexpected columns")):
        with pytest.raises(ValueError, match=told):
            tm.validate(bad, "metrics")


def test_dataset_and_subset(spark, tmp_path):
    rows = spark.createDataFrame([("a", 3, 1.0), ("a", 1, 2.0), ("b", 2, 3.0)], "datapack string, s long, value double").select("datapack", F.timestamp_seconds("s").alias("time"), F.lit("m").alias("metric"), "value", F.lit("w").alias("service_name"), F.lit(1).alias("attr.x"))
    tm.write_dataset(rows, "metrics", str(tmp_path), "d0")
    tm.write_dataset(rows.where("datapack = 'b'").withColumn("value", F.lit(9.0)), "metrics", str(tmp_path), "d0")
    back = spark.read.parquet(str(tmp_path / "data" / "d0" / "metrics"))
    assert {(r.datapack, r.value) for r in back.collect()} == {("a", 1.0), ("a", 2.0), ("b", 9.0)}
    labels = spark.createDataFrame([("b", "service", "x"), ("a", "service", "y"), ("a", "pod", "z"), ("c", None, None)], "datapack string, level string, name string")
    index, told = tm.index_and_labels(labels, "d0")
    assert [r.datapack for r in index.collect()] == ["a", "b", "c"] and [tuple(r)[1:] for r in told.collect()] == [("a", "pod", "z"), ("a", "service", "y"), ("b", "service", "x")]
    few = spark.createDataFrame([("a",), ("a",)], "datapack string")
    i2, l2 = tm.subset(index, told, few, "d1")
    assert [tuple(r) for r in i2.collect()] == [("d1", "a")] and {tuple(r) for r in l2.collect()} == {("d1", "a", "pod", "z"), ("d1", "a", "service", "y")}
    with pytest.raises(ValueError, match="not in the dataset: zz"):
        tm.subset(index, told, spark.createDataFrame([("zz",)], "datapack string"), "d1")
    with pytest.raises(Exception, match="a label needs"):
        tm.index_and_labels(labels.withColumn("name", F.lit("")), "d0")[1].collect()


def test_nested_spans_and_lines(spark, tmp_path):
    trace = {"processes": {"p1": {"serviceName": "web"}}, "spans": [{"traceID": "t", "spanID": "a", "startTime": 8 * 3600 * 10**6 + 5, "duration": 7, "operationName": "op", "processID": "p1", "references": []}, {"traceID": "t", "spanID": "b", "startTime": 8 * 3600 * 10**6, "duration": 1, "operationName": "op2", "processID": "p9", "references": [{"spanID": "a"}, {"spanID": "z"}]}]}
    (tmp_path / "spans.json").write_text(json.dumps([trace], indent=1))
    got = {r.span_id: r for r in tm.nested_spans(spark, str(tmp_path / "spans.json")).withColumn("us", F.unix_micros("time")).collect()}
    assert (got["a"].us, got["a"].service_name, got["a"].parent_span_id, got["b"].parent_span_id, got["b"].service_name) == (5, "web", "", "a", None)
    (tmp_path / "logs.json").write_text(json.dumps({"web": ["[2022-Apr-17 10:00:00.250000] <info>: (x.cpp:5) hello: <b>", "no time <info>: x", "[never] <info>: x"], "db": ["[2022-Apr-18 08:00:00.000000] <error>:   down"]}))
    rows = tm.parsed_lines(tm.service_lines(spark, str(tmp_path / "logs.json")), "bracketed").withColumn("at", F.date_format("time", "dd HH:mm:ss.SSS")).collect()
    assert {(r.service_name, r.level, r.message, r["at"]) for r in rows} == {("web", "info", "(x.cpp:5) hello: <b>", "17 02:00:00.250"), ("db", "error", "down", "18 00:00:00.000")}
    tt = spark.createDataFrame([("o", "2022-04-17 10:00:00.123  WARN 1 --- [main] x : y"), ("o", "junk")], "service_name string, line string")
    assert [(r.level, r.message) for r in tm.parsed_lines(tt, "dashed").collect()] == [("WARN", "[main] x : y")]


def test_epochs_conclusions_and_defaults(spark, tmp_path):
    df = spark.createDataFrame([("1700000000", "1700000000123", "1700000000123456", "1700000000123456789")], "s string, ms string, us string, ns string")
    assert tuple(df.select(*[F.unix_micros(tm.epoch(c, c)) for c in df.columns]).first()) == (1700000000000000, 1700000000123000, 1700000000123456, 1700000000123456)
    assert tm.read_conclusions(spark, []).columns[0] == "SpanName" and tm.read_conclusions(spark, []).count() == 0
    (tmp_path / "dp1").mkdir()
    header = ",".join(c.split(" ")[0] for c in tm.CONCLUSION.split(", "))
    (tmp_path / "dp1" / "conclusion.csv").write_text(header + '\n"GET /a","{""p90"": {}}",1,2,3,4,5,6,7,8,9,10\n"GET /b","{}",,,,,,,,,,\n')
    rows = {r.SpanName: r for r in tm.read_conclusions(spark, [str(tmp_path / "dp1" / "conclusion.csv")]).collect()}
    assert rows["GET /a"].Issues == '{"p90": {}}' and rows["GET /a"].NormalP99 == 10.0 and rows["GET /b"].AbnormalP90 is None and rows["GET /b"].datapack == "dp1"
    a, b = spark.createDataFrame([(1, "x")], "k int, name string"), spark.createDataFrame([(2, 0.5)], "k int, rate double")
    assert {tuple(r) for r in tm.union_runs([a, b]).select("k", "name", "rate").collect()} == {(1, "x", None), (2, None, 0.5)}
    assert [tuple(r) for r in tm.with_defaults(a, {"rate": ("double", 0.0), "k": ("long", None)}).collect()] == [(0.0, 1)]
    cases = {"tail_random_0.1_online": ("tail_random", 0.1, "online"), "a_1_offline": ("a", 1.0, "offline"), "0.1_online": None, "a_x_online": None, "a_0.1_other": None, None: None}
    got = spark.createDataFrame([(k,) for k in cases], "f string").withColumn("s", tm.sampler_of(F.col("f"))).collect()
    assert {r.f: r.s and tuple(r.s) for r in got} == cases


def test_nested_lists_stay_short(spark, tmp_path, monkeypatch):
    """A list holds so many ids of traces at most, whatever the table's size: 64 lists of all traces were a row of gigabytes."""
    from tracejobs import queries_ingest

    monkeypatch.setattr(queries_ingest, "LIST", 16)
    monkeypatch.setattr(queries_ingest, "_folder", lambda _: f"file://{tmp_path}/lists")
    n = queries_ingest._nested(spark, "/root/testdata/sf0.001").count()
    assert n == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    lists = spark.read.text(f"file://{tmp_path}/lists").selectExpr("size(from_json(value, 'array<struct<processes:string>>')) AS n")
    assert lists.agg({"n": "max"}).first()[0] == 2  # of 16 ids, each datapack has two
