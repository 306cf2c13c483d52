"""Event pairs, trace patterns and their comparison on traces made by hand."""

import itertools
import random

import pytest

from tracejobs.operators import events

SPANS = "datapack string, trace_id long, span_id string, parent_span_id string, service_name string, span_name string, time timestamp, duration long, status_code string"
LOGS = "datapack string, trace_id long, span_id string, time timestamp, level string, template string"


@pytest.fixture
def case(spark):
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    spans = [("d", 1, "a", None, "web", "GET", at(0), 10_000_000, "Ok"), ("d", 1, "b", "a", "db", "SQL", at(1), 2_000_000, "Error"), ("d", 2, "c", "gone", "db", "SQL", at(0), 1_000_000, "Ok"), ("d", 3, "e", "", "db", "SQL", at(0), 1_000_000, "Ok")]
    logs = [("d", 1, "b", at(5), "ERROR", "t2"), ("d", 1, "b", at(3), "WARN", "t1"), ("d", 1, "b", at(5), "INFO", None), ("d", 1, None, at(1), "ERROR", "t3"), ("d", 1, "zz", at(1), "INFO", "t4")]
    limits = [("d", "web", "GET", 2.5), ("d", "db", "SQL", 2.0)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumns({"time": events.F.to_timestamp("time")} if "time" in schema else {})
    return df(spans, SPANS), df(logs, LOGS), spark.createDataFrame(limits, "datapack string, service_name string, span_name string, limit_ms double")


def test_event_pairs(case):
    spans, logs, limits = case
    got = {(r.trace_id, r.a, r.b) for r in events.event_pairs(spans, logs, limits).collect()}
    web = [(1, "S:web_GET", "P:web_GET"), (1, "P:web_GET", "F:web_GET"), (1, "F:web_GET", "S:db_SQL")]
    db = [(1, "S:db_SQL", "L:t1"), (1, "L:t1", "L:t2"), (1, "L:t2", "E:db_SQL"), (1, "E:db_SQL", "F:db_SQL")]
    assert got == {*web, *db, (3, "S:db_SQL", "F:db_SQL")}  # trace 2 has no root; 2 ms is not over the limit of 2 ms
    assert {r.trace_id for r in events.event_pairs(spans, logs, limits, "web").collect()} == {1}
    assert events.event_pairs(spans.where("false"), logs, limits).count() == 0


def test_anomaly_scores(case, spark):
    spans, logs, limits = case
    samples = spark.createDataFrame([("d", 1), ("d", 1), ("d", 3), ("d", 2)], "datapack string, trace_id long")
    # trace 1: one error span, a root at 4 times its limit, a warning and two errors in its logs; trace 3: nothing
    assert [tuple(r) for r in events.anomaly_scores(spans, logs, limits, samples).collect()] == [("d", 2, (5 + 2 + 5) / 2)]


def traces(spark, sets):
    rows = [(d, t, a, a + "'") for (d, t), s in sets.items() for a in s]
    return spark.createDataFrame(rows, "datapack string, trace_id long, a string, b string")


def test_coverage(spark):
    sets = {("d", 1): "xy", ("d", 2): "yx", ("d", 3): "xyz", ("d", 4): "q", ("e", 1): "x"}
    samples = spark.createDataFrame([("d", 1), ("d", 2), ("d", 3), ("d", 99)], "datapack string, trace_id long")
    got = {r.datapack: tuple(r)[1:] for r in events.event_coverage(traces(spark, sets), samples).collect()}
    assert got["d"] == (4, 3, 0.75, 3, 2, 0.666667, 0.918296, 0.5)
    assert got["e"] == (1, 0, 0.0, 1, 0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("block", [384, 3])
def test_dissimilarity_is_all_pairs(spark, block):
    rng = random.Random(9)
    sets = {("d", t): rng.sample("abcdefgh", rng.randint(1, 6)) for t in range(40)} | {("e", 1): "ab", ("e", 2): "ba", ("f", 1): "ab", ("f", 2): "cd"}
    samples = spark.createDataFrame([k for k in sets if k != ("d", 0)], "datapack string, trace_id long")
    got = {r.datapack: (r.patterns, r.dissimilarity) for r in events.mean_dissimilarity(traces(spark, sets), samples, block).collect()}
    own = {frozenset(s) for (d, t), s in sets.items() if d == "d" and t}
    pairs = [1 - len(a & b) / len(a | b) for a, b in itertools.combinations(own, 2)]
    assert got == {"d": (len(own), round(sum(pairs) / len(pairs), 6)), "e": (1, 0.0), "f": (2, 1.0)}


def test_spans_meet_their_logs_in_their_trace(spark):
    """Equal trace ids in two datapacks keep apart; many logs of one span; a log of no span. No join needs spans dealt by their ids."""
    at = "CAST('2024-01-01' AS TIMESTAMP)"
    spans = spark.createDataFrame([(d, 1, i, p, "w", n, 10, s) for d, i, p, n, s in (("d", "a", "", "r", "Ok"), ("d", "b", "a", "x", "Ok"), ("d", "c", "a", "x", "Error"), ("e", "a", "", "q", "Ok"), ("e", "b", "zz", "y", "Ok"))], SPANS.replace("time timestamp, ", "")).selectExpr("*", f"{at} AS time")
    logs = spark.createDataFrame([("d", 1, "a", n, "t%d" % (n % 2)) for n in range(50)] + [("e", 1, "b", 1, "u"), ("e", 1, "c", 1, "v"), ("f", 1, "a", 1, "w")], "datapack string, trace_id long, span_id string, n long, template string").selectExpr("datapack", "trace_id", "span_id", f"{at} + make_interval(0, 0, 0, 0, 0, 0, n) AS time", "template")
    limits = spark.createDataFrame([], "datapack string, service_name string, span_name string, limit_ms double")
    found = events.event_pairs(spans, logs, limits)
    own = {("S:w_r", "L:t0"), ("L:t0", "L:t1"), ("L:t1", "L:t0"), ("L:t1", "F:w_r"), ("F:w_r", "S:w_x"), ("S:w_x", "F:w_x"), ("S:w_x", "E:w_x"), ("E:w_x", "F:w_x")}
    assert {tuple(r) for r in found.collect()} == {("d", 1, *p) for p in own} | {("e", 1, *p) for p in (("S:w_q", "F:w_q"), ("S:w_y", "L:u"), ("L:u", "F:w_y"))}
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("span_id" in line for line in joins)


def test_dissimilarity_in_strips(spark, monkeypatch):
    """Blocks of a few patterns, each gone over in strips, as many pairs as there are."""
    import pyarrow as pa

    monkeypatch.setattr(events, "CELLS", 7)
    rng = random.Random(15)
    a, b = ([sorted(rng.sample(range(20), rng.randint(0, 6))) for _ in range(n)] for n in (9, 5))
    alike = lambda x, y: len(set(x) & set(y)) / max(1, len(set(x) | set(y)))
    kind = pa.list_(pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_pydict({"datapack": ["d", "d"], "same": [False, True], "left": pa.array([a, a], kind), "right": pa.array([b, a], kind)})
    across, inside = (out["alike"][0].as_py() for out in events._block_sums(iter([batch])))
    assert abs(across - sum(alike(x, y) for x in a for y in b)) < 1e-9 and abs(inside - sum(alike(x, y) for x, y in itertools.combinations(a, 2))) < 1e-9
