"""Shortest paths, alignment and judged graphs on graphs made by hand."""

import random
from collections import deque

from tracejobs.operators import judge, paths

EDGES = "datapack string, src string, dst string"


def bfs(edges, source):
    """The least shortest path to each node."""
    found, queue = {source: [source]}, deque([source])
    while queue:
        u = queue.popleft()
        for v in sorted(d for s, d in edges if s == u):
            if v not in found or len(found[v]) == len(found[u]) + 1 and found[u] + [v] < found[v]:
                if v not in found:
                    queue.append(v)
                found[v] = found[u] + [v]
    return found


def test_shortest_paths(spark):
    rng = random.Random(11)
    edges = {(rng.choice("abcdefgh"), rng.choice("abcdefgh")) for _ in range(14)}
    df = spark.createDataFrame([("d", *e) for e in edges] + [("e", "a", "b")], EDGES)
    sources = spark.createDataFrame([("d", "a"), ("d", "c"), ("d", "z"), ("e", "a")], "datapack string, source string")
    got = {(r.datapack, r.source, r.target): list(r.path) for r in paths.shortest_paths(df, sources).collect()}
    wanted = {("d", s, t): p for s in "acz" for t, p in bfs(edges, s).items()} | {("e", "a", "a"): ["a"], ("e", "a", "b"): ["a", "b"]}
    assert got == wanted


def test_alignment(spark):
    # in -> a -> b -> c, a -> x; b is true
    edges = spark.createDataFrame([("d", *e) for e in [("in", "a"), ("a", "b"), ("b", "c"), ("a", "x"), ("q", "in")]] + [("e", "u", "v")], EDGES)
    ranked = spark.createDataFrame([("d", "m", 1, "a"), ("d", "m", 2, "zz"), ("d", "m", 3, "x"), ("d", "m", 4, "b"), ("d", "m", 5, "c"), ("d", "n", 1, "q"), ("e", "m", 1, "v")], "datapack string, algorithm string, rank int, name string")
    truth = spark.createDataFrame([("d", "b"), ("d", "nowhere"), ("e", "v")], "datapack string, name string")
    got = {(r.algorithm, r.rank): r.alignment for r in paths.alignment_scores(edges, "in", ranked, truth).collect()}
    # a: 2 / (1 + 1) * 2/3; x reaches no true service; b: 2 / 2 * 1; c: b is not reached from it, so the maximum stays; q is not reached
    assert got == {("m", 1): 0.666667, ("m", 2): 0.0, ("m", 3): 0.666667, ("m", 4): 1.0, ("m", 5): 1.0, ("n", 1): 0.0}
    eff = {(r.datapack, r.algorithm): r.efficiency for r in paths.path_efficiency(edges, "in", ranked.where("name IN ('x', 'c', 'q', 'v')"), truth).collect()}
    assert eff == {("d", "m"): 0.6, ("d", "n"): 0.0, ("e", "m"): 0.0}


def test_components_and_states(spark):
    c = lambda rows: spark.createDataFrame(rows, "sample string, component string")
    found = c([("s", "service|TS-Order"), ("s", "ts-order"), ("s", "pay"), ("t", "a"), ("v", "b")])
    got = {r.sample: tuple(r)[1:] for r in judge.component_scores(found, c([("s", "order"), ("s", "ship"), ("u", "x"), ("v", "b")])).collect()}
    assert got == {"s": (1, 0.333333, 0.5, 0.4), "t": (0, 0.0, 1.0, 0.0), "u": (0, 0.0, 0.0, 0.0), "v": (1, 1.0, 1.0, 1.0)}
    st = lambda rows: spark.createDataFrame(rows, "sample string, component string, state string")
    got = {r.sample: (r.coverage, r.extra) for r in judge.state_scores(st([("s", "ts-a", "slow"), ("s", "b", "down"), ("s", "c", None), ("t", "a", "x")]), st([("s", "a", "slow"), ("s", "a", "hot"), ("s", "b", "hot"), ("u", "a", "y")])).collect()}
    assert got == {"s": (0.5, 0.5), "t": (1.0, 1.0), "u": (0.0, 0.0)}
    at = lambda rows: spark.createDataFrame(rows, "sample string, component string, timestamp long")
    got = {r.sample: r.score for r in judge.temporal_scores(at([("s", "a", 110), ("s", "b", 500), ("s", "c", 5), ("t", "a", 1)]), at([("s", "a", 100), ("s", "b", 100), ("s", "c", 0), ("t", "z", 1)])).collect()}
    assert got == {"s": 0.45}


def test_reachability(spark):
    e = lambda rows: spark.createDataFrame(rows, "sample string, src string, dst string")
    n = lambda rows: spark.createDataFrame(rows, "sample string, service string")
    edges = e([("s", "ts-a", "b"), ("s", "b", "c"), ("s", "c", "b"), ("t", "a", "b"), ("w", "a", "b")])
    found = n([("s", "a"), ("t", "b"), ("u", "x"), ("v", "a"), ("w", "b"), ("y", "g")])
    true = n([("s", "A"), ("s", "q"), ("t", "ts-b"), ("u", "z"), ("v", "a"), ("w", "b"), ("y", "g"), ("z", "k")])
    alarms = n([("s", "C"), ("t", "a"), ("u", "x"), ("w", "loadgenerator"), ("y", "g"), ("y", "loadgenerator")])
    true_edges = e([("w", "b", "loadgenerator")])
    got = {r.sample: r.reachable for r in judge.path_reachability(edges, found, true, alarms, true_edges).collect()}
    # t: b does not lead to a; u: no correct root; v: no alarm; w: b calls the load generator; y: a root that is an alarm; z: nothing found
    assert got == {"s": True, "t": False, "u": None, "v": None, "w": True, "y": True, "z": None}


def test_top_services_and_elements(spark):
    from tracejobs.operators.coverage import set_elements

    edges = spark.createDataFrame([("d", "a", "b"), ("d", "b", "c"), ("e", "a", "b")], EDGES)
    size = spark.createDataFrame([("d", "a", 3.0), ("d", "b", 2.0), ("d", "c", 1.0), ("e", "b", 9.0), ("e", "a", 9.0)], "datapack string, service_name string, magnitude double")
    roots = spark.createDataFrame([("d", "c"), ("e", "zz")], "datapack string, name string")
    near = lambda n: {r.datapack: r.distance for r in paths.nearest_of_top(edges, size, roots, n).collect()}
    assert near(1) == {"d": 2, "e": 999} and near(2) == {"d": 1, "e": 999} and near(3) == {"d": 0, "e": 999}
    got = {r.datapack: (r.matched, r.missed, r.extra) for r in set_elements(edges, edges.where("src = 'a'").unionByName(spark.createDataFrame([("f", "x", "y")], EDGES)), ["datapack"]).collect()}
    assert got == {"d": (["a b"], [], ["b c"]), "e": (["a b"], [], []), "f": ([], ["x y"], [])}


def test_performance_levels(spark):
    from tracejobs.operators.evaluate import performance

    rows = [("m", "s", "d", "p1", 1, False, 2.0), ("m", "s", "d", "p1", 2, True, 2.0), ("m", "s", "d", "p2", 1, False, 4.0), ("m", "r", "f", "p3", 1, True, None)]
    got = {(r.level, r.sampler, r.dataset, r.datapack): r for r in performance(spark.createDataFrame(rows, "algorithm string, sampler string, dataset string, datapack string, rank int, hit boolean, runtime double")).collect()}
    assert {k[0] for k in got} == {"datapack", "dataset", "algorithm", "sampler", "sampler_dataset"} and len(got) == 3 + 2 + 1 + 2 + 2
    r = got["algorithm", None, None, None]
    assert (r.total, r.count_1, r.count_2, r.ac_2, r.avg_2, r.p_2, r.mrr, r.avg_runtime) == (3, 1, 2, 0.666667, 0.5, 0.333333, 0.75, 3.0)
    assert (got["sampler_dataset", "s", "d", None].mrr, got["datapack", None, "d", "p2"].mrr, got["datapack", None, "f", "p3"].avg_runtime) == (0.5, 0.0, 0.0)


def test_whole_traces_as_by_joins(spark, monkeypatch):
    """Levels of short traces by one task each are those of the joins: cycles, lost parents, ids that repeat, null keys and ids; and without a join or a kept table."""
    import random

    from pyspark.sql import functions as F

    from tracejobs.operators import structure

    rng, rows = random.Random(16), []
    for t in range(40):
        n = rng.randrange(1, 12)
        for i in range(n):
            up = rng.choice(["", None, "lost", str(rng.randrange(n)), str(max(0, i - 1)), str(i // 2)])
            rows.append((rng.choice("de") if t % 9 else "d", t if t % 13 else None, None if rng.random() < 0.05 else str(i if rng.random() < 0.9 or t % 4 else rng.randrange(n)), up, rng.choice("ab"), rng.choice("xy")))
    spans = spark.createDataFrame(rows, "datapack string, trace_id long, span_id string, parent_span_id string, service_name string, span_name string")
    acyclic = spans.where("trace_id % 4 <> 0 OR parent_span_id IS NULL OR parent_span_id IN ('', 'lost') OR parent_span_id < span_id")
    both = lambda df: sorted(map(repr, df.collect()))
    whole, encoded, deep = (both(f(acyclic)) for f in (structure.levels, structure.path_encoding, structure.depth))
    kept = []
    monkeypatch.setattr(structure, "cut", lambda df, f=structure.cut: kept.append(1) or f(df))
    structure.path_encoding(acyclic).count()
    assert not kept
    for most in (5, 0):  # some traces, and all, by joins
        monkeypatch.setattr(structure, "WHOLE", most)
        assert both(structure.levels(acyclic)) == whole and both(structure.depth(acyclic)) == deep
    assert both(structure.path_encoding(acyclic)) == encoded and kept
    assert structure.levels(spans.where("false")).count() == 0
