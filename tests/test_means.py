"""Means of scores that are ties."""

from tracejobs.operators import reports


def test_tied_mean_in_any_order(spark):
    """16 cases whose avg5 adds up to 37 fifths: the mean 0.4625 is 0.463, though doubles add up to less in most orders."""
    best = [None] * 6 + [5, 3, 3, 2, 2, 2, 2, 2, 1, 1]
    for step in (1, 3, 5, 7):
        order = [best[i * step % 16] for i in range(16)]
        rows = [("a", i, b or 9, True) for i, b in enumerate(order)]
        rankings = spark.createDataFrame(rows, "algorithm string, datapack long, rank int, hit boolean").coalesce(1)
        found = reports.algorithm_means(rankings, rankings.select("datapack"), []).collect()
        assert [(r.runs, r.top1, r.avg5) for r in found] == [(16, 0.125, 0.463)]


def test_mean_by_nulls(spark):
    rows = [("a", None), ("b", 1.0), ("b", None), ("b", 2.0)]
    found = {r.k: (r.runs, r.v) for r in reports.mean_by(spark.createDataFrame(rows, "k string, v double"), ["k"], ["v"]).collect()}
    assert found == {"a": (1, None), "b": (3, 1.5)}
