"""Log templates: planted templates are found, whatever the order, the tasks and the size of pieces."""

import random

import pytest
from pyspark.sql import functions as F

from tracejobs.operators import templates

FORMS = ["User {w} logged in from {ip}", "User {w} logged out after {n} s", "Cache miss for key {h} on shard {n}", "{n} rows read from table {w} in {n} ms", "Connection to {ip} lost , retry {n} of {n}"]


def planted(rng, n):
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = []
    for _ in range(n):
        form = rng.choice(FORMS)
        text = form
        while "{" in text:
            text = text.replace("{w}", rng.choice(words), 1).replace("{ip}", f"10.1.{rng.randrange(255)}.{rng.randrange(255)}:{rng.randrange(9999)}", 1).replace("{n}", str(rng.randrange(10**6)), 1).replace("{h}", f"0x{rng.randrange(10**9):x}", 1)
        rows.append((text, FORMS.index(form)))
    return rows


@pytest.mark.parametrize("piece,parts", [(4096, 1), (3, 5)])
def test_planted_templates(spark, piece, parts):
    rows = planted(random.Random(10), 400)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "message string, form int, template_no long").repartition(parts)
    mined = templates.mine_templates(df, piece=piece)
    out = templates.with_templates(df, mined).select("form", "template_id", "log_template").distinct().collect()
    # every form is one template and every template is of one form
    assert len(out) == len(FORMS) == len({r.form for r in out}) == len({r.template_id for r in out})
    assert sorted(r.log_template for r in out)[0] == "<*> rows read from table <*> in <*> ms"
    assert [r.template_id for r in sorted(out, key=lambda r: r.log_template)] == [1, 2, 3, 4, 5]


def test_merge():
    merge = templates.merge_patterns
    assert merge(["a b c", "a b d", "x y z"], [1, 2, 5]) == ["a b <*>", "a b <*>", "x y z"]
    assert merge(["a"], [1]) == ["a"] and merge([], []) == []
    # a third in common is too little
    assert merge(["a b c", "a x y"], [1, 1]) == ["a b c", "a x y"]
    assert merge(["<*> <*>", "<*> <*>"], [1, 1]) == ["<*> <*>", "<*> <*>"]


def test_masks_and_nothing(spark):
    cases = {"id 123e4567-e89b-12d3-a456-426614174000 x": "id <*> x", "at 10.0.0.1:80 or 10.0.0.2": "at <*> or <*>", "v2 of -3.5 and 0xFF, 7": "v2 of <*> and <*>, <*>", "  a \n b ": "a b", "": None, " ": None, None: None, "abc123 deadbeefcafe12": "abc123 <*>"}
    df = spark.createDataFrame([(k,) for k in cases], "message string")
    assert {r.message: r.p for r in df.withColumn("p", templates.pattern_of(F.col("message"))).collect()} == cases
    mined = templates.mine_templates(df.where("message IS NULL OR trim(message) = ''"))
    assert mined.count() == 0
    assert [tuple(r) for r in templates.with_templates(df.where("message = ''"), mined).collect()] == [("", None, None)]


def test_numbered(spark):
    words = [f"{i * 7919 % 1000:04d}" for i in range(1000)]
    got = templates.numbered(spark.createDataFrame([(w,) for w in words], "w string"), "w", "i").collect()
    assert {r.w: r.i for r in got} == {w: i for i, w in enumerate(sorted(words), 1)}
