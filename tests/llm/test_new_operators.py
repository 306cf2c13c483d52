"""Top-k search, filter audit and conversation repair against plain Python, on small cases that the tables lack."""

import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tracejobs.llm import conversation_repair as cr
from tracejobs.llm import filter_audit as fa
from tracejobs.llm import topk_search as ts

VECTORS = "vec_id long, embedding array<float>, rank string, score int"


def best(data, k=5, every=50):
    """(query, rank, key, score) by sorting everything."""
    sound = [(key, [math.floor(256 * x) for x in v]) for key, v, *_ in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, (q, a) in enumerate(sound):
        if q is not None and q % every == 0:
            found = sorted(((-sum(x * y for x, y in zip(a, b)), key is None, key or 0, key) for j, (key, b) in enumerate(sound) if j != i and len(a) == len(b)))
            out += [(q, r, f[3], -f[0]) for r, f in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def top_k(spark, data, **options):
    df = ts.top_k(spark.createDataFrame(data, VECTORS).repartition(3), **options)
    return sorted((tuple(r)[:4] for r in df.collect()), key=repr)


def test_top_k_is_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    vec = lambda n: [rng.uniform(-1, 1) for _ in range(n)]
    same = [0.5, 0.25, 0.125]
    data = [(i, vec(3), "r", 1) for i in range(120)] + [(i, same, None, None) for i in range(120, 240)] + [(None, same, "x", 0), (None, vec(3), "x", 0)]
    data += [(50, vec(3), "again", 2), (50, same, "again", 2), (0, vec(4), "wide", 1), (7, vec(4), "wide", 1), (100, [1.0] * 7, "alone", 0), (150, [], None, 0), (151, [], None, 0)]
    data += [(200, None, "", 0), (250, [1.0, None, 2.0], "", 0), (251, [float("nan"), 0.0, 1.0], "", 0), (252, [float("inf"), 0.0, 1.0], "", 0)]
    # vectors are floats in the table, so that the plain form must see floats too
    data = [(a, v and [x if x is None else float(np.float32(x)) for x in v], b, c) for a, v, b, c in data]
    assert top_k(spark, data) == best(data)
    monkeypatch.setattr(ts, "FEW", 5)
    monkeypatch.setattr(ts, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(ts, "ASKED_ROWS", 2)
    assert top_k(spark, data, k=3, every=10) == best(data, 3, 10)


def test_top_k_of_large_numbers_and_nothing(spark):
    data = [(0, [3e5, -2e5], "", 0), (1, [3e5, -2e5], "", 0), (2, [2e5, 2e5], "", 0), (3, [1e7, 1e7], "", 0), (50, [-1e7, 1.5e7], "", 0)]
    assert top_k(spark, data) == best(data)
    assert top_k(spark, [(0, [1e30, 1.0], "", 0), (1, [-1e30, 1.0], "", 0)]) == [(0, 1, 1, ts.LEAST_SCORE)]
    assert top_k(spark, []) == [] and top_k(spark, [(3, [1.0], "", 0)]) == [] and top_k(spark, [(0, [1.0], "", 0)]) == []


def test_scores_are_exact():
    rng = np.random.default_rng(0)
    for top in (10, 1 << 20, 1 << 40):
        a, b = rng.integers(-top, top, (3, 5)), rng.integers(-top, top, (4, 5))
        exact = [[max(ts.LEAST_SCORE, min(ts.MOST_SCORE, sum(int(x) * int(y) for x, y in zip(p, q)))) for q in b] for p in a]
        assert ts.scores(a, b).tolist() == exact


def test_posting_lists():
    rng = random.Random(2)
    lists = [np.array(sorted(rng.sample(range(300), n)), "int64") for n in (0, 1, 120, 40, 299)]
    assert fa.union(lists).tolist() == sorted(set().union(*map(set, map(np.ndarray.tolist, lists))))
    sizes = fa.set_sizes(lists, [lists[3]])
    for s, (n, shared) in enumerate(sizes):
        rows = set().union(*[set(x.tolist()) for i, x in enumerate(lists) if s >> i & 1])
        assert (n, shared) == (len(rows), len(rows & set(lists[3].tolist())))
    assert fa.union([]).tolist() == []


def audit(docs, labels):
    """Every order's removal, one document at a time."""
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[i] == 1} for i in (0, 1))
    rows = []
    for key, text, part, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
                 "E": key is not None and any(k is not None and k < key and (t or "") == text for k, t, *_ in docs)}
        rows.append((part or "", {f for f, x in fails.items() if x}, key in good, key in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in r[0] for r in own) - len(gone), sum(r[0] == {f} for r in own), sum(r[1] for r in gone), sum(r[2] for r in gone), f]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = total[row[-1]]
    return out


DOCS, LABELS = "doc_id long, text string, lang string, row string, first long", "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("heavy", [512, 3])
def test_filter_audit_is_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(fa, "HEAVY", heavy)
    monkeypatch.setattr(fa, "RANGE", 4)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "a # b", "A B C", " ".join(words[:250]), "x " * 300, " ".join(words) + " |", "CAPS " * 210, " ".join(words * 50)]
    docs = [(rng.choice([None, rng.randrange(40)]) if i % 7 == 0 else i, rng.choice(texts), rng.choice([None, "", "en", "de"]), "r", i) for i in range(60)]
    labels = [(rng.randrange(60), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(40)] + [(None, 1, 1)]
    got = fa.filter_audit(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)).collect()
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == audit(docs, labels)
    assert len(got) == 600 * len({d[2] or "" for d in docs})


def test_filter_audit_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert fa.filter_audit(none, spark.createDataFrame([], LABELS)).collect() == []
    one = fa.filter_audit(spark.createDataFrame([(1, None, None, "", 0)], DOCS), spark.createDataFrame([], LABELS)).where("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [tuple(r)[3:] for r in one] == [(0, 1, 0, 1, 0, 0, 120)] + [(0, 0, 0, 0, 0, 0, 0)] * 4


def cheapest(classes):
    """All edits of a few rows, with at most two turns inserted in a gap."""
    found = None
    for ops in itertools.product("KRD", repeat=len(classes)):
        for gaps in itertools.product((0, 1, 2), repeat=len(classes) + 1):
            audit_ = "".join("I" * g + o for g, o in itertools.zip_longest(gaps, ops, fillvalue=""))
            cost, pools, rows = 5 * sum(gaps), [], iter(classes)
            for edit in audit_:
                c = next(rows) if edit != "I" else ""
                if edit == "D":
                    cost += 2
                else:
                    cost += 5 * c.isupper() + (edit == "R") + (1000 if c == "d" else 0)
                    pools.append(c.lower() if edit == "K" else "ua")
            if (found is None or (cost, audit_) < found) and any(re.fullmatch("(s?(ua)+)?", "".join(r)) for r in itertools.product(*pools)):
                found = (cost, audit_)
    return found


def test_repairs_are_cheapest():
    rng = random.Random(4)
    for classes in ["", "s", "S", "a", "ua", "sua", "uu", "au", "dd", *("".join(rng.choice("suaxSUAXdua") for _ in range(rng.randint(1, 4))) for _ in range(60))]:
        assert cr.parse(classes)[0][1:] == cheapest(classes), classes


def repair_by_hand(data):
    """Damage, sort and count by the contract's words; the parser is checked on its own."""
    convs, ids = {}, {}
    for conv, turn, role, text, *_ in data:
        key = " " if conv is None else str(conv)
        ids[conv] = key
        rows = convs.setdefault(key, [])
        kind = zlib.crc32(f"{key}:{' ' if turn is None else turn}".encode()) % 20
        role, text = ("user" if kind == 4 else " " if role is None else role), " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, key in ids.items():
        rows = sorted(convs[key], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        n, classes, seen = [0, 0, 0], "", set()
        for _, role, text in rows:
            said = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not said else 1 if (role, text) in seen else 2 if said[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                n[fault] += 1
            c = role[0] if role[:1] in ("s", "u", "a") else "x"
            classes += "d" if fault in (0, 1) else c.upper() if fault == 2 else c
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        ((_, cost, edits),) = cr.parse(classes)
        lines, it, at = [], iter(rows), 0
        for e in edits:
            row = next(it) if e != "I" else (None, "", "")
            if e != "D":
                turn_of = ("user", "assistant")[(at - (bool(lines) and lines[0][:1] == "s")) % 2]
                lines.append(f"{row[1] if e == 'K' else turn_of}:{row[2]}")
                at += 1
        out[conv] = (gaps, *n, illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, conv string, piece long, audit int"


@pytest.mark.parametrize("piece_rows", [2048, 3, 1])
def test_conversation_repair(spark, piece_rows):
    rng = random.Random(5)
    data = []
    for conv in [None, *range(1, 14)]:
        for t in range(rng.choice([1, 3, 8, 30])):
            data.append((conv, rng.choice([t, t, t, None, t + 1]), rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(["Hi.", "no", "", None, "x? ", f"w{t}.", "long " * 3000 + "."]), "c", 1, 0))
    data += [(20, 1, "user", "same.", "c", 1, 0)] * 9
    got = cr.conversation_repair(spark.createDataFrame(data, CONVERSATIONS).repartition(3), piece_rows=piece_rows).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == repair_by_hand(data)
    assert len(got) == 15


def test_conversation_repair_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in cr.conversation_repair(df).collect()}
    assert got == repair_by_hand([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_conversation_repair_without_rows(spark):
    assert cr.conversation_repair(spark.createDataFrame([], CONVERSATIONS)).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = cr.conversation_repair(spark.createDataFrame([(gone, 0, "user", "Hi.", "", 0, 0)], CONVERSATIONS)).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("name", ["op11_exact_top_k", "op12_filter_audit"])
def test_same_as_sql(spark, name):
    from tracejobs.llm import queries

    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(want.fetchall())
