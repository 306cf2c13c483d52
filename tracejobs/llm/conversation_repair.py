"""Repair of conversations whose turns do not follow the order of roles, by a generalised LR parser.

A conversation is right when the initials of its roles are ``(s?(ua)+)?``: nothing, or an optional system turn
and then pairs of a user and an assistant turn. A parser keeps a graph-structured stack: all stacks that some
choice of edits can have after the rows read so far, as chains that share their lower parts. Each row is kept,
given another role or deleted, turns may be inserted anywhere, and of equal stacks the one with the least
(cost, audit) stays. The grammar is left-recursive, so that a stack is at most four states deep and there are at
most eight of them, however long a conversation is.

A conversation of at most ``piece_rows`` rows and ``PIECE_BYTES`` bytes is one group. Longer ones are sorted over
all tasks and cut in pieces of that many rows; each piece is parsed from every stack that may stand at its start, and
what the pieces found is put together in order, by the same minimum, which does not depend on where they are cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracejobs.llm.common import lean, store, text_batches

#: Rows and bytes of a conversation that are one group; more are cut in pieces.
PIECE_ROWS = 2048
PIECE_BYTES = 4 << 20

#: Costs of edits; a truncated row that is not deleted adds TRUNCATED.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: LR(0) automaton of  C -> e | P | s P ;  P -> u a | P u a.  State 2 has read the first u, 5 a later one.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 6, (3, "u"): 5, (4, "u"): 5, (5, "a"): 7}
REDUCE = {6: 2, 7: 3}
GOTO = {0: 3, 1: 4}
ACCEPT = (0, 3, 4)
START = "0"

#: A row's class: its role's initial, in capitals if its text is truncated; x for other roles; d if it must go.
Best = tuple[int, str]


def advance(stack: str, symbol: str) -> str | None:
    """The stack after a symbol and the reduction that may follow, None if the symbol cannot come there."""
    state = SHIFT.get((int(stack[-1]), symbol))
    if state is None:
        return None
    if state in REDUCE:
        below = stack[: len(stack) + 1 - REDUCE[state]]
        return below + str(GOTO[int(below[-1])])
    return stack + str(state)


def offer(heads: dict[str, Best], stack: str | None, cost: int, audit: str) -> bool:
    """Merge a stack into the others: of equal ones the least (cost, audit) stays. Whether it is the new one."""
    if stack is None or stack in heads and heads[stack] <= (cost, audit):
        return False
    heads[stack] = (cost, audit)
    return True


def with_inserts(heads: dict[str, Best]) -> dict[str, Best]:
    """heads, and all stacks that inserted turns lead to."""
    out, work = dict(heads), list(heads)
    while work:
        stack = work.pop()
        cost, audit = out[stack]
        for symbol in "ua":
            after = advance(stack, symbol)
            if offer(out, after, cost + INSERT, audit + "I"):
                work.append(after)
    return out


@lru_cache(maxsize=1 << 16)
def parse(classes: str, start: str = START, ends: bool = True) -> tuple[tuple[str, int, str], ...]:
    """(stack, cost, audit) of each stack after the rows of these classes; with ``ends``, of the one that accepts best."""
    heads: dict[str, Best] = {start: (0, "")}
    for c in classes:
        heads, before = {}, with_inserts(heads)
        extra = TRUNCATED if c.isupper() else 0
        for stack, (cost, audit) in before.items():
            offer(heads, stack, cost + DELETE, audit + "D")
            if c != "d":
                offer(heads, advance(stack, c.lower()), cost + extra, audit + "K")
                for symbol in "ua":
                    offer(heads, advance(stack, symbol), cost + extra + RENAME, audit + "R")
    if ends:
        heads = {s: b for s, b in with_inserts(heads).items() if int(s[-1]) in ACCEPT}
        stack = min(heads, key=heads.get)
        heads = {stack: heads[stack]}
    return tuple((s, *b) for s, b in heads.items())


def _all_stacks() -> list[str]:
    found, work = {START}, [START]
    while work:
        stack = work.pop()
        for symbol in "sua":
            after = advance(stack, symbol)
            if after is not None and after not in found:
                found.add(after)
                work.append(after)
    return sorted(found)


STACKS = _all_stacks()


def repaired(turns: list[tuple[str, str]], audit: str, stack: str = START) -> Iterator[str]:
    """The lines ``role:text`` that an audit leaves of these turns, from a stack on."""
    rows = iter(turns)
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit != "K":
            role = "user" if advance(stack, "u") else "assistant"
        stack = advance(stack, role[:1])
        yield f"{role}:{text}"


SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
LEGAL = {"su", "ua", "au"}


def classify(turns: list[tuple[str, str]], seen: set[str]) -> tuple[str, dict[str, int]]:
    """The rows' classes and the faults counted; ``seen`` holds digests of rows before these and gets theirs."""
    classes, n = [], {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    for i, (role, text) in enumerate(turns):
        said = text.strip(SPACES)
        mark = digest(role, text)
        if not said:
            n["blank"] += 1
            classes.append("d")
        elif mark in seen:
            n["duplicate"] += 1
            classes.append("d")
        else:
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            if said[-1] not in ".!?":
                n["truncated"] += 1
                initial = initial.upper()
            classes.append(initial)
        seen.add(mark)
        if i and turns[i - 1][0][:1] + role[:1] not in LEGAL:
            n["illegal"] += 1
    return "".join(classes), n


def digest(role: str, text: str) -> str:
    """Which row this is among rows of a conversation, as _MARK has it in Spark."""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


_MARK = "sha2(concat(length(t.role), ':', t.role, t.text), 256)"


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copy) of conversations with planted faults; nulls of key, role and text are one space.

    crc32 of ``conv:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes its ``[.!?]`` away, 3 repeats it,
    4 makes it a user's.
    """
    c = F.coalesce(F.col(conv).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(c, F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit(" "))).cast("binary")) % 20
    said = F.coalesce(F.col(text), F.lit(" "))
    out = rows.select(
        c.alias("conv"), F.col(turn).cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(F.coalesce(F.col(role), F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said).alias("text"), kind.alias("kind"),
    )
    return out.where("kind <> 0").select("conv", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


_TURNS = "array<struct<role:string,text:string>>"
_ORDER = ["turn", "role", "text", "copy"]  # ascending: nulls come first


def pieces(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(conv, piece, cut, turns): every conversation's rows in order, in pieces of bounded size; cut if there are several.

    Turns of one number are in the order of role and text. Only conversations beyond the bound are sorted over all tasks.
    """
    size = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("bytes"))
    long = store(size.where((F.col("n") > piece_rows) | (F.col("bytes") > PIECE_BYTES)).select("conv"), "long")[0]
    turns = F.transform(F.array_sort(F.collect_list(F.struct(*_ORDER))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns")
    if long.isEmpty():
        return rows.groupBy("conv").agg(turns).select("conv", F.lit(0).cast("long").alias("piece"), F.lit(False).alias("cut"), "turns")
    short = rows.join(long, "conv", "left_anti").groupBy("conv").agg(turns).select("conv", F.lit(0).cast("long").alias("piece"), F.lit(False).alias("cut"), "turns")
    # Equal rows of a conversation are told apart by a number, so that any of them can be the end of a task's range.
    many = store(rows.join(long, "conv", "left_semi").withColumn("row", F.monotonically_increasing_id()), "many")[0]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv", *_ORDER, "row"]
    many = many.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    many = store(many, "ordered")[0]
    part = F.floor(F.col("at") / piece_rows).cast("long").alias("piece")
    # a task's last piece and the next task's first have different numbers, as the task's number is in the high bits
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns")
    split = many.groupBy("conv", part).agg(listed).select("conv", "piece", F.lit(True).alias("cut"), "turns")
    return short.unionByName(split)


_FAULTS = ["blank", "duplicate", "truncated", "illegal"]
_DONE = pa.schema([("conv", pa.string()), *[(k, pa.int64()) for k in [*_FAULTS, "cost"]], ("audit", pa.string()), ("repaired_sha256", pa.string())])
_DONE_DDL = "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _turns(cell: list[dict]) -> list[tuple[str, str]]:
    return [(x["role"], x["text"]) for x in cell]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of one piece, from their turns to the repaired digest."""
    for batch in batches:
        out = []
        for conv, cell in zip(batch["conv"].to_pylist(), batch["turns"]):
            turns = _turns(cell.as_py())
            classes, n = classify(turns, set())
            ((_, cost, audit),) = parse(classes)
            text = "\n".join(repaired(turns, audit))
            out.append({"conv": conv, **n, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()})
        yield pa.RecordBatch.from_pylist(out, _DONE)


_PART = pa.schema([
    ("conv", pa.string()), ("piece", pa.int64()), *[(k, pa.int64()) for k in _FAULTS], ("first", pa.string()), ("last", pa.string()),
    ("ways", pa.list_(pa.struct([("start", pa.string()), ("stack", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))),
])
_PART_DDL = "conv string, piece long, blank long, duplicate long, truncated long, illegal long, first string, last string, ways array<struct<start:string,stack:string,cost:long,audit:string>>"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of longer conversations: their counts, and what each stack at their start leads to."""
    for batch in batches:
        for row in range(batch.num_rows):
            turns, seen = _turns(batch["turns"][row].as_py()), batch["seen"][row].as_py()
            classes, n = classify(turns, set(seen or ()))
            ways = [{"start": s, "stack": t, "cost": c, "audit": a} for s in STACKS for t, c, a in parse(classes, s, False)]
            yield pa.RecordBatch.from_pylist([{"conv": batch["conv"][row].as_py(), "piece": batch["piece"][row].as_py(), **n, "first": turns[0][0][:1], "last": turns[-1][0][:1], "ways": ways}], _PART)


class Way:
    """An audit as a chain of the pieces' audits, so that ways share their beginnings."""

    __slots__ = ("audit", "before", "stack")

    def __init__(self, before: Way | None, stack: str, audit: str) -> None:
        self.before, self.stack, self.audit = before, stack, audit

    def since(self, other: Way) -> tuple[str, str]:
        """Both audits from where they part. Ways that are compared are of the same number of pieces."""
        a, b, x, y = self, other, [], []
        while a is not b:
            x.append(a.audit)
            y.append(b.audit)
            a, b = a.before, b.before
        return "".join(reversed(x)), "".join(reversed(y))


_CHOSEN = pa.schema([
    ("conv", pa.string()), ("piece", pa.int64()), ("start", pa.string()), ("edits", pa.string()), ("cost", pa.int64()), *[(k, pa.int64()) for k in _FAULTS],
])
_CHOSEN_DDL = "conv string, piece long, start string, edits string, cost long, blank long, duplicate long, truncated long, illegal long"


def fold(rows: Iterator[dict]) -> Iterator[dict]:
    """From the pieces of one conversation, in order: what is chosen of each; the costs and counts stand at the first."""
    heads, n, numbers, last = {START: (0, Way(None, START, ""))}, dict.fromkeys(_FAULTS, 0), [], None

    def put(out: dict, stack: str, cost: int, way: Way) -> bool:
        if stack in out:
            had, other = out[stack]
            if had < cost or had == cost and other.since(way)[0] <= other.since(way)[1]:
                return False
        out[stack] = (cost, way)
        return True

    for row in rows:
        numbers.append(row["piece"])
        for k in _FAULTS:
            n[k] += row[k]
        if last is not None and last + row["first"] not in LEGAL:
            n["illegal"] += 1
        last, after = row["last"], {}
        for w in row["ways"]:
            if w["start"] in heads:
                cost, way = heads[w["start"]]
                put(after, w["stack"], cost + w["cost"], Way(way, w["start"], w["audit"]))
        heads = after
    # turns inserted at the end belong to the last piece
    best: dict = {}
    for stack, (cost, way) in heads.items():
        for after, (more, audit) in with_inserts({stack: (0, "")}).items():
            if int(after[-1]) in ACCEPT:
                put(best, "", cost + more, Way(way.before, way.stack, way.audit + audit))
    cost, way = best[""]
    chain = []
    while way.before is not None:
        chain.append((way.stack, way.audit))
        way = way.before
    for i, (piece, (start, edits)) in enumerate(zip(numbers, reversed(chain))):
        yield {"piece": piece, "start": start, "edits": edits, "cost": 0 if i else cost, **(dict.fromkeys(_FAULTS, 0) if i else n)}


def _folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fold for each conversation of a task, whose pieces come sorted."""
    rows = (row for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist())
    for conv, group in groupby(rows, key=lambda row: row["conv"]):
        for one in fold(group):
            yield pa.RecordBatch.from_pylist([{"conv": conv, **one}], _CHOSEN)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired lines of each piece; null if none are left."""
    names = ("conv", "piece", "start", "edits", "turns")
    for batch in batches:
        for i in range(batch.num_rows):
            conv, piece, start, edits, turns = (batch[c][i].as_py() for c in names)
            lines = list(repaired(_turns(turns), edits, start))
            yield pa.RecordBatch.from_pylist([{"conv": conv, "piece": piece, "edits": edits, "lines": "\n".join(lines) if lines else None}], pa.schema([("conv", pa.string()), ("piece", pa.int64()), ("edits", pa.string()), ("lines", pa.string())]))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit and the digest of each conversation of a task, whose pieces come sorted; one piece is held at a time."""
    schema = pa.schema([("conv", pa.string()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    conv, h, audit, empty = None, None, [], True

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"conv": conv, "audit": "".join(audit), "repaired_sha256": h.hexdigest()}], schema)

    for batch in batches:
        for i in range(batch.num_rows):
            if h is None or batch["conv"][i].as_py() != conv:
                if h is not None:
                    yield done()
                conv, h, audit, empty = batch["conv"][i].as_py(), hashlib.sha256(), [], True
            audit.append(batch["edits"][i].as_py())
            lines = batch["lines"][i].as_py()
            if lines is not None:
                h.update((lines if empty else "\n" + lines).encode())
                empty = False
    if h is not None:
        yield done()


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(conv, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of conversations as damage() gives them.

    rows: conv string, turn long (nulls first), role, text, copy, none null but turn. A row's first fault counts: blank
    (white space only), duplicate (role and text seen earlier in the conversation), truncated (its last other
    character is not ``.!?``). illegal: neighbours whose initials are not su, ua or au. The cheapest edits: keep 0, give
    the role user or assistant 1, delete 2 (blank and duplicate rows must go), insert an empty turn 5; a truncated row
    that stays adds 5. audit: their initials K R D I in order, of equal cost the least in ASCII.
    repaired_sha256: of the lines ``role:text`` that are left. A conversation without rows does not come here.
    """
    text_batches(rows.sparkSession)
    cut = store(pieces(rows, piece_rows), "pieces")[0]
    done = cut.where("NOT cut").select("conv", "turns").mapInArrow(lean(_whole), _DONE_DDL)
    many = cut.where("cut")
    if many.isEmpty():
        return done
    # which rows of a piece an earlier piece of its conversation has
    marks = store(many.select("conv", "piece", F.explode("turns").alias("t")).select("conv", "piece", F.expr(_MARK).alias("mark")).distinct(), "marks")[0]
    first = marks.groupBy("conv", "mark").agg(F.min("piece").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    seen = marks.join(first, ["conv", "mark"]).where("piece > first").groupBy("conv", "piece").agg(F.collect_list("mark").alias("seen"))
    parts = many.join(seen, ["conv", "piece"], "left").select("conv", "piece", "turns", "seen").mapInArrow(lean(_parts), _PART_DDL)
    parts = store(parts, "parts")[0]
    chosen = store(parts.repartition("conv").sortWithinPartitions("conv", "piece").mapInArrow(_folds, _CHOSEN_DDL), "chosen")[0]
    lines = many.join(chosen.select("conv", "piece", "start", "edits"), ["conv", "piece"]).select("conv", "piece", "start", "edits", "turns").mapInArrow(lean(_lines), "conv string, piece long, edits string, lines string")
    hashes = lines.repartition("conv").sortWithinPartitions("conv", "piece").mapInArrow(lean(_hashes), "conv string, audit string, repaired_sha256 string")
    counts = chosen.groupBy("conv").agg(*[F.sum(k).alias(k) for k in [*_FAULTS, "cost"]])
    return done.unionByName(counts.join(hashes, "conv").select(*done.columns))


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def conversation_repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Damage conversations and repair them: one row per conv_id of the table, as repair() describes, and gaps.

    gaps: numbers missing between the least and the greatest turn, nulls ignored, 0 if all are null. A conversation that
    lost all its rows has zeros, no audit and the digest of an empty text. A null conv_id is a conversation, called
    one space as in the damage's key; columns of other names are ignored; an empty table gives no row.
    """
    rows = store(damage(conversations, conv, turn, role, text), "damaged")[0]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    # distinct turns first: a conversation's turns are counted in parts
    turns = rows.select("conv", "turn").distinct().groupBy("conv").agg(gaps.alias("gaps"))
    all_ids = conversations.select(F.col(conv).alias("id")).distinct().withColumn("conv", F.coalesce(F.col("id").cast("string"), F.lit(" ")))
    out = all_ids.join(turns, "conv", "left").join(repair(rows, piece_rows), "conv", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        F.col("id").alias(conv), *[zero(c) for c in ("gaps", *_FAULTS, "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"),
    )
