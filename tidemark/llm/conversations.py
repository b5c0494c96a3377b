"""Repair of conversation structure: cheapest edits by a run-length dynamic programme.

The rows of a conversation become symbols (role initial and fault). Reading them moves
an automaton of four states: nothing yet, after a system row, after a user row, after an
assistant row; edits have costs, so a symbol is a min-plus 4 x 4 matrix. Equal symbols in
a row are one run, whose matrix is a product of cached binary powers. Costs to go come
from the end; then the edits are unrolled from the start, always the ASCII-least letter
among the cheapest (D delete, I insert, K keep, R change role), which gives the least
audit, since a letter leaves one next state only.

No task holds a conversation: rows are range-partitioned by (conversation, turn), a
*piece* is what one partition holds of a conversation, and pieces exchange matrices,
vectors of costs to go and states. Texts leave their table only to be joined with the
edits of their rows and, in ``digest``, to be hashed in order, which streams.

Rows of a conversation are ordered by turn (nulls first), then role, then the SHA-256 of
the text; rows equal in all of these are adjacent copies.

Edge cases: null role or text counts as one space; null conversation ids are one
conversation; rows of null turn come first and have no part in gaps (at most 2^63 - 1); an empty table gives
an empty result; other columns are ignored, whatever their names. A conversation without
rows has no faults and no edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache, lru_cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import stage

# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
INF = 1 << 50
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # what an inserted or changed row must be in each state
ACCEPTED = (0, INF, INF, 0)
MUST_GO = 8  # the symbol of a row that must be deleted; others are 2 * role + truncated

Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(min(a[i][k] + b[k][j] for k in range(4)), INF) for j in range(4)) for i in range(4))


def applied(m: Matrix, v: Vector) -> Vector:
    return tuple(min(min(m[i][k] + v[k] for k in range(4)), INF) for i in range(4))


IDENTITY: Matrix = tuple(tuple(0 if i == j else INF for j in range(4)) for i in range(4))
_ONE: Matrix = tuple(tuple(0 if i == j else INSERT if NEXT[i] == j else INF for j in range(4)) for i in range(4))
INSERTS = times(_ONE, times(_ONE, _ONE))  # any number of inserted rows


def kept(symbol: int, state: int) -> int | None:
    """The state after keeping a row, None where it can't be kept."""
    role = symbol >> 1
    if role == 0:
        return SYSTEM if state == START else None
    return role + 1 if role in (1, 2) and NEXT[state] == role + 1 else None


@cache
def power(symbol: int, k: int) -> Matrix:
    """Of 2^k equal rows, with what may be inserted before each."""
    if k:
        return times(power(symbol, k - 1), power(symbol, k - 1))
    rows = []
    for q in range(4):
        row = [INF] * 4
        row[q] = DELETE
        if symbol != MUST_GO:
            late = symbol & 1 and TRUNCATED
            row[NEXT[q]] = min(row[NEXT[q]], REROLE + late)
            if (to := kept(symbol, q)) is not None:
                row[to] = min(row[to], late)
        rows.append(tuple(row))
    return times(INSERTS, tuple(rows))


@lru_cache(1 << 14)
def run_matrix(symbol: int, n: int) -> Matrix:
    m, k = IDENTITY, 0
    while n:
        if n & 1:
            m = times(m, power(symbol, k))
        n, k = n >> 1, k + 1
    return m


@lru_cache(1 << 16)
def before(symbol: int, n: int, shape: Vector) -> tuple[Vector, int]:
    """Costs to go before a run, from those behind it, as a shape of least 0 and what must be added."""
    v = applied(run_matrix(symbol, n), shape)
    low = min(v)
    return tuple(min(x - low, INF) for x in v), low


def normal(v: Vector) -> Vector:
    low = min(v)
    return tuple(min(x - low, INF) for x in v)


@lru_cache(1 << 16)
def choice(symbol: int, shape: Vector, state: int) -> tuple[str, int]:
    """Letters up to and with one row's own, and the state behind it, given the costs to go behind it."""
    here, letters = applied(power(symbol, 0), shape), ""
    late = symbol & 1 and TRUNCATED
    while True:
        want = here[state]
        if DELETE + shape[state] == want:
            return letters + "D", state
        to = NEXT[state]
        if INSERT + here[to] == want:
            letters, state = letters + "I", to
            continue
        if symbol != MUST_GO:
            if (keep := kept(symbol, state)) is not None and late + shape[keep] == want:
                return letters + "K", keep
            if REROLE + late + shape[to] == want:
                return letters + "R", to
        raise AssertionError("no edit reaches the least cost")


END: Vector = applied(INSERTS, ACCEPTED)


def closing(state: int) -> str:
    """Insertions behind the last row."""
    out = ""
    while ACCEPTED[state]:
        out, state = out + "I", NEXT[state]
    return out


def unroll(symbols: list[tuple[int, int]], ending: Vector, state: int) -> tuple[list[list[str]], int]:
    """Letters of every row of every run, and the state behind them."""
    shapes = [normal(ending)]
    for symbol, n in reversed(symbols[1:]):
        shapes.append(before(symbol, n, shapes[-1])[0])
    out = []
    for (symbol, n), behind in zip(symbols, reversed(shapes)):
        each = [behind]  # costs to go behind every row of the run, from its end
        for _ in range(n - 1):
            each.append(before(symbol, 1, each[-1])[0])
        letters = []
        for shape in reversed(each):
            got, state = choice(symbol, shape, state)
            letters.append(got)
        out.append(letters)
    return out, state


BLANKS = " \t\n\x0b\x0c\r"
_CONV = ["_c", "_null"]
_KEY = [*_CONV, "_known", "_turn", "_role", "_sha"]  # of a row: conversation, turn, role and text, none of them null


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults: of twenty values of crc32(``conv_id:turn``) 0 drops a row, 1 empties
    its text, 2 takes its ``.!?``, 3 doubles it and 4 makes it a user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    c = conversations.select("conv_id", "turn", "role", "text", kind.alias("_kind")).where("_kind <> 0")
    role, text = F.when(F.col("_kind") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))), F.coalesce("text", F.lit(" "))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return c.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies)).drop("col")


def keyed(conversations: DataFrame) -> DataFrame:
    """The table as ``_KEY`` and ``_text``."""
    c = conversations.select(
        F.coalesce("conv_id", F.lit(0)).cast("long").alias("_c"), F.col("conv_id").isNull().alias("_null"), F.col("turn").isNotNull().alias("_known"), F.coalesce("turn", F.lit(0)).cast("long").alias("_turn"),
        F.coalesce("role", F.lit(" ")).alias("_role"), F.coalesce("text", F.lit(" ")).alias("_text"),
    )
    return c.withColumn("_sha", F.sha2(F.col("_text").cast("binary"), 256))


def faults(table: DataFrame) -> DataFrame:
    """Each distinct row once: ``n`` copies, ``blank``, ``truncated`` and ``first`` (no equal role and text at an earlier turn)."""
    last = F.right(F.rtrim("_text", F.lit(BLANKS)), F.lit(1))
    flat = table.select(*_KEY, (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))
    distinct = flat.groupBy(*_KEY, "blank", "truncated").agg(F.count("*").alias("n"))
    same = [*_CONV, "_role", "_sha"]
    seen = distinct.groupBy(*same).agg(F.min(F.struct("_known", "_turn")).alias("_at"))
    return distinct.join(seen, same).withColumn("first", F.col("_at") == F.struct("_known", "_turn")).drop("_at")


def placed(distinct: DataFrame) -> DataFrame:
    """Rows in range partitions with their place ``pos``; ``part`` is the partition."""
    d = distinct.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY).withColumn("pos", F.monotonically_increasing_id())
    return stage(d.withColumn("part", F.shiftright("pos", 33)), "conversation_rows")


def pieces(p: DataFrame) -> DataFrame:
    """What each partition holds of a conversation, its distinct rows in order."""
    initial = F.left("_role", F.lit(1))
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    symbol = F.when(F.col("blank") | ~F.col("first"), MUST_GO).otherwise(role * 2 + F.col("truncated").cast("int"))
    row = F.struct("pos", symbol.alias("symbol"), initial.alias("initial"), "n")
    return stage(p.groupBy(*_CONV, "part").agg(F.sort_array(F.collect_list(row)).alias("rows")), "conversation_pieces")


def symbols(rows: list[dict]) -> list[tuple[int, int]]:
    """(symbol, how often) row by row: the first copy, and copies behind it, which must go."""
    return [s for r in rows for s in ((r["symbol"], 1), (MUST_GO, r["n"] - 1)) if s[1]]


def collapsed(each: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [(s, sum(n for _, n in g)) for s, g in groupby(each, lambda x: x[0])]


LEGAL = {"su", "ua", "au"}


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _mapped(df: DataFrame, schema: str, step: Callable[..., Iterator[tuple]]) -> DataFrame:
    """What ``step`` yields for the values of every row, as rows of ``schema``."""
    reads = df.columns
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r for values in zip(*(batch.column(c).to_pylist() for c in reads)) for r in step(*values)]
            cols = list(zip(*out)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, arrow.types)], arrow.names)

    return df.mapInArrow(run, schema)


def _whole(each: list[tuple[int, int]]) -> Matrix:
    m = IDENTITY
    for symbol, n in each:
        m = times(m, run_matrix(symbol, n))
    return m


def summarized(c: int, null: bool, part: int, rows: list[dict]) -> Iterator[tuple]:
    """A piece's matrix, outer initials and illegal pairs."""
    m = _whole(collapsed(symbols(rows)))
    initials = [r["initial"] for r in rows]
    yield c, null, part, [x for row in m for x in row], initials[0], initials[-1], illegal_pairs(initials) + sum(r["n"] - 1 for r in rows)


def closed(c: int, null: bool, parts: list[dict]) -> Iterator[tuple]:
    """The costs to go behind each piece of a conversation; the first one carries the conversation's cost and illegal pairs."""
    v, out = END, []
    for p in reversed(parts):
        out.append((p["part"], list(v)))
        v = applied(tuple(tuple(p["matrix"][4 * i : 4 * i + 4]) for i in range(4)), v)
    illegal = sum(p["illegal"] for p in parts) + illegal_pairs([x for p in parts for x in (p["first"], p["last"])]) - sum(illegal_pairs([p["first"], p["last"]]) for p in parts)
    for i, (part, ending) in enumerate(reversed(out)):
        yield c, null, part, ending, START if not i else None, len(parts) > 1, i == len(parts) - 1, None if i else v[START], None if i else illegal


def exits(c: int, null: bool, part: int, rows: list[dict], ending: list[int]) -> Iterator[tuple]:
    """The state behind a piece for each state before it."""
    each = collapsed(symbols(rows))
    yield c, null, part, [unroll(each, tuple(ending), q)[1] for q in range(4)]


def entered(c: int, null: bool, parts: list[dict]) -> Iterator[tuple]:
    """The state before each piece."""
    q = START
    for p in parts:
        yield c, null, p["part"], q
        q = p["exits"][q]


ROLES = {USER: "user", ASSISTANT: "assistant"}


def edited(c: int, null: bool, part: int, rows: list[dict], ending: list[int], start: int, last: bool) -> Iterator[tuple]:
    """A piece's letters, and of every row that leaves something the rows that come of it: a role (null: its own) and whether they hold its text."""
    letters, state = unroll(collapsed(symbols(rows)), tuple(ending), start)
    flat = [x for run in letters for x in run]
    q, at, out, audit = start, 0, [], []
    for i, r in enumerate(rows):
        own = flat[at : at + r["n"]]
        at += r["n"]
        if last and i == len(rows) - 1:
            own[-1] += closing(state)
        came = []
        for x in "".join(own):
            if x in "IR":
                q = NEXT[q]
                came.append((ROLES[q], x == "R"))
            elif x == "K":
                q = kept(r["symbol"], q)
                came.append((None, True))
        audit += own
        if came:
            out.append((r["pos"], [{"role": role, "own": o} for role, o in came]))
    yield c, null, part, "".join(audit), [{"pos": p, "came": x} for p, x in out]


class Repair(NamedTuple):
    """``summary``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; ``rows``: the repaired
    conversations as conv_id, place, step, role, text, in the order of place and step."""

    summary: DataFrame
    rows: DataFrame


def _own_id() -> Column:
    return F.when(~F.col("_null"), F.col("_c")).alias("conv_id")


def repair(conversations: DataFrame) -> Repair:
    """Faults and cheapest repair of every conversation of (conv_id, turn, role, text)."""
    table = keyed(conversations)
    p = placed(faults(table))
    cut = pieces(p)
    base = "_c long, _null boolean, "
    ends = _mapped(cut.select(*_CONV, "part", "rows"), base + "part long, matrix array<bigint>, first string, last string, illegal long", summarized)
    whole = lambda df, *cols: df.groupBy(*_CONV).agg(F.sort_array(F.collect_list(F.struct("part", *cols))).alias("parts"))
    ends = stage(_mapped(whole(ends, "matrix", "first", "last", "illegal"), base + "part long, ending array<bigint>, start int, divided boolean, last boolean, cost long, illegal long", closed), "conversation_ends")
    at = [*_CONV, "part"]
    divided = cut.join(ends.where("divided").select(*at, "ending"), at).select(*at, "rows", "ending")
    starts = _mapped(whole(_mapped(divided, base + "part long, exits array<int>", exits), "exits"), base + "part long, _start int", entered)
    both = cut.join(ends, at).join(starts, at, "left").select(*at, "rows", "ending", F.coalesce("_start", "start").alias("start"), "last")
    edits = stage(_mapped(both, base + "part long, audit string, edits array<struct<pos:bigint,came:array<struct<role:string,own:boolean>>>>", edited), "conversation_edits")

    turn, clear = F.when(F.col("_known"), F.col("_turn")), ~F.col("blank")
    wide = "decimal(20,0)"
    gaps = F.least(F.coalesce(F.max(turn).cast(wide) - F.min(turn).cast(wide) + 1 - F.count_distinct(turn), F.lit(0)), F.lit(2**63 - 1)).cast("long")
    counts = p.groupBy(*_CONV).agg(
        gaps.alias("gaps"), F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"), F.sum(F.when(clear, F.col("n") - F.col("first").cast("int")).otherwise(0)).alias("duplicate"),
        F.count_if(clear & F.col("first") & F.col("truncated")).alias("truncated"),
    )
    audits = whole(edits, "audit").select(*_CONV, F.array_join("parts.audit", "").alias("audit"))
    summary = counts.join(ends.where("cost is not null").select(*_CONV, "illegal", "cost"), _CONV).join(audits, _CONV)
    summary = summary.select(_own_id(), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    came = edits.select(F.explode("edits").alias("e")).select("e.*").join(p.select(*_KEY, "pos"), "pos")
    texts = table.groupBy(*_KEY).agg(F.first("_text").alias("_text"))
    made = came.join(texts, _KEY).select(*_CONV, "pos", "_role", "_text", F.posexplode("came").alias("step", "x"))
    new = made.select(_own_id(), F.col("pos").alias("place"), "step", F.coalesce("x.role", "_role").alias("role"), F.when(F.col("x.own"), F.col("_text")).otherwise("").alias("text"))
    return Repair(summary, new)


def digest(rows: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines. A digest has one order, so a conversation streams through one task, in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        out: list[tuple[int | None, str]] = []
        for batch in batches:
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if state is None or conv != at:
                    if state is not None:
                        out.append((at, state.hexdigest()))
                    at, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text.as_py()}".encode())
            yield as_batch(out)
            out = []
        if state is not None:
            yield as_batch([(at, state.hexdigest())])

    def as_batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], ["conv_id", "repaired_sha256"])

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place", "step").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, repaired_sha256 string")


def audited(original: DataFrame, found: Repair) -> DataFrame:
    """One row for every conversation of the original table: its summary and the digest of what repair leaves."""
    ids = original.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    digests = digest(found.rows)
    j = ids.join(found.summary, same(ids, found.summary), "left").drop(found.summary["conv_id"])
    j = j.join(digests, same(ids, digests), "left").drop(digests["conv_id"])
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return j.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
