"""Conversation repair against an exhaustive search."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


def brute_audit(rows):
    """Dijkstra over (row, state) with the letters so far: the least (cost, letters), and what it leaves."""
    n = len(rows)
    heap, done = [(0, "", 0, 0, ())], set()
    follow = {0: "su", 1: "u", 2: "a", 3: "u"}
    number = {"s": 1, "u": 2, "a": 3}
    full = {"u": "user", "a": "assistant"}
    while heap:
        cost, letters, i, q, out = heapq.heappop(heap)
        if i == n and q in (0, 3):
            return cost, letters, out
        if (i, q) in done:
            continue
        done.add((i, q))
        for x in follow[q].replace("s", ""):
            heapq.heappush(heap, (cost + 2, letters + "I", i, number[x], out + ((full[x], ""),)))
        if i < n:
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, letters + "D", i + 1, q, out))
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                if role[:1] and role[:1] in follow[q]:
                    heapq.heappush(heap, (cost + late, letters + "K", i + 1, number[role[0]], out + ((role, text),)))
                for x in follow[q].replace("s", ""):
                    heapq.heappush(heap, (cost + 2 + late, letters + "R", i + 1, number[x], out + ((full[x], text),)))
    raise AssertionError


def brute(rows, damage=True):
    kept = defaultdict(list)
    for conv, turn, role, text in rows:
        kept[conv] += []
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 99
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in kept.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faulty, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            v = VISIBLE.findall(text)
            fault = "blank" if not v else "duplicate" if (role, text) in seen else "truncated" if v[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            faulty.append((role, text, fault))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, left = brute_audit(faulty)
        out.append((conv, gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def table():
    r = random.Random(5)
    text = lambda: r.choice(["Yes.", "No!", "so", "", " ", "Why?", "é. \n", "a" * 30 + ".", "tail", "x. y", None, "\x1c.", "Yes."])
    role = lambda: r.choice(["user", "assistant", "system", "tool", "", "user", "assistant", "unit", "Sys", None])
    rows = []
    for conv in range(250):
        rows += [(conv, r.choice([t, t, t, t * 2, None, 0]), role(), text()) for t in range(r.randint(1, 12))]
    for conv in range(300, 340):
        rows += [(conv, t, ("user", "assistant")[t % 2] if r.random() < 0.8 else role(), f"Say {t}." if r.random() < 0.8 else text()) for t in range(r.randint(1, 60))]
    rows += [(None, t, role(), text()) for t in range(20)] + [(400, t, "user", "same") for t in range(50)] + [(401, 3, "user", "copy.")] * 40
    return rows + [(402, t, ("user", "assistant")[t % 2], f"line {t}." if t % 7 else "cut") for t in range(3000)] + [(403, None, "system", "s."), (403, None, "user", "u."), (-5, -(2**62), "user", "a."), (-5, 2**62, "assistant", "b.")]


def run(spark, rows, parts):
    df = spark.createDataFrame([(*r, 1, "x", True) for r in rows], SCHEMA + ", pos int, part string, first boolean").repartition(parts)
    return sorted((tuple(r) for r in C.audited(df, C.repair(C.damaged(df))).collect()), key=str)


def test_repair(spark, table):
    assert run(spark, table, 5) == brute([r for r in table])


def test_divided_conversations(spark, table):
    """One conversation holds most rows and lies in many partitions."""
    keep = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        own = [r for r in table if r[0] in (402, 401, 310, 311, None)]
        assert C.placed(C.faults(C.keyed(spark.createDataFrame(own, SCHEMA)))).where("_c = 402").select("part").distinct().count() > 5
        assert run(spark, own, 3) == brute(own)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keep[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", keep[1])


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Q?"), (1, 2, "user", "Q?"), (1, 3, "tool", "r.")]
    found = C.repair(spark.createDataFrame(rows, SCHEMA))
    got = [(r["role"], r["text"]) for r in found.rows.orderBy("place", "step").collect()]
    s = found.summary.collect()[0]
    assert (s["audit"], s["cost"], s["duplicate"]) == ("IKKDR", 7, 1) and got == [("user", ""), ("assistant", "Hi."), ("user", "Q?"), ("assistant", "r.")]


def test_empty(spark):
    assert run(spark, [], 1) == []


def test_runs_by_powers():
    for symbol in range(9):
        step, whole = C.power(symbol, 0), C.IDENTITY
        for n in range(1, 40):
            whole = C.times(whole, step)
            assert C.run_matrix(symbol, n) == whole
