"""Scans over slices: one key that holds all rows lies in many slices and equals a plain fold."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import book, scan, screener, trades

KEYS = ["strategy", "venue", "symbol_id"]
FILL = "strategy string, venue string, symbol_id long, side string, qty double, price double, fee double, ts_ns long, seq long"
BOOK = "venue string, symbol_id long, recv_ts_ns long, stream_seq long, kind string, seq long, first_seq long, last_seq long, bids array<struct<price:double,qty:double>>, asks array<struct<price:double,qty:double>>"


def test_scanned_folds(spark):
    r = random.Random(1)
    rows = [("a" if i % 5 else None, r.choice([None, *range(0, 400, 3)]), i, r.choice([None, r.randint(-9, 9)])) for i in range(900)]
    d = spark.createDataFrame(rows, "k string, t long, s long, v long").repartition(5)
    v = F.col("v")
    folds = {f"{k}_{int(strict)}": (k, v, strict) for k in ("sum", "max", "min", "last") for strict in (False, True)}
    got = {x["s"]: x for x in scan.scanned(d, ["k"], folds, "t", ("s",), 10).collect()}
    for key in ("a", None):
        seen = []
        for _, _, s, x in sorted((w for w in rows if w[0] == key), key=lambda w: (w[1] is not None, w[1] or 0, w[2])):
            for strict in (1, 0):
                if not strict and x is not None:
                    seen.append(x)
                want = (sum(seen), max(seen), min(seen), seen[-1]) if seen else (None,) * 4
                assert tuple(got[s][f"{k}_{strict}"] for k in ("sum", "max", "min", "last")) == want


def test_affine_in_blocks(spark):
    r = random.Random(2)
    rows = [("k", i, r.choice([1.0, 1.0, 0.5, 1e-9, 1e9, 0.0]) if i % 3 else 1.0, r.random()) for i in range(3000)] + [("one", 0, 0.7, 2.0)]
    got = {(x["k"], x["i"]): x["x"] for x in scan.affine(spark.createDataFrame(rows, "k string, i long, m double, b double").repartition(4), ["k"], "i", "m", {"x": "b"}).collect()}
    x = 0.0
    for k, i, m, b in rows[:3000]:
        x = m * x + b
        assert got[k, i] == pytest.approx(x, rel=1e-9)
    assert got["one", 0] == 2.0


def folded_ledger(fills):
    out, positions = {}, {}
    for f in sorted(fills, key=lambda f: (f[7], f[8])):
        p = positions.setdefault(f[:3], trades.Position())
        gross, fees, closed = p.fill(f[4] if f[3] == "Buy" else -f[4], f[5], f[6])
        out[f[8]] = (p.qty, p.avg if p.qty else 0.0, gross, fees, closed, gross - fees if closed else 0.0)
    return out


@pytest.mark.parametrize("sizes", [(1, 2, 3), (0.5, 0.25, 8.0), (1, 1, 1)])
def test_ledger_of_one_hot_key_equals_the_fold(spark, sizes):
    r = random.Random(str(sizes))
    fills = [("s", "okx", 1, r.choice(["Buy", "Sell"]), float(r.choice(sizes)), r.randint(50, 150) * 1.0, r.choice([0.0, 0.1, 0.3]), r.randrange(800), i) for i in range(4000)]
    fills += [("s", None, 2, r.choice(["Buy", "Sell"]), 1.5, 10.0 + i % 7, 0.01, i, 10_000 + i) for i in range(60)] + [("s", "okx", 3, "Buy", 0.0, 5.0, 0.2, 1, 20_000), ("s", "okx", 3, "Buy", 2.0, 5.0, 0.2, 2, 20_001), ("s", "okx", 3, "Sell", 2.0, 6.0, 0.2, 3, 20_002)]
    want = folded_ledger(fills)
    got = {x["seq"]: tuple(x[c] for c in ("qty", "avg", "realized", "attributed_fees", "closed_qty", "net")) for x in trades.position_ledger(spark.createDataFrame(fills, FILL).repartition(6), KEYS).collect()}
    assert got.keys() == want.keys()
    for seq, row in want.items():
        assert got[seq] == pytest.approx(row, rel=1e-9, abs=1e-9), seq


def test_ledger_without_fills(spark):
    assert trades.position_ledger(spark.createDataFrame([], FILL), KEYS).collect() == []


def hot_book(r, n):
    rows, last = [], 0
    for i in range(n):
        levels = lambda base: [(float(base + r.randint(-5, 5)), float(r.choice([0, 0, 1, 2, 5]))) for _ in range(r.randint(0, 3))]
        if i % 97 == 3:
            last += 1
            rows.append(("okx", 1, i * 7, i, "book_snapshot", last, None, None, levels(100), levels(110)))
            continue
        first = last + (r.choice([1] * 60 + [0, -3, 3]))
        rows.append(("okx", 1, i * 7, i, "book_delta", None, first, first + r.randint(0, 2), levels(100), levels(110)))
        last = max(last, rows[-1][7]) if r.random() < 0.95 else last
    return rows


def plain_actions(rows, rule):
    out, epoch, known, state = [], 0, None, "start"
    for x in rows:
        if x[4] == "book_snapshot":
            epoch, known, state = epoch + 1, x[5], "live"
            out.append((epoch, "Snapshot"))
            continue
        if state != "live":
            out.append((epoch, "Drop"))
            continue
        gap = x[6] > known + 1 if rule == "range" else x[6] != known + 1 if rule == "strict" else x[6] != known
        if gap:
            state = "broken"
            out.append((epoch, "Gap"))
        elif rule == "range" and x[7] <= known:
            out.append((epoch, "Drop"))
        else:
            out.append((epoch, "Apply"))
        known = max(known, x[7]) if rule == "range" else x[7]
    return out


@pytest.mark.parametrize("rule", ["range", "strict", "prev"])
def test_continuity_of_one_hot_key(spark, monkeypatch, rule):
    monkeypatch.setattr(scan.scanned, "__defaults__", ("recv_ts_ns", ("stream_seq",), 100, False))
    rows = hot_book(random.Random(rule), 1500)
    c = book.book_continuity(spark.createDataFrame(rows, BOOK).repartition(5), rule)
    got = [(x["epoch"], x["action"]) for x in c.orderBy("stream_seq").collect()]
    assert got == plain_actions(rows, rule) and len(set(got)) > 30


def test_top_of_book_of_one_hot_epoch(spark):
    r = random.Random(9)
    rows = hot_book(r, 1200)
    c = spark.createDataFrame(rows, BOOK).withColumns({"epoch": F.lit(1), "action": F.when(F.col("stream_seq") == 0, "Snapshot").otherwise("Apply")}).repartition(5)
    got = {x["stream_seq"]: x for x in book.top_of_book(c, ("venue", "symbol_id"), 150).collect()}
    sides = ({}, {})
    for x in rows:
        for side, levels in zip(sides, x[8:10]):
            for price, qty in levels:
                side[price] = qty
        bid, ask = (max((p for p, q in sides[0].items() if q > 0), default=None), min((p for p, q in sides[1].items() if q > 0), default=None))
        g = got[x[3]]
        assert (g["best_bid"], g["bid_qty"], g["best_ask"], g["ask_qty"]) == (bid, sides[0].get(bid), ask, sides[1].get(ask))
        assert (g["bid_levels"], g["ask_levels"]) == tuple(sum(q > 0 for q in s.values()) for s in sides)
    assert len(got) == len(rows)


def test_screener_with_many_features_and_one_hot_key(spark):
    r = random.Random(4)
    rows = [(f"f{r.randrange(600)}" if i % 3 else "x", 1, r.randrange(4 * 10**13), i, i % 2, float(r.randint(-5, 5))) for i in range(3000)]
    h = screener.screen(spark.createDataFrame(rows, "feature string, symbol_id long, emit_ts_ns long, emit_seq long, reg_idx int, value double").repartition(4), {"up": [("x", "Gt", 2.0)], "both": [("x", "Lt", 0.0), ("f1", "Gt", 0.0)]}).collect()
    got = sorted((x["rule_id"], x["ts_ns"], x["snapshot"]) for x in h)
    want, last, before = [], {}, {"up": False, "both": False}
    for f, _, t, _, _, v in sorted(rows, key=lambda x: (x[2], x[3], x[4])):
        last[f] = v
        now = {"up": last.get("x", 0) > 2, "both": last.get("x", 0) < 0 and last.get("f1", 0) > 0}
        want += [(rule, t, dict(last)) for rule in now if now[rule] and not before[rule]]
        before = now
    assert got == sorted(want, key=lambda x: x[:2]) and len(want) > 200


def test_persistence_and_trailing_orders_of_one_hot_key(spark):
    r = random.Random(5)
    day = 86_400 * 10**9
    rows = [(1, t, r.random() < 0.8) for t in sorted(r.sample(range(0, 40 * day, day // 24), 400))]
    got = sorted((x["ts_ns"], x["since_ns"]) for x in screener.persistent(spark.createDataFrame(rows, "symbol_id long, ts_ns long, sat boolean"), day // 2).collect())
    want, since, told = [], None, False
    for _, t, sat in rows:
        since, told = (since if since is not None else t, told) if sat else (None, False)
        if sat and t - since >= day // 2 and not told:
            want.append((t, since))
            told = True
    assert got == want
    orders = [("s", r.randrange(3000), i) for i in range(700)] + [("s", None, 900)]
    n = {x["seq"]: x["orders_last_min"] for x in trades.trailing_order_count(spark.createDataFrame(orders, "strategy string, ts_ns long, seq long"), ["strategy"], window_ns=100).collect()}
    for _, t, i in orders[:700]:
        assert n[i] == sum(1 for _, u, j in orders[:700] if t - 100 < u <= t and (u, j) < (t, i))
    assert len(n) == 701
