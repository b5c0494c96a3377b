"""Keys with few rows are not cut in slices, those with many are; both equal a plain loop."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_fills import HOUR, prints_and_orders, through
from test_scan import FILL, folded_ledger

from tidemark import staging
from tidemark.operators import asof, core, fills, rolling, scan, trades

KEYS = ["strategy", "venue", "symbol_id"]


def plain_equity(ledger, funding, at, mark, key):
    """cash, what is held, fees and funding up to and with ``at``"""
    if at is None or None in key:
        return 1000.0
    led = sorted((x for x in ledger if x[:3] == key and (x[3] is None or x[3] <= at)), key=lambda x: (x[3] is not None, x[3] or 0, x[4]))
    paid = [x for x in funding if x[:3] == key and (x[3] is None or x[3] <= at)]
    eq = 1000.0
    if led and led[-1][3] is not None:
        eq += sum(x[9] for x in led) - sum(x[7] for x in led) + led[-1][5] * (mark - led[-1][8])
    return eq - (sum(x[4] for x in paid) if any(x[3] is not None for x in paid) else 0.0)


@pytest.mark.parametrize("many", [0, 150, 10**6])
def test_equity_is_folded_once_and_equals_a_loop(spark, monkeypatch, many):
    """One key has most rows; some lack a time or a strategy."""
    monkeypatch.setattr(core, "MANY", many)
    written = []
    monkeypatch.setattr(scan, "staged", lambda df, name: written.append(name) or staging.staged(df, name))
    r, day = random.Random(9), trades.DAY_NS
    key = lambda: ("a", "okx", 1) if r.random() < 0.6 else (r.choice(["a", "b", None]), "okx", r.randrange(2, 6))
    at = lambda: None if r.random() < 0.02 else r.randrange(40 * 4) * (day // 4)
    ledger = [(*key(), at(), i, r.randint(-9, 9) / 1.0, r.randint(-9, 9) / 2, r.randint(0, 5) / 4, r.randint(1, 9) / 1.0, r.randint(-9, 9) / 8, 3.0) for i in range(400)]
    funding = [(*key(), at(), r.randint(-9, 9) / 16) for _ in range(120)]
    marks = sorted({(s, t): (s, t, r.randint(1, 20) / 2) for s, t in ((r.randrange(1, 7), at()) for _ in range(300))}.values(), key=str)
    led = spark.createDataFrame(ledger, "strategy string, venue string, symbol_id long, ts_ns long, seq long, qty double, fill_qty double, fee double, avg double, realized double, price double")
    f = spark.createDataFrame(funding, "strategy string, venue string, symbol_id long, ts_ns long, paid double")
    got = trades.equity_curve(led, spark.createDataFrame(marks, "symbol_id long, ts_ns long, mark double"), f, KEYS, 1000.0, ["symbol_id"])
    assert got.columns == ["symbol_id", "ts_ns", "mark", "strategy", "venue", "qty", "avg", "cum_realized", "cum_fees", "cum_cash", "cum_funding", "unrealized", "equity", "residual"]
    have = {(x["strategy"], x["symbol_id"], x["ts_ns"]): x["equity"] for x in got.collect()}
    assert have == {(k[0], s, t): plain_equity(ledger, funding, t, m, k) for s, t, m in marks for k in {x[:3] for x in ledger if x[2] == s}}
    assert written == (["starts"] if many < 10**6 else [])  # without a busy key nothing is carried


@pytest.mark.parametrize("many", [0, 10**6])
def test_equity_moves_its_rows_once(spark, monkeypatch, many):
    monkeypatch.setattr(core, "MANY", many)
    led = spark.range(40).selectExpr("'s' AS strategy", "'okx' AS venue", "id % 3 AS symbol_id", "id AS ts_ns", "id AS seq", "1.0D AS qty", "1.0D AS fill_qty", "0.0D AS fee", "1.0D AS avg", "0.0D AS realized", "1.0D AS price")
    e = trades.equity_curve(led, led.selectExpr("symbol_id", "ts_ns", "price AS mark"), led.selectExpr(*KEYS, "ts_ns", "qty AS paid"), KEYS, 0.0, ["symbol_id"])
    assert e._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1


@pytest.mark.parametrize("many", [0, 50, 10**6])
def test_ledgers_of_keys_with_few_and_many_fills(spark, monkeypatch, many):
    monkeypatch.setattr(core, "MANY", many)
    r = random.Random(many)
    fills = [("s", "okx", 1 if i % 3 else r.randrange(2, 40), r.choice(["Buy", "Sell"]), r.choice([0.5, 1.0, 3.0]), r.randint(50, 150) * 1.0, r.choice([0.0, 0.1, 0.3]), r.randrange(200), i) for i in range(900)]
    want = folded_ledger(fills)
    got = {x["seq"]: tuple(x[c] for c in ("qty", "avg", "realized", "attributed_fees", "closed_qty", "net")) for x in trades.position_ledger(spark.createDataFrame(fills, FILL).repartition(6), KEYS).collect()}
    assert got.keys() == want.keys()
    for seq, row in want.items():
        assert got[seq] == pytest.approx(row, rel=1e-9, abs=1e-9)


def test_a_ledger_of_small_keys_moves_its_fills_once(spark):
    f = spark.createDataFrame([("s", "okx", i % 5, "Buy", 1.0, 2.0, 0.1, i, i) for i in range(60)], FILL)
    plan = trades.position_ledger(f, KEYS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


@pytest.mark.parametrize("forward, strict", [(False, False), (False, True), (True, False), (True, True)])
@pytest.mark.parametrize("many", [0, 100, 10**6])
def test_as_of_with_few_and_many_rows_a_key(spark, monkeypatch, many, forward, strict):
    monkeypatch.setattr(core, "MANY", many)
    r = random.Random(many)
    key = lambda: "a" if r.random() < 0.7 else r.choice(["b", "c", None])
    at = lambda: r.choice([None, *range(0, 90)])
    left, right = [(key(), at(), i) for i in range(150)], [(key(), at(), i, r.choice([None, i])) for i in range(120)]
    l, rt = spark.createDataFrame(left, "k string, t long, i long"), spark.createDataFrame(right, "k string, t long, q long, v long")
    got = {x["i"]: x["v"] for x in asof.asof(l, rt, ["k"], "t", "t", ["v"], "q", forward, strict, 7, busy=core.crowded(["k"], l, rt)).collect()}
    for k, t, i in left:
        near = (lambda u: u > t if strict else u >= t) if forward else (lambda u: u < t if strict else u <= t)
        seen = sorted(((x[1], x[2], x[3]) for x in right if None not in (k, t, x[0], x[1]) and x[0] == k and near(x[1])), key=lambda x: x[:2])
        assert got[i] == (seen[0 if forward else -1][2] if seen else None)


@pytest.mark.parametrize("many", [0, 10**6])
def test_funding_of_small_keys_moves_its_rows_once_a_join(spark, monkeypatch, many):
    monkeypatch.setattr(core, "MANY", many)
    f = spark.range(60).selectExpr("'s' AS strategy", "id % 3 AS symbol_id", "id AS ts_ns", "id % 4 - 1.0D AS qty", "id * 1.0D AS mark", "0.5D AS rate")
    a = trades.accrue_funding(f.select("symbol_id", "ts_ns", "rate"), f.select("strategy", "symbol_id", "ts_ns", "qty"), f.select("symbol_id", "ts_ns", "mark"), ["strategy", "symbol_id"], ["symbol_id"])
    assert {(x["ts_ns"], x["paid"]) for x in a.collect()} == {(i, 0.5 * (i % 4 - 1) * i) for i in range(60) if i % 4 != 1}
    assert a._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 2


def test_quantiles_of_many_short_slices(spark):
    """Slices of several keys pass together, not a call each; what one asks never meets another's rows."""
    r = random.Random(12)
    nan = float("nan")
    rows = [("x" if i % 3 else r.choice(["y", "z", None]), 1.0 if i % 3 else r.choice([1.0, nan, None]), r.randrange(500), i, r.choice([None, *range(30)])) for i in range(900)]
    d = spark.createDataFrame(rows, "k string, f double, t long, i long, x int").repartition(3)
    q = rolling.quantiles(d, ["k", "f"], F.col("x"), {"p": 0.9}, "t", 50, least=1)
    assert "GroupsInArrow" not in q._jdf.queryExecution().executedPlan().toString()
    got = {x["i"]: x["p"] for x in q.collect()}
    same = lambda a, b: a == b or (a is not None and b is not None and a != a and b != b)
    assert len(got) == len(rows)
    for k, f, t, i, _ in rows:
        past = [x for k2, f2, t2, _, x in rows if k2 == k and same(f2, f) and x is not None and t - 50 <= t2 < t]
        assert got[i] == (pytest.approx(np.percentile(past, 90), rel=1e-12) if past else None)


@pytest.mark.parametrize("chunk", [1, 700, 10**6])
def test_slices_are_handed_on_whole_and_many_at_a_time(monkeypatch, chunk):
    monkeypatch.setattr(rolling, "CHUNK", chunk)
    sizes = np.random.default_rng(5).integers(1, 40, 3000)
    sizes[[7, 2999]] = 9000  # longer than a chunk
    slots = np.repeat(np.arange(3000), sizes)
    rows = pa.table({"k": pa.array(["a"] * len(slots)), "_s": slots})
    parts = [(p["_s"].to_numpy(), g) for p, g in rolling._whole_slices(iter(rows.to_batches(max_chunksize=500)), ["k", "_s"])]
    assert np.concatenate([s for s, _ in parts]).tolist() == slots.tolist() and len(parts) <= len(slots) // 500 + 1
    for s, g in parts:
        assert (g == np.unique(s, return_inverse=True)[1]).all()
    assert all(x[-1] < y[0] for (x, _), (y, _) in zip(parts, parts[1:]))


@pytest.mark.parametrize("few", [0, 450, 10**6])
@pytest.mark.parametrize("share", [None, 0.25])
def test_resting_orders_of_keys_with_few_and_many_prints(spark, monkeypatch, few, share):
    monkeypatch.setattr(fills, "FEW", few)
    ladders, plain = [], fills._by_slices
    monkeypatch.setattr(fills, "_by_slices", lambda *a: ladders.append(1) or plain(*a))
    prints, orders, t, o = prints_and_orders(spark, 8)
    want = {}
    for x in orders:
        crossing, got, at = through(x, prints), 0.0, None
        for p in crossing:
            got += p[5] * (share or 1e9)
            if at is None and got >= x[6]:
                at = p[2]
        want[x[0]] = (at, None if share is None or not crossing else min(got, x[6]))
    have = fills.touch_through(o, t, ["venue", "symbol_id"], share, slice_ns=HOUR)
    assert {r["order_id"]: (r["fill_ts_ns"], r["filled_qty"] if share else None) for r in have.collect()} == want
    assert ladders == ([] if few == 10**6 else [1])
