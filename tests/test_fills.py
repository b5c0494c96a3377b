"""Resting orders against plain loops over the prints."""

import random

import pytest

from tidemark.operators import fills

HOUR = 3_600 * 10**9


def prints_and_orders(spark, seed):
    r = random.Random(seed)
    t = [("okx", 0 if r.random() < 0.7 else 1, r.randrange(400 * HOUR), i, float(r.randint(90, 110)), r.randint(1, 40) / 4, r.choice(["Buy", "Sell", "Sell", None])) for i in range(900)]
    t.append(("okx", 0, 5_000 * HOUR, 900, 80.0, 1_000.0, "Sell"))  # long after all others
    o = [(i, "okx", r.randrange(3), r.randrange(400 * HOUR), r.choice(["Buy", "Sell"]), float(r.randint(91, 109)), float(r.choice([1, 20, 200, 100_000]))) for i in range(120)]
    return t, o, spark.createDataFrame(t, "venue string, symbol_id long, recv_ts_ns long, stream_seq long, price double, qty double, side string"), spark.createDataFrame(o, "order_id long, venue string, symbol_id long, ready_ns long, side string, limit_px double, qty double")


def through(order, prints):
    _, v, s, ready, side, limit, _ = order
    hit = lambda p: p[6] is not None and (p[6] != "Buy" and p[4] < limit if side == "Buy" else p[6] == "Buy" and p[4] > limit)
    return sorted((p for p in prints if p[:2] == (v, s) and p[2] >= ready and hit(p)), key=lambda p: p[2:4])


@pytest.mark.parametrize("slice_ns", [HOUR, HOUR // 64, 10_000 * HOUR])
def test_queue_share_fills_equal_a_loop(spark, slice_ns):
    prints, orders, t, o = prints_and_orders(spark, 5)
    want = {}
    for x in orders:
        got, at = 0.0, None
        crossing = through(x, prints)
        for p in crossing:
            got += p[5] * 0.25
            if got >= x[6]:
                at = p[2]
                break
        want[x[0]] = (at, min(got, x[6]) if crossing else None)
    have = {r["order_id"]: (r["fill_ts_ns"], r["filled_qty"]) for r in fills.touch_through(o, t, ["venue", "symbol_id"], 0.25, slice_ns=slice_ns).collect()}
    assert have == want and len({w[0] for w in want.values()}) > 20 and any(w[0] is None and w[1] for w in want.values())


@pytest.mark.parametrize("slice_ns", [HOUR, 10**6 * 50])
def test_first_crossings_equal_a_loop_whatever_the_slice(spark, slice_ns):
    prints, orders, t, o = prints_and_orders(spark, 6)
    have = {r["order_id"]: r["fill_ts_ns"] for r in fills.touch_through(o, t, ["venue", "symbol_id"], slice_ns=slice_ns).collect()}
    assert have == {x[0]: min((p[2] for p in through(x, prints)), default=None) for x in orders}


def test_without_orders_or_prints(spark):
    _, _, t, o = prints_and_orders(spark, 7)
    none = fills.touch_through(o, t.limit(0), ["venue", "symbol_id"], 0.5).collect()
    assert len(none) == 120 and all(r["fill_ts_ns"] is None and r["filled_qty"] is None for r in none)
    assert fills.touch_through(o.limit(0), t, ["venue", "symbol_id"], 0.5).count() == 0
