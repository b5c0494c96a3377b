"""Operators on small hand-made frames; the numbers are worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as sc
from tidemark.operators import asof, bars, book, core, features, fills, grading, intervals, monitor, quality, screener, study, trades

SEC, MIN, DAY = 10**9, 60 * 10**9, 86_400 * 10**9
EVENT = "venue string, symbol_id long, recv_ts_ns long, stream_seq long, price double, qty double, side string"


def ev(spark, rows):
    return spark.createDataFrame([("okx", 1, *r) for r in rows], EVENT)


def values(df, order=("recv_ts_ns", "stream_seq")):
    return [r["value"] for r in df.orderBy(*order).collect()]


def test_cvd(spark):
    assert values(features.cvd(ev(spark, [(1, 1, 10.0, 2.0, "Buy"), (2, 2, 10.0, 0.5, "Sell")]))) == [2.0, 1.5]


def test_cvd_carries_over_days(spark):
    rows = [(i * DAY // 3, i, 1.0, 1.0, "Buy" if i % 3 else "Sell") for i in range(20)]
    run, want = 0.0, []
    for r in rows:
        run += 1.0 if r[4] == "Buy" else -1.0
        want.append(run)
    assert values(features.cvd(ev(spark, rows))) == want


def test_prefix_property(spark):
    """No feature looks ahead: features of the first rows are the first of the features."""
    r = random.Random(3)
    rows = sorted((r.randrange(0, 40) * SEC, i, r.uniform(1, 9), r.uniform(1, 9), r.choice(["Buy", "Sell"])) for i in range(60))
    for f in (features.cvd, lambda t: features.liq_cluster(t, 5 * SEC, 0.0), features.session_vwap, lambda t: features.sweep(t, 5 * SEC)):
        full = {x["stream_seq"]: x for x in f(ev(spark, rows)).collect()}
        for x in f(ev(spark, rows[:35])).collect():
            assert x.asDict() == pytest.approx(full[x["stream_seq"]].asDict())


def test_whale_prints(spark):
    assert values(core.whale_prints(ev(spark, [(1, 1, 100.0, 500.0, "Buy"), (2, 2, 100.0, 2000.0, "Sell")]), 100_000.0)) == [-200_000.0]


def test_liq_cluster(spark):
    assert values(features.liq_cluster(ev(spark, [(1, 1, 30_000.0, 20.0, "Sell"), (2, 2, 30_000.0, 20.0, "Sell")]), 10 * SEC, 1e6)) == [-1_200_000.0]


def test_liq_window_is_inclusive_and_peers_do_not_leak(spark):
    rows = [(0, 1, 1.0, 1.0, "Buy"), (10, 2, 1.0, 1.0, "Buy"), (10, 3, 1.0, 1.0, "Buy"), (11, 4, 1.0, 1.0, "Buy")]
    assert values(features.liq_cluster(ev(spark, rows), 10, 0.0)) == [1.0, 2.0, 3.0, 3.0]


def test_oi_delta(spark):
    df = spark.createDataFrame([("okx", 1, 1, 1, 1000.0), ("okx", 1, 2, 2, 1050.0)], "venue string, symbol_id long, recv_ts_ns long, stream_seq long, oi_contracts double")
    assert values(features.oi_delta(df)) == [50.0]


def test_time_bars(spark):
    b = bars.time_bars(ev(spark, [(0, 1, 10.0, 3.0, "Buy"), (SEC // 2, 2, 12.0, 1.0, "Sell"), (SEC + 1, 3, 11.0, 1.0, "Buy")]), SEC).collect()
    assert len(b) == 1 and b[0]["delta"] == 2.0 and (b[0]["open"], b[0]["close"], b[0]["high"], b[0]["n"]) == (10.0, 12.0, 12.0, 2)
    assert b[0]["close_ts_ns"] == SEC and b[0]["emit_ts_ns"] == SEC + 1 and b[0]["vwap"] == pytest.approx(42 / 4)


def test_negative_buckets(spark):
    r = spark.range(1).select(sc.bucket(F.lit(-5), 3).alias("a"), sc.bucket_index(F.lit(-5), 3).alias("b")).first()
    assert (r["a"], r["b"]) == (-6, -2)


def _bars(spark, closes):
    rows = [("okx", 1, i, float(c), float(c), float(c)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "venue string, symbol_id long, open_ts_ns long, high double, low double, close double")


def test_donchian(spark):
    assert features.donchian(_bars(spark, [1, 2]), 3).count() == 0
    assert values(features.donchian(_bars(spark, [1, 2, 3, 4, 0, 2]), 3), ["open_ts_ns"]) == [0.0, 1.0, -1.0, 0.0]


def test_realized_vol_counts_valid_returns(spark):
    got = features.realized_vol(_bars(spark, [1, 2, 0, 4, 8, 16]), 2).orderBy("open_ts_ns").collect()
    assert [r["open_ts_ns"] for r in got] == [4, 5] and got[0]["value"] == pytest.approx((2 * 0.480453) ** 0.5, abs=1e-5)


STATUS = "venue string, symbol_id long, recv_ts_ns long, stream_seq long, kind string, status_kind string, detail string, reason string"


def test_manifest_disconnect(spark):
    df = spark.createDataFrame([("okx", 1, 500, 1, "trade", None, None, None), ("okx", 1, 1000, 2, "status", "Disconnected", None, None), ("okx", 1, 1500, 3, "status", "Disconnected", None, None), ("okx", 1, 1000 + DAY // 2, 4, "status", "Connected", None, None)], STATUS)
    m = quality.quality_manifest(df, 0, DAY).first()
    assert m["stream"] == "trades" and len(m["gaps"]) == 1 and m["coverage"] == pytest.approx(0.5)


def test_manifest_sequence_gap(spark):
    df = spark.createDataFrame([("okx", 1, 500, 1, "book_delta", None, None, None), ("okx", 1, 1000, 2, "status", "GapDetected", "venue", None), ("okx", 1, 1000 + DAY // 4, 3, "book_snapshot", None, None, "GapResync")], STATUS)
    m = {r["stream"]: r for r in quality.quality_manifest(df, 0, DAY).collect()}
    assert m["book_deltas"]["coverage"] == pytest.approx(0.75) and m["book_deltas"]["gaps"][0]["kind"] == "Venue" and m["book_snapshots"]["coverage"] == 1.0


def test_merged_order(spark):
    a, b = ev(spark, [(t, t, 1.0, 1.0, "Buy") for t in (1, 3, 5)]), ev(spark, [(t, t, 1.0, 1.0, "Buy") for t in (2, 4, 5)])
    assert [(r["recv_ts_ns"], r["source_idx"]) for r in core.in_order(core.merged(a, b)).collect()] == [(1, 0), (2, 1), (3, 0), (4, 1), (5, 0), (5, 1)]


def test_forward_returns(spark):
    prices = spark.createDataFrame([("B", 0, 100.0), ("B", MIN, 110.0)], "symbol string, ts_ns long, price double")
    f = lambda t, h: asof.forward_returns(spark.createDataFrame([("B", t)], "symbol string, ts_ns long"), prices, h).first()["fwd"]
    assert f(0, MIN) == pytest.approx(0.10) and f(0, 2 * MIN) is None and f(-MIN, MIN) is None


def test_asof_ties_and_direction(spark):
    l = spark.createDataFrame([(1, 10), (1, 5), (2, 10)], "k int, t long")
    r = spark.createDataFrame([(1, 10, 1, "a"), (1, 10, 2, "b"), (1, 12, 3, "c")], "k int, t long, q long, v string")
    back = {(x["k"], x["t"]): x["v"] for x in asof.asof_backward(l, r, ["k"], "t", ["v"], "q").collect()}
    ahead = {(x["k"], x["t"]): x["v"] for x in asof.asof(l, r, ["k"], "t", "t", ["v"], "q", forward=True).collect()}
    strict = {(x["k"], x["t"]): x["v"] for x in asof.asof(l, r, ["k"], "t", "t", ["v"], "q", forward=True, strict=True).collect()}
    assert back == {(1, 10): "b", (1, 5): None, (2, 10): None}
    assert ahead == {(1, 10): "a", (1, 5): "a", (2, 10): None} and strict == {(1, 10): "c", (1, 5): "a", (2, 10): None}


def test_grades_and_decay(spark):
    prices = spark.createDataFrame([("B", 0, 100.0), ("B", MIN, 110.0), ("B", 2 * MIN, 121.0)], "symbol string, ts_ns long, price double")
    hits = spark.createDataFrame([("r", "B", 0), ("r", "B", MIN), ("r", "B", 9 * MIN)], "rule string, symbol string, ts_ns long")
    base = spark.createDataFrame([("B", 0.05)], "symbol string, avg_fwd double")
    g = grading.grade_hits(hits, prices, MIN, base).first()
    assert (g["n"], g["wins"]) == (2, 2) and g["avg_excess"] == pytest.approx(0.05)
    for series, want in (([0.10] * 8 + [0.01] * 4, True), ([0.10] * 12, False), ([0.1] * 4, False), ([-0.02] * 12, False)):
        w = spark.createDataFrame([("r", i, x) for i, x in enumerate(series)], "rule string, week int, avg_excess double")
        assert grading.edge_decay(w).orderBy(F.desc("week")).first()["decayed"] is want


def test_car_and_bootstrap(spark):
    x = spark.createDataFrame(list({9: 0.0, 10: 0.02, 11: 0.01, 19: 0.0, 20: 0.04, 21: 0.03}.items()), "ts_ns long, excess double")
    e = spark.createDataFrame([(10, None), (20, "up"), (30, None)], "ts_ns long, regime string")
    assert [r["car"] for r in study.car(e, x, 1, 1, 1).orderBy("offset").collect()] == pytest.approx([0, 0.03, 0.05])
    assert [r["car"] for r in study.car(e.where("ts_ns = 30"), x, 1, 1, 1).orderBy("offset").collect()] == [0, 0, 0]
    t = study.terminals(e, x, 1, 1, 1)
    one, two = (study.bootstrap_ci(t, "terminal", ["ts_ns"], 7, 200).first() for _ in range(2))
    assert 0.03 - 1e-9 <= one["lo"] <= one["hi"] <= 0.07 + 1e-9 and one == two and one["n"] == 2
    assert tuple(study.bootstrap_ci(t.limit(0), "terminal", ["ts_ns"]).first()) == (0.0, 0.0, 0)


def test_mc_drawdown_against_paths(spark):
    r = random.Random(1)
    rows = [("s", d * DAY + i, round(r.uniform(-5, 5), 2)) for d in range(4) for i in range(r.randint(1, 4))]
    got = study.mc_drawdown(spark.createDataFrame(rows, "strategy string, ts_ns long, pnl double"), 40, 5, DAY).first()
    blocks = [[p for _, t, p in rows if t // DAY == d] for d in range(4)]
    import hashlib

    dds = []
    for rep in range(40):
        n, i, eq, peak, dd = 0, 0, 0.0, 0.0, 0.0
        while n < len(rows):
            b = blocks[int(hashlib.md5(f"5:{rep}:{i}".encode()).hexdigest()[:8], 16) % 4]
            for p in b:
                eq += p
                peak = max(peak, eq)
                dd = max(dd, peak - eq)
                n += 1
            i += 1
        dds.append(dd)
    dds.sort()
    assert (got["p50_max_dd"], got["p95_max_dd"], got["worst_max_dd"]) == pytest.approx((dds[20], dds[37], dds[39]))


FEATURE = "feature string, venue string, symbol_id long, ts_ns long, emit_ts_ns long, emit_seq long, value double, reg_idx int"


def test_screener_edges(spark):
    rows = [("cvd", "okx", 1, t, t, t, v, 0) for t, v in ((1, 3.0), (2, 7.0), (3, 8.0))]
    h = screener.screen(spark.createDataFrame(rows, FEATURE), {"r": [("cvd", "Ge", 5.0)], "never": [("none", "Gt", 0.0)]}).collect()
    assert len(h) == 1 and h[0]["snapshot"] == {"cvd": 7.0} and h[0]["ts_ns"] == 2


def test_screener_snapshot_holds_features_outside_the_rules(spark):
    rows = [("oi", "okx", 1, 1, 1, 1, 4.0, 1), ("oi", "okx", 1, 2, 2, 2, 5.0, 1), ("cvd", "okx", 1, 3, 3, 3, 7.0, 0), ("oi", "okx", 1, 4, 4, 4, 6.0, 1), ("late", "okx", 1, 5, 5, 5, 1.0, 2), ("oi", "okx", 2, 1, 1, 1, 9.0, 1), ("cvd", "okx", 2, 2, 2, 2, 8.0, 0)]
    h = screener.screen(spark.createDataFrame(rows, FEATURE), {"r": [("cvd", "Ge", 5.0)]}).collect()
    assert {r["symbol_id"]: r["snapshot"] for r in h} == {1: {"cvd": 7.0, "oi": 5.0}, 2: {"cvd": 8.0, "oi": 9.0}} and len(h) == 2


BOOK = "venue string, symbol_id long, recv_ts_ns long, stream_seq long, kind string, seq long, first_seq long, last_seq long, bids array<struct<price:double,qty:double>>, asks array<struct<price:double,qty:double>>"


def test_book(spark):
    rows = [("okx", 1, 1, 1, "book_snapshot", 100, None, None, [(100.0, 6.0)], [(101.0, 2.0)]), ("okx", 1, 2, 2, "book_delta", None, 99, 100, [(1.0, 1.0)], []), ("okx", 1, 3, 3, "book_delta", None, 101, 101, [(99.0, 4.0)], [(101.0, 0.0), (102.0, 6.0)]), ("okx", 1, 4, 4, "book_delta", None, 105, 105, [], []), ("okx", 1, 5, 5, "book_delta", None, 106, 106, [(5.0, 5.0)], []), ("okx", 1, 6, 6, "book_snapshot", 200, None, None, [(50.0, 1.0)], [])]
    df = spark.createDataFrame(rows, BOOK)
    c = book.book_continuity(df)
    assert [r["action"] for r in c.orderBy("stream_seq").collect()] == ["Snapshot", "Drop", "Apply", "Gap", "Drop", "Snapshot"]
    assert values(book.top_imbalance(c)) == [0.5, 0.0]
    lv = {(r["side"], r["price"], r["qty"]): r["to_ns"] for r in book.book_levels(c).collect()}
    assert lv == {("bid", 100.0, 6.0): 4, ("ask", 101.0, 2.0): 3, ("bid", 99.0, 4.0): 4, ("ask", 102.0, 6.0): 4, ("bid", 50.0, 1.0): None}
    at = book.levels_at(book.book_levels(c), spark.createDataFrame([("okx", 1, 3)], "venue string, symbol_id long, ts_ns long"), ["venue", "symbol_id"], 2)
    assert sorted((r["side"], r["price"]) for r in at.collect()) == [("ask", 102.0), ("bid", 99.0), ("bid", 100.0)]


def test_book_rules(spark):
    d = lambda i, a, b: ("okx", 1, i, i, "book_delta", None, a, b, [], [])
    snap = ("okx", 1, 1, 1, "book_snapshot", 10, None, None, [], [])
    act = lambda rows, rule: [r["action"] for r in book.book_continuity(spark.createDataFrame(rows, BOOK), rule).orderBy("stream_seq").collect()]
    assert act([snap, d(2, 11, 11), d(3, 11, 11), d(4, 12, 12)], "strict") == ["Snapshot", "Apply", "Gap", "Drop"]
    assert act([snap, d(2, 10, 14), d(3, 14, 20), d(4, 19, 25)], "prev") == ["Snapshot", "Apply", "Apply", "Gap"]
    assert act([d(1, 1, 10), d(2, 11, 12), d(3, 20, 21), d(4, 30, 31), d(5, 32, 33)], "reseed") == ["Snapshot", "Apply", "Gap", "Snapshot", "Apply"]


FILL = "strategy string, venue string, symbol_id long, side string, qty double, price double, fee double, ts_ns long, seq long"


def test_ledger_and_equity(spark):
    keys = ["strategy", "venue", "symbol_id"]
    f = spark.createDataFrame([("s", "okx", 1, "Buy", 1.0, 100.0, 1.0, 1, 1), ("s", "okx", 1, "Sell", 1.0, 110.0, 1.0, 3, 2)], FILL)
    led = trades.position_ledger(f, keys)
    last = led.orderBy("ts_ns").collect()[-1]
    assert last["realized"] == 10.0 and last["attributed_fees"] == 2.0 and last["net"] == 8.0 and last["qty"] == 0.0
    marks = spark.createDataFrame([(1, 2, 110.0), (1, 4, 110.0)], "symbol_id long, ts_ns long, mark double")
    fund = trades.accrue_funding(spark.createDataFrame([(1, 2, 0.001)], "symbol_id long, ts_ns long, rate double"), led, marks, keys, ["symbol_id"])
    assert fund.first()["paid"] == pytest.approx(0.11)
    e = trades.equity_curve(led, marks, fund.select(*keys, "ts_ns", "paid"), keys, 1000.0, ["symbol_id"]).orderBy("ts_ns").collect()
    assert [r["residual"] for r in e] == pytest.approx([0, 0], abs=1e-9) and e[-1]["equity"] == pytest.approx(1000 + 10 - 2 - 0.11)


def test_ledger_flip(spark):
    f = spark.createDataFrame([("s", "okx", 1, "Buy", 2.0, 10.0, 2.0, 1, 1), ("s", "okx", 1, "Buy", 2.0, 20.0, 2.0, 2, 2), ("s", "okx", 1, "Sell", 1.0, 25.0, 1.0, 3, 3), ("s", "okx", 1, "Sell", 6.0, 30.0, 6.0, 4, 4)], FILL)
    r = trades.position_ledger(f, ["strategy", "venue", "symbol_id"]).orderBy("ts_ns").collect()
    assert [x["avg"] for x in r] == [10.0, 15.0, 15.0, 30.0] and [x["qty"] for x in r] == [2.0, 4.0, 3.0, -3.0]
    assert (r[2]["realized"], r[2]["attributed_fees"]) == (10.0, 2.0) and (r[3]["realized"], r[3]["attributed_fees"]) == (45.0, 6.0)


def test_sizing(spark):
    o = spark.createDataFrame([(1, 5, 100_000.0, 0.5, 1.0, 1.5, 0.001, 10.0)], "k int, ts_ns long, equity double, weight double, risk_units double, k_stop double, step_size double, min_notional double")
    vol, mark = spark.createDataFrame([(1, 1, 0.02)], "k int, ts_ns long, vol double"), spark.createDataFrame([(1, 1, 100.0)], "k int, ts_ns long, mark double")
    s = trades.size_orders(o, vol, mark, ["k"], 0.005).first()
    assert s["qty"] == pytest.approx(83.333) and s["trace"]["raw"] == pytest.approx(83.3333, abs=1e-4)
    none = trades.size_orders(o, vol.limit(0), mark, ["k"], 0.005).first()
    assert none["qty"] == 0.0


def test_reconcile(spark):
    a, b = spark.createDataFrame([(0, 1.5)], "symbol_id long, qty double"), spark.createDataFrame([(0, 1.5), (1, 3.0)], "symbol_id long, qty double")
    assert [tuple(r) for r in trades.reconcile(a, b, 1e-9).collect()] == [(1, 0.0, 3.0)]


def test_plateau(spark):
    f = lambda pts: study.plateau_ok(spark.createDataFrame(pts, "delta double, expectancy double, base double")).first()["ok"]
    assert f([(0.3, -1.0, 1.0)]) is False and f([(0.31, -1.0, 1.0), (0.2, 2.0, 1.0)]) is True and f([(0.0, 1.0, 1.0)]) is True


def test_lifecycle(spark):
    rows = [("a", 1, "Submit", False), ("a", 2, "Ack", False), ("a", 3, "Fill", False), ("a", 4, "Ack", False), ("a", 5, "Fill", True), ("b", 1, "Submit", False), ("b", 2, "AckTimeout", False)]
    r = {x["client_id"]: x for x in trades.order_lifecycle(spark.createDataFrame(rows, "client_id string, seq int, event string, complete boolean")).collect()}
    assert r["a"]["state"] == "Filled" and r["a"]["terminal"] and r["a"]["illegal"] == ["PartFilled on Ack"] and r["b"]["unknown"]


def test_funnel(spark):
    t = spark.createDataFrame([("x", "Idea", "Hypothesis", False, None, 1), ("x", "Hypothesis", "WalkForward", False, None, 2), ("x", "WalkForward", "Killed", False, False, 3), ("y", "Paper", "LiveSmall", False, None, 40 * DAY)], "id string, from string, to string, actor_human boolean, autopsy_complete boolean, ts_ns long")
    e = spark.createDataFrame([("y", "LiveSmall", 1)], "id string, to string, ts_ns long")
    got = sorted((r["id"], r["violation"]) for r in trades.funnel_audit(t, e).collect())
    assert got == [("x", "NoAutopsy"), ("x", "NoEvidence"), ("x", "SkipsStage"), ("y", "NeedsHuman"), ("y", "StaleEvidence")]


def test_alert_routing(spark):
    H = 3_600 * SEC
    rows = [("a", "P2", 100, None, 0), ("a", "P2", 100, None, 99), ("a", "P2", 100, None, 100), ("b", "P3", 1, "k", 23 * H), ("b", "P1", 1, "k", 23 * H + 5)]
    r = monitor.route_alerts(spark.createDataFrame(rows, "id string, severity string, dedupe_window_ns long, dedupe_key string, ts_ns long"), (22 * 60, 6 * 60)).orderBy("ts_ns").collect()
    assert [x["outcome"] for x in r] == ["Sent", "Deduped", "Sent", "Batched", "Sent"]


def test_grounding(spark):
    t = spark.createDataFrame([(1, "up 3.50 from 2 and -7"), (2, "nothing"), (3, "1234567")], "id int, text string")
    i = spark.createDataFrame([(1, 3.5), (1, 2.0), (3, 1234568.0)], "id int, value double")
    r = {x["id"]: x for x in monitor.verify_grounded(t, i, "id").collect()}
    assert not r[1]["grounded"] and len(r[1]["ungrounded"]) == 1 and r[2]["grounded"] and r[3]["grounded"]


def test_intervals(spark):
    iv = spark.createDataFrame([(0, 10), (10, 20), (15, 18), (30, 40), (50, 50)], "start long, end long")
    assert sorted(map(tuple, check(spark, iv).collect())) == [(20, 30), (40, 100)]
    with pytest.raises(intervals.CoverageError):
        intervals.check_coverage(iv, 0, 100, "refuse")
    assert intervals.check_coverage(iv.limit(0), 5, 9).collect()[0][:] == (5, 9)


def check(spark, iv):
    return intervals.check_coverage(iv, 0, 100)


def test_touch_through_is_strict(spark):
    t = ev(spark, [(5, 1, 99.0, 4.0, "Sell"), (6, 2, 98.0, 4.0, "Buy"), (7, 3, 98.5, 4.0, "Sell"), (8, 4, 98.0, 4.0, "Sell")])
    o = spark.createDataFrame([(1, "okx", 1, 5, "Buy", 99.0, 3.0)], "order_id long, venue string, symbol_id long, ready_ns long, side string, limit_px double, qty double")
    assert fills.touch_through(o, t, ["venue", "symbol_id"]).first()["fill_ts_ns"] == 7
    assert fills.touch_through(o, t, ["venue", "symbol_id"], 0.5).first()["fill_ts_ns"] == 8


def test_touch_through_finds_the_first_crossing_at_any_distance(spark):
    """Hours, days and years after ready, over all lengths of slices."""
    hour = 3_600 * 10**9
    far = [0, 1, 2, 14, 15, 16, 17, 200, 255, 256, 257, 4000, 4096, 5000, 70_000, 1_100_000]
    for first in (3 * hour + 5, 479_999 * hour):
        t = ev(spark, [(first + h * hour + i, i, 99.0 - i, 1.0, "Sell") for i, h in enumerate(far)] + [(first + 3 * hour, 99, 1.0, 1.0, "Buy")])
        o = spark.createDataFrame([(i, "okx", 1, first, "Buy", 99.5 - i, 1.0) for i in range(len(far))] + [(100, "okx", 1, first, "Buy", 1.0, 1.0), (101, "okx", 2, first, "Buy", 1e9, 1.0)], "order_id long, venue string, symbol_id long, ready_ns long, side string, limit_px double, qty double")
        got = {r["order_id"]: r["fill_ts_ns"] for r in fills.touch_through(o, t, ["venue", "symbol_id"]).collect()}
        assert got == {i: first + h * hour + i for i, h in enumerate(far)} | {100: None, 101: None}


def test_depth_walk_and_arrival(spark):
    o = spark.createDataFrame([(1, "Buy", 5.0, 10, "okx")], "order_id long, side string, qty double, ts_ns long, venue string")
    lv = spark.createDataFrame([(1, 101.0, 2.0), (1, 102.0, 10.0)], "order_id long, price double, qty double")
    w = fills.depth_walk(o, lv).first()
    assert w["avg_px"] == pytest.approx((2 * 101 + 3 * 102) / 5) and w["unfilled_qty"] == 0
    q = spark.createDataFrame([("okx", 9, 1, 1.0, 1.0, 2.0, 4.0), ("okx", 15, 2, 1.0, 1.0, 3.0, 4.0)], "venue string, recv_ts_ns long, stream_seq long, best_bid double, bid_qty double, best_ask double, ask_qty double")
    a = fills.arrival_cost(o, q, ev(spark, [(1, 1, 7.0, 1.0, "Buy")]), ["venue"], 2, 0.5, 0.01).first()
    assert (a["fill_px"], a["filled_qty"], a["unfilled_qty"]) == (pytest.approx(3.03), 2.0, 3.0)  # the booked price slips too
    empty = fills.arrival_cost(o, q.withColumn("ask_qty", F.lit(0.0)), ev(spark, [(1, 1, 7.0, 1.0, "Buy")]), ["venue"], 2, 0.5, 0.01).first()
    assert (empty["fill_px"], empty["filled_qty"], empty["unfilled_qty"]) == (None, 0.0, 5.0)
    late = fills.arrival_cost(o, q.where("recv_ts_ns < 10"), ev(spark, [(1, 1, 7.0, 1.0, "Buy")]), ["venue"], 2, 0.5, 0.01).first()
    assert late["fill_px"] == pytest.approx(7.07)


def test_scalars(spark):
    r = spark.range(1).select(
        sc.ms_to_ns(F.lit(2**60)).alias("top"), sc.ms_to_ns(F.lit(5).cast("long")).alias("ms"), sc.number(F.lit("1.5")).alias("a"), sc.number(F.lit("x")).alias("b"), sc.fnv1a64(F.lit("a")).alias("h"),
        sc.venue_code(F.lit("bybit")).alias("v"), sc.round_down(F.lit(7.9), F.lit(0.5)).alias("d"), sc.round_down(F.lit(7.9), F.lit(0.0)).alias("p"),
    ).first()
    assert (r["top"], r["ms"], r["a"], r["b"], r["v"], r["d"], r["p"]) == (2**63 - 1, 5_000_000, 1.5, None, 2, 7.5, 7.9) and r["h"] % 2**64 == 0xAF63DC4C8601EC8C
    with pytest.raises(Exception, match="unknown venue"):
        spark.range(1).select(sc.venue_code(F.lit("nowhere"))).collect()
