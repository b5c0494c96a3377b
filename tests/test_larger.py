"""What larger tables brought up: starts beyond a long's time, ratios over zero, rows sorted and parsed more than once."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_scan import BOOK, hot_book, plain_actions

from tidemark import staging
from tidemark.operators import book, core, scan, trades
from tidemark.plans import registry
from tidemark.sources import normalize


def test_versions_that_start_after_the_last_nanosecond(spark, tmp_path):
    at = dt.datetime(2030, 1, 1)
    spark.createDataFrame([(3, 0), (5, 0), (98_000, 0), (900_000, 0), (899_999, 1)], "c_custkey bigint, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    rows = [(1, 3, at), (2, 900_000, at), (3, 899_999, at), (4, 3, dt.datetime(1992, 1, 5))]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    got = registry.QUERIES["jn2_scd2_as_of"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == {(1, 5), (2, 5), (3, None), (4, 3)}


def test_ratios_without_a_losing_period(spark):
    r = spark.createDataFrame([("up", 1.0), ("up", 2.0), ("same", 2.0), ("same", 2.0), ("flat", 0.0), ("flat", 0.0), ("one", -1.0)], "s string, r double")
    got = {x["s"]: (x["sharpe"], x["sortino"]) for x in trades.performance(r, ["s"], 4).collect()}
    assert got["up"][0] > 0 and got["up"][1] == float("inf") and got["same"] == (float("inf"), float("inf"))
    assert all(v != v for v in got["flat"]) and got["one"] == (None, -2.0)


@pytest.mark.parametrize("rule", ["range", "strict", "prev"])
def test_continuity_writes_the_rows_once(spark, monkeypatch, rule):
    """Rows are sorted by slice once; gaps that hang on ids carried from earlier slices are found all the same."""
    monkeypatch.setattr(book, "HOUR_NS", 10)
    written = []
    monkeypatch.setattr(book, "staged", lambda df, name: written.append(name) or staging.staged(df, name))
    monkeypatch.setattr(scan, "staged", lambda df, name: written.append(name) or staging.staged(df, name))
    step = 0 if rule == "prev" else 1
    ids, last = [], 0
    for n in range(60):
        snap, last = n in (0, 33), last + 1
        ids.append((1, n, n, "book_snapshot" if snap else "book_delta", last if snap else None, None if snap else last - 1 + step + (5 if n in (12, 47) else 0), None if snap else last))
    rows = spark.createDataFrame(ids, "k int, recv_ts_ns bigint, stream_seq bigint, kind string, seq bigint, first_seq bigint, last_seq bigint")
    got = [(r.epoch, r.action) for r in book.book_continuity(rows, rule, ("k",)).orderBy("stream_seq").collect()]
    want = lambda n: "Snapshot" if n in (0, 33) else "Gap" if n in (12, 47) else "Drop" if 12 < n < 33 or n > 47 else "Apply"
    assert got == [(1 if n < 33 else 2, want(n)) for n in range(60)]
    assert written == ["continuity", "starts"]


@pytest.mark.parametrize("rule", ["range", "strict", "prev"])
def test_continuity_over_many_slices_equals_the_fold(spark, monkeypatch, rule):
    monkeypatch.setattr(book, "HOUR_NS", 7)
    rows = hot_book(random.Random(rule), 1500)
    c = book.book_continuity(spark.createDataFrame(rows, BOOK).repartition(5), rule)
    assert [(x["epoch"], x["action"]) for x in c.orderBy("stream_seq").collect()] == plain_actions(rows, rule)


@pytest.mark.parametrize("venue, parse, most", [("binance_futures", normalize.binance, 1), ("bybit", normalize.bybit, 2)])
def test_topics_are_told_in_one_pass_over_the_frames(spark, venue, parse, most):
    raw = spark.createDataFrame([(venue, 1, 1, "{}")], "venue string, recv_ts_ns bigint, stream_seq bigint, payload string")
    plan = parse(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= most
    assert plan.count("from_json(MapType(StringType,StringType,true), payload") <= most


def test_trades_with_an_escaped_topic(spark):
    text = '{"topic":"public\\u0054rade.BTC","ts":1,"data":[{"T":1,"s":"BTC","S":"Buy","v":"1","p":"2","i":"x"}]}'
    raw = spark.createDataFrame([("bybit", 1, 1, text)], "venue string, recv_ts_ns bigint, stream_seq bigint, payload string")
    assert [(r.kind, r.price, r.venue_symbol) for r in normalize.normalize_frames(raw, "bybit").collect()] == [("trade", 2.0, "BTC")]


def test_orders_are_not_dealt_by_strategy_or_venue(spark):
    """A few kill switches taken from a large table: joined by what they are, not by what they were taken from."""
    f = spark.range(3_000_000).selectExpr("id AS symbol_id", "concat('s', id % 3) AS strategy", "concat('v', id % 2) AS venue")
    kills = f.selectExpr("'strategy' AS scope", "strategy AS target").where("target = 's1'").distinct()
    o = trades.allow_and_kill_flags(f, f.where("symbol_id = 5").select("venue", "symbol_id"), kills)
    plan = o._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [strategy" not in plan
    assert o.where("killed").count() == 1_000_000 and o.where("allowed").count() == 1


def _compliance_frames(spark, n=240, seed=4):
    """Orders, some without a time or a key, of times that tie and lie on the edges of days; and all that they are held against."""
    r, day = random.Random(seed), 86_400_000_000_000
    when = lambda: r.choice([None, *(d * day + s for d in (0, 1, 4) for s in (0, 5, day // 2, day - 1))])
    one = lambda: (r.choice("ab"), r.choice(["x", "y", None]), r.choice(["v", "w"]), r.choice([1, 2, None]), when())
    key = "portfolio string, strategy string, venue string, symbol_id long, ts_ns long, seq long"

    def frame(more, *alone):
        rows = [(*one(), i, r.choice([None, *(float(x) for x in range(1, 90))])) for i in range(n // 2)]
        kept = {tuple(row[k] for k in alone) or row: row for row in rows}  # one of a key and time, where no seq decides
        return spark.createDataFrame(list(kept.values()), f"{key}, {more} double")

    orders = spark.createDataFrame([(*one(), i, r.choice(["Buy", "Sell"]), 1.0, 2.0, True) for i in range(n)], f"{key}, side string, qty double, price double, mode_allows boolean")
    return orders, frame("position_qty"), frame("mark", 3, 4), frame("gross_exposure", 0, 4), frame("daily_pnl")


@pytest.mark.parametrize("many", [200_000, 20])
def test_compliance_inputs_against_plain_python(spark, monkeypatch, many):
    """What each order sees, by a search of all rows; with symbols of one task and with crowded ones."""
    monkeypatch.setattr(core, "MANY", many)
    frames = _compliance_frames(spark)
    orders, positions, marks, exposure, pnl = ([x.asDict() for x in f.collect()] for f in frames)
    day = 86_400_000_000_000

    def last(rows, o, by, value, strict, same_day=False):
        if o["ts_ns"] is None or any(o[k] is None for k in by):
            return None
        fit = [x for x in rows if x["ts_ns"] is not None and all(x[k] == o[k] for k in by) and (x["ts_ns"] < o["ts_ns"] if strict else x["ts_ns"] <= o["ts_ns"])]
        x = max(fit, key=lambda x: (x["ts_ns"], x["seq"]), default=None)
        return (x, x[value]) if x and not (same_day and x["ts_ns"] // day != o["ts_ns"] // day) else None

    def want(o):
        z = lambda found: 0.0 if found is None else found[1]
        f = lambda found: z(found) or 0.0  # noqa: E731  filled
        mates = [x for x in orders if o["ts_ns"] is not None and x["ts_ns"] is not None and x["strategy"] == o["strategy"] and (x["ts_ns"], x["seq"]) < (o["ts_ns"], o["seq"]) and x["ts_ns"] > o["ts_ns"] - 60]
        n = len(mates) if o["ts_ns"] is not None else None
        return n, f(last(positions, o, ["strategy", "venue", "symbol_id"], "position_qty", True)), f(last(marks, o, ["symbol_id"], "mark", False)), f(last(exposure, o, ["portfolio"], "gross_exposure", False)), z(last(pnl, o, ["strategy"], "daily_pnl", True, True)), z(last(pnl, o, ["portfolio"], "daily_pnl", True, True))

    o, *rest = frames
    allow = spark.createDataFrame([("v", 1)], "venue string, symbol_id long")
    kills = spark.createDataFrame([], "scope string, target string")
    held = spark.createDataFrame([("v", 1, 1.0)], "venue string, symbol_id long, qty double")
    out = trades.compliance_inputs(o, *rest, rest[-1], allow, kills, held, held, 1e-6, 60)
    got = {x["seq"]: (x["orders_last_min"] if x["ts_ns"] is not None else None, x["position_qty"], x["mark"], x["gross_exposure"], x["strategy_pnl"], x["portfolio_pnl"]) for x in out.collect()}
    assert out.count() == len(orders) and got == {x["seq"]: want(x) for x in orders}
    assert len({v for row in got.values() for v in row}) > 20


def test_compliance_inputs_do_not_repeat_what_stands_before(spark):
    """Each as-of join ran all before it once for its rows and once for its slices: some hundred exchanges in one plan."""
    o, *rest = _compliance_frames(spark, 20)
    few = o.select("venue", "symbol_id")
    held = few.withColumn("qty", F.lit(1.0))
    out = trades.compliance_inputs(o, *rest, rest[-1], few, spark.createDataFrame([], "scope string, target string"), held, held, 1e-6, 60)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("REPARTITION") <= 4
