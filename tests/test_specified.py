"""Specified features and formulas, on numbers worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars, book, features, fills, trades

DAY = 86_400 * 10**9


def test_correlation_penalty_counts_what_exceeds_the_threshold_in_sixty_days(spark):
    a = [1.0, 2.0, 4.0, 1.0]
    series = {"a": a, "b": [2 * x for x in a], "c": [-x for x in a], "d": [3.0, 1.0, 0.0, 5.0]}
    rows = [(s, day, r) for s, rs in series.items() for day, r in enumerate(rs)] + [("a", 100, 1.0), ("b", 100, 9.0), ("alone", 3, 1.0)]
    got = {(x["strategy"], x["day"]): x["penalty"] for x in trades.correlation_penalty(spark.createDataFrame(rows, "strategy string, day long, r double")).collect()}
    # On day 3 a and b correlate fully; c and d move against them and with each other.
    ma, md = sum(a) / 4, sum(series["d"]) / 4
    cd = sum((-x + ma) * (y - md) for x, y in zip(a, series["d"])) / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - md) ** 2 for y in series["d"]))
    assert cd > 0.5 and got["a", 3] == pytest.approx(0.5) and got["b", 3] == pytest.approx(0.5) and got["c", 3] == pytest.approx(1 / (1 + cd)) == pytest.approx(got["d", 3])
    assert got["a", 0] == 1.0 and got["alone", 3] == 1.0  # nothing to correlate with
    assert got["a", 100] == 1.0  # the days before are over sixty days old
    assert len(got) == len(rows)


BARS = "venue string, symbol_id long, open_ts_ns long, open double, high double, low double, close double, volume double, close_ts_ns long, last_ts_ns long"


def days(closes, highs=None, lows=None):
    return [("v", 1, i * DAY, c, (highs or closes)[i], (lows or closes)[i], c, 1.0, (i + 1) * DAY, i * DAY + 5) for i, c in enumerate(closes)]


def test_range_distances_in_vol_units(spark):
    rows = days([10.0, 20.0, 40.0, 30.0], highs=[12.0, 22.0, 44.0, 31.0], lows=[9.0, 18.0, 35.0, 29.0])
    got = {x["open_ts_ns"] // DAY: (x["dist_pdh"], x["dist_pdl"]) for x in features.previous_day_range(spark.createDataFrame(rows, BARS), 2).collect()}
    assert got[0] == got[1] == (None, None)  # not two returns yet
    unit = 40 * math.sqrt(2 * math.log(2) ** 2)
    assert got[2] == pytest.approx(((22 - 40) / unit, (40 - 18) / unit))  # above the high: negative
    unit = 30 * math.sqrt(math.log(2) ** 2 + math.log(0.75) ** 2)
    assert got[3] == pytest.approx(((44 - 30) / unit, (30 - 35) / unit))  # below the low: negative


def test_vwap_deviation_in_vol_units(spark):
    rows = days([10.0, 20.0, 40.0])
    ticks = [("v", 1, 2 * DAY, 1, "Buy", 10.0, 3.0), ("v", 1, 2 * DAY + 5, 2, "Buy", 40.0, 1.0), ("v", 1, 2 * DAY + 9, 3, "Buy", 90.0, 9.0)]
    t = spark.createDataFrame(ticks, "venue string, symbol_id long, recv_ts_ns long, stream_seq long, side string, price double, qty double")
    got = {x["open_ts_ns"] // DAY: x["value"] for x in features.vwap_deviation(spark.createDataFrame(rows, BARS), t, 2).collect()}
    assert got[2] == pytest.approx((40 - 17.5) / (40 * math.sqrt(2) * math.log(2))) and got[0] is None


def test_profile_nodes_do_not_look_ahead(spark):
    ticks = [("v", 1, d * DAY, d, "Buy", p, q) for d, p, q in ((0, 10.5, 1.0), (0, 12.5, 9.0), (0, 14.5, 1.0), (1, 30.5, 1.0), (1, 32.5, 50.0), (1, 34.5, 1.0))]
    t = spark.createDataFrame(ticks, "venue string, symbol_id long, recv_ts_ns long, stream_seq long, side string, price double, qty double")
    nodes = {(x["day"], x["bin"]) for x in bars.rolling_profile(t, 1.0, 1).where("node = 'hvn'").collect()}
    assert nodes == {(1, 12), (2, 32)}  # a day's profile is that of the day before alone
    both = {(x["day"], x["bin"]) for x in bars.rolling_profile(t, 1.0, 2).where("node = 'hvn'").collect()}
    assert both == {(1, 12), (2, 12), (2, 32), (3, 32)}
    rows = days([10.0, 20.0, 40.0])
    got = {x["open_ts_ns"] // DAY: x["dist_hvn"] for x in bars.node_distance(spark.createDataFrame(rows, BARS), t, 1.0, 2, 1).collect()}
    assert got[1] == pytest.approx(7.5 / (20 * math.log(2))) and got[2] == pytest.approx(7.5 / (40 * math.log(2)))


LEVEL = "venue string, symbol_id long, epoch long, side string, price double, qty double, from_ns long, from_place long, to_ns long, to_place long, changed boolean"


def test_walls_survive_changes_of_size(spark):
    rows = [
        ("v", 1, 1, "bid", 100.0, 5.0, 10, 1, 20, 2, True), ("v", 1, 1, "bid", 100.0, 7.0, 20, 2, 50, 5, True),  # one wall, then taken away
        ("v", 1, 1, "ask", 101.0, 5.0, 10, 1, 30, 3, True), ("v", 1, 1, "ask", 101.0, 1.0, 30, 3, 60, 6, True),  # shrinks below the size
        ("v", 1, 1, "bid", 99.0, 9.0, 10, 1, 70, 7, False),  # stands when the epoch ends
        ("v", 1, 1, "bid", 50.0, 99.0, 10, 1, 20, 2, True),  # far from the mid
    ]
    mids = spark.createDataFrame([("v", 1, 5, 100.5)], "venue string, symbol_id long, recv_ts_ns long, mid double")
    got = sorted((x["side"], x["price"], x["from_ns"], x["to_ns"], x["value"]) for x in book.wall_persistence(spark.createDataFrame(rows, LEVEL), mids, 200.0, 400.0).collect())
    assert got == [("ask", 101.0, 10, 30, 2e-8), ("bid", 100.0, 10, 50, 4e-8)]


def test_basis_and_divergence(spark):
    schema = "symbol_id long, recv_ts_ns long, stream_seq long, {} double"
    marks = spark.createDataFrame([(1, 0, 1, 100.0), (1, 3 * 10**9, 2, 110.0)], schema.format("mark"))
    index = spark.createDataFrame([(1, 10**9, 1, 50.0)], schema.format("index_price"))
    assert {x["ts_ns"] // 10**9: x["value"] for x in features.basis(marks, index).collect()} == {1: 1.0, 3: 1.2}
    a, b = (spark.createDataFrame([(1, 0, 1, m), (1, 1, 2, None)], schema.format("mid")) for m in (99.0, 100.0))
    assert [x["value"] for x in features.price_divergence(a, b).collect()] == [-0.01]


def test_depth_walk_falls_back_to_the_last_price(spark):
    o = spark.createDataFrame([(1, "Buy", 5.0, 100.0), (2, "Sell", 5.0, 100.0), (3, "Buy", 5.0, None), (4, "Buy", 5.0, 100.0)], "order_id long, side string, qty double, last double")
    lv = spark.createDataFrame([(4, 90.0, 2.0)], "order_id long, price double, qty double")
    got = {x["order_id"]: (x["avg_px"], x["filled_qty"], x["unfilled_qty"]) for x in fills.depth_walk(o, lv, slip=0.01).collect()}
    assert got == {1: (101.0, 5.0, 0.0), 2: (99.0, 5.0, 0.0), 3: (None, 0.0, 5.0), 4: (90.0, 2.0, 3.0)}
    assert fills.depth_walk(o.drop("last"), lv).where(F.col("filled_qty") > 0).count() == 1
