"""Places, as-of joins and running totals on many rows, hot keys and null keys or times."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, core, study, trades
from tidemark.sources import sinks

N = 2_000_000


@pytest.fixture(params=["true", "false"])
def adaptive(spark, request):
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    yield request.param
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def mixed(spark, n, mod=None):
    """``v`` is a permutation of 0..n-1 (or has ``mod`` different values) in no order."""
    d = spark.range(n).withColumn("v", F.col("id") * 1_299_709 % n)
    return d.withColumn("v", F.col("v") % mod) if mod else d


@pytest.mark.parametrize("wide", [False, True])
def test_positions_are_dense(spark, adaptive, wide):
    d = mixed(spark, N)
    d = d.withColumns({"x": F.col("v") * 2, "y": F.lit("pad")}) if wide else d.select("v")
    p = core.positions(d, ["v"])
    assert p.where("idx <> v").count() == 0
    assert p.agg(F.count_distinct("idx"), F.min("idx"), F.max("idx")).first()[:] == (N, 0, N - 1)


def test_positions_of_a_tied_order(spark):
    p = core.positions(mixed(spark, 600_000, 3), ["v"])
    assert p.agg(F.count_distinct("idx"), F.max("idx")).first()[:] == (600_000, 599_999)
    assert [tuple(r) for r in p.groupBy("v").agg(F.min("idx"), F.max("idx")).orderBy("v").collect()] == [(k, k * 200_000, k * 200_000 + 199_999) for k in range(3)]


def test_first_divergence_far_in(spark, adaptive):
    a = mixed(spark, N).select("v", F.lit(0).alias("x"))
    b = a.withColumn("x", F.when(F.col("v").isin(951_888, 1_500_000), 1).otherwise(0))
    assert [r["idx"] for r in core.first_divergence(a, b, ["v"], ["v", "x"]).collect()] == [951_888]
    assert core.first_divergence(a, a, ["v"], ["v", "x"]).collect() == []
    shorter = a.where("v < 1900000")
    assert core.first_divergence(a, shorter, ["v"], ["v", "x"]).first()["idx"] == 1_900_000


def test_rank_pick_of_many_values(spark, adaptive):
    d = mixed(spark, N).withColumn("k", F.when(F.col("v") % 10 < 7, "hot").otherwise(F.lit(None)))
    got = {r["k"]: r["v"] for r in core.rank_pick(d, "v", F.floor(F.col("_n") / 2).cast("long"), ["k"]).collect()}
    assert got == {"hot": 1_000_000, None: 1_000_007}


def test_symbols_are_interned_densely(spark):
    e = mixed(spark, 400_000).select(F.lit("okx").alias("venue"), F.col("v").cast("string").alias("venue_symbol"), F.col("v").alias("recv_ts_ns"), F.lit(0).alias("stream_seq"))
    s = sinks.intern_symbols(e)
    assert s.where("venue_symbol <> cast(symbol_id as string)").count() == 0 and s.count() == 400_000


def test_bootstrap_uses_every_value_once(spark):
    d = mixed(spark, 300_000).withColumn("x", F.lit(1.0))
    r = study.bootstrap_ci(d, "x", ["v"], n_boot=2).first()
    assert (r["lo"], r["hi"], r["n"]) == (1.0, 1.0, 300_000)


LEFT = "k string, t long, id int"


def test_asof_keeps_rows_without_key_or_time(spark):
    left = spark.createDataFrame([("a", 5, 1), (None, 5, 2), ("a", None, 3), ("b", 5, 4), (None, None, 5)], LEFT)
    right = spark.createDataFrame([("a", 4, 1.0), (None, 4, 2.0), ("a", None, 3.0), ("a", 10**15, 4.0)], "k string, t long, v double")
    back = {r["id"]: r["v"] for r in asof.asof_backward(left, right, ["k"], "t", ["v"]).collect()}
    assert back == {1: 1.0, 2: None, 3: None, 4: None, 5: None}
    ahead = {r["id"]: r["v"] for r in asof.asof(left, right, ["k"], "t", "t", ["v"], forward=True).collect()}
    assert ahead == {1: 4.0, 2: None, 3: None, 4: None, 5: None}


def test_running_keeps_rows_without_key_or_time(spark):
    d = spark.createDataFrame([("a", 1, 0, 1.0), ("a", 2 * 10**14, 1, 2.0), ("a", None, 2, 4.0), (None, 3, 3, 8.0), (None, 4 * 10**14, 4, 16.0)], "k string, t long, s long, v double")
    got = {r["s"]: r["x"] for r in core.running(d, F.col("v"), ("k",), "x", ts="t", seq=("s",)).collect()}
    assert got == {2: 4.0, 0: 5.0, 1: 7.0, 3: 8.0, 4: 24.0}


def test_orders_without_symbol_are_sized_zero(spark):
    o = spark.createDataFrame([(1, "x", 10, 1000.0, 1.0, 1.0, 1.0, 0.1, 0.0), (2, None, 10, 1000.0, 1.0, 1.0, 1.0, 0.1, 0.0)], "id long, symbol string, ts_ns long, equity double, weight double, risk_units double, k_stop double, step_size double, min_notional double")
    vol = spark.createDataFrame([("x", 1, 0.1)], "symbol string, ts_ns long, vol double")
    marks = spark.createDataFrame([("x", 1, 10.0)], "symbol string, ts_ns long, mark double")
    got = {r["id"]: r["qty"] for r in trades.size_orders(o, vol, marks, ["symbol"], 0.01).collect()}
    assert got[2] == 0.0 and got[1] == pytest.approx(10.0) and len(got) == 2


def test_forward_returns_on_a_busy_symbol(spark):
    r = random.Random(2)
    day = 86_400 * 10**9
    px = sorted((r.randrange(40 * day), r.randint(1, 9) * 1.0) for _ in range(4000))
    hits = [(i, "s", r.randrange(-day, 41 * day)) for i in range(300)] + [(900, None, 5), (901, "s", None)]
    got = {x["id"]: x["fwd"] for x in asof.forward_returns(spark.createDataFrame(hits, "id long, symbol string, ts_ns long"), spark.createDataFrame([("s", t, p) for t, p in px], "symbol string, ts_ns long, price double"), 3 * day).collect()}

    def at(t):
        return next((p for s, p in reversed(px) if s <= t), None)

    want = {i: None if s is None or t is None or at(t) is None or px[-1][0] < t + 3 * day else at(t + 3 * day) / at(t) - 1 for i, s, t in hits}
    assert got.keys() == want.keys() and all(got[i] == (None if w is None else pytest.approx(w)) for i, w in want.items())
