"""Rolling order statistics, windowed lead-lag and bootstraps by splitting against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import core, features, rolling, study


def test_ranks_within_ranges():
    g = np.random.default_rng(1)
    for n, top in ((1, 1), (2, 5), (257, 9), (1000, 10**6)):
        v = g.integers(0, top, n) / 7
        lo = g.integers(0, n, 400)
        hi = lo + 1 + g.integers(0, n - lo)
        k = g.integers(0, hi - lo)
        assert rolling.ranked_in(v, lo, hi, k).tolist() == [sorted(v[a:b])[i] for a, b, i in zip(lo, hi, k)]


def test_quantiles_of_one_key(spark):
    r = random.Random(2)
    rows = [("a" if i % 9 else None, r.choice([None, *range(0, 3000, 7)]), i, r.choice([None, *range(20)])) for i in range(2500)]
    d = spark.createDataFrame(rows, "k string, t long, i long, x int").repartition(5)
    got = {x["i"]: x for x in rolling.quantiles(d, ["k"], F.col("x"), {"p": 0.95, "m": 0.5}, "t", 200, least=1).collect()}
    assert set(got) == {i for _, t, i, _ in rows if t is not None}
    for k, t, i, _ in rows:
        if t is not None:
            past = [x for k2, t2, _, x in rows if k2 == k and x is not None and t2 is not None and t - 200 <= t2 < t]
            for name, q in (("p", 0.95), ("m", 0.5)):
                assert got[i][name] == (pytest.approx(np.percentile(past, 100 * q), rel=1e-12) if past else None)
    last = [x for x in rolling.quantiles_of_last(d.where("k = 'a'"), ["k"], F.col("x"), {"m": 0.5}, "i", 30, least=1).orderBy("i").collect()]
    for at, x in enumerate(last):
        past = [y["x"] for y in last[max(0, at - 30) : at] if y["x"] is not None]
        assert x["m"] == (np.median(past) if past else None)
    assert rolling.quantiles(d.limit(0), ["k"], F.col("x"), {"p": 0.5}, "t", 200).columns == ["k", "t", "i", "x", "p"]


def test_correlations_are_direct_sums():
    g = np.random.default_rng(3)
    x, y = g.normal(size=300), g.normal(size=300)
    y[4:] += 2 * x[:-4]
    c = rolling.correlations(x, y, 9)
    for lag in range(-9, 10):
        a, b = (x[: 300 - lag], y[lag:]) if lag >= 0 else (x[-lag:], y[:lag])
        assert c[lag + 9] == pytest.approx(np.corrcoef(a, b)[0, 1], rel=1e-9)
    assert np.isnan(rolling.correlations(np.zeros(50), y[:50], 3)).all()


def test_lead_of_one_venue_on_seconds(spark):
    """Prices of b repeat those of a two seconds later; seconds without a price have no return."""
    r, second, price, a, b = random.Random(4), 10**9, 100.0, [], []
    for s in range(900):
        if r.random() < 0.4:
            price *= math.exp(r.gauss(0, 0.01))
            a.append((7, s * second + 5, s, price))
            b.append((7, (s + 2) * second + 9, s, price))
    schema = "symbol_id long, recv_ts_ns long, stream_seq long, price double"
    frames = [rolling.grid_returns(spark.createDataFrame(x + [(7, 3, 0, None), (None, 4, 0, 2.0)], schema), ["symbol_id"], "price", second, slice_ns=50 * second) for x in (a, b)]
    for x, f in zip((a, b), frames):
        want = {row[1] // second * second: math.log(row[3] / before[3]) for before, row in zip(x, x[1:])}
        assert {v["ts_ns"]: v["r"] for v in f.collect()} == pytest.approx(want, rel=1e-9)
    got = rolling.lead_lag(*frames, 300 * second, 5).orderBy("ts_ns").collect()
    assert [(x["symbol_id"], x["ts_ns"], x["lag"]) for x in got] == [(7, (i + 1) * 300 * second, 2) for i in range(3)]
    assert all(x["corr"] > 0.99 for x in got)
    with pytest.raises(ValueError):
        rolling.lead_lag(*frames, 5 * second, 5)


def test_draws_of_blocks_are_multinomial():
    n, width, reps = 1000, 64, 4000
    k = np.stack([study.block_draws(5, n, width, b, reps) for b in range(16)])
    assert (k.sum(0) == n).all() and (k >= 0).all()
    p = np.array([64.0] * 15 + [40.0]) / n
    assert k.mean(1) == pytest.approx(n * p, rel=0.02)
    assert k.var(1) == pytest.approx(n * p * (1 - p), rel=0.1)
    assert np.cov(k)[0, 9] == pytest.approx(-n * p[0] * p[9], abs=1.0)


def test_interval_by_splitting_covers():
    """Of 200 samples, about 95 in 100 intervals hold the true mean."""
    g, held = np.random.default_rng(6), 0
    for seed in range(200):
        x = g.exponential(size=200)
        means = sum(study.block_sums(x[b * 64 : b * 64 + 64], seed, 200, 64, b, 200) for b in range(4)) / 200
        lo, hi = np.sort(means)[[5, 195]]
        held += lo <= 1.0 <= hi
    assert 175 <= held <= 199


def test_bootstrap_by_splitting(spark):
    g = np.random.default_rng(7)
    x = g.normal(3, 2, 5000)
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(9999, None)], "i long, v double")
    one, two = (study.bootstrap_by_splitting(d.repartition(k), "v", ["i"], n_boot=300, width=512).first() for k in (3, 7))
    assert one == two and one["n"] == 5000
    se = x.std() / math.sqrt(5000)
    assert one["lo"] == pytest.approx(x.mean() - 1.96 * se, abs=0.4 * se) and one["hi"] == pytest.approx(x.mean() + 1.96 * se, abs=0.4 * se)
    plain = np.sort(sum(study.block_sums(x[b * 512 : b * 512 + 512], 7, 5000, 512, b, 300) for b in range(10)) / 5000)
    assert (one["lo"], one["hi"]) == pytest.approx((plain[7], plain[292]), rel=1e-12)
    assert tuple(study.bootstrap_by_splitting(d.where("v is null"), "v", ["i"]).first()) == (0.0, 0.0, 0)


def test_zscores_and_steps_of_one_key(spark):
    r = random.Random(8)
    rows = [("v", 1, r.randrange(10**6) * 10**9, i, r.choice([None, *range(50)])) for i in range(9000)]
    d = spark.createDataFrame(rows, "venue string, symbol_id long, recv_ts_ns long, stream_seq long, oi_contracts int").repartition(4)
    rows.sort(key=lambda x: (x[2], x[3]))
    got = {x["stream_seq"]: x["value"] for x in features.zscore(d.withColumnRenamed("oi_contracts", "x"), "x", 20).collect()}
    delta = {x["stream_seq"]: x["value"] for x in features.oi_delta(d).collect()}
    left = {x["stream_seq"] for x in core.warm(d, 700, "venue", "symbol_id", ts="recv_ts_ns", seq="stream_seq").collect()}
    assert len(got) == 9000 and left == {x[3] for x in rows[700:]}
    for i, x in enumerate(rows):
        past = [y[4] for y in rows[max(0, i - 19) : i + 1]]
        if len(past) < 20 or None in past:
            assert got[x[3]] is None
        else:
            sd = np.std(past, ddof=1)
            assert got[x[3]] == (pytest.approx((x[4] - np.mean(past)) / sd, rel=1e-9, abs=1e-9) if sd else None)
        pair = (x[4], rows[i - 1][4] if i else None)
        assert delta.get(x[3]) == (None if None in pair else pair[0] - pair[1])
    assert [tuple(x) for x in core.first_by_key(d, ["venue"], "recv_ts_ns", "stream_seq").collect()] == [rows[0]]
