"""Alerts of one key lie in many blocks and equal a plain fold."""

import random

import pytest

from tidemark.operators import monitor

SCHEMA = "id string, severity string, dedupe_window_ns long, dedupe_key string, ts_ns long"


def folded(rows):
    out, last = {}, {}
    for i, _, w, k, t in sorted((r for r in rows if r[4] is not None), key=lambda r: r[4]):
        out[i] = k not in last or t - last[k] >= (w or 0)
        if out[i]:
            last[k] = t
    return out | {r[0]: True for r in rows if r[4] is None}


@pytest.mark.parametrize("windows", [[300], [None, 0, 5, 40, 2000], list(range(100)), [10**7]])
def test_one_key_in_blocks(spark, windows):
    r = random.Random(len(windows))
    times = r.sample(range(20_000), 1100)
    rows = [(f"a{i}", "P2", r.choice(windows), "hot" if i < 900 else r.choice(["few", None, "x"]), t) for i, t in enumerate(times)]
    rows += [("n1", "P2", 5, "hot", None), ("n2", "P1", None, None, None)]
    got = monitor.since_sent(spark.createDataFrame(rows, SCHEMA).repartition(4), "dedupe_key", "ts_ns", "dedupe_window_ns", "kept", 16).collect()
    assert len(got) == len(rows) and {x["id"]: x["kept"] for x in got} == folded(rows)


def test_ties_and_empty(spark):
    rows = [("a", "P2", w, "k", t) for t in range(0, 60, 3) for w in (10, 10, 10)]
    for width in (4, 4096):
        got = monitor.since_sent(spark.createDataFrame(rows, SCHEMA), "dedupe_key", "ts_ns", "dedupe_window_ns", "kept", width).collect()
        assert sorted(x["ts_ns"] for x in got if x["kept"]) == list(range(0, 60, 12)) and len(got) == 60
    assert monitor.route_alerts(spark.createDataFrame([], SCHEMA), (1320, 360)).collect() == []
