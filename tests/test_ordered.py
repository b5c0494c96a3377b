"""Streams released in total order: batch's results under shuffled arrival, and after a restart."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalar import DAY_NS
from tidemark.operators import bars, book, core, features, monitor
from tidemark.sources import adapters, normalize
from tidemark.streaming import ordered

SECOND = 10**9
LEVELS = "array<struct<price:double,qty:double>>"
BOOK = f"venue string, symbol_id long, exch_ts_ns long, recv_ts_ns long, stream_seq long, kind string, seq long, first_seq long, last_seq long, bids {LEVELS}, asks {LEVELS}"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def arrive(spark, rows, schema, at, folder, seed, apart=5 * SECOND):
    """Files of ``rows`` in an order that displaces each by less than ``apart``; gives (write, stream)."""
    r = random.Random(seed)
    mixed = sorted(rows, key=lambda x: x[at] + r.random() * apart)
    cuts = [mixed[: len(mixed) // 2], mixed[len(mixed) // 2 :]]
    write = lambda i: spark.createDataFrame(cuts[i], schema).coalesce(1).write.mode("append").parquet(str(folder))
    write(0)
    return write, lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(make, name, tmp_path, write):
    """Two runs of one query with one checkpoint, a file more before the second: its rows."""
    out = str(tmp_path / f"{name}_out")
    for i in range(2):
        if i:
            write(i)
        df = make()
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}_ck")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    return df.sparkSession.read.parquet(out).collect()


def book_rows(seed, n=240, last_key=2):
    r, rows = random.Random(seed), []
    for s in range(last_key):
        last = 2**53 + 1  # ids that doubles can't hold
        for i in range(n):
            t, px = (i + 1) * SECOND + s, lambda: float(r.randint(90, 110))
            side = lambda: [(px(), float(r.choice([0, 1, 2, 5]))) for _ in range(r.randint(0, 3))]
            if i % 60 == 7:
                last += 5
                rows.append(("okx", s, None, t, i, "book_snapshot", last, None, None, [(99.0, 1.0)], [(101.0, 2.0)]))
                continue
            first = last + (9 if r.random() < 0.03 else 1 if r.random() < 0.9 else 0)
            end = first + r.randint(0, 2)
            rows.append(("okx", s, None if i % 2 else t + 1, t, i, "book_delta", None, first, end, side(), side()))
            last = max(last, end)
    return rows


END = 10_000 * SECOND  # a last row far ahead lets the watermark pass all others


@pytest.mark.parametrize("rule", ["reseed"])
def test_continuity_of_a_shuffled_stream_equals_batch(spark, tmp_path, rule):
    rows = [r for r in book_rows(3) if rule != "reseed" or r[5] == "book_delta"]
    write, stream = arrive(spark, [*rows, ("okx", 9, None, END, 0, "book_delta", None, 1, 1, [], [])], BOOK, 3, tmp_path / "in", 5)
    got = run(lambda: ordered.book_continuity(stream(), rule, delay="8 seconds"), rule, tmp_path, write)
    want = book.book_continuity(spark.createDataFrame(rows, BOOK), rule).collect()
    order = lambda x: sorted(map(repr, x))
    assert order((r["symbol_id"], r["stream_seq"], r["exch_ts_ns"], r["seq"], r["first_seq"], r["last_seq"], r["bids"], r["epoch"], r["action"]) for r in got if r["symbol_id"] != 9) == order((r["symbol_id"], r["stream_seq"], r["exch_ts_ns"], r["seq"], r["first_seq"], r["last_seq"], r["bids"], r["epoch"], r["action"]) for r in want)
    assert {r["action"] for r in got} >= {"Gap", "Apply", "Snapshot"}


def test_gap_and_resync_events_of_a_stream_equal_batch(spark, tmp_path):
    schema = BOOK.replace("symbol_id long", "venue_symbol string") + ", status_kind string, detail string, reason string, depth long"
    rows = [("bybit", f"S{r[1]}", *r[2:], None, None, None, None) for r in book_rows(4)]
    trade = ("bybit", "S0", None, END, 1, "trade", *[None] * 9)
    end = ("bybit", "S9", None, END, 0, "book_delta", None, 1, 1, [], [], None, None, None, None)
    write, stream = arrive(spark, [*rows, trade, end], schema, 3, tmp_path / "in", 9)
    got = run(lambda: normalize.synchronised(stream(), "bybit", "8 seconds"), "sync", tmp_path, write)
    want = normalize.synchronised(spark.createDataFrame([*rows, trade], schema), "bybit").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and {r["status_kind"] for r in got} == {None, "GapDetected"} and {r["reason"] for r in got} == {None, "Init", "GapResync"}


def test_tops_of_a_shuffled_stream_equal_batch(spark, tmp_path):
    rows = book_rows(8)
    write, stream = arrive(spark, [*rows, ("okx", 9, None, END, 0, "book_delta", None, 1, 1, [], [])], BOOK, 3, tmp_path / "in", 6)
    got = run(lambda: ordered.top_of_book(stream(), delay="8 seconds"), "tops", tmp_path, write)
    want = book.top_of_book(book.book_continuity(spark.createDataFrame(rows, BOOK))).collect()
    key = lambda x: sorted(repr((r["symbol_id"], r["stream_seq"], r["epoch"], r["best_bid"], r["bid_qty"], r["best_ask"], r["ask_qty"])) for r in x)
    assert key(got) == key(want) and len(want) > 100


def test_alerts_of_a_shuffled_stream_equal_batch(spark, tmp_path):
    schema = "id string, severity string, dedupe_window_ns long, dedupe_key string, ts_ns long"
    rows = [(f"a{i:03}", ("P1", "P2", "P3")[i % 3], (3 + i % 5) * SECOND, None if i % 4 == 3 else f"k{i % 3}", (i + 1) * SECOND + i) for i in range(120)]
    write, stream = arrive(spark, [*rows, ("end", "P1", 0, "end", END)], schema, 4, tmp_path / "in", 7)
    got = run(lambda: ordered.route_alerts(stream(), 7 * SECOND, (0, 1), delay="8 seconds"), "alerts", tmp_path, write)
    want = monitor.route_alerts(spark.createDataFrame(rows, schema), (0, 1)).collect()
    key = lambda x: sorted((r["id"], r["ts_ns"], r["outcome"], r["channel"]) for r in x if r["id"] != "end")
    assert key(got) == key(want) and {r["outcome"] for r in want} == {"Sent", "Deduped", "Batched"}


def test_features_of_a_shuffled_stream_equal_batch(spark, tmp_path):
    e = adapters.market_events(spark, "/root/testdata/sf0.001").select("venue", "symbol_id", "recv_ts_ns", "stream_seq", "kind", "side", "price", "qty", "oi_contracts")
    e = e.withColumns({c: F.col(c).cast("double") for c in ("price", "qty", "oi_contracts")})
    rows = [tuple(r) for r in e.collect()]
    end = (*rows[0][:2], max(r[2] for r in rows) + 40 * DAY_NS, 0, "none", None, None, None, None)
    write, stream = arrive(spark, [*rows, end], e.schema, 2, tmp_path / "in", 8, apart=DAY_NS)
    got = run(lambda: ordered.features(stream(), DAY_NS, 900.0, 600.0, DAY_NS, 3, 4, delay="3 days"), "features", tmp_path, write)
    kind = lambda k: e.where(F.col("kind") == k)
    daily = bars.time_bars(kind("trade"), DAY_NS)
    batch = {
        "cvd": features.cvd(kind("trade")), "whale_print": core.whale_prints(kind("trade"), 600), "oi_delta": features.oi_delta(kind("open_interest")), "liq_cluster": features.liq_cluster(kind("liquidation"), DAY_NS, 900.0),
        "realized_vol": features.realized_vol(daily, 3).withColumn("recv_ts_ns", F.col("emit_ts_ns")), "donchian": features.donchian(daily, 4).withColumn("recv_ts_ns", F.col("emit_ts_ns")),
    }
    want = {(n, r["venue"], r["symbol_id"], r["recv_ts_ns"]): float(r["value"]) for n, df in batch.items() for r in df.collect()}
    have = {(r["feature"], r["venue"], r["symbol_id"], r["recv_ts_ns"]): r["value"] for r in got if r["feature"] in batch}
    assert have.keys() == want.keys() and all(have[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want)
