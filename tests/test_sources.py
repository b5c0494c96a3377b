"""Readers, normalisers, sinks and streaming twins."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars, core, features, monitor, quality
from tidemark.operators.intervals import CoverageError
from tidemark.plans import features as plug
from tidemark.sources import adapters, normalize, reader, sinks
from tidemark.streaming import online

DAY = 86_400 * 10**9
RAW = "venue string, recv_ts_ns long, stream_seq long, payload string"


def norm(spark, venue, *frames):
    rows = [(venue, i, i, f if isinstance(f, str) else json.dumps(f)) for i, f in enumerate(frames)]
    return normalize.normalize_frames(spark.createDataFrame(rows, RAW), venue).orderBy("stream_seq", "kind").collect()


def kinds(rows):
    return [x["kind"] for x in rows]


def test_binance(spark):
    t = 1_717_171_717_171
    r = norm(
        spark, "binance_futures", {"e": "aggTrade", "E": t, "s": "QXR", "a": 9001, "p": "812.25", "q": "1.5", "T": t - 4, "m": False}, {"stream": "qxr@aggTrade", "data": {"e": "aggTrade", "E": t, "s": "QXR", "a": 9002, "p": 812, "q": 3, "m": True}},
        {"e": "markPriceUpdate", "E": t, "s": "QXR", "p": "811.5", "i": "811.75", "r": "-0.00025", "T": t + 60_000}, {"e": "forceOrder", "E": t, "o": {"s": "QXR", "S": "BUY", "q": "0.75", "p": "799"}}, {"e": "kline"}, "[not json",
    )
    assert kinds(r) == ["trade", "trade", "funding", "mark_price", "liquidation", "malformed"]
    assert (r[0]["side"], r[0]["price"], r[0]["trade_id"], r[0]["exch_ts_ns"]) == ("Buy", 812.25, 9001, (t - 4) * 10**6) and (r[1]["side"], r[1]["price"]) == ("Sell", 812.0)
    assert r[2]["rate"] == -0.00025 and r[2]["interval_s"] == 28_800 and r[3]["mark"] == 811.5 and r[3]["index"] == 811.75 and (r[4]["side"], r[4]["qty"]) == ("Buy", 0.75)


def test_binance_reseeds_after_a_gap(spark):
    up = lambda first, last: {"e": "depthUpdate", "E": 8, "s": "QXR", "U": first, "u": last, "b": [["800.5", "2"]], "a": [["801", "7"], ["802", "0"]]}
    r = norm(spark, "binance_futures", up(31, 40), up(41, 44), up(38, 42), up(50, 52), up(53, 60), up(61, 61))
    assert kinds(r) == ["book_snapshot", "book_delta", "status", "book_snapshot", "book_delta"]
    assert (r[0]["seq"], r[0]["reason"], r[3]["seq"], r[3]["reason"]) == (40, "Init", 60, "GapResync")
    assert (r[1]["first_seq"], r[1]["last_seq"]) == (41, 44) and [tuple(x) for x in r[1]["asks"]] == [(801.0, 7.0), (802.0, 0.0)]
    assert r[2]["status_kind"] == "GapDetected" and "50 to 52" in r[2]["detail"] and r[2]["bids"] is None


def test_bybit(spark):
    r = norm(
        spark, "bybit", {"topic": "publicTrade.WVN", "ts": 71, "data": [{"T": 68, "s": "WVN", "S": "Sell", "v": "14", "p": "0.625", "i": "c0ffee"}, {"T": 69, "s": "WVN", "S": "Buy", "v": "2", "p": "0.63", "i": "d1"}]},
        {"topic": "orderbook.200.WVN", "type": "delta", "ts": 72, "data": {"s": "WVN", "u": 5, "b": [["0.61", "many"]], "a": []}}, {"topic": "tickers.WVN", "ts": 73, "data": {"symbol": "WVN", "fundingRate": "0.00375", "markPrice": "0.6275", "openInterest": "88123"}},
        {"topic": "allLiquidation.WVN", "ts": 74, "data": [{"s": "WVN", "S": "Buy", "v": "350", "p": "0.59"}]}, {"topic": "liquidation.WVN", "ts": 75, "data": {"symbol": "WVN", "side": "Sell", "size": "61", "price": "0.655"}},
    )
    assert kinds(r) == ["trade", "trade", "malformed", "funding", "mark_price", "open_interest", "liquidation", "liquidation"]
    assert r[0]["exch_ts_ns"] in (68_000_000, 69_000_000) and r[5]["oi_contracts"] == 88123.0 and (r[6]["side"], r[7]["side"]) == ("Buy", "Sell")


def test_bybit_gap_and_resync(spark):
    frame = lambda kind, u: {"topic": "orderbook.200.WVN", "type": kind, "ts": 80 + u, "data": {"s": "WVN", "u": u, "b": [["0.61", "40"], ["0.6", "9"]], "a": [["0.64", "3"]]}}
    r = norm(spark, "bybit", frame("delta", 6), frame("snapshot", 17), frame("delta", 18), frame("delta", 21), frame("delta", 22), frame("snapshot", 30), frame("delta", 31), frame("snapshot", 44))
    assert kinds(r) == ["book_snapshot", "book_delta", "status", "book_snapshot", "book_delta", "book_snapshot"]
    assert [x["reason"] for x in r if x["kind"] == "book_snapshot"] == ["Init", "GapResync", "GapResync"]
    assert (r[0]["seq"], r[0]["depth"], r[1]["last_seq"], r[2]["status_kind"]) == (17, 3, 18, "GapDetected")


def test_okx_gap_and_resync(spark):
    book = lambda action, prev, seq: {"arg": {"channel": "books", "instId": "ZUR-SWAP"}, "action": action, "data": [{"bids": [["33.5", "6", "0", "1"]], "asks": [], "seqId": seq, "prevSeqId": prev, "ts": "5150"}]}
    r = norm(spark, "okx", book("snapshot", -1, 700), book("update", 700, 707), book("update", 711, 719), book("update", 719, 720), book("snapshot", -1, 733), book("update", 733, 735))
    assert kinds(r) == ["book_snapshot", "book_delta", "status", "book_snapshot", "book_delta"]
    assert (r[1]["first_seq"], r[1]["last_seq"]) == (707, 707) and [r[0]["reason"], r[3]["reason"]] == ["Init", "GapResync"]
    r = norm(
        spark, "okx", {"arg": {"channel": "trades", "instId": "ZUR-SWAP"}, "data": [{"instId": "ZUR-SWAP", "tradeId": "88", "px": "33.25", "sz": "12", "side": "buy", "ts": "5151"}]},
        {"arg": {"channel": "liquidation-orders"}, "data": [{"instId": "ZUR-SWAP", "details": [{"bkPx": "30.5", "sz": "4", "side": "buy"}, {"bkPx": "31", "sz": "8"}]}]}, {"event": "error"},
    )
    assert kinds(r) == ["trade", "liquidation", "liquidation"] and r[0]["side"] == "Buy" and sorted(x["side"] for x in r[1:]) == ["Buy", "Sell"]


def test_kraken_gap_and_resync(spark):
    snap = lambda seq: {"feed": "book_snapshot", "product_id": "PF_TRN", "seq": seq, "time": 12, "bids": [{"price": 1450.5, "qty": 3}], "asks": []}
    step = lambda seq, side="sell": {"feed": "book", "product_id": "PF_TRN", "side": side, "seq": seq, "price": 1462, "qty": 8}
    r = norm(spark, "kraken_futures", snap(205), step(206), step(206, "buy"), step(209), step(210), snap(240), step(241, "buy"), {"feed": "ticker", "product_id": "PF_TRN", "markPrice": 1455.5, "funding_rate": -0.02, "openInterest": 640})
    assert kinds(r) == ["book_snapshot", "book_delta", "status", "book_snapshot", "book_delta", "funding", "mark_price", "open_interest"]
    assert tuple(r[1]["asks"][0]) == (1462.0, 8.0) and r[1]["bids"] == [] and r[3]["reason"] == "GapResync" and tuple(r[4]["bids"][0]) == (1462.0, 8.0)


def test_coinbase_and_hyperliquid(spark):
    r = norm(spark, "coinbase", {"channel": "market_trades", "events": [{"trades": [{"trade_id": "31337", "product_id": "OBL-USD", "price": "17.75", "size": "60", "side": "BUY"}]}]}, {"channel": "l2_data", "events": [{"type": "snapshot", "product_id": "OBL-USD", "updates": [{"side": "bid", "price_level": "17.5", "new_quantity": "11"}, {"side": "offer", "price_level": "18", "new_quantity": "29"}]}]})
    assert kinds(r) == ["trade", "book_snapshot"] and r[0]["exch_ts_ns"] == 0 and tuple(r[1]["asks"][0]) == (18.0, 29.0)
    r = norm(spark, "hyperliquid", {"channel": "trades", "data": [{"coin": "VEX", "side": "B", "px": "2.875", "sz": "19", "time": 901, "tid": 5577}]}, {"channel": "l2Book", "data": {"coin": "VEX", "time": 902, "levels": [[{"px": "2.85", "sz": "7"}], [{"px": "2.9", "sz": "13"}]]}}, {"channel": "activeAssetCtx", "data": {"coin": "VEX", "ctx": {"markPx": "2.88", "oraclePx": "2.87", "funding": "-0.0004", "openInterest": "7300"}}})
    assert kinds(r) == ["trade", "book_snapshot", "funding", "mark_price", "open_interest"] and r[0]["side"] == "Buy" and r[2]["interval_s"] == 3600 and tuple(r[1]["bids"][0]) == (2.85, 7.0)


def test_parse_health_and_sequence_gaps(spark):
    frame = lambda kind, u: json.dumps({"topic": "orderbook.200.WVN", "type": kind, "ts": u, "data": {"s": "WVN", "u": u, "b": [["0.61", "40"]], "a": []}})
    raw = [frame("snapshot", 3), frame("delta", 4), "{", frame("delta", 9), frame("snapshot", 20), frame("delta", 27)]
    n = normalize.normalize_frames(spark.createDataFrame([("bybit", 10 * i, i, f) for i, f in enumerate(raw)], RAW), "bybit")
    h = normalize.parse_health(n).first()
    assert (h["emitted"], h["dropped"], h["gaps"], h["resyncs"]) == (5, 1, 2, 1)
    gaps = quality.sequence_gaps(n, 1000, ("venue", "venue_symbol")).orderBy("from_ns").collect()
    assert [(g["from_ns"], g["to_ns"], g["gap_kind"]) for g in gaps] == [(30, 40, "Venue"), (50, 1000, "Venue")]


TRADE = "venue string, symbol_id long, exch_ts_ns long, recv_ts_ns long, stream_seq long, kind string, price double, qty double, side string, trade_id long, status_kind string, detail string"


def trade_rows(spark, n=6):
    return spark.createDataFrame([("okx", 1, 0, i * DAY // 4, i, "trade", 10.0 + i, 1.0, "Buy" if i % 2 else "Sell", i, None, None) for i in range(n)], TRADE)


def test_compact_read_and_prune(spark, tmp_path):
    root, e = str(tmp_path / "store"), trade_rows(spark)
    assert reader.read_stream(spark, root, "trade").count() == 0
    assert sinks.compact(e, root, "h1") == {"trades": 2} and sinks.compact(e, root, "h1") == {}
    day = reader.read_stream(spark, root, "trade", "okx", 1, ["1970-01-01"])
    assert day.count() == 4 and "PartitionFilters: [isnotnull(venue" in day._jdf.queryExecution().toString()
    assert sinks.read_metadata(spark.read.parquet(f"{root}/trades"))["source_log_hash"] == "h1"
    m = reader.read_manifests(spark, root)
    assert m.count() == 2 and quality.coverage(m, date="1970-01-01").first()["coverage"] == 1.0
    assert quality.verify_prunable(m.where("date = '1970-01-01'"), day).count() == 0
    assert quality.verify_prunable(m.where("date = '1970-01-01'"), day.limit(3)).first()["problem"] == "RowCountMismatch"
    df, gaps = reader.read_gated(spark, root, "okx", 1, "1970-01-01", "refuse")
    assert df.count() == 4 and gaps.count() == 0
    with pytest.raises(CoverageError):
        reader.read_gated(spark, root, "okx", 1, "1999-01-01", "refuse")


def test_feature_store_versions(spark, tmp_path):
    root = str(tmp_path / "fs")
    f = spark.createDataFrame([(1, 3, 5, 1.0, "okx")], "symbol_id long, venue_code int, ts_ns long, value double, venue string")
    assert [sinks.materialize(f, root, "cvd", p) for p in ({"a": 1, "b": 2}, {"b": 2, "a": 1}, {"a": 2})] == [0, 0, 1]
    assert reader.read_features(spark, root, "cvd", 1).first()["value"] == 1.0


def test_journal_scd_and_symbols(spark, tmp_path):
    j = spark.createDataFrame([("w1", 1.0)], "week string, x double")
    assert sinks.append_once(j, str(tmp_path / "j"), ["week"]) and not sinks.append_once(j, str(tmp_path / "j"), ["week"])
    dim = spark.createDataFrame([("okx", "B", 0.1, 0, None)], "venue string, venue_symbol string, tick double, valid_from_ns long, valid_to_ns long")
    new = spark.createDataFrame([("okx", "B", 0.5, 10, None)], dim.schema)
    assert [r["valid_to_ns"] for r in sinks.scd2_append(dim, new).orderBy("valid_from_ns").collect()] == [10, None]
    e = spark.createDataFrame([("okx", "Z", 1, 1), ("okx", "A", 2, 2), ("okx", "Z", 3, 3)], "venue string, venue_symbol string, recv_ts_ns long, stream_seq long")
    known = sinks.intern_symbols(e)
    more = sinks.intern_symbols(e.union(spark.createDataFrame([("okx", "0", 0, 0)], e.schema)), known)
    assert {r["venue_symbol"]: r["symbol_id"] for r in more.collect()} == {"Z": 0, "A": 1, "0": 2}


def stream(spark, df, tmp_path, name):
    df.write.parquet(str(tmp_path / name))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / name))


def drain(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}_ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streaming_bars_equal_batch(spark, tmp_path):
    t = trade_rows(spark, 30).drop("status_kind", "detail")
    got = drain(online.bars(stream(spark, t, tmp_path, "t"), "1 day", "0 seconds"), "bars_out", tmp_path)
    want = {r["open_ts_ns"]: (r["open"], r["close"], r["volume"]) for r in bars.time_bars(t, DAY).collect()}
    assert {r["open_ts_ns"]: (r["open"], r["close"], r["volume"]) for r in got.collect()} == want


def test_streaming_features_equal_batch(spark, tmp_path):
    t = trade_rows(spark, 12).drop("status_kind", "detail")
    got = drain(online.running_cvd(stream(spark, t, tmp_path, "c")), "cvd_out", tmp_path)
    assert {r["stream_seq"]: r["value"] for r in got.collect()} == {r["stream_seq"]: r["value"] for r in features.cvd(t).collect()}


def test_streaming_features_of_all_kinds_equal_batch(spark, tmp_path):
    e = adapters.market_events(spark, "/root/testdata/sf0.001")
    kind = lambda k: e.where(F.col("kind") == k)
    out = online.features(stream(spark, e, tmp_path, "all"), DAY, 900.0, 600.0, DAY, 3, 4)
    got = {(r["feature"], r["venue"], r["symbol_id"], r["recv_ts_ns"]): r["value"] for r in drain(out, "all_out", tmp_path).collect()}
    daily = bars.time_bars(kind("trade"), DAY)
    batch = {
        "cvd": features.cvd(kind("trade")), "whale_print": core.whale_prints(kind("trade"), 600), "oi_delta": features.oi_delta(kind("open_interest")), "liq_cluster": features.liq_cluster(kind("liquidation"), DAY, 900.0),
        "realized_vol": features.realized_vol(daily, 3).withColumn("recv_ts_ns", F.col("emit_ts_ns")), "donchian": features.donchian(daily, 4).withColumn("recv_ts_ns", F.col("emit_ts_ns")),
    }
    want = {(n, r["venue"], r["symbol_id"], r["recv_ts_ns"]): float(r["value"]) for n, df in batch.items() for r in df.collect()}
    assert {k[0] for k in want} == set(batch) and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want)


def test_streaming_alerts_equal_batch(spark, tmp_path):
    hour = 3_600 * 10**9
    rows = [(f"a{i}", ("P1", "P2", "P3")[i % 3], 30 * hour, None if i % 4 else f"k{i % 3}", i * 2 * hour + i) for i in range(40)]
    a = spark.createDataFrame(rows, "id string, severity string, dedupe_window_ns long, dedupe_key string, ts_ns long")
    quiet = (22 * 60, 6 * 60)
    got = drain(online.route_alerts(stream(spark, a, tmp_path, "al"), quiet), "alerts_out", tmp_path)
    key = lambda df: sorted((r["id"], r["severity"], r["ts_ns"], r["outcome"], r["channel"]) for r in df.collect())
    assert key(got) == key(monitor.route_alerts(a, quiet)) and {r["outcome"] for r in got.collect()} == {"Sent", "Batched", "Deduped"}


def test_streaming_deadman(spark, tmp_path):
    b = spark.createDataFrame([("gw", 5, False), ("gw", 9, True), ("ui", 7, False)], "proc string, ts_ns long, critical boolean")
    q = online.deadman(stream(spark, b, tmp_path, "beats"), 300, 3, True).writeStream.format("memory").queryName("dead_out").outputMode("append").option("checkpointLocation", str(tmp_path / "dead_ck")).trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(120):
            if spark.table("dead_out").count() >= 2:
                break
            time.sleep(0.5)
        assert {(r["proc"], r["last_ns"], r["severity"], r["dedupe_key"]) for r in spark.table("dead_out").collect()} == {("gw", 9, "P1", "deadman:gw"), ("ui", 7, "P2", "deadman:ui")}
    finally:
        q.stop()


def test_streaming_screen(spark, tmp_path):
    rows = [("cvd", 1, t, t, v, 0) for t, v in ((1, 3.0), (2, 7.0), (3, 8.0), (4, 1.0), (5, 9.0))]
    f = spark.createDataFrame(rows, "feature string, symbol_id long, emit_ts_ns long, emit_seq long, value double, reg_idx int")
    got = drain(online.screen(stream(spark, f, tmp_path, "f"), {"r": [("cvd", "Ge", 5.0)]}), "screen_out", tmp_path)
    assert sorted((r["ts_ns"], r["snapshot"]["cvd"]) for r in got.collect()) == [(2, 7.0), (5, 9.0)]


def test_streaming_book_mirror(spark, tmp_path):
    rows = [("okx", 1, 1, 1, "book_snapshot", 100, None, None, [(100.0, 6.0)], [(101.0, 2.0)]), ("okx", 1, 2, 2, "book_delta", None, 101, 101, [], [(101.0, 0.0), (103.0, 1.0)]), ("okx", 1, 3, 3, "book_delta", None, 105, 105, [], [])]
    b = spark.createDataFrame(rows, "venue string, symbol_id long, recv_ts_ns long, stream_seq long, kind string, seq long, first_seq long, last_seq long, bids array<struct<price:double,qty:double>>, asks array<struct<price:double,qty:double>>")
    got = drain(online.book_mirror(stream(spark, b, tmp_path, "b")), "book_out", tmp_path)
    assert sorted((r["stream_seq"], r["best_bid"], r["best_ask"]) for r in got.collect()) == [(1, 100.0, 101.0), (2, 100.0, 103.0)]


def test_feature_plugins(spark):
    plug.register_feature("double", 1, 0, "Offline", lambda df: df.withColumn("value", F.col("qty") * 2))
    assert plug.apply_feature("double", trade_rows(spark, 1)).first()["value"] == 2.0
    with pytest.raises(ValueError):
        plug.register_feature("double", 1, 0, "Online", lambda df: df)


def test_first_divergence(spark):
    a = spark.createDataFrame([(i, i) for i in range(50)], "k long, v long")
    b = spark.createDataFrame([(i, -1 if i == 33 else i) for i in range(50)], "k long, v long")
    assert core.first_divergence(a, b, ["k"], ["k", "v"]).first()["idx"] == 33 and core.first_divergence(a, a, ["k"], ["k", "v"]).count() == 0
    assert core.first_divergence(a, a.where("k < 40"), ["k"], ["k", "v"]).first()["idx"] == 40
