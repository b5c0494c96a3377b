"""Streaming operators: windowed bars, and keyed state for what depends on order.

Event time is ``ts`` (TIMESTAMP, from ``recv_ts_ns``); late rows beyond the
watermark are dropped. The stateful operators fold rows in total order within a
micro-batch, with the same folds as the batch side, so with rows arriving in
order both give the same results.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.scalar import DAY_NS
from tidemark.operators.core import KEYS
from tidemark.operators.monitor import CHANNELS, Deduper
from tidemark.operators.screener import Condition
from tidemark.operators.trades import Position


def with_time(df: DataFrame, delay: str = "10 seconds") -> DataFrame:
    return df.withColumn("ts", F.timestamp_micros((F.col("recv_ts_ns") / 1000).cast("long"))).withWatermark("ts", delay)


def bars(trades: DataFrame, tf: str, delay: str = "10 seconds", keys: Sequence[str] = KEYS) -> DataFrame:
    """Tumbling bars in append mode; a bar is emitted when the watermark passes its end."""
    at, buy = F.struct("recv_ts_ns", "stream_seq"), F.col("side") == "Buy"
    g = with_time(trades, delay).groupBy(F.window("ts", tf), *keys).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("qty").alias("volume"),
        F.sum(F.when(buy, F.col("qty")).otherwise(0)).alias("buy_volume"), F.count("*").alias("n"))
    return g.select(*keys, (F.unix_micros("window.start") * 1000).alias("open_ts_ns"), (F.unix_micros("window.end") * 1000).alias("close_ts_ns"), "open", "high", "low", "close", "volume", "buy_volume", "n")


def dedupe_book(book: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Drop repeats of a book id that arrive within the watermark."""
    return with_time(book, delay).dropDuplicatesWithinWatermark([*KEYS, "kind", "last_seq"])


def keyed_fold(df: DataFrame, keys: Sequence[str], start: Callable[[], Any], step: Callable[[Any, dict], list[tuple]], freeze: Callable[[Any], str], thaw: Callable[[str], Any], schema: str, order: Sequence[str] = ("recv_ts_ns", "stream_seq")) -> DataFrame:
    """Rows that ``step`` makes of each input row in order, with state kept per key between micro-batches (as text)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = thaw(state.get[0]) if state.exists else start()
        pdf = pd.concat(list(batches)).sort_values(list(order), kind="stable")
        out = [(*key, *row) for r in pdf.to_dict("records") for row in step(s, r)]
        state.update((freeze(s),))
        names = [c.split()[0] for c in full.split(", ")]
        yield pd.DataFrame(out, columns=names)

    types = dict(df.dtypes)
    full = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + schema
    return df.groupBy(*keys).applyInPandasWithState(run, full, "s string", "append", GroupStateTimeout.NoTimeout)


def _json():
    import json

    return json.dumps, json.loads


def running_cvd(trades: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    def step(s: dict, r: dict) -> list[tuple]:
        s["v"] += r["qty"] if r["side"] == "Buy" else -r["qty"]
        return [(r["recv_ts_ns"], r["stream_seq"], s["v"])]

    freeze, thaw = _json()
    t = trades.withColumn("qty", F.col("qty").cast("double"))
    return keyed_fold(t, keys, lambda: {"v": 0.0}, step, freeze, thaw, "recv_ts_ns long, stream_seq long, value double")


def running_oi_delta(oi: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    def step(s: dict, r: dict) -> list[tuple]:
        before, s["x"] = s["x"], r["oi_contracts"]
        return [] if before is None else [(r["recv_ts_ns"], r["stream_seq"], r["oi_contracts"] - before)]

    freeze, thaw = _json()
    return keyed_fold(oi.withColumn("oi_contracts", F.col("oi_contracts").cast("double")), keys, lambda: {"x": None}, step, freeze, thaw, "recv_ts_ns long, stream_seq long, value double")


class Online:
    """Every feature of one key, event by event: what the batch features give for the same rows."""

    def __init__(self, window_ns: int, min_notional: float, whale: float, tf_ns: int, vol_bars: int, range_bars: int, state: dict | None = None):
        self.set = {"window_ns": window_ns, "min_notional": min_notional, "whale": whale, "tf_ns": tf_ns, "vol_bars": vol_bars, "range_bars": range_bars}
        self.s = state or {"cvd": 0.0, "oi": None, "liqs": [], "bar": None, "close": None, "returns": [], "ranges": []}

    def event(self, kind: str, ts: int, side: str | None, price: float | None, qty: float | None, oi: float | None, rate: float | None) -> list[tuple[str, float]]:
        s, sign = self.s, 1.0 if side == "Buy" else -1.0
        if kind == "open_interest":
            before, s["oi"] = s["oi"], oi
            return [] if before is None else [("oi_delta", oi - before)]
        if kind == "funding":
            return [("funding", rate)]
        if kind == "liquidation":
            s["liqs"] = [(t, v) for t, v in s["liqs"] if t >= ts - self.set["window_ns"]] + [(ts, sign * price * qty)]
            total = sum(v for _, v in s["liqs"])
            return [("liq_cluster", total)] if abs(total) >= self.set["min_notional"] else []
        if kind != "trade":
            return []
        out = self.bar(ts - ts % self.set["tf_ns"], price)
        s["cvd"] += sign * qty
        out.append(("cvd", s["cvd"]))
        if price * qty >= self.set["whale"]:
            out.append(("whale_print", sign * price * qty))
        return out

    def bar(self, start: int, price: float) -> list[tuple[str, float]]:
        """Take a trade's price into the running bar; features of the bar that it closes."""
        s, old = self.s, self.s["bar"]
        if old and old[0] == start:
            s["bar"] = [start, max(old[1], price), min(old[2], price), price]
            return []
        s["bar"] = [start, price, price, price]
        if not old:
            return []
        _, high, low, close = old
        out = []
        if s["close"] is not None and s["close"] > 0 and close > 0:
            s["returns"] = [*s["returns"], math.log(close / s["close"])][-self.set["vol_bars"] :]
        s["close"] = close
        if len(s["returns"]) == self.set["vol_bars"]:
            out.append(("realized_vol", math.sqrt(sum(r * r for r in s["returns"]))))
        n, before = self.set["range_bars"], s["ranges"]
        if len(before) >= n - 1:
            full = len(before) == n
            out.append(("donchian", 1.0 if full and close > max(h for h, _ in before) else -1.0 if full and close < min(x for _, x in before) else 0.0))
        s["ranges"] = [*before, (high, low)][-n:]
        return out


def features(events: DataFrame, window_ns: int, min_notional: float, whale: float, tf_ns: int, vol_bars: int, range_bars: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, recv_ts_ns, stream_seq, feature, value) of a stream of all kinds of events, in one fold."""
    names = ("side", "price", "qty", "oi_contracts", "rate")
    values = {n: F.col(n).cast("string" if n == "side" else "double") if n in events.columns else F.lit(None).cast("string" if n == "side" else "double") for n in names}
    e = events.withColumns(values)
    of = lambda r, n: None if r[n] is None or r[n] != r[n] else r[n]

    def step(o: Online, r: dict) -> list[tuple]:
        found = o.event(r["kind"], int(r["recv_ts_ns"]), *(of(r, n) for n in names))
        return [(r["recv_ts_ns"], r["stream_seq"], name, v) for name, v in found if v is not None and math.isfinite(v)]

    start = lambda state=None: Online(window_ns, min_notional, whale, tf_ns, vol_bars, range_bars, state)
    freeze, thaw = _json()
    return keyed_fold(e, keys, start, step, lambda o: freeze(o.s), lambda t: start(thaw(t)), "recv_ts_ns long, stream_seq long, feature string, value double")


def top_imbalance(book: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Imbalance of the best sizes after each applied book event, where both sides are known."""
    t = book_mirror(book, keys).where("bid_qty is not null and ask_qty is not null")
    return t.select(*keys, "recv_ts_ns", "stream_seq", ((F.col("bid_qty") - F.col("ask_qty")) / (F.col("bid_qty") + F.col("ask_qty"))).alias("value"))


def screen(features: DataFrame, rules: dict[str, Sequence[Condition]], keys: Sequence[str] = ("symbol_id",)) -> DataFrame:
    """Edge-triggered hits over a stream of (keys, feature, value, emit_ts_ns, emit_seq, reg_idx)."""
    test = {"Gt": lambda a, b: a > b, "Ge": lambda a, b: a >= b, "Lt": lambda a, b: a < b, "Le": lambda a, b: a <= b}

    def step(s: dict, r: dict) -> list[tuple]:
        s["last"][r["feature"]] = r["value"]
        out = []
        for name, conds in rules.items():
            now = all(f in s["last"] and test[op](s["last"][f], x) for f, op, x in conds)
            if now and not s["on"].get(name):
                out.append((name, r["emit_ts_ns"], dict(s["last"])))
            s["on"][name] = now
        return out

    freeze, thaw = _json()
    return keyed_fold(features, keys, lambda: {"last": {}, "on": {}}, step, freeze, thaw, "rule_id string, ts_ns long, snapshot map<string,double>", ("emit_ts_ns", "emit_seq", "reg_idx"))


def book_mirror(book: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Top of book after each applied event; silent from a gap to the next snapshot."""

    def step(s: dict, r: dict) -> list[tuple]:
        if r["kind"] == "book_snapshot":
            s.update(last=int(r["seq"]), live=True, bids={}, asks={})
        elif not s["live"] or r["last_seq"] <= s["last"]:
            return []
        elif r["first_seq"] > s["last"] + 1:
            s["live"] = False
            return []
        else:
            s["last"] = int(r["last_seq"])
        for side in ("bids", "asks"):
            for level in r[side] if r[side] is not None else ():
                price, qty = repr(float(level["price"])), float(level["qty"])
                if qty > 0:
                    s[side][price] = qty
                else:
                    s[side].pop(price, None)
        bid, ask = max(map(float, s["bids"]), default=None), min(map(float, s["asks"]), default=None)
        return [(r["recv_ts_ns"], r["stream_seq"], bid, None if bid is None else s["bids"][repr(bid)], ask, None if ask is None else s["asks"][repr(ask)])]

    freeze, thaw = _json()
    return keyed_fold(book, keys, lambda: {"last": 0, "live": False, "bids": {}, "asks": {}}, step, freeze, thaw, "recv_ts_ns long, stream_seq long, best_bid double, bid_qty double, best_ask double, ask_qty double")


def ledger(fills: DataFrame, keys: Sequence[str]) -> DataFrame:
    def step(p: Position, r: dict) -> list[tuple]:
        gross, fees, closed = p.fill(r["qty"] if r["side"] == "Buy" else -r["qty"], r["price"], r["fee"])
        return [(r["ts_ns"], r["seq"], p.qty, p.avg, gross, fees)]

    def thaw(text: str) -> Position:
        p = Position()
        p.__dict__.update(_json()[1](text))
        return p

    return keyed_fold(fills, keys, Position, step, lambda p: _json()[0](p.__dict__), thaw, "ts_ns long, seq long, qty double, avg double, realized double, attributed_fees double", ("ts_ns", "seq"))


def route_alerts(alerts: DataFrame, quiet: tuple[int, int] | None = None) -> DataFrame:
    """``outcome`` (Deduped, Batched in quiet hours, or Sent) and ``channel`` of each alert, as in batch."""

    def step(d: Deduper, r: dict) -> list[tuple]:
        now = int(r["ts_ns"])
        outcome = "Sent" if d.send(now, int(r["dedupe_window_ns"])) else "Deduped"
        if outcome == "Sent" and quiet and r["severity"] == "P3":
            minute = now % DAY_NS // 60_000_000_000
            a, b = quiet
            if a <= minute < b if a <= b else minute >= a or minute < b:
                outcome = "Batched"
        return [(r["id"], r["severity"], now, outcome, CHANNELS.get(r["severity"]))]

    keyed = alerts.withColumn("dedupe_key", F.coalesce("dedupe_key", "id"))
    return keyed_fold(keyed, ("dedupe_key",), Deduper, step, lambda d: _json()[0](d.last), lambda t: Deduper(_json()[1](t)), "id string, severity string, ts_ns long, outcome string, channel string", ("ts_ns",))


def silent_streams(events: DataFrame, limits_ms: dict[str, int], default_ms: int, key: str = "topic", ts: str = "recv_ts_ns", extra: str | None = None) -> DataFrame:
    """(key, last_ns, limit_ms and the last value of the column ``extra``) of keys from which nothing came for
    their limit of processing time; a limit of zero or less never complains."""
    name, types = extra or "_extra", dict(events.dtypes)
    e = events if extra else events.withColumn(name, F.lit(None).cast("boolean"))
    kind = types.get(name, "boolean")

    def run(of: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        limit = limits_ms.get(str(of[0]), default_ms)
        if state.hasTimedOut:
            last, value = state.get
            state.remove()
            yield pd.DataFrame({key: [of[0]], "last_ns": [last], "limit_ms": [limit], name: [value]})
            return
        last, value = state.get if state.exists else (None, None)
        for b in batches:
            if len(b) and (last is None or b[ts].max() >= last):
                row = b.loc[b[ts].idxmax()]
                last, value = int(row[ts]), None if pd.isna(row[name]) else row[name]
        state.update((last, value))
        if limit > 0:
            state.setTimeoutDuration(limit)

    found = e.groupBy(key).applyInPandasWithState(run, f"{key} {types[key]}, last_ns long, limit_ms long, {name} {kind}", f"last long, value {kind}", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return found if extra else found.drop(name)


def deadman(beats: DataFrame, interval_ms: int, misses: int, live: bool) -> DataFrame:
    """Processes (proc, ts_ns, critical) silent for more than ``misses`` intervals: severity and dedupe key as in batch."""
    silent = silent_streams(beats, {}, interval_ms * misses, "proc", "ts_ns", "critical")
    severity = F.when(F.coalesce("critical", F.lit(False)) & F.lit(live), "P1").otherwise("P2")
    return silent.select("proc", "last_ns", severity.alias("severity"), F.concat(F.lit("deadman:"), F.col("proc").cast("string")).alias("dedupe_key"))


def append_to(df: DataFrame, path: str, keys: Sequence[str], checkpoint: str, start: bool = True):
    """Write a stream to a journal once per key, whatever is replayed."""
    from tidemark.sources.sinks import append_once

    writer = df.writeStream.foreachBatch(lambda b, _: append_once(b.dropDuplicates(list(keys)), path, list(keys))).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if start else writer
