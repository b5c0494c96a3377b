"""Streams in total order, whatever order they arrive in: typed state, released by event-time timers.

Rows wait in a list of their key until the watermark has passed them; from then on rows of that
time count as late and are dropped, so what is released is in the batch side's order and the
results are the batch side's. Between releases a key holds the rows of the watermark's delay and
the operator's own state: a map entry per price level, not one text that each batch rewrites.

State lives in RocksDB: set ``spark.sql.streaming.stateStore.providerClass`` to ``ROCKSDB`` below.
Rows without a time can't be placed and are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from tidemark.functions.scalar import in_quiet_hours
from tidemark.operators.book import Side
from tidemark.operators.core import KEYS
from tidemark.operators.monitor import channel_of
from tidemark.streaming.online import Online

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND_NS = 1_000_000_000


def plain(v):
    """``v`` with tuples for rows at any depth: what typed state takes."""
    if isinstance(v, list):
        return [plain(x) for x in v]
    return tuple(plain(x) for x in v) if isinstance(v, tuple) else v


class InOrder(StatefulProcessor):
    """Gives a key's rows to ``apply`` in order of (``ts``, ``seq``, arrival) once the watermark has passed them."""

    out: list[str]  # names of the columns given, keys first

    def __init__(self, held: StructType, ts: str, seq: Sequence[str]):
        self.held, self.names = held, held.fieldNames()
        self.ts, self.order = self.names.index(ts), [self.names.index(c) for c in (ts, *seq)]

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.held)
        self.open(handle)

    def open(self, handle) -> None:
        """Make the state variables of the operator."""

    def apply(self, key: tuple, rows: list[Row]) -> Iterator[tuple]:
        raise NotImplementedError

    def passed(self, upto_ns: int) -> None:
        """The watermark has reached ``upto_ns``; state that no later row can need may go."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [plain(tuple(r[n] for n in self.names)) for r in rows]
        self.waiting.appendList(new)
        for second in {-(-r[self.ts] // SECOND_NS) for r in new}:  # a timer a second, not one a row
            self.handle.registerTimer(second * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000  # microseconds, as event time counts
        due, later = [], []
        for r in self.waiting.get():
            (due if r[self.ts] // 1000 <= upto else later).append(plain(r))
        if due:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
            due.sort(key=lambda r: [(r[i] is not None, r[i]) if r[i] is not None else (False,) for i in self.order])
            for out in self.apply(key, [Row(*self.names)(*r) for r in due]):
                yield Row(**dict(zip(self.out, (*key, *out))))
        self.passed(upto * 1000)

    def close(self) -> None:
        pass


def in_order(df: DataFrame, keys: Sequence[str], make: Callable[[StructType], InOrder], schema: str, ts: str = "recv_ts_ns", delay: str = "10 seconds") -> DataFrame:
    """``keys`` and the columns of ``schema`` that the processor ``make`` builds gives for the rows of each key."""
    timed = df.where(F.col(ts).isNotNull()).withColumn("_at", F.timestamp_micros(F.expr(f"{ts} div 1000"))).withWatermark("_at", delay)
    held = StructType([f for f in df.schema.fields if f.name not in keys])
    types = dict(df.dtypes)
    full = StructType.fromDDL(", ".join(f"{k} {types[k]}" for k in keys) + ", " + schema)
    work = make(held)
    work.out = full.fieldNames()
    return timed.groupBy(*keys).transformWithState(work, full, "append", "EventTime")


def follow(rule: str, snapshot: bool, first: int | None, end: int | None, known: int | None, epoch: int, broken: bool) -> tuple[str, int | None, int, bool]:
    """The action for one book event, then what is known, the epoch and whether the book is broken: the rules of ``book_continuity``."""
    if rule == "reseed":
        if broken or epoch == 0:
            return "Snapshot", end, epoch + 1, False
        if first > known + 1:
            return "Gap", None, epoch, True
        return ("Drop", known, epoch, False) if end <= known else ("Apply", end, epoch, False)
    if snapshot:
        return "Snapshot", end, epoch + 1, False
    if epoch == 0 or broken:
        return "Drop", known, epoch, broken
    if first is not None and known is not None:
        if {"range": first > known + 1, "strict": first != known + 1, "prev": first != known}[rule]:
            return "Gap", known, epoch, True
    if rule == "range" and end is not None and known is not None and end <= known:
        return "Drop", known, epoch, False
    return "Apply", known if end is None else end, epoch, False


class Continuity(InOrder):
    """Every book event with its epoch and action."""

    def __init__(self, held: StructType, rule: str):
        super().__init__(held, "recv_ts_ns", ["stream_seq"])
        self.rule = rule

    def open(self, handle) -> None:
        self.known = handle.getValueState("known", "known long, epoch long, broken boolean")

    def actions(self, rows: list[Row]) -> Iterator[tuple[Row, int, str]]:
        known, epoch, broken = self.known.get() if self.known.exists() else (None, 0, False)
        for r in rows:
            snapshot = r["kind"] == "book_snapshot"
            end = r["seq"] if snapshot and self.rule != "reseed" else r["last_seq"]
            action, known, epoch, broken = follow(self.rule, snapshot, r["first_seq"], end, known, epoch, broken)
            yield r, epoch, action
        self.known.update((known, epoch, broken))

    def apply(self, key: tuple, rows: list[Row]) -> Iterator[tuple]:
        for r, epoch, action in self.actions(rows):
            yield (*r, epoch, action)


class Tops(Continuity):
    """Best prices and sizes after each applied event; a map entry of state for each price level."""

    def open(self, handle) -> None:
        super().open(handle)
        self.levels = handle.getMapState("levels", "side int, price double", "qty double")

    def apply(self, key: tuple, rows: list[Row]) -> Iterator[tuple]:
        sides = (Side(-1), Side(1))
        for (n, price), (qty,) in self.levels.iterator():
            sides[n].put(price, qty)
        before = [dict(s.at) for s in sides]
        for r, epoch, action in self.actions(rows):
            if action == "Snapshot":
                sides = (Side(-1), Side(1))
            if action not in ("Snapshot", "Apply"):
                continue
            for side, name in zip(sides, ("bids", "asks")):
                for price, qty in r[name] or ():
                    side.put(float(price), float(qty))
            bid, ask = (s.best() for s in sides)
            yield r["recv_ts_ns"], r["stream_seq"], epoch, action, bid, sides[0].at.get(bid), ask, sides[1].at.get(ask)
        for n, (side, old) in enumerate(zip(sides, before)):
            for price, qty in side.at.items():
                if old.get(price) != qty:
                    self.levels.updateValue((n, price), (qty,))
            for price in old.keys() - side.at.keys():
                self.levels.removeKey((n, price))


def book_continuity(book: DataFrame, rule: str = "range", keys: Sequence[str] = KEYS, delay: str = "10 seconds") -> DataFrame:
    """Every book event of a stream with ``epoch`` and ``action``, as the batch operator of this name gives them."""
    out = ", ".join(f"`{c}` {t}" for c, t in book.dtypes if c not in keys) + ", epoch long, action string"
    return in_order(book, keys, lambda held: Continuity(held, rule), out, delay=delay).select(*book.columns, "epoch", "action")


def top_of_book(book: DataFrame, rule: str = "range", keys: Sequence[str] = KEYS, delay: str = "10 seconds") -> DataFrame:
    """Best prices and sizes after each applied event of a stream; nothing while a book is broken."""
    out = "recv_ts_ns long, stream_seq long, epoch long, action string, best_bid double, bid_qty double, best_ask double, ask_qty double"
    return in_order(book, keys, lambda held: Tops(held, rule), out, delay=delay)


class Alerts(InOrder):
    """Whether each alert is sent; the time of the last one is forgotten once no window can reach back to it."""

    def __init__(self, held: StructType, longest_ns: int):
        super().__init__(held, "ts_ns", ["id"])
        self.longest = longest_ns

    def open(self, handle) -> None:
        self.last = handle.getValueState("last", "ts_ns long")

    def apply(self, key: tuple, rows: list[Row]) -> Iterator[tuple]:
        last = self.last.get()[0] if self.last.exists() else None
        for r in rows:
            if r["dedupe_window_ns"] > self.longest:
                raise ValueError(f"an alert's window of {r['dedupe_window_ns']} ns is longer than the longest one named, {self.longest}")
            sent = last is None or r["ts_ns"] - last >= r["dedupe_window_ns"]
            last = r["ts_ns"] if sent else last
            yield r["id"], r["severity"], r["ts_ns"], sent
        self.last.update((last,))
        self.handle.registerTimer(-(-(last + self.longest) // SECOND_NS) * 1000)

    def passed(self, upto_ns: int) -> None:
        if self.last.exists() and self.last.get()[0] + self.longest <= upto_ns:
            self.last.clear()


def route_alerts(alerts: DataFrame, longest_ns: int, quiet: tuple[int, int] | None = None, delay: str = "10 seconds") -> DataFrame:
    """``outcome`` and ``channel`` of each alert as in batch. No window may be longer than ``longest_ns``."""
    a = alerts.select(F.coalesce("dedupe_key", "id").alias("dedupe_key"), "id", "severity", "ts_ns", "dedupe_window_ns")
    kept = in_order(a, ["dedupe_key"], lambda held: Alerts(held, longest_ns), "id string, severity string, ts_ns long, sent boolean", "ts_ns", delay)
    calm = in_quiet_hours("ts_ns", *quiet) if quiet else F.lit(False)
    outcome: Column = F.when(~F.col("sent"), "Deduped").when((F.col("severity") == "P3") & calm, "Batched").otherwise("Sent")
    return kept.withColumns({"outcome": outcome, "channel": channel_of("severity")}).drop("sent")


class Features(InOrder):
    """Every feature of a key, with the running values as typed columns of state."""

    STATE = "cvd double, oi double, liqs array<struct<t:long,v:double>>, bar struct<start:long,high:double,low:double,close:double>, close double, returns array<double>, ranges array<struct<high:double,low:double>>"

    def __init__(self, held: StructType, settings: tuple):
        super().__init__(held, "recv_ts_ns", ["stream_seq"])
        self.settings = settings

    def open(self, handle) -> None:
        self.running = handle.getValueState("running", self.STATE)

    def apply(self, key: tuple, rows: list[Row]) -> Iterator[tuple]:
        names = ("cvd", "oi", "liqs", "bar", "close", "returns", "ranges")
        o = Online(*self.settings, dict(zip(names, self.running.get())) if self.running.exists() else None)
        for r in rows:
            for name, v in o.event(r["kind"], r["recv_ts_ns"], *(r[n] for n in ("side", "price", "qty", "oi_contracts", "rate"))):
                if v is not None and math.isfinite(v):
                    yield r["recv_ts_ns"], r["stream_seq"], name, float(v)
        self.running.update(plain(tuple(tuple(o.s[n]) if n == "bar" and o.s[n] else o.s[n] for n in names)))


def features(events: DataFrame, window_ns: int, min_notional: float, whale: float, tf_ns: int, vol_bars: int, range_bars: int, keys: Sequence[str] = KEYS, delay: str = "10 seconds") -> DataFrame:
    """(keys, recv_ts_ns, stream_seq, feature, value) of a stream of all kinds of events."""
    kinds = {"side": "string", "price": "double", "qty": "double", "oi_contracts": "double", "rate": "double"}
    values = [(F.col(n) if n in events.columns else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()]
    e = events.select(*keys, "recv_ts_ns", "stream_seq", "kind", *values)
    settings = (window_ns, min_notional, whale, tf_ns, vol_bars, range_bars)
    return in_order(e, keys, lambda held: Features(held, settings), "recv_ts_ns long, stream_seq long, feature string, value double", delay=delay)
