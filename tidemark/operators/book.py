"""Order books: continuity of deltas, levels, top of book.

Book events carry kind, seq (snapshots), first_seq, last_seq (deltas) and level
arrays. Everything but the reseeding rule is scans over slices of time, so a busy
book is not one task's; level states are validity intervals, so a book at any time is
a filter, not a replay.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import bucket_index
from tidemark.operators.asof import asof
from tidemark.operators.core import KEYS, folded, joined
from tidemark.operators.scan import HOUR_NS, scanned
from tidemark.staging import staged


def book_continuity(book: DataFrame, rule: str = "range", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``action`` of each book event: Snapshot, Apply, Gap or Drop, and its ``epoch`` (snapshots so far).

    range: a delta may overlap what is known; strict: first_seq must be the last id
    plus one, older ids are gaps too; prev: first_seq names the id before it; reseed:
    the message after a gap starts a new book.
    """
    if rule == "reseed":
        return _reseeding(book, keys)
    if rule not in ("range", "strict", "prev"):
        raise ValueError(f"unknown rule: {rule}")
    own, first = list(keys), F.col("first_seq")
    is_snap = F.col("kind") == "book_snapshot"
    last = F.when(is_snap, F.col("seq")).otherwise(F.col("last_seq"))
    in_slice = Window.partitionBy(*own, "_slice").orderBy("recv_ts_ns", "stream_seq")
    before = Window.partitionBy(*own, "_slice", "_e").orderBy("recv_ts_ns", "stream_seq").rowsBetween(Window.unboundedPreceding, -1)
    d = book.withColumn("_slice", bucket_index("recv_ts_ns", HOUR_NS)).withColumn("_e", F.sum(is_snap.cast("long")).over(in_slice.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_k", F.max(last).over(before) if rule == "range" else F.last(last, True).over(before))

    def breaks(f: Column, known: Column) -> Column:
        return f > known + 1 if rule == "range" else f != known + (1 if rule == "strict" else 0)

    # What a slice knows of itself decides its gaps, but for the rows before its first id: theirs hang on the id
    # carried to it, and so (range) do those that it may exceed. The extremes of such first_seq are enough to tell.
    sure = F.when(~is_snap & breaks(first, F.col("_k")), first)
    unsure = F.when(~is_snap & F.col("_k").isNull(), first)
    marks = {"_g": F.max(sure), "_lo": F.min(unsure), "_hi": F.max(unsure)}
    d = staged(d.withColumns({n: c.over(before) for n, c in marks.items()}), "continuity")
    starts = _carried(d, own, rule, last, sure, unsure, breaks)
    c = joined(d, starts, [*own, "_slice"])
    carried = F.when(F.col("_e") == 0, F.col("_c"))
    known = F.greatest("_k", carried) if rule == "range" else F.coalesce("_k", carried)
    broken = _broken(rule, carried, breaks) | F.coalesce((F.col("_e") == 0) & F.col("_bc"), F.lit(False))
    epoch = F.col("_e") + F.coalesce("_start", F.lit(0))
    gap, old = F.coalesce(breaks(first, known), F.lit(False)), F.coalesce(F.col("last_seq") <= known, F.lit(False)) if rule == "range" else F.lit(False)
    action = F.when(is_snap, "Snapshot").when((epoch == 0) | broken, "Drop").when(gap, "Gap").when(old, "Drop").otherwise("Apply")
    return c.select(*book.columns, epoch.alias("epoch"), action.alias("action"))


def _broken(rule: str, carried: Column, breaks) -> Column:
    """Whether a gap is among the rows that ``_g``, ``_lo`` and ``_hi`` sum up, if ``carried`` was known before them."""
    sure = F.col("_g") > carried + 1 if rule == "range" else F.col("_g").isNotNull()
    sure = F.coalesce(sure, F.col("_g").isNotNull() & carried.isNull())
    return sure | F.coalesce(breaks(F.col("_hi"), carried) | breaks(F.col("_lo"), carried), F.lit(False))


def _carried(d: DataFrame, own: list[str], rule: str, last: Column, sure: Column, unsure: Column, breaks) -> DataFrame:
    """Of each slice with an epoch under way at its start: that epoch's number, last known id and whether it is broken."""
    at = () if rule == "range" else ("recv_ts_ns", "stream_seq")
    none = F.col("_e") == 0
    s = d.groupBy(*own, "_slice").agg(
        F.max("_e").alias("_n"), F.max(F.when(last.isNotNull(), F.struct("_e", *at, last.alias("x")))).alias("_id"), F.max(F.struct("_e", sure.isNotNull().alias("x"))).alias("_end"),
        F.max(F.when(none, sure)).alias("_g"), F.min(F.when(none, unsure)).alias("_lo"), F.max(F.when(none, unsure)).alias("_hi"),
    )
    order = Window.partitionBy(*own).orderBy("_slice")
    s = s.withColumn("_epoch", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    same = Window.partitionBy(*own, "_epoch").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    end = F.when(F.col("_id._e") == F.col("_n"), F.col("_id.x"))  # of the slice's last epoch
    s = s.withColumn("_known", F.max(end).over(same) if rule == "range" else F.last(end, True).over(same))
    s = s.withColumns({"_c": F.lag("_known").over(order), "_start": F.lag("_epoch").over(order)})
    gap = F.when(F.col("_n") > 0, F.col("_end.x")).otherwise(_broken(rule, F.col("_c"), breaks))
    s = s.withColumn("_bad", F.max(gap).over(same)).withColumn("_bc", F.lag("_bad").over(order))
    return staged(s.where("_start > 0").select(*own, "_slice", "_start", "_c", "_bc"), "starts")  # written: its size decides how it is joined


def _reseeding(book: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Epochs depend on gaps here, so this is a fold."""

    def start():
        last, epoch = None, 0

        def step(first: int, end: int) -> tuple[int, str]:
            nonlocal last, epoch
            if last is None:
                last, epoch, action = end, epoch + 1, "Snapshot"
            elif first > last + 1:
                last, action = None, "Gap"
            elif end <= last:
                action = "Drop"
            else:
                last, action = end, "Apply"
            return epoch, action

        return step

    return folded(book, list(keys), ["recv_ts_ns", "stream_seq"], start, ["first_seq", "last_seq"], "epoch long, action string")


def book_levels(continuity: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Each price level's life: keys, epoch, side, price, qty, from and to (ns and place); removed levels have no rows.

    A level ends at the next event for its price (``changed``), or with its epoch (next snapshot or gap).
    """
    c = scanned(continuity.where(F.col("action") != "Drop"), list(keys), {"place": ("sum", F.lit(1).cast("long"), False)}, keep=True)
    ends = c.groupBy(*keys, "epoch").agg(F.min(F.when(F.col("action") == "Gap", F.struct("recv_ts_ns", "place"))).alias("_gap"), F.min("recv_ts_ns").alias("_from"), F.min("place").alias("_first"))
    by_epoch = Window.partitionBy(*keys).orderBy("epoch")
    ends = ends.select(*keys, "epoch", F.coalesce(F.col("_gap"), F.struct(F.lead("_from").over(by_epoch).alias("recv_ts_ns"), F.lead("_first").over(by_epoch).alias("place"))).alias("_end"))
    live = c.where(F.col("action").isin("Snapshot", "Apply"))
    sides = F.concat(F.transform("bids", lambda x: F.struct(F.lit("bid").alias("side"), x["price"].alias("price"), x["qty"].alias("qty"))), F.transform("asks", lambda x: F.struct(F.lit("ask").alias("side"), x["price"].alias("price"), x["qty"].alias("qty"))))
    lv = live.select(*keys, "epoch", "recv_ts_ns", "place", F.inline(sides))
    same = Window.partitionBy(*keys, "epoch", "side", "price").orderBy("place")
    lv = lv.withColumns({"_to_ns": F.lead("recv_ts_ns").over(same), "_to": F.lead("place").over(same)}).join(ends, [*keys, "epoch"])
    return lv.where("qty > 0").select(*keys, "epoch", "side", "price", "qty", F.col("recv_ts_ns").alias("from_ns"), F.col("place").alias("from_place"), F.coalesce("_to_ns", "_end.recv_ts_ns").alias("to_ns"), F.coalesce("_to", "_end.place").alias("to_place"), F.col("_to").isNotNull().alias("changed"))


class Side:
    """One side's sizes by price; the best price from a heap whose removed entries are skipped."""

    def __init__(self, sign: int):
        self.sign, self.at, self.heap = sign, {}, []

    def put(self, price: float, qty: float) -> None:
        if qty > 0:
            if price not in self.at:
                heapq.heappush(self.heap, self.sign * price)
            self.at[price] = qty
        else:
            self.at.pop(price, None)

    def best(self) -> float | None:
        while self.heap and self.sign * self.heap[0] not in self.at:
            heapq.heappop(self.heap)
        return self.sign * self.heap[0] if self.heap else None


TOP = "best_bid double, bid_qty double, best_ask double, ask_qty double, bid_levels long, ask_levels long, mid double"


def _starting_levels(c: DataFrame, keys: list[str]) -> DataFrame:
    """The levels with which each slice of an epoch begins: of every price the last change before, as (price, qty) pairs a side."""
    changes = None
    for n, side in ((0, "bids"), (1, "asks")):
        part = c.select(*keys, "_s", "recv_ts_ns", "stream_seq", F.lit(n).alias("side"), F.posexplode(side).alias("_i", "_x")).withColumns({"price": F.col("_x")[0], "qty": F.col("_x")[1]}).drop("_x")
        changes = part if changes is None else changes.unionByName(part)
    by_price = [*keys, "side", "price"]
    ends = changes.groupBy(*by_price, "_s").agg(F.max_by("qty", F.struct("recv_ts_ns", "stream_seq", "_i")).alias("qty"))
    following = Window.partitionBy(*by_price).orderBy("_s")
    last = c.groupBy(*keys).agg(F.max("_s").alias("_end"))
    ends = joined(ends.withColumn("_next", F.lead("_s").over(following)), last, keys, "inner").where("qty > 0")
    upto = F.coalesce(F.col("_next"), F.col("_end"))
    lives = ends.where(F.col("_s") < upto).withColumn("_s", F.explode(F.sequence(F.col("_s") + 1, upto)))
    level = lambda n: F.filter(F.collect_list(F.struct("side", "price", "qty")), lambda x: x["side"] == n)
    pairs = lambda n: F.transform(level(n), lambda x: F.array(x["price"], x["qty"]))
    starts = lives.groupBy(*keys, "_s").agg(pairs(0).alias("bids"), pairs(1).alias("asks"))  # as many as a book is deep
    return joined(starts, c.select(*keys, "_s").distinct(), [*keys, "_s"], "inner")


def top_of_book(continuity: DataFrame, keys: tuple[str, ...] = KEYS, slice_ns: int = HOUR_NS) -> DataFrame:
    """After every applied book event: best prices and sizes, level counts and mid. Nothing while a book is broken.

    A running best under removals is a fold, but a book's slices of time are independent
    once each knows the levels it begins with; so even one epoch of one key spreads over tasks.
    """
    own = [*keys, "epoch"]
    c = continuity.where(F.col("action").isin("Snapshot", "Apply")).withColumn("_s", bucket_index("recv_ts_ns", slice_ns))
    c = c.select(*own, "_s", "recv_ts_ns", "stream_seq", "action", *(F.transform(s, lambda x: F.array(x["price"], x["qty"])).alias(s) for s in ("bids", "asks")))
    c = staged(c, "book_events")
    none = {"recv_ts_ns": F.lit(None).cast("long"), "stream_seq": F.lit(None).cast("long"), "action": F.lit("Start")}
    c = c.unionByName(_starting_levels(c, own).withColumns(none))

    width = len(own) + 1

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        sides: tuple[Side, Side] = (Side(-1), Side(1))
        for batch in batches:
            rows, kept = [], []
            cols = [x.to_pylist() for x in batch.columns]
            for key, action, *levels in zip(zip(*cols[:width]), *cols[width + 2 :]):
                if key != at or action == "Snapshot":
                    at, sides = key, (Side(-1), Side(1))
                for side, changes in zip(sides, levels):
                    for price, qty in changes or ():
                        side.put(price, qty)
                kept.append(action != "Start")
                if action == "Start":
                    continue
                bid, ask = (side.best() for side in sides)
                rows.append((bid, sides[0].at.get(bid), ask, sides[1].at.get(ask), len(sides[0].at), len(sides[1].at), (bid + ask) / 2 if bid is not None and ask is not None else None))
            names = [x.split()[0] for x in TOP.split(", ")]
            kinds = [pa.int64() if n.endswith("levels") else pa.float64() for n in names]
            new = [pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else [()] * len(names), kinds)]
            own_columns = batch.filter(pa.array(kept, pa.bool_()))
            shown = [*range(width - 1), width, width + 1]
            yield pa.RecordBatch.from_arrays([*(own_columns.column(i) for i in shown), *new], [*(batch.schema.names[i] for i in shown), *names])

    types = dict(c.dtypes)
    schema = ", ".join(f"{x} {types[x]}" for x in [*own, "recv_ts_ns", "stream_seq"]) + ", " + TOP
    order = [*own, "_s", F.asc_nulls_first("recv_ts_ns"), F.asc_nulls_first("stream_seq")]
    return c.repartition(*own, "_s").sortWithinPartitions(*order).mapInArrow(fold, schema)


def top_imbalance(continuity: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    t = top_of_book(continuity, keys).where("bid_qty is not null and ask_qty is not null")
    return t.withColumn("value", (F.col("bid_qty") - F.col("ask_qty")) / (F.col("bid_qty") + F.col("ask_qty")))


def _div(x: Column, n: int) -> Column:
    """Whole division of a number that is not negative."""
    return F.call_function("div", x, F.lit(n))


def levels_at(levels: DataFrame, times: DataFrame, by: list[str], slice_ns: int = 60_000_000_000, ts: str = "ts_ns", fan: int = 64, steps: int = 4) -> DataFrame:
    """Levels live at each sample time: an equi-join on time slices, then the exact test.

    A life is covered by slices of growing length (``fan`` of one length in the next): the longest
    that fit, shorter ones at its ends, so it takes at most 2 * ``fan`` rows a length however long it is.
    Each sample time asks once per length.
    """
    top = times.select(F.max(ts).alias("_max"))
    lv = levels.crossJoin(F.broadcast(top)).withColumn("_end", F.least(F.coalesce("to_ns", F.col("_max") + 1), F.col("_max") + 1)).where(F.col("from_ns") < F.col("_end"))
    lo, hi = bucket_index("from_ns", slice_ns), bucket_index(F.col("_end") - 1, slice_ns) + 1  # slices [lo, hi)
    none, pieces = F.array().cast("array<bigint>"), []
    for k in range(steps):
        level = F.lit(k).alias("k")
        if k < steps - 1:
            up = _div(lo + (fan - 1), fan)  # first whole longer slice, and the end of the last
            down = F.greatest(_div(hi, fan), up)
            end, start = F.least(up * fan, hi), F.greatest(down * fan, F.least(up * fan, hi))
            own = F.concat(F.when(lo < end, F.sequence(lo, end - 1)).otherwise(none), F.when(start < hi, F.sequence(start, hi - 1)).otherwise(none))
            lo, hi = up, down
        else:
            own = F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(none)
        pieces.append(F.transform(own, lambda x: F.struct(level, x.alias("s"))))  # noqa: B023  evaluated at once
    lv = lv.withColumn("_p", F.explode(F.concat(*pieces))).select("*", F.col("_p.k").alias("_k"), F.col("_p.s").alias("_s")).drop("_p", "_max", "_end")
    slot = bucket_index(ts, slice_ns)
    asks = F.array(*(F.struct(F.lit(k).alias("k"), _div(slot, fan**k).alias("s")) for k in range(steps)))
    t = times.withColumn("_p", F.explode(asks)).select(*times.columns, F.col("_p.k").alias("_k"), F.col("_p.s").alias("_s"))
    return t.join(lv, [*by, "_k", "_s"]).where((F.col("from_ns") <= F.col(ts)) & (F.col("to_ns").isNull() | (F.col(ts) < F.col("to_ns")))).drop("_k", "_s")


def depth(at: DataFrame, bps: float, by: list[str], ts: str = "ts_ns", tick: float | None = None) -> DataFrame:
    """Depth within ``bps`` of the mid on both sides, imbalance and spread (with ``tick`` also in ticks), from ``levels_at``."""
    best = at.groupBy(*by, ts).agg(F.max(F.when(F.col("side") == "bid", F.col("price"))).alias("bid"), F.min(F.when(F.col("side") == "ask", F.col("price"))).alias("ask"))
    mid = (F.col("bid") + F.col("ask")) / 2
    near = at.join(best, [*by, ts]).where(F.abs(F.col("price") - mid) <= mid * bps / 1e4)
    d = near.groupBy(*by, ts).agg(F.sum(F.when(F.col("side") == "bid", F.col("qty")).otherwise(0.0)).alias("bid_depth"), F.sum(F.when(F.col("side") == "ask", F.col("qty")).otherwise(0.0)).alias("ask_depth"), F.first(F.col("ask") - F.col("bid")).alias("spread"))
    if tick is not None:
        d = d.withColumn("spread_ticks", F.round(F.col("spread") / tick, 6))
    return d.withColumn("imbalance", F.try_divide(F.col("bid_depth") - F.col("ask_depth"), F.col("bid_depth") + F.col("ask_depth")))


def wall_persistence(levels: DataFrame, mids: DataFrame, bps: float, min_notional: float, by: tuple[str, ...] = KEYS) -> DataFrame:
    """One row for every wall that was removed: by, side, price, from_ns, to_ns and the seconds it survived (``value``).

    A wall is a price at which ``min_notional`` or more stands without a break, within ``bps`` of the mid at its
    appearance (``mids``: by, recv_ts_ns, mid). Ends of epochs remove none: what stood there is not known.
    """
    same = [*by, "epoch", "side", "price"]
    w = Window.partitionBy(*same).orderBy("from_place")
    big = levels.where(F.col("price") * F.col("qty") >= min_notional)
    big = big.withColumn("_new", (~F.lag("to_place").over(w).eqNullSafe(F.col("from_place"))).cast("int"))
    big = big.withColumn("_wall", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    walls = big.groupBy(*same, "_wall").agg(F.min("from_ns").alias("from_ns"), F.max_by(F.struct("to_ns", "changed"), "from_place").alias("_e"))
    walls = walls.where("_e.changed").select(*by, "side", "price", "from_ns", F.col("_e.to_ns").alias("to_ns"))
    at = asof(walls, mids, list(by), "from_ns", "recv_ts_ns", ["mid"])
    near = F.abs(F.col("price") - F.col("mid")) <= F.col("mid") * bps / 1e4
    return at.where(near).withColumn("value", (F.col("to_ns") - F.col("from_ns")) / 1e9).drop("mid")
