"""Fill and cost estimates for independent orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import bucket_index
from tidemark.operators.asof import asof
from tidemark.operators.core import crowded, joined
from tidemark.staging import staged

BUY = "Buy"


def _slipped(px, side, slip: float):
    return F.when(side == BUY, px * (1 + slip)).otherwise(px * (1 - slip))


def next_bar_open_fill(orders: DataFrame, bars: DataFrame, by: list[str], slip: float) -> DataFrame:
    """Price of the first bar that opens after the bar in which the order became ready has closed."""
    w = Window.partitionBy(*by).orderBy("open_ts_ns")
    b = bars.select(*by, "open_ts_ns", F.lag("close_ts_ns").over(w).alias("_ready"), F.col("open").cast("double").alias("_open"), F.col("open_ts_ns").alias("fill_ts_ns")).where("_ready is not null")
    f = asof(orders, b, by, "ts_ns", "_ready", ["_open", "fill_ts_ns"], forward=True)
    return f.withColumn("fill_px", _slipped(F.col("_open"), F.col("side"), slip)).drop("_open")


def arrival_cost(orders: DataFrame, quotes: DataFrame, trades: DataFrame, by: list[str], latency_ns: int, participation: float, slip: float) -> DataFrame:
    """The opposing best at the first quote at or after arrival, quantity capped by its share; else the last price.

    Either price slips against the order. Where nothing can be had there is no fill: price null, quantity 0.
    """
    o = orders.withColumn("_t", F.col("ts_ns") + latency_ns)
    q = quotes.select(*by, F.col("recv_ts_ns").alias("_q"), "stream_seq", "best_bid", "bid_qty", "best_ask", "ask_qty")
    f = asof(o, q, by, "_t", "_q", ["best_bid", "bid_qty", "best_ask", "ask_qty"], "stream_seq", forward=True)
    f = asof(f, trades.select(*by, F.col("recv_ts_ns").alias("_q"), "stream_seq", F.col("price").cast("double").alias("_last")), by, "_t", "_q", ["_last"], "stream_seq")
    buy = F.col("side") == BUY
    px, top = F.when(buy, F.col("best_ask")).otherwise(F.col("best_bid")), F.when(buy, F.col("ask_qty")).otherwise(F.col("bid_qty"))
    booked = px.isNotNull() & top.isNotNull()
    touch = F.when(booked, px).otherwise(F.col("_last"))
    filled = F.when(booked, F.least(F.col("qty"), F.greatest(top * participation, F.lit(0.0)))).when(touch.isNotNull(), F.col("qty")).otherwise(0.0)
    return f.withColumns({"fill_px": F.when(filled > 0, _slipped(touch, F.col("side"), slip)), "filled_qty": filled, "unfilled_qty": F.col("qty") - filled}).drop("_t", "_last", "best_bid", "bid_qty", "best_ask", "ask_qty")


def depth_walk(orders: DataFrame, levels: DataFrame, order_id: str = "order_id", slip: float = 0.0) -> DataFrame:
    """Average price when an order takes levels best first. ``levels``: order_id, price, qty of the opposing side.

    An order that finds nothing in the book is filled whole at its last traded price (``last``, if orders have it), slipped.
    """
    l = orders.select(order_id, "side", F.col("qty").alias("_want")).join(levels.select(order_id, "price", "qty"), order_id)
    w = Window.partitionBy(order_id).orderBy(F.when(F.col("side") == BUY, F.col("price")).otherwise(-F.col("price")))
    before = F.coalesce(F.sum("qty").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    l = l.withColumn("_take", F.least(F.greatest(F.col("_want") - before, F.lit(0.0)), F.col("qty")))
    s = l.groupBy(order_id).agg(F.sum("_take").alias("filled_qty"), F.sum(F.col("_take") * F.col("price")).alias("_n"))
    out = orders.join(s, order_id, "left").withColumn("filled_qty", F.coalesce("filled_qty", F.lit(0.0)))
    last = F.col("last").cast("double") if "last" in orders.columns else F.lit(None).cast("double")
    walked, known = F.col("filled_qty") > 0, last.isNotNull()
    px = F.when(walked, F.try_divide("_n", "filled_qty")).otherwise(_slipped(last, F.col("side"), slip))
    filled = F.when(walked, F.col("filled_qty")).when(known, F.col("qty")).otherwise(0.0)
    return out.withColumns({"avg_px": px, "filled_qty": filled, "unfilled_qty": F.col("qty") - filled}).drop("_n")


def _crosses(low: str, high: str):
    """Whether a sale below a buyer's limit or a purchase above a seller's is among prints of these extremes."""
    return F.when(F.col("side") == BUY, F.col(low) < F.col("limit_px")).otherwise(F.col(high) > F.col("limit_px"))


FAN = 32  # slices of one length in one of the next
FEW = 1024  # orders and prints of a key that are compared one by one


def _lengths(slices: DataFrame, orders: DataFrame) -> int:
    """How many lengths of slices reach from the first order's own slice to the last one there is."""
    first, last = orders.agg(F.min("_own")).first()[0], slices.agg(F.max("_s")).first()[0]
    n = 1
    while first is not None and last is not None and FAN**n <= last - first:
        n += 1
    return n


def _later(own, lengths: int):
    """Structs (k, s) of the slices that cover all time after the slice ``own``: the rest of each longer slice it lies in."""
    places = []
    for k in range(lengths):
        at = bucket_index(own, FAN**k)
        end = (bucket_index(at, FAN) + 1) * FAN if k < lengths - 1 else at + FAN + 1
        rest = F.when(at + 1 < end, F.sequence(at + 1, end - 1)).otherwise(F.array().cast("array<bigint>"))
        level = F.lit(k).alias("k")
        places.append(F.transform(rest, lambda s: F.struct(level, s.alias("s"))))  # noqa: B023  evaluated at once
    return F.concat(*places)


def _starts(k, s):
    """The first of the shortest slices in slice ``s`` of length ``k``."""
    return s * F.pow(F.lit(FAN), k).cast("long")


def first_crossing_slice(orders: DataFrame, base: DataFrame, by: list[str], order_id: str) -> DataFrame:
    """(order_id, slice): the first slice after the order's own in which a print crosses its limit.

    Slices are summed up in ever longer ones, ``FAN`` of a level in one of the next. An order looks at
    the rest of its own longer slice on every level, takes the earliest that crosses, and goes down again.
    """
    base, orders = staged(base, "extremes"), staged(orders, "resting")
    levels = _lengths(base, orders)
    ladder = [base.withColumn("_k", F.lit(0))]
    for k in range(1, levels):
        ladder.append(ladder[-1].groupBy(*by, bucket_index("_s", FAN).alias("_s")).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).withColumn("_k", F.lit(k)))
    table = ladder[0]
    for level in ladder[1:]:
        table = table.unionByName(level)
    keep = [order_id, *by, "side", "limit_px"]

    def earliest(tries: DataFrame) -> DataFrame:
        hit = tries.join(table, [*by, "_k", "_s"]).where(_crosses("_lo", "_hi"))
        return hit.groupBy(*keep).agg(F.min_by(F.struct("_k", "_s"), _starts(F.col("_k"), F.col("_s"))).alias("_at")).select(*keep, "_at.*")

    found = earliest(orders.select(*keep, F.explode(_later(F.col("_own"), levels)).alias("_at")).select(*keep, F.col("_at.k").alias("_k"), F.col("_at.s").alias("_s")))
    for k in range(levels - 1, 0, -1):
        children = F.when(F.col("_k") == k, F.sequence(F.col("_s") * FAN, F.col("_s") * FAN + FAN - 1)).otherwise(F.array("_s"))
        found = earliest(found.select(*keep, F.when(F.col("_k") == k, F.lit(k - 1)).otherwise(F.col("_k")).alias("_k"), F.explode(children).alias("_s")))
    return found.select(order_id, "_s")


def _reaching_slice(orders: DataFrame, volumes: DataFrame, by: list[str], order_id: str) -> tuple[DataFrame, DataFrame]:
    """(order_id, slice, before) of the slice after its own in which the volume through an order's limit reaches
    ``_need``, with the volume of earlier slices; and (order_id, volume) of the orders that it never reaches.

    ``volumes`` has by, aggressor, slice, price as ``_x`` (of buyers' prints negative, so that through means below)
    and volume. Each longer slice holds the volumes by price of its parts. What went through a limit in a slice is a
    running sum over its prices; an order asks the slices that cover its future, takes the first that reaches its
    need, and goes down in it: about FAN questions a length.
    """
    levels = _lengths(volumes, orders)
    at = [*by, "_sale", "_k", "_s"]
    ladder = [volumes.withColumn("_k", F.lit(0))]
    for k in range(1, levels):
        up = ladder[-1].groupBy(*by, "_sale", "_x", bucket_index("_s", FAN).alias("_s")).agg(F.sum("_v").alias("_v"))
        ladder.append(up.withColumn("_k", F.lit(k)))
    table = ladder[0]
    for level in ladder[1:]:
        table = table.unionByName(level)
    table = staged(table, "volumes")
    below = F.sum("_v").over(Window.partitionBy(*at).orderBy("_x", F.col("_o").isNotNull().desc()).rowsBetween(Window.unboundedPreceding, 0))
    keep = [order_id, *by, "_sale", "_x", "_need"]

    def ask(tries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``tries``: keep, _before, _k, _s. The first slice that reaches the need; and what went through in all."""
        asked = tries.select(*at, "_x", F.struct(order_id, "_need", "_before").alias("_o"), F.lit(None).cast("double").alias("_v"))
        seen = table.withColumn("_o", F.lit(None).cast(asked.schema["_o"].dataType)).unionByName(asked)
        got = seen.withColumn("_v", F.coalesce(below, F.lit(0.0))).where("_o is not null").select(*at, "_x", "_v", "_o.*")
        w = Window.partitionBy(order_id).orderBy(_starts(F.col("_k"), F.col("_s"))).rowsBetween(Window.unboundedPreceding, 0)
        run = staged(got.withColumn("_upto", F.col("_before") + F.sum("_v").over(w)), "asked")
        hit = run.where(F.round("_upto", 9) >= F.col("_need"))
        first = hit.groupBy(*keep).agg(F.min_by(F.struct("_k", "_s", (F.col("_upto") - F.col("_v")).alias("_before")), _starts(F.col("_k"), F.col("_s"))).alias("_at"))
        return first.select(*keep, "_at.*"), run.groupBy(order_id).agg(F.max("_upto").alias("_upto"))

    found, total = ask(orders.select(*keep, "_before", F.explode(_later(F.col("_own"), levels)).alias("_at")).select(*keep, "_before", F.col("_at.k").alias("_k"), F.col("_at.s").alias("_s")))
    total = total.join(found, order_id, "left_anti")
    for k in range(levels - 1, 0, -1):
        lower, _ = ask(found.where(F.col("_k") == k).select(*keep, "_before", F.lit(k - 1).alias("_k"), F.explode(F.sequence(F.col("_s") * FAN, F.col("_s") * FAN + FAN - 1)).alias("_s")))
        found = found.where(F.col("_k") < k).unionByName(lower)
    return found.select(order_id, "_s", "_before"), total


def touch_through(orders: DataFrame, trades: DataFrame, by: list[str], queue_share: float | None = None, order_id: str = "order_id", slice_ns: int = 3_600_000_000_000) -> DataFrame:
    """When the first trade from ready on goes strictly through the limit with the opposing aggressor; orders never expire.

    Keys of up to ``FEW`` orders and prints are joined print by print. Of others trades are summed up in time slices,
    in which each order finds the slice of its first crossing (a ladder of longer and longer slices); only that
    slice and its own are joined print by print.
    With ``queue_share`` each crossing print fills that share of its quantity and the order is done when they
    add up; the slice in which they do is found in a ladder of volumes by price. ``filled_qty`` is null where
    no print crosses. Ids of orders are unique.
    """
    slot = lambda c: bucket_index(c, slice_ns)
    t = trades.select(*by, slot("recv_ts_ns").alias("_s"), F.col("recv_ts_ns").alias("_t"), F.col("stream_seq").alias("_q"), F.col("price").cast("double").alias("_p"), F.col("qty").cast("double").alias("_n"), F.col("side").alias("_side"))
    busy = crowded(by, orders, trades, most=FEW)
    if busy.isEmpty():
        return orders.join(_print_by_print(orders, t, by, queue_share, order_id), order_id, "left")
    done = _print_by_print(orders.join(busy, by, "left_anti"), t.join(busy, by, "left_anti"), by, queue_share, order_id)
    done = done.unionByName(_by_slices(orders.join(busy, by, "left_semi"), t.join(busy, by, "left_semi"), by, queue_share, order_id, slot))
    return orders.join(done, order_id, "left")


def _through():
    """Whether a print ``_p`` of ``_side`` goes through an order's limit from its time on."""
    sale = F.col("_side") != BUY
    through = F.when(F.col("side") == BUY, sale & (F.col("_p") < F.col("limit_px"))).otherwise(~sale & (F.col("_p") > F.col("limit_px")))
    return (F.col("_t") >= F.col("ready_ns")) & through


def _print_by_print(orders: DataFrame, t: DataFrame, by: list[str], queue_share: float | None, order_id: str) -> DataFrame:
    """What ``touch_through`` adds, by order id, each order joined with all prints of its key: orders and prints move once."""
    pairs = orders.join(t, by).where(_through())
    if queue_share is None:
        return pairs.groupBy(*by, order_id).agg(F.min("_t").alias("fill_ts_ns")).select(order_id, "fill_ts_ns")
    upto = F.sum("_n").over(Window.partitionBy(*by, order_id).orderBy("_t", "_q").rowsBetween(Window.unboundedPreceding, 0))
    want = F.col("qty").cast("double")
    done = F.when(F.round("_upto", 9) >= F.col("qty") / queue_share, F.col("_t"))
    sums = pairs.withColumn("_upto", upto).groupBy(*by, order_id).agg(F.min(done).alias("fill_ts_ns"), F.max(want).alias("_want"), F.max("_upto").alias("_upto"))
    return sums.select(order_id, "fill_ts_ns", F.when(F.col("fill_ts_ns").isNotNull(), F.col("_want")).when(F.col("_upto") > 0, F.col("_upto") * queue_share).alias("filled_qty"))


def _by_slices(orders: DataFrame, t: DataFrame, by: list[str], queue_share: float | None, order_id: str, slot) -> DataFrame:
    """What ``touch_through`` adds, by order id, through ladders of slices."""
    sale = F.col("_side") != BUY
    base = t.groupBy(*by, "_s").agg(F.min(F.when(sale, F.col("_p"))).alias("_lo"), F.max(F.when(~sale, F.col("_p"))).alias("_hi"))
    o = orders.withColumn("_own", slot("ready_ns"))
    prints = lambda x: x.join(t, [*by, "_s"]).where(_through())
    if queue_share is None:
        now = prints(o.withColumnRenamed("_own", "_s")).groupBy(order_id).agg(F.min("_t").alias("fill_ts_ns"))
        later = first_crossing_slice(o.join(now, order_id, "left_anti"), base, by, order_id)
        done = now.unionByName(prints(o.join(later, order_id)).groupBy(order_id).agg(F.min("_t").alias("fill_ts_ns")))
    else:
        o = staged(o.withColumns({"_need": F.col("qty") / queue_share, "_sale": F.col("side") == BUY, "_x": F.when(F.col("side") == BUY, F.col("limit_px").cast("double")).otherwise(-F.col("limit_px").cast("double"))}), "resting")
        first = prints(o.withColumnRenamed("_own", "_s")).groupBy(order_id).agg(F.sum("_n").alias("_first"))
        o = staged(joined(o, first, [order_id]), "resting").withColumn("_before", F.coalesce("_first", F.lit(0.0)))
        here = F.round("_before", 9) >= F.col("_need")
        volumes = staged(t.groupBy(*by, "_s", sale.alias("_sale"), F.when(sale, F.col("_p")).otherwise(-F.col("_p")).alias("_x")).agg(F.sum("_n").alias("_v")), "volumes")
        later, short = _reaching_slice(o.where(~here), volumes, by, order_id)
        last = o.where(here).select(order_id, F.col("_own").alias("_s"), F.lit(0.0).alias("_before")).unionByName(later)
        upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(order_id).orderBy("_t", "_q").rowsBetween(Window.unboundedPreceding, 0))
        run = prints(o.drop("_before").join(last, order_id)).withColumn("_upto", upto).where(F.round("_upto", 9) >= F.col("_need"))
        done = run.groupBy(order_id).agg(F.min("_t").alias("fill_ts_ns"), F.max("qty").cast("double").alias("filled_qty"))
        part = short.where("_upto > 0").select(order_id, F.lit(None).cast("long").alias("fill_ts_ns"), (F.col("_upto") * queue_share).alias("filled_qty"))
        done = done.unionByName(part)
    return done
