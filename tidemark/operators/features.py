"""Ordered features. Every window is in the stream's total order and looks only back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import DAY_NS, bucket, bucket_index, signed
from tidemark.operators import rolling
from tidemark.operators.asof import asof
from tidemark.operators.core import KEYS, joined, ordered, running, upto
from tidemark.operators.scan import scanned


def cvd(trades: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Running signed quantity of each key, never reset."""
    return running(trades, signed("qty"), keys, "value")


def _in_slices(df: DataFrame, window_ns: int) -> DataFrame:
    """Each row in its slice of time and, as context (not ``_own``), in the next; slices are no shorter than the window."""
    slot = bucket_index("recv_ts_ns", max(window_ns, 60_000_000_000))
    return df.withColumn("_s", F.explode(F.array(slot, slot + 1))).withColumn("_own", F.col("_s") == slot)


def rolling_sum(df: DataFrame, value, window_ns: int, keys: tuple[str, ...] = KEYS, name: str = "value") -> DataFrame:
    """Sum over the last ``window_ns`` (both ends in), later rows of the same time excluded.

    Time is cut into slices as long as the window (at least a minute); each row also goes
    to the next slice as context, so no task holds more of a key than two slices.
    """
    d = _in_slices(df.withColumn("_x", value), window_ns)
    w = Window.partitionBy(*keys, "_s")
    total = F.sum("_x").over(w.orderBy("recv_ts_ns", "stream_seq").rowsBetween(Window.unboundedPreceding, 0))
    older = F.sum("_x").over(w.orderBy("recv_ts_ns").rangeBetween(Window.unboundedPreceding, -(window_ns + 1)))
    return d.withColumn(name, total - F.coalesce(older, F.lit(0))).where("_own").drop("_x", "_s", "_own")


def liq_cluster(liqs: DataFrame, window_ns: int, min_notional: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return rolling_sum(liqs, signed(F.col("price") * F.col("qty")), window_ns, keys).where(F.abs("value") >= min_notional)


def oi_delta(oi: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    before = scanned(oi, list(keys), {"_before": ("last", F.struct("oi_contracts"), True)}, slice_ns=DAY_NS)  # a struct: the row before, also where it has none
    return before.withColumn("value", F.col("oi_contracts") - F.col("_before.oi_contracts")).where("value is not null").drop("_before")


def _bar_window(keys: tuple[str, ...]):
    return Window.partitionBy(*keys).orderBy("open_ts_ns")


def log_returns(bars: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``r``: log return of the close, null if either close is not positive."""
    b = bars.withColumns({"_c": F.col("close").cast("double"), "_p": F.lag(F.col("close").cast("double")).over(_bar_window(keys))})
    return b.withColumn("r", F.when((F.col("_c") > 0) & (F.col("_p") > 0), F.log(F.when(F.col("_c") > 0, F.col("_c")) / F.when(F.col("_p") > 0, F.col("_p"))))).drop("_c", "_p")


def realized_vol(bars: DataFrame, w: int, keys: tuple[str, ...] = KEYS, annualize: float | None = None) -> DataFrame:
    """Root of the sum of the last ``w`` valid squared returns, on every bar once there are so many."""
    order = _bar_window(keys)
    r = log_returns(bars, keys).withColumn("_k", F.count("r").over(upto(order)))
    total = F.sum(F.col("r") * F.col("r")).over(Window.partitionBy(*keys).orderBy("_k").rangeBetween(-(w - 1), 0))
    factor = 1.0 if annualize is None else annualize
    return r.withColumn("value", F.sqrt(total) * factor).where(F.col("_k") >= w).drop("_k", "r")


def donchian(bars: DataFrame, n: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """+1 / -1 when the close leaves the range of the ``n`` bars before, else 0. The n-th bar gives the first value, 0."""
    back = _bar_window(keys).rowsBetween(-n, -1)
    b = bars.withColumns({"_hi": F.max("high").over(back), "_lo": F.min("low").over(back), "_n": F.row_number().over(_bar_window(keys))})
    full = F.col("_n") > n
    return b.where(F.col("_n") >= n).withColumn("value", F.when(full & (F.col("close") > F.col("_hi")), 1.0).when(full & (F.col("close") < F.col("_lo")), -1.0).otherwise(0.0)).drop("_hi", "_lo", "_n")


# Features that only the written specification defines.


def cvd_across(trades: DataFrame, base: str = "symbol_id") -> DataFrame:
    """Running signed notional of a base symbol over all venues."""
    return running(trades, signed(F.col("price") * F.col("qty")), (base,), "value", seq=("stream_seq", "venue"))


def trade_size_quantile(trades: DataFrame, window_ns: int, q: float = 0.95, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rolling quantile (interpolated) of the notional over strictly older trades of the window."""
    return rolling.quantiles(trades, list(keys), F.col("price") * F.col("qty"), {"value": q}, "recv_ts_ns", window_ns)


def adaptive_whales(trades: DataFrame, floor_usd: float, window_ns: int, k: float = 3.0) -> DataFrame:
    t = trade_size_quantile(trades, window_ns).withColumnRenamed("value", "_p")
    notional = (F.col("price") * F.col("qty")).cast("double")
    return t.where(notional >= F.greatest(F.lit(floor_usd), k * F.coalesce("_p", F.lit(0.0)))).withColumn("value", signed(notional)).drop("_p")


def whale_flow(whales: DataFrame, window_ns: int) -> DataFrame:
    return rolling_sum(whales, F.col("value"), window_ns, name="flow")


def whale_share(trades: DataFrame, floor_usd: float, tf_ns: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    notional = F.col("price") * F.col("qty")
    return trades.groupBy(*keys, bucket("recv_ts_ns", tf_ns).alias("open_ts_ns")).agg(F.try_divide(F.sum(F.when(notional >= floor_usd, notional).otherwise(0)).cast("double"), F.sum(notional).cast("double")).alias("value"))


def sweep(trades: DataFrame, window_ns: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Per trade: share of the window's volume on the trade's own side and the price moved over it."""
    buy = F.when(F.col("side") == "Buy", F.col("qty")).otherwise(0)
    both = rolling_sum(rolling_sum(trades, buy, window_ns, keys, "_buy"), F.col("qty"), window_ns, keys, "_all")
    first = F.first("price").over(Window.partitionBy(*keys, "_s").orderBy("recv_ts_ns").rangeBetween(-window_ns, 0))
    both = _in_slices(both, window_ns).withColumn("_first", first).where("_own").drop("_s", "_own")
    side = F.when(F.col("side") == "Buy", F.col("_buy")).otherwise(F.col("_all") - F.col("_buy"))
    new = {"side_volume": side, "one_sided": F.try_divide(side.cast("double"), F.col("_all").cast("double")), "displacement": (F.col("price") - F.col("_first")).cast("double")}
    return both.withColumns(new).drop("_buy", "_all", "_first")


def sweep_events(trades: DataFrame, bars: DataFrame, window_ns: int, k: float, min_move: float, n_bars: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """+1 / -1 where a side's volume of the window reaches ``k`` times the median volume of the last closed bars
    and the price has moved its way by ``min_move``."""
    last = _bar_window(keys).rowsBetween(-(n_bars - 1), 0)
    median = bars.select(*keys, F.col("close_ts_ns").alias("_t"), F.percentile(F.col("volume").cast("double"), F.lit(0.5)).over(last).alias("_median"))
    s = asof(sweep(trades, window_ns, keys), median, list(keys), "recv_ts_ns", "_t", ["_median"])
    sign = F.when(F.col("side") == "Buy", 1.0).otherwise(-1.0)
    return s.where((F.col("side_volume").cast("double") >= k * F.col("_median")) & (F.col("displacement") * sign >= min_move)).withColumn("value", sign).drop("_median")


def absorption(bars: DataFrame, tick: float) -> DataFrame:
    return bars.withColumn("value", F.abs(F.col("delta")).cast("double") / (F.abs(F.col("close") - F.col("open")).cast("double") / tick + 1))


def relative_volume(bars: DataFrame, days: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Volume over the median of the same time of day on the ``days`` days before."""
    w = Window.partitionBy(*keys, "_tod").orderBy("open_ts_ns").rowsBetween(-days, -1)
    b = bars.withColumn("_tod", F.pmod("open_ts_ns", F.lit(DAY_NS)))
    return b.withColumn("value", F.try_divide(F.col("volume").cast("double"), F.percentile(F.col("volume").cast("double"), F.lit(0.5)).over(w))).drop("_tod")


def session_vwap(trades: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Volume-weighted price since the start of the UTC day."""
    w = upto(ordered(*keys, "_day"))
    t = trades.withColumn("_day", bucket("recv_ts_ns", DAY_NS))
    pq, q = F.sum(F.col("price") * F.col("qty")).over(w).cast("double"), F.sum("qty").over(w).cast("double")
    return t.withColumn("vwap", F.when(q > 0, pq / q).otherwise(F.col("price").cast("double"))).drop("_day")


def in_vol_units(bars: DataFrame, w: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``bars`` with ``unit``, the price unit scaled by volatility: close times realised volatility of ``w`` returns, null until warm."""
    rv = realized_vol(bars, w, keys).select(*keys, "open_ts_ns", F.col("value").alias("_rv"))
    return joined(bars, rv, [*keys, "open_ts_ns"]).withColumn("unit", F.col("close").cast("double") * F.col("_rv")).drop("_rv")


def vwap_deviation(bars: DataFrame, trades: DataFrame, w: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Distance of each bar's close from the session's volume-weighted price at its last trade, in vol units."""
    v = session_vwap(trades, keys).select(*keys, F.col("recv_ts_ns").alias("_t"), "stream_seq", F.col("vwap").alias("session_vwap"))
    b = asof(in_vol_units(bars, w, keys), v, list(keys), "last_ts_ns", "_t", ["session_vwap"], "stream_seq")
    return b.withColumn("value", F.try_divide(F.col("close").cast("double") - F.col("session_vwap"), F.col("unit"))).drop("unit")


def previous_day_range(bars: DataFrame, w: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Distance of each close to the high and low of the last day before that has bars, in vol units; negative beyond the level."""
    day = bucket("open_ts_ns", DAY_NS)
    days = bars.groupBy(*keys, day.alias("_day")).agg(F.max("high").alias("_h"), F.min("low").alias("_l"))
    before = Window.partitionBy(*keys).orderBy("_day")
    days = days.select(*keys, "_day", F.lag("_h").over(before).alias("pdh"), F.lag("_l").over(before).alias("pdl"))
    b = joined(in_vol_units(bars, w, keys).withColumn("_day", day), days, [*keys, "_day"], "inner")
    gap = lambda x: F.try_divide(x.cast("double"), F.col("unit"))
    return b.withColumns({"dist_pdh": gap(F.col("pdh") - F.col("close")), "dist_pdl": gap(F.col("close") - F.col("pdl"))}).drop("_day", "unit")


def climax(bars: DataFrame, days: int, min_rvol: float, min_share: float) -> DataFrame:
    b = relative_volume(bars, days).withColumnRenamed("value", "rvol")
    share = F.try_divide(F.abs("delta").cast("double"), F.col("volume").cast("double"))
    return b.withColumn("value", F.coalesce((F.col("rvol") >= min_rvol) & (share >= min_share), F.lit(False)))


def zscore(df: DataFrame, value: str, w: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Against the ``w`` values up to and with this one, once there are so many.

    A key's rows are numbered and cut in slices of places, each with the slice before as context.
    """
    slot = bucket_index("_place", max(w, 4096))
    d = running(df, F.lit(1).cast("long"), keys, "_place").withColumn("_s", F.explode(F.array(slot, slot + 1))).withColumn("_own", F.col("_s") == slot)
    win = Window.partitionBy(*keys, "_s").orderBy("_place").rowsBetween(-(w - 1), 0)
    x = F.col(value).cast("double")
    score = F.when(F.count(value).over(win) >= w, F.try_divide(x - F.avg(x).over(win), F.stddev_samp(x).over(win)))
    return d.withColumn("value", score).where("_own").drop("_place", "_s", "_own")


def cross_venue(a: DataFrame, b: DataFrame, by: str = "symbol_id", grid_ns: int = 1_000_000_000, value_a: str = "price", value_b: str = "price") -> DataFrame:
    """Relative difference of ``value_a`` in ``a`` from ``value_b`` in ``b``, on the grid seconds in which either has one (last ones carried on, by slices)."""
    grid = bucket("recv_ts_ns", grid_ns).alias("ts_ns")
    last = lambda d, c, n: d.groupBy(by, grid).agg(F.max_by(c, F.struct("recv_ts_ns", "stream_seq")).cast("double").alias(n))
    both = last(a, value_a, "_a").join(last(b, value_b, "_b"), [by, "ts_ns"], "full_outer")
    carried = scanned(both, [by], {"px_a": ("last", F.col("_a"), False), "px_b": ("last", F.col("_b"), False)}, "ts_ns", (), DAY_NS)
    return carried.where("px_a is not null and px_b is not null").select(by, "ts_ns", "px_a", "px_b").withColumn("value", F.try_divide(F.col("px_a") - F.col("px_b"), F.col("px_b")))


def basis(marks: DataFrame, index: DataFrame, by: str = "symbol_id", grid_ns: int = 1_000_000_000) -> DataFrame:
    """(mark of venue a - index price of venue b) / index price; columns ``mark`` and ``index_price``."""
    return cross_venue(marks, index, by, grid_ns, "mark", "index_price")


def price_divergence(quotes_a: DataFrame, quotes_b: DataFrame, by: str = "symbol_id", grid_ns: int = 1_000_000_000) -> DataFrame:
    """(mid a - mid b) / mid b, from two venues' tops of book."""
    known = "mid is not null"
    return cross_venue(quotes_a.where(known), quotes_b.where(known), by, grid_ns, "mid", "mid")


def oi_quadrant(oi: DataFrame, bars: DataFrame, tf_ns: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Change of open interest over each bar, and 1..4: price up/OI up, up/down, down/up, down/down."""
    per = oi.groupBy(*keys, bucket("recv_ts_ns", tf_ns).alias("open_ts_ns")).agg(F.max_by("oi_contracts", F.struct("recv_ts_ns", "stream_seq")).cast("double").alias("oi"))
    per = per.withColumn("oi_delta", F.col("oi") - F.lag("oi").over(_bar_window(keys)))
    j = bars.join(per, [*keys, "open_ts_ns"])
    up, more = F.col("close") >= F.col("open"), F.col("oi_delta") >= 0
    return j.where("oi_delta is not null").withColumn("quadrant", F.when(up & more, 1).when(up, 2).when(more, 3).otherwise(4))


def lead_lag(a: DataFrame, b: DataFrame, max_lag: int, tf_ns: int, by: str = "symbol_id") -> DataFrame:
    """The lag (in bars) at which the returns of ``a`` and ``b`` (by, open_ts_ns, r) correlate most."""
    lags = F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag)))
    x = a.select(by, "open_ts_ns", F.col("r").alias("ra")).withColumn("lag", lags).withColumn("open_ts_ns", F.col("open_ts_ns") + F.col("lag") * tf_ns)
    c = x.join(b.select(by, "open_ts_ns", F.col("r").alias("rb")), [by, "open_ts_ns"]).groupBy(by, "lag").agg(F.corr("ra", "rb").alias("c"), F.count("*").alias("n")).where("c is not null and not isnan(c)")
    best = F.struct(F.round(F.abs("c"), 12), -F.abs("lag"), -F.col("lag"))
    return c.groupBy(by).agg(F.max_by("lag", best).alias("lag"), F.max_by("c", best).alias("corr"))


def regimes(bars: DataFrame, w: int, lookback: int, keys: tuple[str, ...] = KEYS, min_trend: float = 0.3) -> DataFrame:
    """Volatility regime by the 33rd and 66th percentile of past volatility, trend by the efficiency ratio."""
    rv = realized_vol(bars, w, keys).withColumnRenamed("value", "rv").withColumn("rv", F.round("rv", 12))
    rv = rolling.quantiles_of_last(log_returns(rv, keys), list(keys), F.col("rv"), {"_lo": 1 / 3, "_hi": 2 / 3}, "open_ts_ns", lookback)
    span = _bar_window(keys).rowsBetween(-(w - 1), 0)
    er = F.round(F.try_divide(F.abs(F.sum("r").over(span)), F.sum(F.abs("r")).over(span)), 9)
    return rv.withColumns({"vol_regime": F.when(F.col("rv") <= F.col("_lo"), "low").when(F.col("rv") >= F.col("_hi"), "high").when(F.col("_lo").isNotNull(), "mid"), "trend_regime": F.when(er >= min_trend, "trend").otherwise("range")}).drop("_lo", "_hi", "r")
