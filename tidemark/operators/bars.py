"""Bars: time, volume and price footprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import DAY_NS, bucket, bucket_index
from tidemark.operators.core import KEYS, joined, running
from tidemark.operators.features import in_vol_units


def time_bars(trades: DataFrame, tf_ns: int, keys: tuple[str, ...] = KEYS, closed_only: bool = True) -> DataFrame:
    """One row per key and non-empty bucket. A bucket closes when a later one begins, so each key's last stays out.

    One aggregation shuffle with map-side partial results; what a bar needs of the
    order is carried by min_by / max_by, so nothing is sorted.
    """
    at, buy, sell = F.struct("recv_ts_ns", "stream_seq"), F.col("side") == "Buy", F.col("side") != "Buy"
    bars = trades.groupBy(*keys, bucket("recv_ts_ns", tf_ns).alias("open_ts_ns")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("qty").alias("volume"), F.sum(F.when(buy, F.col("qty")).otherwise(0)).alias("buy_volume"), F.sum(F.when(sell, F.col("qty")).otherwise(0)).alias("sell_volume"),
        F.sum(F.col("price") * F.col("qty")).alias("_pq"), F.count("*").alias("n"), F.min("recv_ts_ns").alias("first_ts_ns"), F.max("recv_ts_ns").alias("last_ts_ns"),
    )
    bars = bars.withColumns({"close_ts_ns": F.col("open_ts_ns") + tf_ns, "delta": F.col("buy_volume") - F.col("sell_volume"), "vwap": F.when(F.col("volume") > 0, F.col("_pq").cast("double") / F.col("volume").cast("double")).otherwise(F.col("close").cast("double"))}).drop("_pq")
    if closed_only:
        # The next bucket's first trade is when a bar becomes known.
        bars = bars.withColumn("emit_ts_ns", F.lead("first_ts_ns").over(Window.partitionBy(*keys).orderBy("open_ts_ns"))).where("emit_ts_ns is not null")
    return bars


def volume_bars(trades: DataFrame, threshold: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """A bar per ``threshold`` of running volume; a trade belongs to the bar in which it starts."""
    numbered = running(trades, F.col("qty"), keys, "_before", strict=True)
    numbered = numbered.withColumn("bar", F.floor(F.coalesce("_before", F.lit(0)) / threshold).cast("long"))
    at = F.struct("recv_ts_ns", "stream_seq")
    return numbered.groupBy(*keys, "bar").agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("qty").alias("volume"), F.count("*").alias("n"), F.min("recv_ts_ns").alias("first_ts_ns"))


def footprint(trades: DataFrame, tf_ns: int, price_step: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Bought and sold volume for each bar and price bin."""
    return trades.groupBy(*keys, bucket("recv_ts_ns", tf_ns).alias("open_ts_ns"), (F.floor(F.col("price") / price_step) * price_step).alias("price_bin")).agg(
        F.sum(F.when(F.col("side") == "Buy", F.col("qty")).otherwise(0)).alias("ask_volume"), F.sum(F.when(F.col("side") != "Buy", F.col("qty")).otherwise(0)).alias("bid_volume"))


def profile_nodes(trades: DataFrame, price_step: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Volume profile: smoothed volume of each price bin, and whether it is a high or low node."""
    bins = trades.groupBy(*keys, F.floor(F.col("price") / price_step).cast("long").alias("bin")).agg(F.sum("qty").alias("volume"))
    w = Window.partitionBy(*keys).orderBy("bin")
    smooth = bins.withColumn("smooth", F.avg(F.col("volume").cast("double")).over(w.rangeBetween(-1, 1)))
    near = {"_a": F.lag("smooth").over(w), "_b": F.lead("smooth").over(w)}
    return smooth.withColumns(near).withColumn("node", F.when((F.col("smooth") > F.col("_a")) & (F.col("smooth") > F.col("_b")), "hvn").when((F.col("smooth") < F.col("_a")) & (F.col("smooth") < F.col("_b")), "lvn")).drop("_a", "_b")


def rolling_profile(trades: DataFrame, price_step: float, days: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``profile_nodes`` as of the start of each UTC day (``day``, its number): of the trades of the ``days`` days before it."""
    day = bucket_index("recv_ts_ns", DAY_NS)
    daily = trades.groupBy(*keys, day.alias("_d"), F.floor(F.col("price") / price_step).cast("long").alias("_bin")).agg(F.sum("qty").alias("qty"))
    each = daily.withColumn("day", F.explode(F.sequence(F.col("_d") + 1, F.col("_d") + days)))
    return profile_nodes(each.withColumn("price", (F.col("_bin") + 0.5) * price_step), price_step, (*keys, "day"))


def node_distance(bars: DataFrame, trades: DataFrame, price_step: float, days: int, w: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Distance of each bar's close to the nearest high and low node, in vol units.

    A bar sees the profile of the ``days`` whole UTC days that have ended with its close, none after.
    """
    nodes = rolling_profile(trades, price_step, days, keys).where("node is not null")
    at = F.collect_list(F.when(F.col("node") == "hvn", (F.col("bin") + 0.5) * price_step)), F.collect_list(F.when(F.col("node") == "lvn", (F.col("bin") + 0.5) * price_step))
    lists = nodes.groupBy(*keys, "day").agg(at[0].alias("_hvn"), at[1].alias("_lvn"))  # as many as ten days have price bins
    b = joined(in_vol_units(bars, w, keys).withColumn("day", bucket_index("close_ts_ns", DAY_NS)), lists, [*keys, "day"])
    gap = lambda c: F.try_divide(F.array_min(F.transform(c, lambda x: F.abs(x - F.col("close").cast("double")))), F.col("unit"))
    return b.withColumns({"dist_hvn": gap("_hvn"), "dist_lvn": gap("_lvn")}).drop("_hvn", "_lvn", "day", "unit")
