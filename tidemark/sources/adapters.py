"""The driver's tables as market tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import DAY_NS

# user_id modulo 6 to venue.
VENUE_OF = ("binance_futures", "bybit", "okx", "hyperliquid", "coinbase", "kraken_futures")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ns(c: str):
    return F.unix_micros(F.col(c).cast("timestamp")) * 1000


def market_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trades (view: buy, click: sell), liquidations, open interest and status rows."""
    e, t = table(spark, sf_dir, "events"), F.col("event_type")
    even = F.col("event_id") % 2 == 0
    return e.select(
        F.element_at(F.array(*(F.lit(v) for v in VENUE_OF)), (F.col("user_id") % 6 + 1).cast("int")).alias("venue"), F.col("user_id").alias("symbol_id"), _ns("ts").alias("recv_ts_ns"), F.col("event_id").alias("stream_seq"),
        F.when(t.isin("view", "click"), "trade").when(t == "purchase", "liquidation").when(t == "signup", "open_interest").when(t == "error", "status").alias("kind"),
        F.when(t == "view", "Buy").when(t == "click", "Sell").when((t == "purchase") & even, "Buy").when(t == "purchase", "Sell").alias("side"),
        F.col("value").cast("decimal(18,4)").alias("price"), (F.get_json_object("props", "$.k").cast("bigint") + 1).cast("decimal(18,4)").alias("qty"),
        F.when(t == "signup", F.col("value")).alias("oi_contracts"), F.when((t == "error") & even, "Disconnected").when(t == "error", "Connected").alias("status_kind"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market_events(spark, sf_dir).where("kind = 'trade'").drop("kind", "oi_contracts", "status_kind")


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer as fills: odd keys sell. Several orders share a day, so the key breaks ties."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderpriority").alias("strategy"), F.lit("okx").alias("venue"), F.col("o_custkey").alias("symbol_id"), F.when(F.col("o_orderkey") % 2 == 0, "Buy").otherwise("Sell").alias("side"),
        (F.col("o_orderkey") % 7 + 1).cast("double").alias("qty"), F.round(F.col("o_totalprice") / 1000, 2).alias("price"), F.round(F.col("o_totalprice") / 100000, 4).alias("fee"), _ns("o_orderdate").alias("ts_ns"), F.col("o_orderkey").alias("seq"),
    )


def closed_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as closed trades: the ship mode's profit is a signed share of the price."""
    l = table(spark, sf_dir, "lineitem")
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    return l.select(F.concat_ws("", "l_returnflag", "l_linestatus").alias("strategy"), (F.pmod("l_suppkey", F.lit(5))).alias("bucket"), _ns("l_shipdate").alias("ts_ns"), (sign * F.col("l_extendedprice") * (F.col("l_discount") - 0.04)).cast("decimal(18,4)").alias("pnl"), (F.col("l_linenumber") % 3 == 0).alias("optimistic_maker"), (F.col("l_extendedprice") * F.col("l_tax") / 100).cast("decimal(18,4)").alias("fee"))


DAY = DAY_NS
