"""Readers of the partitioned event store.

Layout: ``{root}/{stream}/venue=/date=/``, sorted by symbol and time within files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.intervals import CoverageError

TRADES = "symbol_id bigint, venue_code int, exch_ts_ns bigint, recv_ts_ns bigint, stream_seq bigint, price double, qty double, side string, trade_id bigint, venue string, date string"
STREAMS = {  # fixed values: event kind to stream name
    "trade": "trades", "book_delta": "book_deltas", "book_snapshot": "book_snapshots", "funding": "funding", "mark_price": "mark_price",
    "open_interest": "open_interest", "liquidation": "liquidations", "index_price": "index_price", "status": "status",
}
FEATURES = "symbol_id bigint, venue_code int, ts_ns bigint, value double, ver int, venue string"
_LEVELS = "array<struct<price:double,qty:double>>"
EVENTS = (
    "schema_ver int, venue string, symbol_id bigint, exch_ts_ns bigint, recv_ts_ns bigint, stream_seq bigint, kind string, price double, qty double, side string, trade_id bigint, "
    f"bids {_LEVELS}, asks {_LEVELS}, first_seq bigint, last_seq bigint, seq bigint, depth int, reason string, rate double, interval_s bigint, next_funding_ts_ns bigint, mark double, index double, "
    "oi_contracts double, oi_notional double, status_kind string, detail string"
)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one of that schema if nothing was written yet."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], T.StructType.fromDDL(schema))
    return spark.read.schema(schema).parquet(path)


def read_stream(spark: SparkSession, root: str, kind: str, venue: str | None = None, symbol: int | None = None, dates: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """One stream, pruned by venue and date; the symbol is pushed down to the files' statistics. Missing: empty."""
    df = _read(spark, f"{root}/{STREAMS[kind]}", schema or (TRADES if kind == "trade" else EVENTS + ", date string"))
    if venue is not None:
        df = df.where(F.col("venue") == venue)
    if dates is not None:
        df = df.where(F.col("date").isin(*dates))
    return df if symbol is None else df.where(F.col("symbol_id") == symbol)


def read_manifests(spark: SparkSession, root: str, venue: str | None = None, date: str | None = None) -> DataFrame:
    schema = "venue string, symbol_id bigint, stream string, events bigint, first_ts_ns bigint, last_ts_ns bigint, gaps array<struct<from_ns:bigint,to_ns:bigint,kind:string>>, coverage double, sampled boolean, day_start_ns bigint, day_end_ns bigint, date string"
    m = _read(spark, f"{root}/manifests", schema)
    for c, v in (("venue", venue), ("date", date)):
        m = m if v is None else m.where(F.col(c) == v)
    return m


def foreign_manifests(spark: SparkSession, path: str) -> DataFrame:
    """JSON manifests: one document per venue and day with a map of streams, one row per stream."""
    stats = "struct<events:bigint,first_ts_ns:bigint,last_ts_ns:bigint,gaps:array<struct<from_ns:bigint,to_ns:bigint,kind:string>>,coverage:double,sampled:boolean>"
    raw = spark.read.schema(f"venue string, date string, schema_ver int, day_start_ns bigint, day_end_ns bigint, streams map<string,{stats}>").option("multiLine", True).json(path)
    one = raw.select("venue", "date", "day_start_ns", "day_end_ns", F.explode("streams").alias("key", "s"))
    return one.select("venue", "date", "day_start_ns", "day_end_ns", F.split_part("key", F.lit(":"), F.lit(1)).alias("stream"), F.split_part("key", F.lit(":"), F.lit(2)).alias("symbol"), "s.*")


def read_gated(spark: SparkSession, root: str, venue: str, symbol: int, date: str, mode: str = "warn") -> tuple[DataFrame, DataFrame]:
    """Trades of a day and its gaps. ``refuse`` raises on a gap, a missing manifest or missing data."""
    if mode not in ("warn", "refuse"):
        raise ValueError(f"unknown mode: {mode}")
    m = read_manifests(spark, root, venue, date).where((F.col("symbol_id") == symbol) & (F.col("stream") == "trades"))
    gaps = m.select("day_start_ns", "day_end_ns", F.explode("gaps").alias("g")).select("g.*")
    trades = read_stream(spark, root, "trade", venue, symbol, [date])
    if mode == "refuse":
        if m.isEmpty():
            raise CoverageError(f"no manifest for {venue} {symbol} {date}")
        if g := gaps.orderBy("from_ns").first():
            raise CoverageError(f"gap from {g['from_ns']} to {g['to_ns']}")
        if trades.isEmpty():
            raise CoverageError(f"no data for {venue} {symbol} {date}")
    return trades, gaps


def read_features(spark: SparkSession, root: str, feature: str, ver: int) -> DataFrame:
    return _read(spark, f"{root}/features/{feature}/ver={ver}", FEATURES)
