"""Sinks: compaction, feature store, journals, dimensions."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.core import positions

from tidemark.functions.scalar import DAY_NS, bucket
from tidemark.operators.core import split_kind
from tidemark.operators.quality import quality_manifest
from tidemark.sources.reader import STREAMS, _read

LOG = "stream string, venue string, date string, source_hash string"


def with_date(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.date_format(F.timestamp_seconds((bucket("recv_ts_ns", DAY_NS) / 1_000_000_000).cast("long")), "yyyy-MM-dd"))


def write_partitions(df: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """Replace only the (venue, date) partitions in ``df``; rows are sorted by symbol and time within files.

    The rebalance lets Spark split a busy venue's day over several files.
    """
    if metadata:
        df = df.withMetadata(next(c for c in df.columns if c not in ("venue", "date")), metadata)
    out = df.hint("rebalance", "venue", "date").sortWithinPartitions("venue", "date", "symbol_id", "recv_ts_ns", *(["stream_seq"] if "stream_seq" in df.columns else []))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("venue", "date").parquet(path)


def write_trades(trades: DataFrame, root: str, meta: dict[str, str]) -> None:
    """``meta`` (schema_ver, compactor_version, source_log_hash) goes to the files' footers."""
    write_partitions(trades if "date" in trades.columns else with_date(trades), f"{root}/trades", meta)


def read_metadata(df: DataFrame) -> dict[str, Any]:
    return next((dict(f.metadata) for f in df.schema.fields if f.metadata), {})


def compact(events: DataFrame, root: str, source_hash: str, kinds: tuple[str, ...] = tuple(STREAMS), version: str = "1") -> dict[str, int]:
    """Split a batch of events into stream tables and write its manifests; partitions already made from this source are left.

    Returns how many partitions of each stream were written.
    """
    spark = events.sparkSession
    dated = with_date(events)
    parts = dated.groupBy("kind", "venue", "date").agg(F.count("*").alias("n"))
    log = _read(spark, f"{root}/compaction_log", LOG).where(F.col("source_hash") == source_hash)
    written: dict[str, int] = {}
    names = F.create_map(*(F.lit(x) for pair in STREAMS.items() for x in pair))
    todo = parts.where(F.col("kind").isin(*kinds)).withColumn("stream", names[F.col("kind")]).join(log, ["stream", "venue", "date"], "left_anti").select("kind", "stream", "venue", "date")
    rows = todo.collect()  # one row per stream, venue and day
    for kind in kinds:
        new = [r for r in rows if r["kind"] == kind]
        if new:
            keep = spark.createDataFrame([(r["venue"], r["date"]) for r in new], "venue string, date string")
            part = split_kind(dated, kind).join(F.broadcast(keep), ["venue", "date"], "left_semi").drop("kind")
            write_partitions(part, f"{root}/{STREAMS[kind]}", {"schema_ver": "1", "compactor_version": version, "source_log_hash": source_hash})
            written[STREAMS[kind]] = len(new)
    for r in sorted({(r["date"]) for r in rows}):
        day = dated.where(F.col("date") == r)
        start = day.select(bucket("recv_ts_ns", DAY_NS).alias("s")).first()["s"]
        m = quality_manifest(day, start, start + DAY_NS).withColumns({"day_start_ns": F.lit(start), "day_end_ns": F.lit(start + DAY_NS), "date": F.lit(r)})
        m.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("venue", "date").parquet(f"{root}/manifests")
    if rows:
        done = spark.createDataFrame([(r["stream"], r["venue"], r["date"], source_hash) for r in rows], LOG)
        done.write.mode("append").parquet(f"{root}/compaction_log")
    return written


def params_hash(params: dict) -> str:
    """Of the canonical form: key order and spacing do not matter."""
    return hashlib.sha256(json.dumps(params, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def resolve_version(spark, root: str, feature: str, params: dict) -> tuple[int, bool]:
    """(version, whether it is new): the one with these parameters, else the next."""
    known = _read(spark, f"{root}/feature_versions", "feature string, params_hash string, ver int").where(F.col("feature") == feature)
    h = params_hash(params)
    r = known.agg(F.max(F.when(F.col("params_hash") == h, F.col("ver"))).alias("same"), F.max("ver").alias("top")).first()
    return (r["same"], False) if r["same"] is not None else (0 if r["top"] is None else r["top"] + 1, True)


def materialize(features: DataFrame, root: str, feature: str, params: dict) -> int:
    """Write one feature under its version; another version is never overwritten."""
    spark = features.sparkSession
    ver, new = resolve_version(spark, root, feature, params)
    rows = features.withColumn("ver", F.lit(ver))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("venue").parquet(f"{root}/features/{feature}/ver={ver}")
    if new:
        spark.createDataFrame([(feature, params_hash(params), ver)], "feature string, params_hash string, ver int").write.mode("append").parquet(f"{root}/feature_versions")
    return ver


def append_once(df: DataFrame, path: str, keys: list[str]) -> bool:
    """Append the rows whose keys are not in the journal yet; whether any were."""
    old = _read(df.sparkSession, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))
    new = df.join(old.select(*keys).distinct(), keys, "left_anti")
    if new.isEmpty():
        return False
    new.write.mode("append").parquet(path)
    return True


def scd2_append(dim: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("venue", "venue_symbol")) -> DataFrame:
    """The history with new versions: each closes the one before at its own start."""
    both = dim.drop("valid_to_ns").unionByName(new.drop("valid_to_ns"), allowMissingColumns=True)
    return both.withColumn("valid_to_ns", F.lead("valid_from_ns").over(Window.partitionBy(*keys).orderBy("valid_from_ns")))


def intern_symbols(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(venue, venue_symbol, symbol_id): dense ids by first appearance; known ones stay, new ones follow.

    The numbering runs over distinct symbols only, in sorted ranges.
    """
    first = events.groupBy("venue", "venue_symbol").agg(F.min(F.struct("recv_ts_ns", "stream_seq")).alias("_at"))
    base = F.lit(0)
    if known is not None:
        first = first.join(known, ["venue", "venue_symbol"], "left_anti")
        base = known.agg(F.coalesce(F.max("symbol_id") + 1, F.lit(0)).alias("_b"))
        first = first.crossJoin(F.broadcast(base))
        base = F.col("_b")
    new = positions(first, ["_at", "venue", "venue_symbol"]).withColumn("symbol_id", (base + F.col("idx")).cast("long")).select("venue", "venue_symbol", "symbol_id")
    return new if known is None else known.select("venue", "venue_symbol", "symbol_id").unionByName(new)
