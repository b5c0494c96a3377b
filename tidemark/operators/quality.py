"""Data quality: gaps, manifests, prune checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.core import KEYS, ordered
from tidemark.operators.intervals import merge_intervals


def open_close(df: DataFrame, opens, closes, day_end_ns: int, keys: tuple[str, ...], extra: dict | None = None) -> DataFrame:
    """Stretches from an opening row (repeats ignored) to the next closing one, else to the day's end."""
    marks = df.withColumn("_open", F.when(opens, True).when(closes, False)).where("_open is not null")
    w = ordered(*keys)
    marks = marks.withColumn("_before", F.lag("_open").over(w)).where("_open <> coalesce(_before, false)")
    ends = F.coalesce(F.lead("recv_ts_ns").over(w), F.lit(day_end_ns))
    return marks.withColumn("to_ns", ends).where("_open").select(*keys, F.col("recv_ts_ns").alias("from_ns"), "to_ns", *(v.alias(k) for k, v in (extra or {}).items()))


def disconnect_gaps(events: DataFrame, day_end_ns: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    k = F.col("status_kind")
    return open_close(events.where("kind = 'status'"), k == "Disconnected", k == "Connected", day_end_ns, keys, {"gap_kind": F.lit("Disconnect")})


def sequence_gaps(events: DataFrame, day_end_ns: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    opens = (F.col("kind") == "status") & (F.col("status_kind") == "GapDetected")
    closes = (F.col("kind") == "book_snapshot") & (F.col("reason") == "GapResync")
    kind = F.when(F.contains(F.coalesce("detail", F.lit("")), F.lit("overrun")), "Overrun").otherwise("Venue")
    return open_close(events, opens, closes, day_end_ns, keys, {"gap_kind": kind})


def quality_manifest(events: DataFrame, day_start_ns: int, day_end_ns: int, keys: tuple[str, ...] = KEYS, sampled: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per key and stream: events, first and last time, gaps and the share of the day outside them.

    Events are only aggregated; gaps come from the few status rows.
    """
    named = F.when(F.col("kind") == "trade", "trades").when(F.col("kind") == "book_delta", "book_deltas").when(F.col("kind") == "book_snapshot", "book_snapshots").when(F.col("kind") == "liquidation", "liquidations").otherwise(F.col("kind"))
    stats = events.where("kind <> 'status'").groupBy(*keys, named.alias("stream")).agg(F.count("*").alias("events"), F.min("recv_ts_ns").alias("first_ts_ns"), F.max("recv_ts_ns").alias("last_ts_ns"))
    disc = disconnect_gaps(events, day_end_ns, keys).withColumn("only", F.lit(None).cast("string"))
    parts = disc
    if "reason" in events.columns:
        parts = disc.unionByName(sequence_gaps(events, day_end_ns, keys).withColumn("only", F.lit("book_deltas")))
    of_stream = stats.select(*keys, "stream").join(parts, list(keys)).where("only is null or only = stream")
    gaps = of_stream.groupBy(*keys, "stream").agg(F.sort_array(F.collect_list(F.struct("from_ns", "to_ns", F.col("gap_kind").alias("kind")))).alias("gaps"))
    clip = of_stream.select(*keys, "stream", F.greatest("from_ns", F.lit(day_start_ns)).alias("start"), F.least("to_ns", F.lit(day_end_ns)).alias("end"))
    lost = merge_intervals(clip, [*keys, "stream"]).groupBy(*keys, "stream").agg(F.sum(F.col("end") - F.col("start")).alias("lost"))
    out = stats.join(gaps, [*keys, "stream"], "left").join(lost, [*keys, "stream"], "left")
    share = 1 - F.coalesce("lost", F.lit(0)) / F.lit(float(max(day_end_ns - day_start_ns, 1)))
    is_sampled = F.lit(False)
    for venue, stream in sampled or []:
        is_sampled = is_sampled | ((F.col("venue") == venue) & (F.col("stream") == stream))
    none = F.array().cast("array<struct<from_ns:bigint,to_ns:bigint,kind:string>>")
    return out.withColumns({"gaps": F.coalesce("gaps", none), "coverage": F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)), "sampled": is_sampled}).drop("lost")


def verify_prunable(manifests: DataFrame, trades: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Problems that forbid deleting the raw log: no manifest, no data, other row counts. Empty: safe."""
    have = trades.groupBy(*keys).agg(F.count("*").alias("rows"))
    want = manifests.where("stream = 'trades'").select(*keys, "events")
    both = want.join(have, list(keys), "full_outer")
    problem = F.when(F.col("events").isNull(), "ManifestMissing").when(F.col("rows").isNull(), "TradesFileMissing").when(F.col("rows") != F.col("events"), "RowCountMismatch")
    return both.withColumn("problem", problem).where("problem is not null")


def coverage(manifests: DataFrame, **where) -> DataFrame:
    for k, v in where.items():
        manifests = manifests.where(F.col(k) == v)
    return manifests.select(*[c for c in manifests.columns if c not in ("gaps",)])


def gaps(manifests: DataFrame, **where) -> DataFrame:
    for k, v in where.items():
        manifests = manifests.where(F.col(k) == v)
    return manifests.select(*[c for c in manifests.columns if c not in ("gaps", "coverage", "events", "first_ts_ns", "last_ts_ns", "sampled")], F.explode("gaps").alias("gap")).select("*", "gap.*").drop("gap")


def stale_streams(events: DataFrame, thresholds: dict[str, int], default_ns: int, now_ns: int, key: str = "topic", ts: str = "recv_ts_ns") -> DataFrame:
    """Topics silent for longer than their threshold; a threshold of zero or less never complains."""
    limit = F.lit(default_ns)
    for topic, ns in thresholds.items():
        limit = F.when(F.col(key) == topic, F.lit(ns)).otherwise(limit)
    last = events.groupBy(key).agg(F.max(ts).alias("last_ns")).withColumns({"limit_ns": limit, "silent_ns": F.lit(now_ns) - F.col("last_ns")})
    return last.where("limit_ns > 0 and silent_ns > limit_ns")
