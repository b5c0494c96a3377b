"""Half-open intervals [start, end): union, difference, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class CoverageError(Exception):
    """Raised in ``refuse`` mode when data is missing."""


def merge_intervals(iv: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping and touching intervals joined."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    live = iv.where(F.col(end) > F.col(start))
    marked = live.withColumn("_new", (reach.isNull() | (F.col(start) > reach)).cast("int"))
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def subtract_intervals(spans: DataFrame, gaps: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """What is left of one span per key after its gaps are taken out."""
    merged = merge_intervals(gaps.select(*keys, start, end), keys, start, end)
    s = spans.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"))
    cut = s.join(merged, keys, "left")
    cut = cut.withColumns({start: F.least(F.greatest(F.col(start), F.col("_s")), F.col("_e")), end: F.least(F.greatest(F.col(end), F.col("_s")), F.col("_e"))})
    w = Window.partitionBy(*keys).orderBy(start)
    before = cut.select(*keys, F.coalesce(F.lag(end).over(w), F.col("_s")).alias("_a"), F.coalesce(F.col(start), F.col("_e")).alias("_b"))
    tail = cut.groupBy(*keys).agg(F.coalesce(F.max(end), F.max("_s")).alias("_a"), F.max("_e").alias("_b")).where(F.col("_a") < F.col("_b"))
    rest = before.unionByName(tail).where("_a < _b").select(*keys, F.col("_a").alias(start), F.col("_b").alias(end)).distinct()
    return rest


def check_coverage(covered: DataFrame, start_ns: int, end_ns: int, mode: str = "warn", keys: list[str] | None = None) -> DataFrame:
    """Gaps of [start, end) that ``covered`` leaves, leading and trailing ones included; ``refuse`` raises on any."""
    if mode not in ("warn", "refuse"):
        raise ValueError(f"unknown mode: {mode}")
    if end_ns < start_ns:
        raise ValueError("end before start")
    keys = keys or []
    key = keys or ["_all"]
    c = covered if keys else covered.withColumn("_all", F.lit(0))
    spark = covered.sparkSession
    ids = c.select(*key).distinct() if keys else spark.range(1).select(F.lit(0).alias("_all"))
    span = ids.withColumns({"start": F.lit(start_ns).cast("long"), "end": F.lit(end_ns).cast("long")})
    gaps = subtract_intervals(span, c, key).select(*keys, "start", "end")
    if mode == "refuse" and (first := gaps.orderBy("start").first()):
        raise CoverageError(f"missing data from {first['start']} to {first['end']}")
    return gaps


def coverage_share(gaps: DataFrame, keys: list[str], start_ns: int, end_ns: int, of: DataFrame | None = None) -> DataFrame:
    """1 minus the gaps' share of [start, end), gaps clipped and counted once; 1 for keys of ``of`` without gaps."""
    clip = gaps.select(*keys, F.greatest("start", F.lit(start_ns)).alias("start"), F.least("end", F.lit(end_ns)).alias("end"))
    total = merge_intervals(clip, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("gapped"))
    if of is not None:
        total = of.select(*keys).distinct().join(total, keys, "left")
    return total.select(*keys, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce("gapped", F.lit(0)) / max(end_ns - start_ns, 1))).alias("coverage"))
