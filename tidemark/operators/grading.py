"""Grading of hits by excess forward returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import forward_returns, forward_returns_at


def with_baseline(df: DataFrame, baseline: DataFrame, by: str = "symbol") -> DataFrame:
    """``avg_fwd`` of the symbol, 0 without one. (A dimension: Spark broadcasts it when it is small.)"""
    return df.join(baseline.select(by, "avg_fwd"), by, "left").withColumn("avg_fwd", F.coalesce("avg_fwd", F.lit(0.0)))


def excess_returns(hits: DataFrame, prices: DataFrame, horizon_ns: int, baseline: DataFrame, by: str = "symbol", seq: str | None = None) -> DataFrame:
    fwd = forward_returns(hits, prices, horizon_ns, by, seq=seq).where("fwd is not null")
    return with_baseline(fwd, baseline, by).withColumn("excess", F.col("fwd") - F.col("avg_fwd"))


def grade_hits(hits: DataFrame, prices: DataFrame, horizon_ns: int, baseline: DataFrame, by: str = "symbol", seq: str | None = None) -> DataFrame:
    """Per rule: n, wins, sum, average and win rate of the excess. Hits without a forward return do not count."""
    return _graded(excess_returns(hits, prices, horizon_ns, baseline, by, seq), ["rule"])


def _graded(x: DataFrame, keys: list[str]) -> DataFrame:
    g = x.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("excess") > 0).alias("wins"), F.sum("excess").alias("sum_excess"))
    return g.withColumns({"avg_excess": F.col("sum_excess") / F.col("n"), "win_rate": F.col("wins") / F.col("n")})


def grade_horizons(hits: DataFrame, prices: DataFrame, horizons: dict[str, int], baseline: DataFrame, by: str = "symbol") -> DataFrame:
    """``grade_hits`` of every horizon, in one pass over the prices: each hit is graded once for each."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("horizon"), F.lit(ns).cast("long").alias("_ns")) for name, ns in horizons.items())))
    h = hits.withColumn("_h", each).select(*hits.columns, "_h.horizon", "_h._ns")
    x = with_baseline(forward_returns_at(h, prices, "_ns", by).where("fwd is not null"), baseline, by).withColumn("excess", F.col("fwd") - F.col("avg_fwd"))
    return _graded(x, ["horizon", "rule"])


def leaderboard(grades: DataFrame) -> DataFrame:
    """Ranked by average excess, win rate, name. One row per rule: small, so one task may rank it."""
    return grades.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("avg_excess"), F.desc("win_rate"), "rule")))


def edge_decay(weekly: DataFrame, keys: tuple[str, ...] = ("rule",), week: str = "week") -> DataFrame:
    """``decayed``: twelve weeks known, their mean positive and the last four below half of it."""
    w = Window.partitionBy(*keys).orderBy(week)
    m12, m4 = F.avg("avg_excess").over(w.rowsBetween(-11, 0)), F.avg("avg_excess").over(w.rowsBetween(-3, 0))
    n = F.count("*").over(w.rowsBetween(-11, 0))
    return weekly.withColumn("decayed", (n >= 12) & (m12 > 0) & (m4 < 0.5 * m12))


def graduates(weekly: DataFrame, min_weeks: int = 8, keys: tuple[str, ...] = ("rule",), week: str = "week") -> DataFrame:
    """Rules whose last ``min_weeks`` graded weeks are all positive."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(week)))
    recent = weekly.withColumn("_n", last).where(F.col("_n") <= min_weeks)
    return recent.groupBy(*keys).agg(F.count("*").alias("weeks"), F.min("avg_excess").alias("worst")).where((F.col("weeks") >= min_weeks) & (F.col("worst") > 0))


def weekly_grading(week: str, hits: DataFrame, prices: DataFrame, horizon_ns: int, baseline: DataFrame, out: str) -> bool:
    """Append the week's leaderboard to the journal at ``out``; False if that week is there already."""
    from tidemark.sources.sinks import append_once

    board = leaderboard(grade_hits(hits, prices, horizon_ns, baseline)).withColumn("week", F.lit(week))
    return append_once(board, out, ["week"])
