"""As-of joins, validity ranges and forward returns.

An as-of join is a union of both sides and a running last value within slices of
time, to which the last value of earlier slices is carried: no range join, any number
of rows a key.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import DAY_NS, bucket_index
from tidemark.operators.core import joined
from tidemark.staging import staged


def asof(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str], seq: str | None = None, forward: bool = False, strict: bool = False, slice_ns: int = DAY_NS, busy: DataFrame | None = None) -> DataFrame:
    """``left`` with the ``values`` of the last ``right`` row at or before it (``forward``: first at or after).

    Of right rows at the same time the last by ``seq`` wins (forward: the first);
    ``strict`` leaves out equal times. In two levels: the last right row of each slice of
    time is carried to later slices, so a busy key is dealt by slices. Every left row stays:
    one without a key or a time finds nothing, and such right rows are not found. With ``busy``
    (``core.crowded`` of some of ``by``) only its keys are dealt by slices; others are each one task's.
    """
    order_seq = F.col(seq) if seq else F.lit(0)
    l = left.select(*by, F.col(left_on).alias("_t"), F.lit(None).alias("_q"), F.struct(*left.columns).alias("_l"), F.lit(None).alias("_r"))
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in dict.fromkeys([*by, right_on])])
    r = right.where(known).select(*by, F.col(right_on).alias("_t"), order_seq.alias("_q"), F.lit(None).alias("_l"), F.struct(*values).alias("_r"))
    both, slot, cut = l.unionByName(r), bucket_index("_t", slice_ns), [*by, "_s"]
    few = busy is not None and busy.isEmpty()
    if few:
        cut = by
    elif busy is None:
        both = both.withColumn("_s", slot)
    else:
        both = joined(both, busy.withColumn("_busy", F.lit(True)), busy.columns).withColumn("_s", F.when(F.col("_busy"), slot))
    ends = (F.min_by if forward else F.max_by)("_r", F.when(F.col("_r").isNotNull(), F.struct("_t", "_q")))
    slices = Window.partitionBy(*by).orderBy(F.desc("_s") if forward else F.col("_s")).rowsBetween(Window.unboundedPreceding, -1)
    # Where right rows of the same time count, they stand on the near side of the left row.
    is_left = F.col("_l").isNotNull().cast("int")
    if forward:
        w = Window.partitionBy(*cut).orderBy(F.desc("_t"), -is_left if strict else is_left, F.desc("_q"))
    else:
        w = Window.partitionBy(*cut).orderBy("_t", -is_left if strict else is_left, "_q")
    found = both.withColumn("_v", F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = found.where("_l is not null")
    if few:
        found = found.withColumn("_before", F.lit(None))
    else:
        carried = (both if busy is None else both.where("_busy")).groupBy(*by, "_s").agg(ends.alias("_end")).select(*by, "_s", F.last("_end", ignorenulls=True).over(slices).alias("_before"))
        found = joined(found, carried if busy is None else staged(carried, "carried"), [*by, "_s"])
    found = found.withColumn("_v", F.when(F.col("_t").isNotNull(), F.coalesce("_v", "_before")))
    return found.select("_l.*", *(F.col(f"_v.{v}").alias(v) for v in values))


class AsOf(NamedTuple):
    """A right side of ``asof_each``: the ``values`` of the last of ``rows`` of the same ``by`` at or before a left row.

    Of rows at the same time the last by ``seq`` wins; ``strict`` leaves out equal times; with ``within`` only rows
    of the left row's own slice of time count.
    """

    rows: DataFrame
    by: list[str]
    on: str
    values: list[str]
    seq: str | None = None
    strict: bool = False
    within: bool = False


def asof_each(left: DataFrame, left_on: str, deal: list[str], rights: list[AsOf], slice_ns: int | None = None) -> DataFrame:
    """Several as-of joins in which each row moves once: all rows are dealt by ``deal``, a part of every side's ``by``.

    Without ``slice_ns`` each value of ``deal`` is one task's. Else it is dealt by slices of time, and what earlier
    slices end with becomes one more row at the beginning of a slice; for these few rows ``left`` and the sides that are not
    ``within`` are read twice. Rows without a key or a time are treated as in ``asof``.
    """
    slot = lambda c: bucket_index(c, slice_ns) if slice_ns else F.lit(None).cast("long")
    keys = list(dict.fromkeys(c for r in rights for c in [*deal, *r.by]))
    both = left.select(*keys, F.col(left_on).cast("long").alias("_t"), slot(left_on).alias("_s"), F.struct(*left.columns).alias("_l"))
    for i, (rows, by, on, values, seq, _, within) in enumerate(rights):
        known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in dict.fromkeys([*by, on])])
        r = rows.where(known).select(*by, F.col(on).cast("long").alias("_t"), slot(on).alias("_s"), (F.col(seq) if seq else F.lit(0)).cast("long").alias("_q"), F.struct(*values).alias(f"_r{i}"))
        both = both.unionByName(r, True)
        if slice_ns and not within:
            ends = r.groupBy(*by, "_s").agg(F.max_by(f"_r{i}", F.struct("_t", "_q")).alias("_end"))
            asked = left.select(*by, slot(left_on).alias("_s")).distinct()
            earlier = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
            slices = ends.unionByName(asked, True).groupBy(*by, "_s").agg(F.first("_end", True).alias("_end"))
            carried = slices.select(*by, "_s", F.last("_end", True).over(earlier).alias(f"_r{i}")).where(F.col(f"_r{i}").isNotNull() & F.col("_s").isNotNull())
            both = both.unionByName(carried.withColumn("_t", F.col("_s") * slice_ns - 1), True)
    both = both.repartition(*deal, *(["_s"] if slice_ns else []))
    is_left = F.col("_l").isNotNull().cast("int")
    for i, r in enumerate(rights):
        w = Window.partitionBy(*dict.fromkeys([*deal, *r.by]), *(["_s"] if slice_ns else [])).orderBy("_t", -is_left if r.strict else is_left, "_q")
        both = both.withColumn(f"_v{i}", F.last(f"_r{i}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    timed = F.col("_t").isNotNull()
    return both.where("_l is not null").select("_l.*", *(F.when(timed, F.col(f"_v{i}.{v}")).alias(v) for i, r in enumerate(rights) for v in r.values))


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], on: str, cols: list[str], seq: str | None = None) -> DataFrame:
    return asof(left, right, by, on, on, cols, seq)


def scd2_as_of(df: DataFrame, dim: DataFrame, ts: str, by: list[str], values: list[str], valid_from: str = "valid_from_ns", valid_to: str = "valid_to_ns") -> DataFrame:
    """The dimension row with valid_from <= ts < valid_to; null values where none holds."""
    d = dim.select(*by, F.col(valid_from).alias("_from"), F.struct(F.col(valid_to).alias("_to"), *values).alias("_d"))
    found = asof(df, d, by, ts, "_from", ["_d"])
    live = F.col("_d._to").isNull() | (F.col(ts) < F.col("_d._to"))
    return found.select(*df.columns, *(F.when(live, F.col(f"_d.{v}")).alias(v) for v in values))


def forward_returns(hits: DataFrame, prices: DataFrame, horizon_ns: int, by: str = "symbol", ts: str = "ts_ns", seq: str | None = None) -> DataFrame:
    """``fwd``: exit over entry minus one; null without both prices, for a zero entry or if the series ends early."""
    return forward_returns_at(hits.withColumn("_horizon", F.lit(horizon_ns).cast("long")), prices, "_horizon", by, ts, seq).drop("_horizon")


def forward_returns_at(hits: DataFrame, prices: DataFrame, horizon: str, by: str = "symbol", ts: str = "ts_ns", seq: str | None = None) -> DataFrame:
    """``fwd`` over each row's own ``horizon``: two as-of joins, by slices of time, and a series' last time."""
    px = prices.select(by, F.col(ts).alias("_at"), F.struct(F.col("price").cast("double").alias("p")).alias("_px"), (F.col(seq) if seq else F.lit(0)).cast("long").alias("_q"))
    px = px.where("_px.p is not null")
    h = asof(hits, px.withColumnRenamed("_px", "_entry"), [by], ts, "_at", ["_entry"], "_q")
    h = asof(h.withColumn("_end", F.col(ts) + F.col(horizon)), px.withColumnRenamed("_px", "_exit"), [by], "_end", "_at", ["_exit"], "_q")
    h = joined(h, prices.where("price is not null").groupBy(by).agg(F.max(ts).alias("_stop")), [by])
    a, b = F.col("_entry.p"), F.col("_exit.p")
    ok = a.isNotNull() & b.isNotNull() & (a != 0) & (F.col("_stop") >= F.col("_end"))
    return h.select(*hits.columns, F.when(ok, F.try_divide(b, a) - 1).alias("fwd"))
