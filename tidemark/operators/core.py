"""Total order, projections and filters over the event table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.scalar import DAY_NS, bucket_index, is_finite, signed
from tidemark.staging import staged

KEYS = ("venue", "symbol_id")
KINDS = ("trade", "book_delta", "book_snapshot", "funding", "mark_price", "open_interest", "liquidation", "index_price", "status")


def ordered(*keys: str, ts: str = "recv_ts_ns", seq: str = "stream_seq") -> WindowSpec:
    """Per key in the stream's total order; ties in time are broken by the sequence."""
    return Window.partitionBy(*(keys or KEYS)).orderBy(ts, seq)


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running(df: DataFrame, value: Column, keys: tuple[str, ...], name: str, fold=F.sum, ts: str = "recv_ts_ns", seq: tuple[str, ...] = ("stream_seq",), strict: bool = False, slice_ns: int = DAY_NS) -> DataFrame:
    """``fold`` (sum, max or min) of ``value`` over each key's rows up to this one (``strict``: before it).

    In two levels: what days hold gives each day's start, a window within the day the
    rest. So a busy key's whole history is not one task's sort. Rows without a key are one
    key; rows without a time come first.
    """
    day = bucket_index(ts, slice_ns)
    d = df.withColumns({"_day": day, "_v": value})
    days = d.groupBy(*keys, "_day").agg(fold("_v").alias("_all"))
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    start = days.withColumn("_start", fold("_all").over(before)).drop("_all")
    w = Window.partitionBy(*keys, "_day").orderBy(ts, *seq).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    within, first = F.col("_within"), F.col("_start")
    both = {F.sum: F.coalesce(first + within, first, within), F.max: F.greatest(first, within), F.min: F.least(first, within)}[fold]
    found = joined(d.withColumn("_within", fold("_v").over(w)), start, [*keys, "_day"], "inner")
    return found.withColumn(name, both).drop("_day", "_v", "_within", "_start")


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """An equality join in which nulls equal each other; the columns ``on`` appear once."""
    r = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return left.join(r, same, how).drop(*(f"_on_{c}" for c in on))


#: Rows of one key that one task sorts and folds at most, where keys with more are told beforehand.
MANY = 200_000


def crowded(by: list[str], *dfs: DataFrame, most: int | None = None) -> DataFrame:
    """Values of ``by`` that have more than ``most`` (``MANY``) rows in ``dfs`` taken together, written: what only few keys need is joined by its size."""
    rows = reduce(DataFrame.unionAll, [d.select(*by) for d in dfs])
    return staged(rows.groupBy(*by).count().where(F.col("count") > (MANY if most is None else most)).select(*by), "crowded")


def folded(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Callable[..., tuple]], reads: list[str], adds: str) -> DataFrame:
    """``df`` with the columns ``adds`` (a schema): what a fold over each key's ordered rows returns for every row.

    ``start`` gives a fresh step function for a key; a step gets the row's ``reads``. Rows
    are sorted within hash partitions and pass in batches, so no key is held in memory.
    """
    names = [x.split()[0] for x in adds.split(", ")]
    kinds = {"boolean": pa.bool_(), "string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    types = [kinds[x.split()[1]] for x in adds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, step = None, None
        for batch in batches:
            rows = []
            key_rows = zip(*(batch.column(k).to_pylist() for k in keys))
            for key, values in zip(key_rows, zip(*(batch.column(c).to_pylist() for c in reads))):
                if step is None or key != at:
                    at, step = key, start()
                rows.append(step(*values))
            new = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(c), t) for c, t in zip(new, types))], [*batch.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + adds
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def split_kind(events: DataFrame, kind: str) -> DataFrame:
    if kind not in KINDS:
        raise ValueError(f"unknown kind: {kind}")
    return events.where(F.col("kind") == kind)


def recv_slice(df: DataFrame, start_ns: int, end_ns: int, ts: str = "recv_ts_ns") -> DataFrame:
    return df.where((F.col(ts) >= start_ns) & (F.col(ts) < end_ns))


def merged(*dfs: DataFrame) -> DataFrame:
    """All rows with ``source_idx``; (recv_ts_ns, stream_seq, source_idx) is their total order."""
    return reduce(DataFrame.unionByName, [d.withColumn("source_idx", F.lit(i)) for i, d in enumerate(dfs)])


def in_order(df: DataFrame) -> DataFrame:
    """Globally sorted, for a sink that needs it."""
    return df.orderBy("recv_ts_ns", "stream_seq", *(["source_idx"] if "source_idx" in df.columns else []))


def whale_prints(trades: DataFrame, floor_usd: float) -> DataFrame:
    notional = F.col("price") * F.col("qty")
    return trades.where(notional >= floor_usd).withColumn("value", signed(notional))


def funding_feature(events: DataFrame) -> DataFrame:
    f = split_kind(events, "funding")
    return f.select(*KEYS, "recv_ts_ns", "stream_seq", F.concat(F.lit("funding."), "venue").alias("feature"), F.col("rate").alias("value"))


def finite_only(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a finite value, and how many of each feature were suppressed."""
    ok = is_finite("value")
    return features.where(ok), features.groupBy("feature").agg(F.count_if(~ok).alias("suppressed"))


def feature_stream(*frames: DataFrame) -> DataFrame:
    """Features in registration order. ``emit_ts_ns`` is when a value became known (default: its own time)."""
    out = []
    for i, f in enumerate(frames):
        if "emit_ts_ns" not in f.columns:
            f = f.withColumn("emit_ts_ns", F.col("ts_ns"))
        if "emit_seq" not in f.columns:
            f = f.withColumn("emit_seq", F.lit(None).cast("long"))
        out.append(f.select("feature", *KEYS, "ts_ns", "emit_ts_ns", "emit_seq", F.col("value").cast("double").alias("value")).withColumn("reg_idx", F.lit(i)))
    return reduce(DataFrame.unionByName, out)


def warm(features: DataFrame, warmup: int, *keys: str, ts: str = "ts_ns", seq: str = "emit_seq") -> DataFrame:
    """Leave out each key's first ``warmup`` values, counted in slices of time."""
    n = running(features, F.lit(1).cast("long"), keys or ("feature", *KEYS), "_n", ts=ts, seq=(seq,))
    return n.where(F.col("_n") > warmup).drop("_n")


def latest(df: DataFrame, keys: list[str], value: str, ts: str = "ts_ns", seq: str = "stream_seq") -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(ts, seq)).alias(value), F.max(ts).alias(ts))


def first_by_key(df: DataFrame, keys: list[str], ts: str = "ts_ns", seq: str = "seq") -> DataFrame:
    """The first row of each key: idempotent submits. An aggregate, so a key's repeats are dropped before they move."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(ts, seq)).alias("_row")).select("_row.*")


def sorted_ranges(df: DataFrame, order: list[str], name: str = "sorted_ranges") -> DataFrame:
    """``df`` cut into sorted ranges of ``order``, written once: ``_p`` is a row's range, ``_i`` its place there.

    Whatever is derived from the result, sizes of ranges as well as places in them, reads the
    same written rows. Cutting twice would not do: every plan samples bounds of its own.
    Rows that tie in ``order`` are dealt by a hash of all their columns.
    """
    tie = F.xxhash64(*df.columns)
    cut = df.withColumn("_tie", tie).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    at = F.monotonically_increasing_id()  # the partition in the upper bits, the row's place in the lower 33
    rows = staged(cut.withColumn("_at", at), name)
    return rows.withColumns({"_p": F.shiftright("_at", 33), "_i": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at")


def rank_pick(df: DataFrame, value: str, index: Column, keys: list[str]) -> DataFrame:
    """The value at an exact rank (from 0) of each key's sorted values. ``index`` may use ``_n``, the key's rows.

    Equal values are counted first, then their counts are summed in ranges of values of
    the whole table, so that a key's rows need not be sorted by one task.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    ranged = sorted_ranges(counts, [*keys, value], "rank_ranges")
    parts = ranged.groupBy(*keys, "_p").agg(F.sum("_c").alias("_sum"))
    base = parts.select(*keys, "_p", F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("_sum").over(Window.partitionBy(*keys)).alias("_n"))
    upto_here = F.sum("_c").over(Window.partitionBy(*keys, "_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    placed = joined(ranged.withColumn("_w", upto_here), base, [*keys, "_p"], "inner")
    want = F.least(F.greatest(index, F.lit(0)), F.col("_n") - 1)
    end = F.col("_base") + F.col("_w")
    return placed.where((want < end) & (want >= end - F.col("_c"))).select(*keys, value)


def first_divergence(a: DataFrame, b: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """(idx): the first position at which two ordered logs differ, no row if they agree.

    Positions come from range-sorted partitions and their sizes, so no single task sees a whole log.
    """
    both = positions(a, order).select("idx", F.struct(*columns).alias("a")).join(positions(b, order).select("idx", F.struct(*columns).alias("b")), "idx", "full_outer")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).agg(F.min("idx").alias("idx")).where("idx is not null")


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """``idx`` from 0 in the given order, by two levels: sizes of sorted ranges, then places within."""
    ranged = sorted_ranges(df, order)
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_c"))  # as many rows as ranges
    before = sizes.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return ranged.join(F.broadcast(before), "_p").withColumn("idx", F.col("_base") + F.col("_i")).drop("_p", "_i", "_base")
