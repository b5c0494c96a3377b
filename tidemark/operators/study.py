"""Event studies, bootstraps and walk-forward slices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import bucket, bucket_index, draw


def event_windows(events: DataFrame, excess: DataFrame, bar_ns: int, pre: int, post: int, by: list[str] | None = None) -> DataFrame:
    """Each event's excess at offsets -pre..post; events that miss a bar are left out."""
    by = by or []
    e = events.withColumn("event_id", F.monotonically_increasing_id())
    e = e.withColumn("offset", F.explode(F.sequence(F.lit(-pre), F.lit(post)))).withColumn("bar_ts", F.col("ts_ns") + F.col("offset") * bar_ns)
    j = e.join(excess.select(*by, F.col("ts_ns").alias("bar_ts"), "excess"), [*by, "bar_ts"])
    n = F.count("*").over(Window.partitionBy("event_id"))
    return j.withColumn("_n", n).where(F.col("_n") == pre + post + 1).drop("_n", "bar_ts")


def car(events: DataFrame, excess: DataFrame, bar_ns: int, pre: int, post: int, by: list[str] | None = None, group: str | None = None) -> DataFrame:
    """Mean excess of each offset and its running sum; zeros if no event is complete."""
    w = event_windows(events, excess, bar_ns, pre, post, by)
    keys = [group] if group else []
    if group:
        w = w.withColumn(group, F.coalesce(group, F.lit("_all")))
    mean = w.groupBy(*keys, "offset").agg(F.avg("excess").alias("mean_excess"))
    if not group:
        grid = events.sparkSession.range(-pre, post + 1).select(F.col("id").cast("int").alias("offset"))
        mean = grid.join(mean, "offset", "left").withColumn("mean_excess", F.coalesce("mean_excess", F.lit(0.0)))
    order = Window.partitionBy(*keys).orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    return mean.withColumn("car", F.sum("mean_excess").over(order))


def car_by_regime(events: DataFrame, excess: DataFrame, bar_ns: int, pre: int, post: int, by: list[str] | None = None) -> DataFrame:
    return car(events, excess, bar_ns, pre, post, by, "regime")


def terminals(events: DataFrame, excess: DataFrame, bar_ns: int, pre: int, post: int, by: list[str] | None = None) -> DataFrame:
    """Each complete event's sum over its window."""
    own = [F.first(c).alias(c) for c in by or []]
    return event_windows(events, excess, bar_ns, pre, post, by).groupBy("event_id").agg(F.min("ts_ns").alias("ts_ns"), *own, F.sum("excess").alias("terminal"))


def bootstrap_ci(values: DataFrame, column: str, order: list[str], seed: int = 7, n_boot: int = 1000, alpha: float = 0.05) -> DataFrame:
    """Percentile interval (lo, hi, n) of the mean under resampling; (0, 0, 0) without values.

    Draws are counter-based, so every replicate is computed on its own: the draws are
    generated in parallel and joined on the value's place.
    """
    spark = values.sparkSession
    v = values.select(column, *[o for o in order if o != column])
    n = v.count()
    if n == 0:
        return spark.range(1).select(F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), F.lit(0).cast("long").alias("n"))
    from tidemark.operators.core import positions

    placed = positions(v, order).select("idx", F.col(column).cast("double").alias("v"))
    cells = spark.range(0, n_boot * n).select((F.col("id") / n).cast("long").alias("rep"), (F.col("id") % n).alias("i"))
    means = cells.select("rep", (draw(seed, "rep", "i") % n).alias("idx")).join(placed, "idx").groupBy("rep").agg(F.avg("v").alias("m"))
    return _interval(means, n, n_boot, alpha)


def _interval(means: DataFrame, n: int, n_boot: int, alpha: float) -> DataFrame:
    rank = F.row_number().over(Window.orderBy("m")) - 1  # n_boot rows
    lo, hi = int(alpha / 2 * n_boot), min(n_boot - 1, int((1 - alpha / 2) * n_boot))
    ranked = means.withColumn("_i", rank)
    return ranked.agg(F.max(F.when(F.col("_i") == lo, F.col("m"))).alias("lo"), F.max(F.when(F.col("_i") == hi, F.col("m"))).alias("hi")).withColumn("n", F.lit(n).cast("long"))


def _generator(seed: int, node: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=np.array([seed, node], np.uint64)))


def block_draws(seed: int, n: int, width: int, block: int, n_boot: int) -> np.ndarray:
    """How many of each replicate's ``n`` draws fall in ``block`` of the blocks of ``width`` places.

    All draws start at the root of a binary tree over the blocks; at each node a binomial number of them goes left.
    A node's generator is named by the node, so blocks that pass it on their own ways agree without speaking.
    """
    size = lambda a, z: min(z * width, n) - a * width
    lo, hi, node, k = 0, -(-n // width), 1, np.full(n_boot, n, np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _generator(seed, node).binomial(k, size(lo, mid) / size(lo, hi))
        if block < mid:
            hi, node, k = mid, 2 * node, left
        else:
            lo, node, k = mid, 2 * node + 1, k - left
    return k


def block_sums(values: np.ndarray, seed: int, n: int, width: int, block: int, n_boot: int) -> np.ndarray:
    """Each replicate's sum over the draws from one block's values, which are in the order of their places."""
    g = _generator(seed, (1 << 63) + block)
    return np.array([values[g.integers(0, len(values), k)].sum() for k in block_draws(seed, n, width, block, n_boot)])


def bootstrap_by_splitting(values: DataFrame, column: str, order: list[str], seed: int = 7, n_boot: int = 1000, alpha: float = 0.05, width: int = 65_536) -> DataFrame:
    """``bootstrap_ci`` for many values: the same distribution, but draws of its own, of which none is shuffled.

    Values go in blocks of ``width`` places. Every block works out how many draws each replicate makes in it
    (``block_draws``), draws them and gives one sum a replicate: values move once, then ``n_boot`` rows a task.
    Null values are left out. Rows that tie in ``order`` change the draws only if their values differ.
    """
    from tidemark.operators.core import positions

    spark = values.sparkSession
    v = values.where(F.col(column).isNotNull()).select(column, *[o for o in order if o != column])
    n = v.count()
    if n == 0:
        return spark.range(1).select(F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), F.lit(0).cast("long").alias("n"))
    placed = positions(v, order).select("idx", F.col(column).cast("double").alias("v"), bucket_index("idx", width).alias("_block"))

    def sums(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        x = rows["v"].to_numpy()[np.argsort(rows["idx"].to_numpy())]
        return pa.table({"rep": np.arange(n_boot, dtype=np.int32), "s": block_sums(x, seed, n, width, key[0].as_py(), n_boot)})

    means = placed.groupBy("_block").applyInArrow(sums, "rep int, s double").groupBy("rep").agg((F.sum("s") / n).alias("m"))
    return _interval(means, n, n_boot, alpha)


def event_study(events: DataFrame, excess: DataFrame, bar_ns: int, pre: int, post: int, by: list[str] | None = None, seed: int = 7, n_boot: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The CAR curve, and the interval of the mean terminal CAR with the number of complete events."""
    curve = car(events, excess, bar_ns, pre, post, by)
    t = terminals(events, excess, bar_ns, pre, post, by)
    # In an order that a second run repeats, which the generated ids are not.
    return curve, bootstrap_ci(t, "terminal", ["ts_ns", *(by or []), "terminal"], seed, n_boot)


def mc_drawdown(trades: DataFrame, resamples: int, seed: int, block_ns: int, keys: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Percentiles of the largest drawdown when whole blocks of trades are drawn with replacement.

    Blocks are drawn until they hold as many trades as there are. A path's drawdown is
    put together from its blocks' sums, peaks and drawdowns, so trades are read once
    and a replicate moves one row per block.
    """
    t = trades.withColumn("_b", bucket("ts_ns", block_ns))
    in_block = Window.partitionBy(*keys, "_b").orderBy("ts_ns", *(["seq"] if "seq" in trades.columns else []))
    t = t.withColumn("_eq", F.sum("pnl").over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("_pk", F.greatest(F.max("_eq").over(in_block.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    blocks = t.groupBy(*keys, "_b").agg(F.count("*").alias("cnt"), F.sum("pnl").alias("total"), F.max("_eq").alias("peak"), F.max(F.col("_pk") - F.col("_eq")).alias("dd"), F.min("_eq").alias("low"))
    blocks = blocks.withColumns({"bi": F.row_number().over(Window.partitionBy(*keys).orderBy("_b")) - 1, "nb": F.count("*").over(Window.partitionBy(*keys)), "target": F.sum("cnt").over(Window.partitionBy(*keys))})
    sizes = blocks.groupBy(*keys).agg(F.first("nb").alias("nb"), F.first("target").alias("target"), F.min("cnt").alias("least"))
    # Enough draws for any luck: as many as the smallest block would need.
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("target") / F.col("least")), F.lit(1)).cast("int") - 1)
    draws = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("i", F.explode(steps))
    draws = draws.select(*keys, "rep", "i", (draw(seed, "rep", "i") % F.col("nb")).cast("int").alias("bi"))
    path = draws.join(blocks.select(*keys, "bi", "cnt", "total", "peak", "dd", "low", "target"), [*keys, "bi"])
    order = Window.partitionBy(*keys, "rep").orderBy("i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    path = path.withColumns({"_had": F.coalesce(F.sum("cnt").over(before), F.lit(0)), "_eq": F.coalesce(F.sum("total").over(before), F.lit(0.0))}).where(F.col("_had") < F.col("target"))
    path = path.withColumn("_top", F.greatest(F.coalesce(F.max(F.col("_eq") + F.col("peak")).over(before), F.lit(0.0)), F.lit(0.0)))
    dd = path.groupBy(*keys, "rep").agg(F.greatest(F.max("dd"), F.max(F.col("_top") - (F.col("_eq") + F.col("low"))), F.lit(0.0)).alias("dd"))
    ranked = dd.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("dd")) - 1)
    pick = lambda q: F.max(F.when(F.col("_i") == int(q * (resamples - 1) + 0.5), F.col("dd")))
    out = ranked.groupBy(*keys).agg(pick(0.5).alias("p50_max_dd"), pick(0.95).alias("p95_max_dd"), F.max("dd").alias("worst_max_dd"))
    return out.withColumn("dd_budget", F.greatest("p95_max_dd", F.lit(0.0)) * 1.25)


def walk_forward(df: DataFrame, train_ns: int, test_ns: int, step_ns: int, keys: tuple[str, ...] = (), ts: str = "ts_ns") -> DataFrame:
    """Rows with the windows they belong to: ``window_id``, ``part`` (train or test) and the window's start.

    The windows of a row follow from its time, so each row makes its own copies; no range join.
    """
    span = df.agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    d = df.crossJoin(F.broadcast(span)) if not keys else df.join(df.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi")), list(keys))
    since = F.col(ts) - F.col("_lo")
    top = F.floor((F.col("_hi") + 1 - F.col("_lo") - train_ns - test_ns) / step_ns)
    first = F.greatest(F.floor((since - train_ns - test_ns) / step_ns) + 1, F.lit(0))
    last = F.least(F.floor(since / step_ns), top)
    w = d.where(first <= last).withColumn("window_id", F.explode(F.sequence(first, last)))
    start = F.col("_lo") + F.col("window_id") * step_ns
    return w.withColumns({"window_start_ns": start, "part": F.when(F.col(ts) < start + train_ns, "train").otherwise("test")}).drop("_lo", "_hi")


def plateau_ok(points: DataFrame, keys: tuple[str, ...] = (), max_delta: float = 0.30) -> DataFrame:
    """Whether no point within ``max_delta`` of the base changes the result's sign. Columns: delta, expectancy, base."""
    near = F.abs("delta") <= max_delta + 1e-9
    same = (F.col("expectancy") > 0) == (F.col("base") > 0)
    return points.groupBy(*keys).agg(F.bool_and(~near | same).alias("ok"))
