"""Scans over each key's rows in order, in slices: no task sorts or holds a whole key.

Each slice is summed up in a value that merges with its neighbours', a scan of these few
values gives every slice its start, and a window within the slice gives the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import bucket_index
from tidemark.operators.core import joined, sorted_ranges
from tidemark.staging import staged

HOUR_NS = 3_600_000_000_000
#: A fold by name: kind (sum, max, min or last: the last that is not null), value, and whether the row itself is left out.
Folds = dict[str, tuple[str, Column, bool]]


def scanned(df: DataFrame, keys: list[str], folds: Folds, ts: str = "recv_ts_ns", seq: tuple[str, ...] = ("stream_seq",), slice_ns: int = HOUR_NS, keep: bool = False, busy: DataFrame | None = None) -> DataFrame:
    """``df`` with a column for each of ``folds`` over the key's rows up to each row, all in one pass over slices of time.

    Rows that have no key are one key; rows without a time come first. Slices and rows both read ``df``:
    ``keep`` writes the rows first, for scans of scans. With ``busy`` (``core.crowded`` of some of ``keys``) only
    its keys are cut in slices: where keys have few rows, there are about as many slices as rows.
    """
    values = {f"_v_{n}": v for n, (_, v, _) in folds.items()}
    d = df.withColumns({"_slice": bucket_index(ts, slice_ns)} | values)
    at = F.struct(ts, *seq)

    def total(kind: str, c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), at)) if kind == "last" else getattr(F, kind)(c)

    def over(kind: str, c: str, w) -> Column:
        return F.last(c, True).over(w) if kind == "last" else getattr(F, kind)(c).over(w)

    def merge(kind: str, before: Column, own: Column) -> Column:
        if kind == "sum":
            return F.coalesce(before + own, before, own)
        return F.coalesce(own, before) if kind == "last" else {"max": F.greatest, "min": F.least}[kind](before, own)

    none = busy is not None and busy.isEmpty()
    if none:
        d = d.withColumn("_slice", F.lit(None).cast("long"))
    elif busy is not None:
        d = joined(d, busy.withColumn("_busy", F.lit(True)), busy.columns).withColumn("_slice", F.when(F.col("_busy"), F.col("_slice")))
    if keep:
        d = staged(d, "scanned")
    order = (Window.partitionBy(*keys) if none else Window.partitionBy(*keys, "_slice")).orderBy(ts, *seq)
    upto = {strict: order.rowsBetween(Window.unboundedPreceding, -1 if strict else 0) for strict in (False, True)}
    rows = d.withColumns({f"_w_{n}": over(k, f"_v_{n}", upto[strict]) for n, (k, _, strict) in folds.items()})
    if none:
        d = rows.withColumns({n: F.col(f"_w_{n}") for n in folds})
        return d.select(*[c for c in d.columns if c in folds or c in df.columns])
    if busy is not None:
        d = d.where("_busy")
    slices = d.groupBy(*keys, "_slice").agg(*(total(k, f"_v_{n}").alias(f"_v_{n}") for n, (k, _, _) in folds.items()))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select(*keys, "_slice", *(over(k, f"_v_{n}", earlier).alias(f"_b_{n}") for n, (k, _, _) in folds.items()))
    some = reduce(lambda x, y: x | y, [F.col(f"_b_{n}").isNotNull() for n in folds])
    starts = staged(starts.where(some), "starts")  # a first slice needs none; written, since its size decides how it is joined
    d = joined(rows, starts, [*keys, "_slice"])
    d = d.withColumns({n: merge(k, F.col(f"_b_{n}"), F.col(f"_w_{n}")) for n, (k, _, _) in folds.items()})
    return d.select(*[c for c in d.columns if c in folds or c in df.columns])


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``, each row's place within its key from 0: places within sorted ranges, and rows of earlier ranges."""
    r = sorted_ranges(df, [*keys, *order], "ranked")
    parts = r.groupBy(*keys, "_p").agg(F.min("_i").alias("_first"), F.count("*").alias("_c"))
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "_p", "_first", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_base"))
    return joined(r, parts, [*keys, "_p"], "inner").withColumn(name, F.col("_base") + F.col("_i") - F.col("_first")).drop("_p", "_i", "_first", "_base")


def affine(df: DataFrame, keys: list[str], place: str, factor: str, terms: dict[str, str], width: int = 16, last: int | None = None) -> DataFrame:
    """x = factor * x before + term, from 0, for every name in ``terms`` (name to its column); ``factor`` 0 starts anew.

    Maps of this kind compose to maps of this kind. Rows go in blocks of ``width`` places; a
    block is one map, blocks are scanned like rows, and so on up: each level has a ``width``-th
    of the rows. Within a block running products of factors do what a fold would; they are
    short, so that they neither overflow nor lose what sixteen digits hold. ``last``: no place is higher.
    """
    last = df.agg(F.max(place)).first()[0] if last is None else last
    return _affine(df, keys, place, factor, terms, width, last or 0)


def _affine(df: DataFrame, keys: list[str], place: str, factor: str, terms: dict[str, str], width: int, last: int) -> DataFrame:
    block = F.call_function("div", F.col(place), F.lit(width))
    d = df.withColumns({"_block": block, "_new": (F.col(factor) == 0).cast("int")})
    order = Window.partitionBy(*keys, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_run", F.sum("_new").over(order))  # 0: what came before the block still counts
    stretch = Window.partitionBy(*keys, "_block", "_run").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_m", F.product(F.when(F.col("_new") == 1, 1.0).otherwise(F.col(factor))).over(stretch))
    d = d.withColumns({f"_s_{n}": F.col("_m") * F.sum(F.col(c) / F.col("_m")).over(stretch) for n, c in terms.items()})
    own = [c for c in d.columns if c not in ("_block", "_new", "_run", "_m")]
    if last < width:
        return d.withColumns({n: F.col(f"_s_{n}") for n in terms}).select(*[c for c in own if not c.startswith("_s_")], *terms)
    d = staged(d, "affine")
    end = F.max_by(F.struct("_run", "_m", *(f"_s_{n}" for n in terms)), place)
    blocks = d.groupBy(*keys, "_block").agg(end.alias("_e"))
    blocks = blocks.select(*keys, F.col("_block").alias("_at"), F.when(F.col("_e._run") > 0, 0.0).otherwise(F.col("_e._m")).alias("_f"), *(F.col(f"_e._s_{n}").alias(f"_t_{n}") for n in terms))
    ends = _affine(blocks, keys, "_at", "_f", {f"_x_{n}": f"_t_{n}" for n in terms}, width, last // width)
    starts = ends.select(*keys, (F.col("_at") + 1).alias("_block"), *(f"_x_{n}" for n in terms))
    d = joined(d, starts, [*keys, "_block"])
    carried = lambda n: F.when(F.col("_run") == 0, F.col("_m") * F.coalesce(f"_x_{n}", F.lit(0.0))).otherwise(0.0)
    return d.withColumns({n: carried(n) + F.col(f"_s_{n}") for n in terms}).select(*[c for c in own if not c.startswith("_s_")], *terms)
