"""Screener: rules over the latest feature values, hits on the edge."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.core import joined
from tidemark.operators.scan import scanned
from tidemark.staging import staged

OPS = {"Gt": lambda a, b: a > b, "Ge": lambda a, b: a >= b, "Lt": lambda a, b: a < b, "Le": lambda a, b: a <= b}
Condition = tuple[str, str, float]


def rule_column(conditions: Sequence[Condition], values: Column | None = None) -> Column:
    """All (feature, op, threshold) hold; a feature without a value fails. ``values``: a map of latest values, default columns."""
    get = (lambda f: F.try_element_at(values, F.lit(f))) if values is not None else (lambda f: F.col(f"`{f}`"))
    return reduce(lambda a, b: a & b, [F.coalesce(OPS[op](get(f), F.lit(x)), F.lit(False)) for f, op, x in conditions], F.lit(True))


def any_of(rules: Sequence[Sequence[Condition]], values: Column | None = None) -> Column:
    return reduce(lambda a, b: a | b, [rule_column(r, values) for r in rules], F.lit(False))


def screen(features: DataFrame, rules: dict[str, Sequence[Condition]], keys: Sequence[str] = ("symbol_id",)) -> DataFrame:
    """(rule_id, keys, ts_ns, snapshot) whenever a rule turns true.

    Only what rules name becomes columns of last values, before and with each row, by a scan over slices of time. The
    snapshot holds the last values of all features so far: each hit asks every feature of its key, in the stream's order.
    """
    names = sorted({f for conds in rules.values() for f, _, _ in conds})
    own, at = list(keys), ("emit_seq", "reg_idx")
    features = staged(features.select("feature", *own, "emit_ts_ns", *at, "value"), "features")  # read for rules, hits and snapshots
    value = lambda n: F.when(F.col("feature") == n, F.col("value"))
    folds = {f"_{when}{i}": ("last", value(n), when == "p") for i, n in enumerate(names) for when in "vp"} | {"_rows": ("sum", F.lit(1).cast("long"), True)}
    f = scanned(features, own, folds, "emit_ts_ns", at)

    def holds(conds: Sequence[Condition], when: str) -> Column:
        return reduce(lambda a, b: a & b, [F.coalesce(OPS[op](F.col(f"_{when}{names.index(n)}"), F.lit(x)), F.lit(False)) for n, op, x in conds], F.lit(True))

    turned = [F.when(holds(c, "v") & ~(holds(c, "p") & F.col("_rows").isNotNull()), F.lit(r)) for r, c in rules.items()]
    hits = f.withColumn("rule_id", F.explode(F.array_compact(F.array(*turned)))).select(*own, "emit_ts_ns", *at, "rule_id")
    hits = staged(hits.withColumn("_id", F.monotonically_increasing_id()), "hits")
    known = features.where("feature is not null").select(*own, "feature").distinct()
    asks = joined(hits, known, own, "inner").withColumns({"value": F.lit(None).cast("double"), "_side": F.lit(1)})
    given = features.select(*own, "feature", "emit_ts_ns", *at, F.col("value").cast("double").alias("value")).withColumns({"rule_id": F.lit(None).cast("string"), "_id": F.lit(None).cast("long"), "_side": F.lit(0)})
    last = scanned(given.unionByName(asks), [*own, "feature"], {"_last": ("last", F.col("value"), False)}, "emit_ts_ns", (*at, "_side")).where("_side = 1 and _last is not null")
    entries = F.sort_array(F.collect_list(F.struct("feature", "_last")))  # as many as there are features
    return last.groupBy("_id", "rule_id", *own, "emit_ts_ns").agg(F.map_from_entries(entries).alias("snapshot")).select("rule_id", *own, F.col("emit_ts_ns").alias("ts_ns"), "snapshot")


def persistent(sat: DataFrame, min_ns: int, keys: Sequence[str] = ("symbol_id",), ts: str = "ts_ns", flag: str = "sat") -> DataFrame:
    """Rows at which ``flag`` has held without a break for ``min_ns`` or longer, once per run.

    A run is told by the last row before it at which the flag did not hold, found by scanning slices of time.
    """
    off = F.when(~F.col(flag), F.col(ts))
    broken = scanned(sat, list(keys), {"_run": ("sum", off.isNotNull().cast("long"), False)}, ts, ())
    held = broken.where(flag)
    start = held.groupBy(*keys, "_run").agg(F.min(ts).alias("since_ns"))
    late = joined(held, start, [*keys, "_run"], "inner").where(F.col(ts) - F.col("since_ns") >= min_ns)
    return late.groupBy(*keys, "_run").agg(F.min(ts).alias(ts), F.first("since_ns").alias("since_ns")).drop("_run")
