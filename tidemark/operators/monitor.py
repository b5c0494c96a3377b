"""Monitoring: dead-man checks, alert routing, grounding of texts."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import bucket_index, in_quiet_hours, numeric_tokens
from tidemark.operators.core import folded, joined
from tidemark.operators.fills import first_crossing_slice
from tidemark.operators.scan import ranked, scanned
from tidemark.staging import staged

CHANNELS = {"P1": "page", "P2": "push", "P3": "digest"}  # fixed values


def deadman(beats: DataFrame, interval_ns: int, misses: int, live: bool, now_ns: int) -> DataFrame:
    """Processes silent for longer than ``misses`` intervals: P1 for a critical one when live, else P2."""
    last = beats.groupBy("proc").agg(F.max("ts_ns").alias("last_ns"), F.max_by("critical", "ts_ns").alias("critical"))
    silent = last.withColumn("silent_ns", F.lit(now_ns) - F.col("last_ns")).where(F.col("silent_ns") > interval_ns * misses)
    return silent.withColumns({"severity": F.when(F.col("critical") & F.lit(live), "P1").otherwise("P2"), "dedupe_key": F.concat(F.lit("deadman:"), "proc")})


def channel_of(severity: str) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in CHANNELS.items() for x in pair)), F.col(severity))


class Deduper:
    """Whether an alert of one key is sent: not within its window since the last one sent."""

    def __init__(self, last: int | None = None):
        self.last = last

    def send(self, now: int, window: int) -> bool:
        if self.last is not None and now - self.last < window:
            return False
        self.last = now
        return True


def _exits():
    """Going back through a block's rows: the last row that is sent in the block once this row is, and its time."""
    reach, ends = [], []  # of later rows that no nearer one exceeds in reach, the nearest last

    def step(place: int, now: int, until: int) -> tuple[int, int]:
        at = bisect_right(reach, -now, key=lambda r: -r) - 1  # the nearest that reaches this row's time
        end = ends[at] if at >= 0 else (place, now)
        while reach and reach[-1] <= until:
            reach.pop(), ends.pop()
        reach.append(until), ends.append(end)
        return end

    return step


def _last_sent(rows: DataFrame) -> DataFrame:
    """(_key, _block, _before): the time of the last row sent before each block of the keys that have more than one.

    Within a block every row leads to a last one (``_exit``). From there the first later block with a row that is not held
    back is found in a ladder of blocks, and the row in it by sorting. So ends of blocks point to ends of blocks;
    pointer doubling from the first row's marks those that are met.
    """
    at = ["_key", "_block"]
    back = folded(rows.withColumn("_back", -F.col("_n")), at, ["_back"], _exits, ["_n", "_now", "_reach"], "_exit long, _exit_ns long")
    upto = Window.partitionBy(*at).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    entries = staged(back.withColumn("_top", F.max("_reach").over(upto)).where("_top is null or _reach > _top").select(*at, "_n", "_reach", "_exit", "_exit_ns"), "entries")
    exits = entries.groupBy(*at, "_exit", "_exit_ns").agg(F.lit("Sell").alias("side"))
    exits = staged(exits.withColumns({"_id": F.struct("_key", "_exit"), "limit_px": F.col("_exit_ns") - 1, "_own": F.col("_block")}), "exits")
    reach = entries.groupBy("_key", F.col("_block").alias("_s")).agg(F.max("_reach").alias("_hi"), F.min("_reach").alias("_lo"))
    found = first_crossing_slice(exits, reach, ["_key"], "_id").select("_id.*", F.col("_s").alias("_block"))
    asked = found.join(exits.select("_key", "_exit", "_exit_ns"), ["_key", "_exit"]).select(*at, F.col("_exit_ns").alias("_v"), F.col("_exit").alias("_from"), F.lit(None).cast("long").alias("_to"))
    both = entries.select(*at, F.col("_reach").alias("_v"), F.lit(None).cast("long").alias("_from"), F.col("_exit").alias("_to")).unionByName(asked)
    above = Window.partitionBy(*at).orderBy(F.desc("_v"), F.col("_to").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    links = staged(both.withColumn("_to", F.last("_to", True).over(above)).where("_from is not null").select("_key", "_from", "_to"), "links")
    met = staged(entries.where("_n = 0").select("_key", "_exit"), "met")
    while not links.isEmpty():
        further = met.join(links, (met["_key"] == links["_key"]) & (met["_exit"] == links["_from"])).select(met["_key"], F.col("_to").alias("_exit"))
        met = staged(met.unionByName(further), "met")
        ahead = links.select("_key", F.col("_from").alias("_to"), F.col("_to").alias("_then"))
        links = staged(links.join(ahead, ["_key", "_to"]).select("_key", "_from", F.col("_then").alias("_to")), "links")
    sent = exits.join(met, ["_key", "_exit"]).groupBy(*at).agg(F.max("_exit_ns").alias("_sent"))
    blocks = reach.select("_key", F.col("_s").alias("_block")).join(sent, at, "left")
    return scanned(blocks, ["_key"], {"_before": ("max", F.col("_sent"), True)}, "_block", (), 1024).select(*at, "_before")


def since_sent(df: DataFrame, key: str, ts: str, window: str, name: str, width: int = 4096) -> DataFrame:
    """``df`` with ``name``: whether a row is sent, that is, not within its own ``window`` since its key's last sent row.

    What was sent last depends on itself, but a block of ``width`` rows of a key needs only the time of the last row
    sent before it (``_last_sent``). So a task folds blocks, however many rows a key has. Rows without a key are
    one key, rows without a window are never held back, rows without a time are sent and hold none back. Rows of one time
    are taken by a hash of their columns.
    """
    marked = df.withColumns({"_key": F.concat(F.when(F.col(key).isNull(), "0").otherwise("1"), F.coalesce(key, F.lit(""))), "_now": F.col(ts).cast("long"), "_reach": F.col(ts).cast("long") - F.coalesce(window, F.lit(0)).cast("long")})
    timed = ranked(marked.where("_now is not null"), ["_key"], ["_now"], "_n").withColumn("_block", bucket_index("_n", width))
    long = timed.where(F.col("_block") > 0).select("_key").distinct()
    timed = joined(timed, _last_sent(staged(timed.join(long, "_key", "left_semi").select("_key", "_block", "_n", "_now", "_reach"), "long_keys")), ["_key", "_block"]) if not long.isEmpty() else timed.withColumn("_before", F.lit(None).cast("long"))

    def start():
        d = None

        def step(now: int, reach: int, before: int | None) -> tuple[bool]:
            nonlocal d
            d = d or Deduper(before)
            return (d.send(now, now - reach),)

        return step

    kept = folded(timed, ["_key", "_block"], ["_n"], start, ["_now", "_reach", "_before"], f"{name} boolean")
    return kept.select(*df.columns, name).unionByName(df.where(F.col(ts).isNull()).withColumn(name, F.lit(True)))


def route_alerts(alerts: DataFrame, quiet: tuple[int, int] | None = None) -> DataFrame:
    """``outcome`` (Deduped, Batched or Sent) and ``channel`` of each alert."""
    a = alerts.withColumn("dedupe_key", F.coalesce("dedupe_key", "id"))
    kept = since_sent(a, "dedupe_key", "ts_ns", "dedupe_window_ns", "kept")
    calm = F.coalesce(in_quiet_hours("ts_ns", *quiet), F.lit(False)) if quiet else F.lit(False)
    outcome = F.when(~F.col("kept"), "Deduped").when((F.col("severity") == "P3") & calm, "Batched").otherwise("Sent")
    return kept.withColumns({"outcome": outcome, "channel": channel_of("severity")}).drop("kept")


def ungrounded(brief, inputs):
    """Tokens of one array column that the other does not have."""
    return F.array_except(brief, inputs)


def verify_grounded(texts: DataFrame, inputs: DataFrame, key: str, text: str = "text", values: str = "value") -> DataFrame:
    """Numbers in each text that its inputs do not hold; ``grounded`` if there are none."""
    have = inputs.select(key, F.explode(numeric_tokens(F.col(values).cast("string"))).alias("_n")).groupBy(key).agg(F.collect_set("_n").alias("_have"))
    j = texts.select(key, F.col(text), numeric_tokens(text).alias("numbers")).join(have, key, "left")
    miss = ungrounded(F.col("numbers"), F.coalesce("_have", F.array().cast("array<string>")))
    return j.select(key, F.size(F.array_distinct("numbers")).alias("n_numbers"), miss.alias("ungrounded"), (F.size(miss) == 0).alias("grounded"))
