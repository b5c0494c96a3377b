"""Registered queries over the driver's tables, each with its DuckDB counterpart where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as sc
from tidemark.functions.scalar import DAY_NS
from tidemark.operators import asof, bars, book, core, features, fills, grading, intervals, monitor, quality, rolling, scan, screener, study, trades
from tidemark.plans import oracles
from tidemark.sources import adapters, normalize, sinks
from tidemark.staging import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ME = """
me AS (SELECT CASE user_id % 6 WHEN 0 THEN 'binance_futures' WHEN 1 THEN 'bybit' WHEN 2 THEN 'okx' WHEN 3 THEN 'hyperliquid' WHEN 4 THEN 'coinbase' ELSE 'kraken_futures' END AS venue,
  user_id AS symbol_id, epoch_us(ts) * 1000 AS recv_ts_ns, event_id AS stream_seq,
  CASE event_type WHEN 'view' THEN 'trade' WHEN 'click' THEN 'trade' WHEN 'purchase' THEN 'liquidation' WHEN 'signup' THEN 'open_interest' WHEN 'error' THEN 'status' END AS kind,
  CASE WHEN event_type = 'view' THEN 'Buy' WHEN event_type = 'click' THEN 'Sell' WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'Buy' WHEN event_type = 'purchase' THEN 'Sell' END AS side,
  value::DECIMAL(18,4) AS price, (regexp_extract(props, '"k": ([0-9]+)', 1)::BIGINT + 1)::DECIMAL(18,4) AS qty, CASE WHEN event_type = 'signup' THEN value END AS oi,
  CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'Disconnected' WHEN event_type = 'error' THEN 'Connected' END AS status_kind FROM events),
t AS (SELECT *, CASE WHEN side = 'Buy' THEN qty ELSE -qty END AS sq FROM me WHERE kind = 'trade')
"""
DAY = f"{DAY_NS}::BIGINT"
BARS = f"""
raw AS (SELECT venue, symbol_id, recv_ts_ns - recv_ts_ns % {DAY} AS open_ts_ns, arg_min(price, (recv_ts_ns, stream_seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (recv_ts_ns, stream_seq)) AS close,
  sum(qty) AS volume, sum(CASE WHEN side = 'Buy' THEN qty ELSE 0 END) AS buy_volume, sum(CASE WHEN side <> 'Buy' THEN qty ELSE 0 END) AS sell_volume, sum(price * qty) AS pq, count(*) AS n,
  min(recv_ts_ns) AS first_ts_ns, max(recv_ts_ns) AS last_ts_ns FROM t GROUP BY ALL),
b AS (SELECT *, open_ts_ns + {DAY} AS close_ts_ns, buy_volume - sell_volume AS delta, pq::DOUBLE / volume::DOUBLE AS vwap, lead(first_ts_ns) OVER (PARTITION BY venue, symbol_id ORDER BY open_ts_ns) AS emit_ts_ns FROM raw QUALIFY emit_ts_ns IS NOT NULL)
"""
KEY = ["venue", "symbol_id"]
PLACE = [*KEY, "recv_ts_ns", "stream_seq"]


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def d(c: str, n: int = 6):
    """As a double of ``n`` places, for comparison across engines."""
    return F.round(F.col(c).cast("double"), n).alias(c)


def me(spark, sf):
    return adapters.market_events(spark, sf)


def tr(spark, sf):
    return adapters.trades(spark, sf)


def daily(spark, sf):
    return bars.time_bars(tr(spark, sf), DAY_NS)


@query(f"WITH {ME}, {BARS} SELECT venue, symbol_id, open_ts_ns, open::DOUBLE AS open, high::DOUBLE AS high, low::DOUBLE AS low, close::DOUBLE AS close, volume::DOUBLE AS volume, buy_volume::DOUBLE AS buy_volume, sell_volume::DOUBLE AS sell_volume, delta::DOUBLE AS delta, round(vwap, 6) AS vwap, n, first_ts_ns, last_ts_ns, close_ts_ns, emit_ts_ns FROM b")
def ag1_time_bars(spark, sf):
    return daily(spark, sf).select(*KEY, "open_ts_ns", *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume", "buy_volume", "sell_volume", "delta")), d("vwap"), "n", "first_ts_ns", "last_ts_ns", "close_ts_ns", "emit_ts_ns")


@query(f"WITH {ME} SELECT kind, venue, count(*) AS n FROM me GROUP BY ALL")
def prj1_split_kind(spark, sf):
    e = me(spark, sf)
    parts = [core.split_kind(e, k) for k in ("trade", "liquidation", "open_interest", "status")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("kind", "venue").agg(F.count("*").alias("n"))


@query(f"WITH {ME} SELECT venue, user_code AS code, count(*) AS n FROM (SELECT venue, CASE venue WHEN 'binance_futures' THEN 1 WHEN 'bybit' THEN 2 WHEN 'okx' THEN 3 WHEN 'hyperliquid' THEN 4 WHEN 'coinbase' THEN 5 ELSE 6 END AS user_code FROM me) GROUP BY ALL")
def prj2_venue_codes(spark, sf):
    e = me(spark, sf).withColumn("code", sc.venue_code("venue"))
    return e.select(sc.venue_slug("code").alias("venue"), "code").groupBy("venue", "code").agg(F.count("*").alias("n"))


@query(f"WITH {ME} SELECT venue, symbol_id, recv_ts_ns, stream_seq, (CASE WHEN side = 'Buy' THEN price * qty ELSE -price * qty END)::DOUBLE AS value FROM t WHERE price * qty >= 5000")
def prj4_whale_prints(spark, sf):
    return core.whale_prints(tr(spark, sf), 5000).select(*PLACE, F.col("value").cast("double").alias("value"))


@query(f"WITH {ME} SELECT recv_ts_ns // {DAY} AS day, count(*) AS n FROM me WHERE recv_ts_ns >= 1704240000000000000 AND recv_ts_ns < 1704672000000000000 GROUP BY ALL")
def prj7_recv_slice(spark, sf):
    return core.recv_slice(me(spark, sf), 1704240000000000000, 1704672000000000000).groupBy(sc.bucket_index("recv_ts_ns", DAY_NS).alias("day")).agg(F.count("*").alias("n"))


@query(f"WITH {ME} SELECT venue, count(*) AS n FROM me WHERE (recv_ts_ns % {DAY}) // 60000000000 >= 1320 OR (recv_ts_ns % {DAY}) // 60000000000 < 360 GROUP BY ALL")
def prj9_quiet_hours(spark, sf):
    return me(spark, sf).where(sc.in_quiet_hours("recv_ts_ns", 1320, 360)).groupBy("venue").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 OR p_brand IN ('Brand#11', 'Brand#12') OR p_type IN ('Brand#11', 'Brand#12') THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS fit FROM part")
def prj10_regime_fit(spark, sf):
    p = adapters.table(spark, sf, "part")
    mask = F.when(F.col("p_size") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Brand#11"), F.lit("Brand#12")))
    return p.select("p_partkey", sc.regime_fit(mask, "p_brand", "p_type", 0.25).alias("fit"))


@query(f"WITH {ME} SELECT 'cvd' AS feature, 0::BIGINT AS suppressed FROM (SELECT 1) UNION ALL SELECT 'inverse', count(*) FILTER (WHERE qty = 1)::BIGINT FROM t")
def prj6_finite_only(spark, sf):
    t = tr(spark, sf)
    inv = t.select(F.lit("inverse").alias("feature"), F.when(F.col("qty") == 1, F.lit(float("inf"))).otherwise(1 / F.col("qty").cast("double")).alias("value"))
    cvd = features.cvd(t).select(F.lit("cvd").alias("feature"), F.col("value").cast("double").alias("value"))
    return core.finite_only(inv.unionByName(cvd))[1]


@query(f"WITH {ME} SELECT venue, symbol_id, recv_ts_ns, stream_seq, sum(sq) OVER (PARTITION BY venue, symbol_id ORDER BY recv_ts_ns, stream_seq)::DOUBLE AS value FROM t")
def wn1_cvd(spark, sf):
    return features.cvd(tr(spark, sf)).select(*PLACE, F.col("value").cast("double").alias("value"))


@query(f"""WITH {ME}, l AS (SELECT *, CASE WHEN side = 'Buy' THEN price * qty ELSE -price * qty END AS x FROM me WHERE kind = 'liquidation'),
s AS (SELECT venue, symbol_id, recv_ts_ns, stream_seq, (sum(x) OVER w - coalesce(sum(x) OVER (PARTITION BY venue, symbol_id ORDER BY recv_ts_ns RANGE BETWEEN UNBOUNDED PRECEDING AND {3 * DAY_NS + 1} PRECEDING), 0))::DOUBLE AS value FROM l WINDOW w AS (PARTITION BY venue, symbol_id ORDER BY recv_ts_ns, stream_seq ROWS UNBOUNDED PRECEDING))
SELECT * FROM s WHERE abs(value) >= 5000""")
def wn2_liq_cluster(spark, sf):
    l = core.split_kind(me(spark, sf), "liquidation")
    return features.liq_cluster(l, 3 * DAY_NS, 5000).select(*PLACE, F.col("value").cast("double").alias("value"))


@query(f"WITH {ME} SELECT venue, symbol_id, recv_ts_ns, stream_seq, round(oi - lag(oi) OVER (PARTITION BY venue, symbol_id ORDER BY recv_ts_ns, stream_seq), 6) AS value FROM me WHERE kind = 'open_interest' QUALIFY value IS NOT NULL")
def wn3_oi_delta(spark, sf):
    return features.oi_delta(core.split_kind(me(spark, sf), "open_interest")).select(*PLACE, d("value"))


@query(f"""WITH {ME}, {BARS}, r AS (SELECT *, lag(close) OVER w AS p, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close::DOUBLE / (lag(close) OVER w)::DOUBLE) END AS r FROM b WINDOW w AS (PARTITION BY venue, symbol_id ORDER BY open_ts_ns)),
k AS (SELECT *, count(r) OVER (PARTITION BY venue, symbol_id ORDER BY open_ts_ns) AS k FROM r)
SELECT venue, symbol_id, open_ts_ns, round(sqrt(sum(r * r) OVER (PARTITION BY venue, symbol_id ORDER BY k RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)), 6) AS value FROM k QUALIFY k >= 5""")
def wn4_realized_vol(spark, sf):
    return features.realized_vol(daily(spark, sf), 5).select(*KEY, "open_ts_ns", d("value"))


@query(f"""WITH {ME}, {BARS}, x AS (SELECT *, max(high) OVER w AS hi, min(low) OVER w AS lo, row_number() OVER (PARTITION BY venue, symbol_id ORDER BY open_ts_ns) AS k FROM b WINDOW w AS (PARTITION BY venue, symbol_id ORDER BY open_ts_ns ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT venue, symbol_id, open_ts_ns, CASE WHEN k > 5 AND close > hi THEN 1.0::DOUBLE WHEN k > 5 AND close < lo THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM x WHERE k >= 5""")
def wn5_donchian(spark, sf):
    return features.donchian(daily(spark, sf), 5).select(*KEY, "open_ts_ns", "value")


END_NS = 1735689600000000000
GAPS = f"""g0 AS (SELECT *, lag(status_kind) OVER w AS p FROM me WHERE kind = 'status' WINDOW w AS (PARTITION BY venue, symbol_id ORDER BY recv_ts_ns, stream_seq)),
g1 AS (SELECT * FROM g0 WHERE status_kind <> coalesce(p, 'Connected')),
g AS (SELECT venue, symbol_id, recv_ts_ns AS from_ns, coalesce(lead(recv_ts_ns) OVER (PARTITION BY venue, symbol_id ORDER BY recv_ts_ns, stream_seq), {END_NS}) AS to_ns, status_kind FROM g1 QUALIFY status_kind = 'Disconnected')"""


@query(f"WITH {ME}, {GAPS} SELECT venue, symbol_id, from_ns, to_ns, 'Disconnect' AS gap_kind FROM g")
def wn6_disconnect_gaps(spark, sf):
    return quality.disconnect_gaps(me(spark, sf), END_NS)


@query(f"""WITH {ME}, {GAPS}, lost AS (SELECT venue, symbol_id, sum(to_ns - from_ns) AS lost, count(*) AS n FROM g GROUP BY ALL)
SELECT m.venue, m.symbol_id, CASE kind WHEN 'trade' THEN 'trades' WHEN 'liquidation' THEN 'liquidations' ELSE kind END AS stream, count(*) AS events, min(recv_ts_ns) AS first_ts_ns, max(recv_ts_ns) AS last_ts_ns,
coalesce(any_value(n), 0)::INTEGER AS n_gaps, round(greatest(0, least(1, 1 - coalesce(any_value(lost), 0) / {END_NS - 1704067200000000000}::DOUBLE)), 6) AS coverage
FROM me m LEFT JOIN lost USING (venue, symbol_id) WHERE kind <> 'status' GROUP BY m.venue, m.symbol_id, kind""")
def ag2_quality_manifest(spark, sf):
    m = quality.quality_manifest(me(spark, sf), 1704067200000000000, END_NS)
    return m.select(*KEY, "stream", "events", "first_ts_ns", "last_ts_ns", F.size("gaps").alias("n_gaps"), d("coverage"))


@query(f"""WITH {ME}, {GAPS}, x AS (SELECT venue, greatest(from_ns, 1704067200000000000) AS a, least(to_ns, {END_NS}) AS b FROM g),
r AS (SELECT *, max(b) OVER (PARTITION BY venue ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x WHERE a < b),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY venue ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT venue, min(a) AS start, max(b) AS "end" FROM i GROUP BY venue, island""")
def jn7_merge_intervals(spark, sf):
    g = quality.disconnect_gaps(me(spark, sf), END_NS).select("venue", F.col("from_ns").alias("start"), F.col("to_ns").alias("end"))
    return intervals.merge_intervals(g, ["venue"])


@query(f"""WITH {ME}, {GAPS}, x AS (SELECT symbol_id, from_ns, to_ns, lag(to_ns) OVER (PARTITION BY symbol_id ORDER BY from_ns) AS p FROM g),
k AS (SELECT symbol_id, coalesce(p, 1704067200000000000) AS start, from_ns AS "end" FROM x UNION ALL SELECT symbol_id, max(to_ns), {END_NS} FROM x GROUP BY symbol_id)
SELECT * FROM k WHERE start < "end" """)
def st5_coverage(spark, sf):
    e = me(spark, sf)
    g = quality.disconnect_gaps(e, END_NS).select("symbol_id", F.col("from_ns").alias("start"), F.col("to_ns").alias("end"))
    return intervals.check_coverage(g, 1704067200000000000, END_NS, "warn", ["symbol_id"])


@query(f"""WITH {ME}, o AS (SELECT venue, symbol_id, recv_ts_ns, stream_seq FROM me WHERE kind = 'liquidation')
SELECT o.venue, o.symbol_id, o.recv_ts_ns, o.stream_seq, (SELECT arg_max(t.price, (t.recv_ts_ns, t.stream_seq)) FROM t WHERE t.venue = o.venue AND t.symbol_id = o.symbol_id AND t.recv_ts_ns <= o.recv_ts_ns)::DOUBLE AS px FROM o""")
def jn1_asof_backward(spark, sf):
    e = me(spark, sf)
    px = tr(spark, sf).select(*KEY, "recv_ts_ns", "stream_seq", F.col("price").cast("double").alias("px"))
    return asof.asof_backward(core.split_kind(e, "liquidation").select(*PLACE), px, KEY, "recv_ts_ns", ["px"], "stream_seq")


@query("""WITH v AS (SELECT c_nationkey AS nation, c_custkey, epoch_us(TIMESTAMP '1992-01-01') * 1000 + c_custkey * 86400000000000 AS f FROM customer),
h AS (SELECT *, lead(f) OVER (PARTITION BY nation ORDER BY f) AS "to" FROM v), o AS (SELECT o_orderkey, c_nationkey AS nation, epoch_us(o_orderdate) * 1000 AS ts FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, (SELECT max(h.c_custkey) FROM h WHERE h.nation = o.nation AND h.f <= o.ts AND (h."to" IS NULL OR o.ts < h."to")) AS version FROM o""")
def jn2_scd2_as_of(spark, sf):
    c = adapters.table(spark, sf, "customer")
    # A start beyond the last nanosecond that a long holds is null: such a version holds at no time a row can have.
    starts = F.try_add(F.lit(694224000000000000), F.try_multiply(F.col("c_custkey"), F.lit(DAY_NS)))
    dim = c.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("version"), starts.alias("valid_from_ns")).where("valid_from_ns is not null")
    dim = sinks.scd2_append(dim.withColumn("valid_to_ns", F.lit(None).cast("long")).limit(0), dim.withColumn("valid_to_ns", F.lit(None).cast("long")), ("nation",))
    o = adapters.table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("nation"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("ts_ns"))
    return asof.scd2_as_of(o, dim, "ts_ns", ["nation"], ["version"]).select("o_orderkey", "version")


HITS = f"""h AS (SELECT 'rule' || (stream_seq % 5)::VARCHAR AS rule, symbol_id AS symbol, recv_ts_ns AS ts_ns, stream_seq AS id FROM me WHERE kind = 'liquidation'),
px AS (SELECT symbol_id AS symbol, recv_ts_ns AS ts_ns, price::DOUBLE AS price FROM t), lastp AS (SELECT symbol, max(ts_ns) AS stop FROM px GROUP BY ALL),
a AS (SELECT h.*, px.price AS entry FROM h ASOF LEFT JOIN px ON h.symbol = px.symbol AND h.ts_ns >= px.ts_ns),
e AS (SELECT *, ts_ns + {DAY} AS t2 FROM a), x AS (SELECT e.*, px.price AS exit FROM e ASOF LEFT JOIN px ON e.symbol = px.symbol AND e.t2 >= px.ts_ns),
f AS (SELECT x.*, CASE WHEN entry IS NOT NULL AND exit IS NOT NULL AND entry <> 0 AND stop >= t2 THEN exit / entry - 1 END AS fwd FROM x LEFT JOIN lastp USING (symbol))"""


def _hits(spark, sf):
    e = core.split_kind(me(spark, sf), "liquidation")
    return e.select(F.concat(F.lit("rule"), (F.col("stream_seq") % 5).cast("string")).alias("rule"), F.col("symbol_id").alias("symbol"), F.col("recv_ts_ns").alias("ts_ns"), F.col("stream_seq").alias("id"))


def _prices(spark, sf):
    return tr(spark, sf).select(F.col("symbol_id").alias("symbol"), F.col("recv_ts_ns").alias("ts_ns"), F.col("price").cast("double").alias("price"))


def _baseline(spark, sf):
    c = adapters.table(spark, sf, "customer")
    return c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("symbol"), F.lit(0.5).alias("avg_fwd"))


@query(f"WITH {ME}, {HITS} SELECT id, rule, symbol, round(fwd, 6) AS fwd FROM f")
def jn3_forward_returns(spark, sf):
    return asof.forward_returns(_hits(spark, sf), _prices(spark, sf), DAY_NS).select("id", "rule", "symbol", d("fwd"))


GRADES = f"""{HITS}, bl AS (SELECT c_custkey AS symbol, 0.5 AS avg_fwd FROM customer WHERE c_custkey % 2 = 0), ex AS (SELECT rule, ts_ns, fwd - coalesce(avg_fwd, 0)::DOUBLE AS excess FROM f LEFT JOIN bl USING (symbol) WHERE fwd IS NOT NULL),
gr AS (SELECT rule, count(*) AS n, count(*) FILTER (WHERE excess > 0) AS wins, sum(excess) AS sum_excess, avg(excess) AS avg_excess, count(*) FILTER (WHERE excess > 0) / count(*)::DOUBLE AS win_rate FROM ex GROUP BY rule)"""


@query(f"WITH {ME}, {GRADES} SELECT rule, n, wins, round(sum_excess, 4) AS sum_excess, round(avg_excess, 6) AS avg_excess, round(win_rate, 6) AS win_rate FROM gr")
def ag3_grade_hits(spark, sf):
    g = grading.grade_hits(_hits(spark, sf), _prices(spark, sf), DAY_NS, _baseline(spark, sf))
    return g.select("rule", "n", "wins", d("sum_excess", 4), d("avg_excess"), d("win_rate"))


@query(f"WITH {ME}, {GRADES} SELECT rule, n, (row_number() OVER (ORDER BY avg_excess DESC, win_rate DESC, rule))::INTEGER AS rank FROM gr")
def so2_leaderboard(spark, sf):
    return grading.leaderboard(grading.grade_hits(_hits(spark, sf), _prices(spark, sf), DAY_NS, _baseline(spark, sf))).select("rule", "n", "rank")


def _weekly(spark, sf):
    x = grading.excess_returns(_hits(spark, sf), _prices(spark, sf), DAY_NS, _baseline(spark, sf))
    return x.groupBy("rule", sc.bucket_index("ts_ns", DAY_NS).alias("week")).agg(F.avg("excess").alias("avg_excess"))


@query(f"""WITH {ME}, {GRADES}, w AS (SELECT rule, ts_ns // {DAY} AS week, avg(excess) AS avg_excess FROM ex GROUP BY ALL),
m AS (SELECT *, avg(avg_excess) OVER (PARTITION BY rule ORDER BY week ROWS 11 PRECEDING) AS m12, avg(avg_excess) OVER (PARTITION BY rule ORDER BY week ROWS 3 PRECEDING) AS m4, count(*) OVER (PARTITION BY rule ORDER BY week ROWS 11 PRECEDING) AS c FROM w)
SELECT rule, week, round(avg_excess, 6) AS avg_excess, c >= 12 AND m12 > 0 AND m4 < 0.5 * m12 AS decayed FROM m""")
def wn16_edge_decay(spark, sf):
    return grading.edge_decay(_weekly(spark, sf)).select("rule", "week", d("avg_excess"), "decayed")


STUDY = f"""{BARS}, xs AS (SELECT symbol_id, open_ts_ns AS ts_ns, (close::DOUBLE / nullif(open::DOUBLE, 0) - 1) AS excess FROM b WHERE open <> 0),
ev AS (SELECT DISTINCT symbol_id, recv_ts_ns - recv_ts_ns % {DAY} AS ts_ns, CASE WHEN symbol_id % 3 > 0 THEN 'r' || (symbol_id % 3)::VARCHAR END AS regime FROM me WHERE kind = 'liquidation'),
o AS (SELECT ev.*, k AS "offset", ts_ns + k * {DAY} AS bar_ts FROM ev, range(-1, 3) AS q(k)), j AS (SELECT o.*, xs.excess FROM o JOIN xs ON o.symbol_id = xs.symbol_id AND o.bar_ts = xs.ts_ns),
c AS (SELECT *, count(*) OVER (PARTITION BY symbol_id, ts_ns) AS n FROM j QUALIFY n = 4)"""


def _study(spark, sf):
    priced = daily(spark, sf).where("open <> 0")  # a bar that opens at 0 has no return
    x = priced.select("symbol_id", F.col("open_ts_ns").alias("ts_ns"), (F.try_divide(F.col("close").cast("double"), F.col("open").cast("double")) - 1).alias("excess"))
    e = core.split_kind(me(spark, sf), "liquidation").select("symbol_id", sc.bucket("recv_ts_ns", DAY_NS).alias("ts_ns"), F.when(F.col("symbol_id") % 3 > 0, F.concat(F.lit("r"), (F.col("symbol_id") % 3).cast("string"))).alias("regime")).distinct()
    return e, x


@query(f"WITH {ME}, {STUDY} SELECT symbol_id, ts_ns, \"offset\"::INTEGER AS \"offset\", round(excess, 6) AS excess FROM c")
def jn4_event_windows(spark, sf):
    e, x = _study(spark, sf)
    return study.event_windows(e, x, DAY_NS, 1, 2, ["symbol_id"]).select("symbol_id", "ts_ns", "offset", d("excess"))


@query(f"WITH {ME}, {STUDY}, m AS (SELECT \"offset\", avg(excess) AS m FROM c GROUP BY ALL) SELECT \"offset\"::INTEGER AS \"offset\", round(m, 6) AS mean_excess, round(sum(m) OVER (ORDER BY \"offset\"), 6) AS car FROM m")
def ag4_car(spark, sf):
    e, x = _study(spark, sf)
    return study.car(e, x, DAY_NS, 1, 2, ["symbol_id"]).select("offset", d("mean_excess"), d("car"))


@query(f"WITH {ME}, {STUDY}, m AS (SELECT coalesce(regime, '_all') AS regime, \"offset\", avg(excess) AS m FROM c GROUP BY ALL) SELECT regime, \"offset\"::INTEGER AS \"offset\", round(m, 6) AS mean_excess, round(sum(m) OVER (PARTITION BY regime ORDER BY \"offset\"), 6) AS car FROM m")
def ag5_car_by_regime(spark, sf):
    e, x = _study(spark, sf)
    return study.car_by_regime(e, x, DAY_NS, 1, 2, ["symbol_id"]).select("regime", "offset", d("mean_excess"), d("car"))


@query(f"""WITH {ME}, {STUDY}, tm AS (SELECT symbol_id, ts_ns, sum(excess) AS v FROM c GROUP BY ALL), p AS (SELECT v, row_number() OVER (ORDER BY ts_ns, symbol_id) - 1 AS idx, count(*) OVER () AS n FROM tm),
dr AS (SELECT rep, ('0x' || substr(md5('7:' || rep::VARCHAR || ':' || i::VARCHAR), 1, 8))::BIGINT % (SELECT any_value(n) FROM p) AS idx FROM range(200) AS a(rep), range((SELECT any_value(n) FROM p)) AS b(i)),
mm AS (SELECT rep, avg(v) AS m FROM dr JOIN p USING (idx) GROUP BY rep), s AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS i FROM mm)
SELECT round(max(CASE WHEN i = 5 THEN m END), 6) AS lo, round(max(CASE WHEN i = 195 THEN m END), 6) AS hi, (SELECT any_value(n) FROM p) AS n FROM s""")
def st2_bootstrap_ci(spark, sf):
    e, x = _study(spark, sf)
    t = study.event_windows(e, x, DAY_NS, 1, 2, ["symbol_id"]).groupBy("ts_ns", "symbol_id").agg(F.sum("excess").alias("terminal"))
    return study.bootstrap_ci(t, "terminal", ["ts_ns", "symbol_id"], 7, 200).select(d("lo"), d("hi"), "n")


@query()
def st2_bootstrap_split(spark, sf):
    return study.bootstrap_by_splitting(adapters.table(spark, sf, "lineitem"), "l_extendedprice", ["l_orderkey", "l_linenumber", "l_extendedprice"], 7, 200).select(d("lo", 2), d("hi", 2), "n")


CT = "ct AS (SELECT l_returnflag || l_linestatus AS strategy, l_suppkey % 5 AS bucket, epoch_us(l_shipdate) * 1000 AS ts_ns, ((CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) * l_extendedprice * (l_discount - 0.04))::DECIMAL(18,4) AS pnl, l_linenumber % 3 = 0 AS maker, (l_extendedprice * l_tax / 100)::DECIMAL(18,4) AS fee FROM lineitem)"
METRICS = f"""{CT}, tm AS (SELECT strategy, bucket, count(*) AS trades, count(*) FILTER (WHERE pnl > 0) AS wins, coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0)::DOUBLE AS gross_win, coalesce(sum(-pnl) FILTER (WHERE pnl < 0), 0)::DOUBLE AS gross_loss,
count(*) FILTER (WHERE maker) AS maker_trades, coalesce(sum(pnl) FILTER (WHERE maker AND pnl > 0), 0)::DOUBLE AS maker_gross_win, coalesce(sum(-pnl) FILTER (WHERE maker AND pnl < 0), 0)::DOUBLE AS maker_gross_loss FROM ct WHERE pnl <> 0 GROUP BY ALL)"""


def _metrics(spark, sf):
    return trades.trade_metrics(adapters.closed_trades(spark, sf), ["strategy", "bucket"])


@query(f"""WITH {METRICS} SELECT strategy, bucket, trades, wins, round(gross_win, 2) AS gross_win, round(gross_loss, 2) AS gross_loss, maker_trades, round(maker_gross_win, 2) AS maker_gross_win, round(maker_gross_loss, 2) AS maker_gross_loss, round(wins / trades::DOUBLE, 6) AS hit_rate, round((gross_win - gross_loss) / trades, 6) AS expectancy, round(gross_win / gross_loss, 6) AS profit_factor FROM tm""")
def ag6_trade_metrics(spark, sf):
    m = _metrics(spark, sf)
    return m.select("strategy", "bucket", "trades", "wins", d("gross_win", 2), d("gross_loss", 2), "maker_trades", d("maker_gross_win", 2), d("maker_gross_loss", 2), d("hit_rate"), d("expectancy"), d("profit_factor"))


@query(f"WITH {METRICS}, fe AS (SELECT strategy, bucket, sum(fee)::DOUBLE AS fees FROM ct GROUP BY ALL) SELECT strategy, bucket, round((gross_win - gross_loss - fees * 1.0) / trades, 3) AS stress_expectancy FROM tm JOIN fe USING (strategy, bucket)")
def ag8_stress_expectancy(spark, sf):
    fees = adapters.closed_trades(spark, sf).groupBy("strategy", "bucket").agg(F.sum("fee").cast("double").alias("fees"))
    m = _metrics(spark, sf).join(fees, ["strategy", "bucket"])
    return trades.stress_expectancy(m, "fees", 2.0).select("strategy", "bucket", d("stress_expectancy", 3))


@query(f"""WITH {METRICS}, fe AS (SELECT strategy, bucket, sum(fee)::DOUBLE AS fees FROM ct GROUP BY ALL), z AS (SELECT *, (gross_win - gross_loss - fees) / trades AS se FROM tm JOIN fe USING (strategy, bucket))
SELECT strategy, bucket, array_to_string(list_filter([CASE WHEN se <= 0 THEN 'stress_expectancy' END, CASE WHEN trades < 2000 THEN 'min_trades' END, CASE WHEN gross_loss > 400000 THEN 'max_drawdown' END, CASE WHEN maker_trades > 0 AND maker_gross_win - maker_gross_loss > 0 AND gross_win - gross_loss - maker_gross_win + maker_gross_loss <= 0 THEN 'maker_dependent' END], lambda x: x IS NOT NULL), ',') AS reasons FROM z""")
def ag9_gate_g1(spark, sf):
    fees = adapters.closed_trades(spark, sf).groupBy("strategy", "bucket").agg(F.sum("fee").cast("double").alias("fees"))
    m = trades.stress_expectancy(_metrics(spark, sf).join(fees, ["strategy", "bucket"]), "fees", 2.0).withColumn("max_drawdown", F.col("gross_loss").cast("double"))
    return trades.gate_g1(m, 2000, 400000.0).select("strategy", "bucket", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {METRICS} SELECT strategy, bucket, round(CASE WHEN trades < 1000 THEN 0.01 WHEN gross_loss > 0 AND wins > 0 THEN 0.25 * greatest(wins / trades::DOUBLE - (1 - wins / trades::DOUBLE) / ((gross_win / wins) / (gross_loss / (trades - wins))), 0) ELSE 0 END, 6) AS cap FROM tm")
def ag10_kelly_cap(spark, sf):
    m = _metrics(spark, sf).withColumns({"gross_win": F.col("gross_win").cast("double"), "gross_loss": F.col("gross_loss").cast("double")})
    return trades.kelly_cap(m, 0.25, 1000, 0.01).select("strategy", "bucket", d("cap"))


@query("""WITH i AS (SELECT s_suppkey, s_acctbal / 10000 AS base, least(greatest(s_nationkey / 20.0, 0), 1) AS fit, least(greatest(s_suppkey % 10 / 8.0, 0), 1) AS corr, least(greatest(s_suppkey % 7 / 6.0, 0), 1) AS gov, s_suppkey % 4 / 20.0 AS cap FROM supplier),
w AS (SELECT s_suppkey, least(greatest(base, 0) * fit * corr * gov, greatest(cap, 0)) AS w FROM i), t AS (SELECT sum(w) AS t FROM w) SELECT s_suppkey, round(CASE WHEN t > 0.8 THEN w * 0.8 / t ELSE w END, 6) AS weight FROM w, t""")
def ag11_allocate(spark, sf):
    s = adapters.table(spark, sf, "supplier")
    i = s.select("s_suppkey", (F.col("s_acctbal") / 10000).alias("base"), (F.col("s_nationkey") / 20.0).alias("fit"), (F.col("s_suppkey") % 10 / 8.0).alias("corr"), (F.col("s_suppkey") % 7 / 6.0).alias("gov"), (F.col("s_suppkey") % 4 / 20.0).alias("cap"))
    return trades.allocate(i, 0.8).select("s_suppkey", d("weight"))


@query("WITH q AS (SELECT c_custkey, c_acctbal FROM customer), p AS (SELECT s_suppkey AS k, s_acctbal AS w FROM supplier) SELECT c_custkey, round(CASE WHEN w IS NULL THEN c_acctbal ELSE least(c_acctbal, w) END, 6) AS weight FROM q LEFT JOIN p ON c_custkey = k")
def jn8_shrink_only(spark, sf):
    prev = adapters.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("weight"))
    new = adapters.table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("weight"))
    return trades.shrink_only(prev, new, "c_custkey").select("c_custkey", d("weight"))


@query("WITH a AS (SELECT s_suppkey AS symbol_id, s_acctbal AS q FROM supplier), b AS (SELECT c_custkey AS symbol_id, c_acctbal AS q FROM customer) SELECT symbol_id, coalesce(a.q, 0) AS internal_qty, coalesce(b.q, 0) AS venue_qty FROM a FULL JOIN b USING (symbol_id) WHERE abs(coalesce(a.q, 0) - coalesce(b.q, 0)) > 100")
def jn6_reconcile(spark, sf):
    a = adapters.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("symbol_id"), F.col("s_acctbal").alias("qty"))
    b = adapters.table(spark, sf, "customer").select(F.col("c_custkey").alias("symbol_id"), F.col("c_acctbal").alias("qty"))
    return trades.reconcile(a, b, 100.0)


@query("""WITH a AS (SELECT s_nationkey AS n, s_suppkey AS s, s_acctbal AS q FROM supplier), b AS (SELECT c_nationkey AS n, c_custkey AS s, c_acctbal AS q FROM customer),
d AS (SELECT n, s FROM a FULL JOIN b USING (n, s) WHERE abs(coalesce(a.q, 0) - coalesce(b.q, 0)) > 9000) SELECT n AS venue, count(d.s) = 0 AS clean, count(d.s)::INTEGER AS n_diverged FROM (SELECT n FROM a UNION SELECT n FROM b) LEFT JOIN d USING (n) GROUP BY n""")
def ta10_reconciliation_status(spark, sf):
    a = adapters.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("venue"), F.col("s_suppkey").alias("symbol_id"), F.col("s_acctbal").alias("qty"))
    b = adapters.table(spark, sf, "customer").select(F.col("c_nationkey").alias("venue"), F.col("c_custkey").alias("symbol_id"), F.col("c_acctbal").alias("qty"))
    return trades.reconciliation_status(a, b, 9000.0).select("venue", "clean", F.size("diverged").alias("n_diverged"))


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'okx' ELSE 'bybit' END AS venue, o_custkey AS symbol_id, o_orderpriority AS strategy FROM orders)
SELECT o_orderkey, symbol_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) AS allowed, (strategy = '1-URGENT' OR venue = 'bybit') AS killed FROM o""")
def jn9_allow_kill(spark, sf):
    o = adapters.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "okx").otherwise("bybit").alias("venue"), F.col("o_custkey").alias("symbol_id"), F.col("o_orderpriority").alias("strategy"))
    c = adapters.table(spark, sf, "customer").where("c_nationkey < 12").select(F.explode(F.array(F.lit("okx"), F.lit("bybit"))).alias("venue"), F.col("c_custkey").alias("symbol_id"))
    kills = spark.createDataFrame([("venue", "bybit"), ("strategy", "1-URGENT")], "scope string, target string")
    return trades.allow_and_kill_flags(o, c, kills).select("o_orderkey", "allowed", "killed")


@query(f"WITH {ME} SELECT venue, symbol_id, arg_max(price, (recv_ts_ns, stream_seq))::DOUBLE AS price, max(recv_ts_ns) AS recv_ts_ns FROM t GROUP BY ALL")
def ag15_latest(spark, sf):
    return core.latest(tr(spark, sf), KEY, "price", "recv_ts_ns").withColumn("price", F.col("price").cast("double"))


@query(f"""WITH {ME}, e AS (SELECT venue, symbol_id, recv_ts_ns, stream_seq, sum(sq) OVER (PARTITION BY venue, symbol_id ORDER BY recv_ts_ns, stream_seq) AS e FROM t),
p AS (SELECT *, max(e) OVER (PARTITION BY venue, symbol_id ORDER BY recv_ts_ns, stream_seq) AS peak FROM e), a AS (SELECT *, max(CASE WHEN e = peak THEN recv_ts_ns END) OVER (PARTITION BY venue, symbol_id ORDER BY recv_ts_ns, stream_seq) AS peak_at FROM p)
SELECT venue, symbol_id, max(recv_ts_ns - peak_at) AS longest_dd_ns, max(peak - e)::DOUBLE AS max_drawdown FROM a GROUP BY ALL""")
def s21_drawdown_duration(spark, sf):
    e = features.cvd(tr(spark, sf)).withColumnRenamed("value", "equity")
    return trades.drawdown_duration(e, KEY, "recv_ts_ns", "stream_seq").select(*KEY, "longest_dd_ns", F.col("max_drawdown").cast("double").alias("max_drawdown"))


@query(f"""WITH {ME}, {GRADES}, w AS (SELECT rule, ts_ns // {DAY} AS week, avg(excess) AS avg_excess FROM ex GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY week DESC) AS n FROM w)
SELECT rule, count(*) AS weeks, round(min(avg_excess), 6) AS worst FROM n WHERE n <= 2 GROUP BY rule HAVING count(*) >= 2 AND min(avg_excess) > 0""")
def s20_graduates(spark, sf):
    return grading.graduates(_weekly(spark, sf), 2).select("rule", "weeks", d("worst"))


@query(f"WITH {ME} SELECT venue, symbol_id, recv_ts_ns, stream_seq, (max(e) OVER w - e)::DOUBLE AS drawdown FROM (SELECT *, sum(sq) OVER (PARTITION BY venue, symbol_id ORDER BY recv_ts_ns, stream_seq) AS e FROM t) WINDOW w AS (PARTITION BY venue, symbol_id ORDER BY recv_ts_ns, stream_seq ROWS UNBOUNDED PRECEDING)")
def wn14_drawdown(spark, sf):
    e = features.cvd(tr(spark, sf)).withColumnRenamed("value", "equity")
    return trades.drawdown(e, KEY, "recv_ts_ns", seq="stream_seq").select(*PLACE, F.col("drawdown").cast("double").alias("drawdown"))


@query("SELECT s_suppkey, round(CASE WHEN s_acctbal > 0 THEN pow(greatest(0, least(1, 1 - s_nationkey * 400 / s_acctbal)), 1.5) ELSE 0 END, 6) AS governor FROM supplier")
def wn15_dd_governor(spark, sf):
    s = adapters.table(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") * 400.0).alias("drawdown"), F.col("s_acctbal").alias("budget"))
    return trades.dd_governor(s, "budget", 1.5).select("s_suppkey", d("governor"))


@query(f"WITH {ME}, e AS (SELECT *, sum(sq) OVER (PARTITION BY venue, symbol_id ORDER BY recv_ts_ns, stream_seq) AS e, recv_ts_ns - recv_ts_ns % {DAY} AS day FROM t) SELECT venue, symbol_id, recv_ts_ns, stream_seq, (e - first_value(e) OVER (PARTITION BY venue, symbol_id, day ORDER BY recv_ts_ns, stream_seq))::DOUBLE AS daily_pnl FROM e")
def wn17_daily_pnl(spark, sf):
    e = features.cvd(tr(spark, sf)).withColumnRenamed("value", "equity")
    return trades.daily_pnl(e, KEY, "recv_ts_ns", "stream_seq").select(*PLACE, F.col("daily_pnl").cast("double").alias("daily_pnl"))


@query(f"""WITH {ME} SELECT venue, symbol_id, recv_ts_ns, stream_seq, (row_number() OVER (PARTITION BY venue, symbol_id ORDER BY recv_ts_ns, stream_seq) - 1 - count(*) OVER (PARTITION BY venue, symbol_id ORDER BY recv_ts_ns RANGE BETWEEN UNBOUNDED PRECEDING AND 3600000000000 PRECEDING)) AS orders_last_min FROM me""")
def wn18_trailing_orders(spark, sf):
    return trades.trailing_order_count(me(spark, sf), KEY, "recv_ts_ns", "stream_seq", 3_600_000_000_000).select(*PLACE, "orders_last_min")


@query(f"""WITH {ME}, s AS (SELECT min(recv_ts_ns) AS lo, max(recv_ts_ns) AS hi FROM t), w AS (SELECT k AS window_id, lo + k * {2 * DAY_NS} AS st FROM s, range(0, 500) AS q(k) WHERE lo + k * {2 * DAY_NS} + {7 * DAY_NS} <= hi + 1)
SELECT window_id, CASE WHEN recv_ts_ns < st + {5 * DAY_NS} THEN 'train' ELSE 'test' END AS part, count(*) AS n, sum(sq)::DOUBLE AS net FROM w JOIN t ON recv_ts_ns >= st AND recv_ts_ns < st + {7 * DAY_NS} GROUP BY ALL""")
def wn19_walk_forward(spark, sf):
    w = study.walk_forward(tr(spark, sf), 5 * DAY_NS, 2 * DAY_NS, 2 * DAY_NS, ts="recv_ts_ns")
    return w.groupBy("window_id", "part").agg(F.count("*").alias("n"), F.sum(sc.signed("qty")).cast("double").alias("net"))


@query("SELECT p_brand, bool_and(abs(p_size - 25) / 50.0 > 0.3 + 1e-9 OR (p_retailprice - 1000 > 0) = (p_size > 3)) AS ok FROM part GROUP BY ALL")
def wn20_plateau(spark, sf):
    p = adapters.table(spark, sf, "part").select("p_brand", ((F.col("p_size") - 25) / 50.0).alias("delta"), (F.col("p_retailprice") - 1000).alias("expectancy"), (F.col("p_size") - 3).alias("base"))
    return study.plateau_ok(p, ("p_brand",))


SCREEN = {"up": [("cvd", "Ge", 100.0)], "down": [("cvd", "Lt", -50.0), ("oi", "Gt", 10.0)]}


def _features(spark, sf):
    cvd = features.cvd(tr(spark, sf)).select(F.lit("cvd").alias("feature"), *KEY, F.col("recv_ts_ns").alias("ts_ns"), F.col("stream_seq").alias("emit_seq"), "value")
    oi = features.oi_delta(core.split_kind(me(spark, sf), "open_interest")).select(F.lit("oi").alias("feature"), *KEY, F.col("recv_ts_ns").alias("ts_ns"), F.col("stream_seq").alias("emit_seq"), "value")
    return core.feature_stream(cvd, oi)


FEATS = """fs AS (SELECT 'cvd' AS feature, venue, symbol_id, recv_ts_ns AS ts, stream_seq AS sq2, (sum(sq) OVER (PARTITION BY venue, symbol_id ORDER BY recv_ts_ns, stream_seq))::DOUBLE AS v, 0 AS ri FROM t
UNION ALL SELECT * FROM (SELECT 'oi', venue, symbol_id, recv_ts_ns, stream_seq, oi - lag(oi) OVER (PARTITION BY venue, symbol_id ORDER BY recv_ts_ns, stream_seq) AS v, 1 FROM me WHERE kind = 'open_interest') WHERE v IS NOT NULL)"""


@query(f"""WITH {ME}, {FEATS}, l AS (SELECT *, last_value(CASE WHEN feature = 'cvd' THEN v END IGNORE NULLS) OVER w AS c, last_value(CASE WHEN feature = 'oi' THEN v END IGNORE NULLS) OVER w AS o FROM fs WINDOW w AS (PARTITION BY symbol_id ORDER BY ts, sq2, ri ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, coalesce(c >= 100, false) AS u, coalesce(c < -50, false) AND coalesce(o > 10, false) AS dn FROM l), p AS (SELECT *, lag(u, 1, false) OVER w AS pu, lag(dn, 1, false) OVER w AS pd FROM s WINDOW w AS (PARTITION BY symbol_id ORDER BY ts, sq2, ri))
SELECT 'up' AS rule_id, symbol_id, ts AS ts_ns, c AS cvd, round(o, 6) AS oi FROM p WHERE u AND NOT pu UNION ALL SELECT 'down', symbol_id, ts, c, round(o, 6) FROM p WHERE dn AND NOT pd""")
def wn11_screen(spark, sf):
    h = screener.screen(_features(spark, sf), SCREEN)
    return h.select("rule_id", "symbol_id", "ts_ns", F.try_element_at("snapshot", F.lit("cvd")).alias("cvd"), F.round(F.try_element_at("snapshot", F.lit("oi")), 6).alias("oi"))


@query(f"WITH {ME}, {FEATS} SELECT feature, venue, symbol_id, ts AS ts_ns, sq2 AS emit_seq, round(v, 6) AS value, ri AS reg_idx FROM (SELECT *, row_number() OVER (PARTITION BY feature, venue, symbol_id ORDER BY ts, sq2) AS k FROM fs) WHERE k > 3")
def wn12_feature_stream(spark, sf):
    return core.warm(_features(spark, sf), 3).select("feature", *KEY, "ts_ns", "emit_seq", d("value"), "reg_idx")


@query()
def sc7_numeric_tokens(spark, sf):
    docs = adapters.table(spark, sf, "documents")
    return docs.select("doc_id", F.size(F.array_distinct(sc.numeric_tokens("text"))).alias("n_numbers"))


@query()
def st6_verify_grounded(spark, sf):
    docs = adapters.table(spark, sf, "documents")
    inputs = docs.select("doc_id", F.col("n_chars").alias("value"))
    return monitor.verify_grounded(docs, inputs, "doc_id").select("doc_id", "n_numbers", F.size("ungrounded").alias("n_ungrounded"), "grounded")


@query()
def ta1_position_ledger(spark, sf):
    led = trades.position_ledger(adapters.fills(spark, sf), ["strategy", "venue", "symbol_id"])
    near = lambda c: F.round(F.col(c) + 1e-9, 6).alias(c)  # noqa: E731  halves go one way in both engines
    return led.select("strategy", "venue", "symbol_id", "ts_ns", "seq", "fill_qty", "price", "fee", "qty", near("avg"), near("realized"), near("attributed_fees"), "closed_qty", near("net"))


@query("""WITH f AS (SELECT o_orderpriority AS strategy, o_custkey AS symbol_id, epoch_us(o_orderdate) * 1000 AS ts_ns, o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END * (o_orderkey % 7 + 1) AS q FROM orders)
SELECT strategy, symbol_id, ts_ns, seq, (sum(q) OVER (PARTITION BY strategy, symbol_id ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING))::DOUBLE AS qty FROM f""")
def ta1_position_qty(spark, sf):
    return trades.position_ledger(adapters.fills(spark, sf), ["strategy", "venue", "symbol_id"]).select("strategy", "symbol_id", "ts_ns", "seq", "qty")


@query()
def ta2_equity(spark, sf):
    led = staged(trades.position_ledger(adapters.fills(spark, sf), ["strategy", "venue", "symbol_id"]), "ledger")
    marks = adapters.fills(spark, sf).groupBy("symbol_id", "ts_ns").agg(F.max("price").alias("mark"))
    funding = led.select("strategy", "venue", "symbol_id", "ts_ns", (F.col("qty") * 0.001).alias("paid"))
    e = trades.equity_curve(led, marks, funding, ["strategy", "venue", "symbol_id"], 100_000.0, ["symbol_id"])
    return e.select("strategy", "symbol_id", "ts_ns", F.round(F.col("equity") + 1e-7, 4).alias("equity"), (F.abs("residual") < 1e-6).alias("balanced"))


RISK = {"max_order_notional": 250_000.0, "max_position_notional": 600_000.0, "max_gross": 900_000.0, "max_px_dev": 0.5, "max_orders_per_min": 12, "strategy_loss": 5000.0, "portfolio_loss": 9000.0}


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'RG-1' WHEN o_custkey % 13 = 0 THEN 'RG-2' WHEN o_totalprice > 250000 THEN 'RG-3' WHEN abs(o_custkey % 5 + (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END)) * 200000 > 600000 THEN 'RG-4'
WHEN o_custkey % 9 * 100000 + o_totalprice > 900000 THEN 'RG-5' WHEN abs(o_totalprice - 200000) / 200000 > 0.5 THEN 'RG-6' WHEN o_orderkey % 17 >= 12 THEN 'RG-7' WHEN -(o_custkey % 7000) < -5000 THEN 'RG-8' WHEN -(o_orderkey % 10000) < -9000 THEN 'RG-9' WHEN o_orderpriority = '1-URGENT' THEN 'RG-10' WHEN o_orderstatus = 'P' THEN 'RG-11' END AS reject FROM orders""")
def ta4_order_compliance(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = adapters.table(spark, sf, "orders").withColumns({
        "mode_allows": k % 11 != 0, "allowed": c % 13 != 0, "qty": F.lit(1.0), "price": F.col("o_totalprice"), "side": F.when(k % 2 == 0, "Buy").otherwise("Sell"), "position_qty": (c % 5).cast("double"), "mark": F.lit(200_000.0),
        "gross_exposure": (c % 9) * 100_000.0, "orders_last_min": k % 17, "strategy_pnl": -(c % 7000), "portfolio_pnl": -(k % 10000), "killed": F.col("o_orderpriority") == "1-URGENT", "reconciled": F.col("o_orderstatus") != "P",
    })
    return trades.order_compliance(o, RISK).select("o_orderkey", "reject")


GATE = {"max_order_notional": 2500.0, "max_position_notional": 2500.0, "max_gross": 9000.0, "max_px_dev": 0.8, "max_orders_per_min": 2, "strategy_loss": 200.0, "portfolio_loss": 600.0}


@query(f"""WITH f AS (SELECT o_orderkey AS seq, o_orderpriority AS strategy, o_custkey AS symbol_id, CASE WHEN o_custkey % 3 > 0 THEN 'okx' ELSE 'kraken_futures' END AS venue, epoch_us(o_orderdate) * 1000 AS dy, epoch_us(o_orderdate) * 1000 + (o_orderkey % 86400) * 1000000000 AS ts,
  CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS sg, (o_orderkey % 7 + 1)::DOUBLE AS qty, round(o_totalprice / 1000 + 1e-9, 2) AS price, round(o_totalprice / 100000 + 1e-9, 4) * (o_orderkey % 3 - 1) * 100 AS inc FROM orders),
x AS (SELECT *, coalesce(sum(sg * qty) OVER (PARTITION BY strategy, venue, symbol_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, max(price) OVER (PARTITION BY symbol_id, dy) AS mark, sum(qty * price) OVER (PARTITION BY dy) AS gross,
  row_number() OVER (PARTITION BY strategy ORDER BY ts, seq) - 1 - count(*) OVER (PARTITION BY strategy ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 3600000000000 PRECEDING) AS n,
  sum(inc) OVER (PARTITION BY strategy, dy ORDER BY ts, seq) - first_value(inc) OVER (PARTITION BY strategy, dy ORDER BY ts, seq) AS sp, sum(inc) OVER (PARTITION BY dy ORDER BY ts, seq) - first_value(inc) OVER (PARTITION BY dy ORDER BY ts, seq) AS pp FROM f),
y AS (SELECT *, coalesce(lag(sp) OVER (PARTITION BY strategy, dy ORDER BY ts, seq), 0) AS s_pnl, coalesce(lag(pp) OVER (PARTITION BY dy ORDER BY ts, seq), 0) AS p_pnl FROM x)
SELECT seq AS order_id, CASE WHEN seq % 11 = 0 THEN 'RG-1' WHEN symbol_id % 13 = 0 THEN 'RG-2' WHEN qty * price > 2500 THEN 'RG-3' WHEN abs(pos + sg * qty) * mark > 2500 THEN 'RG-4' WHEN gross + qty * price > 9000 THEN 'RG-5' WHEN mark > 0 AND abs(price - mark) / mark > 0.8 THEN 'RG-6'
  WHEN n >= 2 THEN 'RG-7' WHEN round(s_pnl, 6) < -200 THEN 'RG-8' WHEN round(p_pnl, 6) < -600 THEN 'RG-9' WHEN strategy = '5-LOW' THEN 'RG-10' WHEN venue = 'kraken_futures' THEN 'RG-11' END AS reject FROM y""")
def ta4_composed_compliance(spark, sf):
    f = adapters.fills(spark, sf).withColumns({"portfolio": F.lit("all"), "venue": F.when(F.col("symbol_id") % 3 > 0, "okx").otherwise("kraken_futures"), "day": F.col("ts_ns"), "ts_ns": F.col("ts_ns") + (F.col("seq") % 86_400) * 1_000_000_000})
    orders = f.select("portfolio", "strategy", "venue", "symbol_id", "ts_ns", "seq", "side", "qty", "price", (F.col("seq") % 11 != 0).alias("mode_allows"))
    positions = scan.scanned(f, ["strategy", "venue", "symbol_id"], {"position_qty": ("sum", sc.signed("qty"), False)}, "ts_ns", ("seq",), DAY_NS, busy=core.crowded(["symbol_id"], f))
    marks = f.groupBy("symbol_id", F.col("day").alias("ts_ns")).agg(F.max("price").alias("mark"))
    exposure = f.groupBy("portfolio", F.col("day").alias("ts_ns")).agg(F.sum(F.col("qty") * F.col("price")).alias("gross_exposure"))
    inc = f.select("portfolio", "strategy", F.col("day").alias("since"), "ts_ns", "seq", (F.col("fee") * (F.col("seq") % 3 - 1) * 100).alias("inc"))

    def pnl(key):
        # Each day's equity from its start: the P&L of the day is the same, and both windows need one move of the rows.
        equity = inc.withColumn("equity", F.sum("inc").over(core.upto(Window.partitionBy(key, "since").orderBy("ts_ns", "seq"))))
        return trades.daily_pnl(equity, [key, "since"]).withColumn("daily_pnl", F.round("daily_pnl", 6))

    allow = f.where("symbol_id % 13 <> 0").select("venue", "symbol_id").distinct()
    kills = f.select(F.lit("strategy").alias("scope"), F.col("strategy").alias("target")).where("target = '5-LOW'").distinct()
    held = f.groupBy("venue", "symbol_id").agg(F.sum(sc.signed("qty")).alias("qty"))
    told = held.withColumn("qty", F.when(F.col("venue") == "okx", F.col("qty")).otherwise(F.col("qty") + 1))
    o = trades.compliance_inputs(orders, positions, marks, exposure, pnl("strategy"), pnl("portfolio"), allow, kills, held, told, 1e-6, 3_600_000_000_000)
    return trades.order_compliance(o, GATE).select(F.col("seq").alias("order_id"), "reject")


@query("""SELECT o_orderkey, round(raw, 7) AS raw, round(CASE WHEN floor(raw / 0.5) * 0.5 * 100 < 2000 THEN 0 ELSE floor(raw / 0.5) * 0.5 END, 4) AS qty FROM (SELECT o_orderkey, greatest(1, 0) * greatest(o_totalprice * (o_custkey % 10) / 10.0, 0) * 0.005 / (1.5 * (0.01 + o_orderkey % 5 / 100.0) * 100) AS raw FROM orders)""")
def ta3_size_orders(spark, sf):
    o = adapters.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("symbol_id"), F.lit(5).alias("ts_ns"), F.col("o_totalprice").alias("equity"), (F.col("o_custkey") % 10 / 10.0).alias("weight"), F.lit(1.0).alias("risk_units"), F.lit(1.5).alias("k_stop"), F.lit(0.5).alias("step_size"), F.lit(2000.0).alias("min_notional"))
    one = o.select(F.col("o_orderkey").alias("id"), F.lit(1).alias("ts_ns"))
    vol = one.select(F.col("id").alias("o_orderkey"), "ts_ns", (0.01 + F.col("id") % 5 / 100.0).alias("vol"))
    marks = one.select(F.col("id").alias("o_orderkey"), "ts_ns", F.lit(100.0).alias("mark"))
    s = trades.size_orders(o, vol, marks, ["o_orderkey"], 0.005)
    return s.select("o_orderkey", F.round("trace.raw", 7).alias("raw"), d("qty", 4))


@query()
def ta9_order_lifecycle(spark, sf):
    l = adapters.table(spark, sf, "lineitem")
    names = F.array(*(F.lit(x) for x in ("Submit", "Ack", "Fill", "Cancel", "AckTimeout", "ResolveAcked")))
    n = Window.partitionBy("l_orderkey").orderBy(*l.columns)
    e = l.withColumn("seq", F.row_number().over(n)).select(F.col("l_orderkey").alias("client_id"), "seq", F.when(F.col("seq") == 1, "Submit").when(F.col("seq") == 2, "Ack").otherwise(F.element_at(names, (F.col("l_partkey") % 6 + 1).cast("int"))).alias("event"), (F.col("l_suppkey") % 2 == 0).alias("complete"))
    return trades.order_lifecycle(e).select("client_id", "state", F.size("illegal").alias("n_illegal"), "terminal", "unknown")


@query(f"""WITH {ME}, {BARS}, o AS (SELECT venue, symbol_id, recv_ts_ns AS ts_ns, stream_seq, side FROM me WHERE kind = 'liquidation'), bb AS (SELECT *, lag(close_ts_ns) OVER (PARTITION BY venue, symbol_id ORDER BY open_ts_ns) AS ready FROM b)
SELECT o.venue, o.symbol_id, o.stream_seq, min(bb.open_ts_ns) AS fill_ts_ns, round(arg_min(bb.open::DOUBLE, bb.open_ts_ns) * CASE WHEN any_value(side) = 'Buy' THEN 1.001 ELSE 0.999 END, 6) AS fill_px FROM o LEFT JOIN bb ON o.venue = bb.venue AND o.symbol_id = bb.symbol_id AND bb.ready >= o.ts_ns GROUP BY ALL""")
def ta5_next_bar_open(spark, sf):
    o = core.split_kind(me(spark, sf), "liquidation").select(*KEY, F.col("recv_ts_ns").alias("ts_ns"), "stream_seq", "side")
    return fills.next_bar_open_fill(o, daily(spark, sf), KEY, 0.001).select(*KEY, "stream_seq", "fill_ts_ns", d("fill_px"))


@query(f"""WITH {ME}, o AS (SELECT stream_seq AS order_id, venue, symbol_id, recv_ts_ns AS ready_ns, side, price::DOUBLE AS limit_px FROM me WHERE kind = 'liquidation')
SELECT order_id, min(t.recv_ts_ns) AS fill_ts_ns FROM o LEFT JOIN t ON o.venue = t.venue AND o.symbol_id = t.symbol_id AND t.recv_ts_ns >= ready_ns AND ((o.side = 'Buy' AND t.side = 'Sell' AND t.price < limit_px) OR (o.side = 'Sell' AND t.side = 'Buy' AND t.price > limit_px)) GROUP BY ALL""")
def ta8_touch_through(spark, sf):
    o = core.split_kind(me(spark, sf), "liquidation").select(F.col("stream_seq").alias("order_id"), *KEY, F.col("recv_ts_ns").alias("ready_ns"), "side", F.col("price").cast("double").alias("limit_px"), F.col("qty").cast("double").alias("qty"))
    return fills.touch_through(o, tr(spark, sf), KEY).select("order_id", "fill_ts_ns")


@query(f"""WITH {ME}, o AS (SELECT stream_seq AS order_id, venue, symbol_id, recv_ts_ns AS ready_ns, side, price::DOUBLE AS limit_px, 3 * qty::DOUBLE AS want FROM me WHERE kind = 'liquidation'),
g AS (SELECT order_id, want, t.recv_ts_ns AS t, sum(0.25 * t.qty::DOUBLE) OVER (PARTITION BY order_id ORDER BY t.recv_ts_ns, t.stream_seq) AS got FROM o JOIN me t ON t.kind = 'trade' AND t.venue = o.venue AND t.symbol_id = o.symbol_id AND t.recv_ts_ns >= ready_ns
AND CASE WHEN o.side = 'Buy' THEN t.side <> 'Buy' AND t.price::DOUBLE < limit_px ELSE t.side = 'Buy' AND t.price::DOUBLE > limit_px END),
f AS (SELECT order_id, min(CASE WHEN round(got, 9) >= want THEN t END) AS fill_ts_ns, least(max(got), max(want)) AS filled FROM g GROUP BY ALL)
SELECT order_id, fill_ts_ns, round(filled, 6) AS filled_qty FROM o LEFT JOIN f USING (order_id)""")
def ta8_queue_share(spark, sf):
    o = core.split_kind(me(spark, sf), "liquidation").select(F.col("stream_seq").alias("order_id"), *KEY, F.col("recv_ts_ns").alias("ready_ns"), "side", F.col("price").cast("double").alias("limit_px"), (3 * F.col("qty").cast("double")).alias("qty"))
    return fills.touch_through(o, tr(spark, sf), KEY, 0.25).select("order_id", "fill_ts_ns", d("filled_qty"))


@query("""WITH l AS (SELECT l_orderkey AS order_id, l_extendedprice / l_quantity AS price, sum(l_quantity) AS qty FROM lineitem WHERE l_orderkey % 5 > 0 GROUP BY ALL), r AS (SELECT *, coalesce(sum(qty) OVER (PARTITION BY order_id ORDER BY price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l),
k AS (SELECT order_id, price, least(greatest(60 - before, 0), qty) AS take FROM r), s AS (SELECT o_orderkey AS order_id, any_value(CASE WHEN o_orderkey % 10 > 0 THEN o_totalprice END) AS last, coalesce(sum(take), 0) AS q, sum(take * price) AS n FROM orders LEFT JOIN k ON o_orderkey = order_id GROUP BY ALL)
SELECT order_id, round(CASE WHEN q > 0 THEN q WHEN last IS NOT NULL THEN 60 ELSE 0 END, 4) AS filled_qty, round(CASE WHEN q > 0 THEN n / q ELSE last * 1.002 END + 1e-8, 6) AS avg_px FROM s""")
def ta7_depth_walk(spark, sf):
    l = adapters.table(spark, sf, "lineitem").where("l_orderkey % 5 > 0").groupBy(F.col("l_orderkey").alias("order_id"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price")).agg(F.sum("l_quantity").alias("qty"))
    o = adapters.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.lit("Buy").alias("side"), F.lit(60.0).alias("qty"), F.when(F.col("o_orderkey") % 10 > 0, F.col("o_totalprice")).alias("last"))
    return fills.depth_walk(o, l, slip=0.002).select("order_id", d("filled_qty", 4), F.round(F.col("avg_px") + 1e-8, 6).alias("avg_px"))  # halves go one way in both engines


def _book(spark, sf):
    """A book per supplier from its line items: a snapshot of five levels, then one delta a row."""
    l = adapters.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("symbol_id"), *[c for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    w = Window.partitionBy("symbol_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    n = l.withColumn("n", F.row_number().over(w).cast("long"))
    level = lambda base: F.struct((base + F.col("l_quantity")).cast("double").alias("price"), F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.round(F.col("l_discount") * 100)).cast("double").alias("qty"))
    snap = (F.col("n") % 50) == 1
    none = F.array().cast(sc.LEVELS)
    skip = F.when(F.col("n") % 23 == 0, 2).otherwise(0)
    bid = F.col("l_linenumber") % 2 == 0
    return n.select(
        F.lit("okx").alias("venue"), "symbol_id", F.col("n").alias("recv_ts_ns"), F.col("n").alias("stream_seq"), F.when(snap, "book_snapshot").otherwise("book_delta").alias("kind"), F.when(snap, F.col("n")).alias("seq"),
        F.when(~snap, F.col("n") + skip).alias("first_seq"), F.when(~snap, F.col("n") + skip).alias("last_seq"), F.when(bid, F.array(level(F.lit(0)))).otherwise(none).alias("bids"), F.when(~bid, F.array(level(F.lit(100)))).otherwise(none).alias("asks"),
    )


@query()
def wn8_book_continuity(spark, sf):
    return book.book_continuity(_book(spark, sf).drop("bids", "asks")).groupBy("symbol_id", "action").agg(F.count("*").alias("n"))  # the rules read ids only


def _book_frames(spark, sf):
    """The books as a venue's frames, normalised."""
    b = _book(spark, sf)
    level = F.coalesce(F.try_element_at("bids", F.lit(1)), F.try_element_at("asks", F.lit(1)))
    payload = F.concat(F.lit('{"topic":"orderbook.1.S'), F.col("symbol_id").cast("string"), F.lit('","type":"'), F.when(F.col("kind") == "book_snapshot", "snapshot").otherwise("delta"), F.lit('","ts":'), F.col("recv_ts_ns").cast("string"), F.lit(',"data":{"s":"S'), F.col("symbol_id").cast("string"), F.lit('","u":'), F.coalesce("seq", "last_seq").cast("string"), F.lit(',"b":[["'), level["price"].cast("string"), F.lit('","'), level["qty"].cast("string"), F.lit('"]],"a":[]}}'))
    # Trades and all other topics read the frames.
    frames = staged(b.select(F.lit("bybit").alias("venue"), "recv_ts_ns", "stream_seq", payload.alias("payload")), "frames")
    return normalize.normalize_frames(frames, "bybit")


@query()
def wn7_sequence_gaps(spark, sf):
    return quality.sequence_gaps(_book_frames(spark, sf), 1_000_000, ("venue", "venue_symbol")).select("venue_symbol", "from_ns", "to_ns", "gap_kind")


@query()
def src12_parse_health(spark, sf):
    return normalize.parse_health(_book_frames(spark, sf))


@query()
def wn8b_book_variants(spark, sf):
    b = staged(_book(spark, sf).drop("bids", "asks"), "book")  # the rules read ids only
    out = None
    for rule in ("strict", "prev", "reseed"):
        x = b.withColumns({"first_seq": F.coalesce("first_seq", "seq"), "last_seq": F.coalesce("last_seq", "seq")}) if rule == "reseed" else b
        c = book.book_continuity(x, rule).groupBy("symbol_id", "action").agg(F.count("*").alias("n")).withColumn("rule", F.lit(rule))
        out = c if out is None else out.unionByName(c)
    return out


@query()
def wn9_top_imbalance(spark, sf):
    return book.top_imbalance(book.book_continuity(_book(spark, sf))).select("symbol_id", "recv_ts_ns", d("value"))


@query()
def wn10_levels_at(spark, sf):
    lv = staged(book.book_levels(book.book_continuity(_book(spark, sf))), "levels")
    times = lv.groupBy("symbol_id").agg(F.explode(F.sequence(F.min("from_ns"), F.max("from_ns"), F.lit(25).cast("long"))).alias("ts_ns"))
    at = book.levels_at(lv, times, ["symbol_id"], 100)
    return at.groupBy("symbol_id", "ts_ns", "side").agg(F.count("*").alias("levels"), F.max("price").alias("top"), F.min("price").alias("bottom"))


@query(f"WITH {ME} SELECT venue, topic, last_ns FROM (SELECT venue, kind AS topic, max(recv_ts_ns) AS last_ns FROM me GROUP BY ALL) WHERE (topic = 'trade' AND {END_NS} - last_ns > 86400000000000) OR (topic = 'liquidation' AND {END_NS} - last_ns > 60000000000)")
def st_s4_stale_streams(spark, sf):
    e = me(spark, sf).withColumn("topic", F.concat_ws("/", "venue", "kind")).where("kind in ('trade', 'liquidation')")
    limits = {f"{v}/trade": DAY_NS for v in adapters.VENUE_OF}
    s = quality.stale_streams(e, limits, 60_000_000_000, END_NS)
    return s.select(F.split_part("topic", F.lit("/"), F.lit(1)).alias("venue"), F.split_part("topic", F.lit("/"), F.lit(2)).alias("topic"), "last_ns")


@query(f"WITH {ME}, p AS (SELECT symbol_id AS proc, max(recv_ts_ns) AS last_ns, (symbol_id % 2 = 0) AS critical FROM me GROUP BY ALL) SELECT proc, last_ns, CASE WHEN critical THEN 'P1' ELSE 'P2' END AS severity FROM p WHERE (SELECT max(recv_ts_ns) FROM me) - last_ns > 3 * 3600000000000::BIGINT")
def st_s5_deadman(spark, sf):
    e = me(spark, sf)
    now = e.agg(F.max("recv_ts_ns")).first()[0]
    beats = e.select(F.col("symbol_id").alias("proc"), F.col("recv_ts_ns").alias("ts_ns"), (F.col("symbol_id") % 2 == 0).alias("critical"))
    return monitor.deadman(beats, 3_600_000_000_000, 3, True, now).select("proc", "last_ns", "severity")


@query()
def st_s6_route_alerts(spark, sf):
    e = me(spark, sf)
    a = e.select(F.col("kind").alias("id"), F.when(F.col("kind") == "status", "P1").when(F.col("kind") == "trade", "P3").otherwise("P2").alias("severity"), F.lit(2 * DAY_NS).cast("long").alias("dedupe_window_ns"), F.concat_ws("/", "kind", "symbol_id").alias("dedupe_key"), F.col("recv_ts_ns").alias("ts_ns"))
    return monitor.route_alerts(a, (1320, 360)).groupBy("severity", "outcome", "channel").agg(F.count("*").alias("n"))


@query(f"WITH {ME}, f AS (SELECT venue, symbol_id, min((recv_ts_ns, stream_seq)) AS seen FROM me GROUP BY ALL) SELECT venue, symbol_id::VARCHAR AS venue_symbol, row_number() OVER (ORDER BY seen, venue, symbol_id::VARCHAR) - 1 AS symbol_id FROM f")
def snk8_intern_symbols(spark, sf):
    return sinks.intern_symbols(me(spark, sf).withColumn("venue_symbol", F.col("symbol_id").cast("string")))


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY ALL")
def se4_first_by_key(spark, sf):
    return core.first_by_key(adapters.table(spark, sf, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query(f"WITH {ME} SELECT source_idx, count(*) AS n, min(recv_ts_ns) AS first_ns, max(stream_seq) AS last_seq FROM (SELECT *, CASE venue WHEN 'okx' THEN 0 ELSE 1 END AS source_idx FROM me WHERE venue IN ('okx', 'bybit')) GROUP BY ALL")
def src2_merged(spark, sf):
    e = me(spark, sf)
    m = core.merged(e.where("venue = 'okx'"), e.where("venue = 'bybit'"))
    return m.groupBy("source_idx").agg(F.count("*").alias("n"), F.min("recv_ts_ns").alias("first_ns"), F.max("stream_seq").alias("last_seq"))


@query("WITH r AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderpriority, o_totalprice FROM r WHERE i = least(round(0.95 * (n - 1)), n - 1)")
def so3_rank_pick(spark, sf):
    o = adapters.table(spark, sf, "orders")
    return core.rank_pick(o, "o_totalprice", F.round(F.lit(0.95) * (F.col("_n") - 1)).cast("long"), ["o_orderpriority"])


@query("WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_orderkey, o_totalprice FROM orders), b AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_orderkey, CASE WHEN o_orderkey % 997 = 5 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders) SELECT min(a.idx) AS idx FROM a JOIN b USING (idx) WHERE a.o_totalprice <> b.o_totalprice")
def jn12_first_divergence(spark, sf):
    o = adapters.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    other = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 997 == 5, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return core.first_divergence(o, other, ["o_orderkey"], ["o_orderkey", "o_totalprice"])


@query()
def st3_mc_drawdown(spark, sf):
    t = adapters.closed_trades(spark, sf).groupBy("strategy", "ts_ns").agg(F.sum("pnl").cast("double").alias("pnl"))
    return study.mc_drawdown(t, 50, 11, 30 * DAY_NS).select("strategy", d("p50_max_dd", 2), d("p95_max_dd", 2), d("worst_max_dd", 2))


@query()
def src7_normalize_binance(spark, sf):
    e = me(spark, sf).where("kind in ('trade', 'liquidation', 'open_interest')")
    ms, sym = (F.col("recv_ts_ns") / 1_000_000).cast("long").cast("string"), F.concat(F.lit("S"), F.col("symbol_id").cast("string"))
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    s = lambda c: F.col(c).cast("string")
    trade = text('{"e":"aggTrade","E":', ms, ',"s":"', sym, '","a":', s("stream_seq"), ',"p":"', s("price"), '","q":"', s("qty"), '","m":', F.when(F.col("side") == "Sell", "true").otherwise("false"), "}")
    liq = text('{"e":"forceOrder","E":', ms, ',"o":{"s":"', sym, '","S":"', F.upper("side"), '","q":"', s("qty"), '","p":"', s("price"), '"}}')
    mark = text('{"e":"markPriceUpdate","E":', ms, ',"s":"', sym, '","p":"', s("oi_contracts"), '","i":"1","r":"0.0001","T":', ms, "}")
    payload = F.when(F.col("kind") == "trade", trade).when(F.col("kind") == "liquidation", liq).otherwise(mark)
    n = normalize.normalize_frames(e.select(F.lit("binance_futures").alias("venue"), "recv_ts_ns", "stream_seq", payload.alias("payload")), "binance_futures")
    return n.groupBy("kind", "side", "venue_symbol").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("qty", "mark", "rate")), 4).alias("total"))


@query(f"WITH {ME} SELECT venue, symbol_id, recv_ts_ns, stream_seq, round(CASE WHEN sum(qty) OVER w > 0 THEN (sum(price * qty) OVER w)::DOUBLE / (sum(qty) OVER w)::DOUBLE END, 6) AS vwap FROM t WINDOW w AS (PARTITION BY venue, symbol_id, recv_ts_ns // {DAY} ORDER BY recv_ts_ns, stream_seq ROWS UNBOUNDED PRECEDING)")
def s6_session_vwap(spark, sf):
    return features.session_vwap(tr(spark, sf)).select(*PLACE, d("vwap"))


@query(f"WITH {ME} SELECT venue, symbol_id, recv_ts_ns, stream_seq, (sum(CASE WHEN side = 'Buy' THEN price * qty ELSE -price * qty END) OVER (PARTITION BY symbol_id ORDER BY recv_ts_ns, stream_seq))::DOUBLE AS value FROM t")
def s1_cvd_across(spark, sf):
    return features.cvd_across(tr(spark, sf)).select(*PLACE, F.col("value").cast("double").alias("value"))


@query(f"WITH {ME}, {BARS} SELECT venue, symbol_id, open_ts_ns, round(abs(delta)::DOUBLE / (abs(close - open)::DOUBLE / 0.01 + 1), 6) AS value FROM b")
def s4_absorption(spark, sf):
    return features.absorption(daily(spark, sf), 0.01).select(*KEY, "open_ts_ns", d("value"))


@query(f"WITH {ME}, {BARS} SELECT venue, symbol_id, open_ts_ns, round(volume::DOUBLE / quantile_cont(volume::DOUBLE, 0.5) OVER (PARTITION BY venue, symbol_id ORDER BY open_ts_ns ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS value FROM b")
def s5_relative_volume(spark, sf):
    return features.relative_volume(daily(spark, sf), 10).select(*KEY, "open_ts_ns", d("value"))


@query()
def s7_previous_day_range(spark, sf):
    return features.previous_day_range(daily(spark, sf), 4).select(*KEY, "open_ts_ns", d("dist_pdh"), d("dist_pdl"))


@query()
def s6_vwap_deviation(spark, sf):
    return features.vwap_deviation(daily(spark, sf), tr(spark, sf), 4).select(*KEY, "open_ts_ns", d("value"))


@query(f"WITH {ME} SELECT venue, symbol_id, recv_ts_ns - recv_ts_ns % {DAY} AS open_ts_ns, (floor(price / 5) * 5)::DOUBLE AS price_bin, sum(CASE WHEN side = 'Buy' THEN qty ELSE 0 END)::DOUBLE AS ask_volume, sum(CASE WHEN side <> 'Buy' THEN qty ELSE 0 END)::DOUBLE AS bid_volume FROM t GROUP BY ALL")
def s25_footprint(spark, sf):
    return bars.footprint(tr(spark, sf), DAY_NS, 5).select(*KEY, "open_ts_ns", F.col("price_bin").cast("double").alias("price_bin"), F.col("ask_volume").cast("double").alias("ask_volume"), F.col("bid_volume").cast("double").alias("bid_volume"))


@query(f"WITH {ME}, x AS (SELECT *, floor(coalesce(sum(qty) OVER (PARTITION BY venue, symbol_id ORDER BY recv_ts_ns, stream_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 500)::BIGINT AS bar FROM t) SELECT venue, symbol_id, bar, arg_min(price, (recv_ts_ns, stream_seq))::DOUBLE AS open, arg_max(price, (recv_ts_ns, stream_seq))::DOUBLE AS close, sum(qty)::DOUBLE AS volume, count(*) AS n FROM x GROUP BY ALL")
def s18_volume_bars(spark, sf):
    return bars.volume_bars(tr(spark, sf), 500).select(*KEY, "bar", F.col("open").cast("double").alias("open"), F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume"), "n")


@query(f"WITH {ME}, {BARS}, o AS (SELECT venue, symbol_id, recv_ts_ns - recv_ts_ns % {DAY} AS open_ts_ns, arg_max(oi, (recv_ts_ns, stream_seq)) AS oi FROM me WHERE kind = 'open_interest' GROUP BY ALL), dl AS (SELECT *, oi - lag(oi) OVER (PARTITION BY venue, symbol_id ORDER BY open_ts_ns) AS x FROM o) SELECT venue, symbol_id, open_ts_ns, round(x, 6) AS oi_delta, CASE WHEN close >= open AND x >= 0 THEN 1 WHEN close >= open THEN 2 WHEN x >= 0 THEN 3 ELSE 4 END AS quadrant FROM b JOIN dl USING (venue, symbol_id, open_ts_ns) WHERE x IS NOT NULL")
def s15_oi_quadrant(spark, sf):
    return features.oi_quadrant(core.split_kind(me(spark, sf), "open_interest"), daily(spark, sf), DAY_NS).select(*KEY, "open_ts_ns", d("oi_delta"), "quadrant")


@query(f"WITH {ME} SELECT venue, symbol_id, recv_ts_ns, stream_seq, round(CASE WHEN count(oi) OVER w >= 5 THEN (oi - avg(oi) OVER w) / nullif(stddev_samp(oi) OVER w, 0) END, 4) AS value FROM me WHERE kind = 'open_interest' WINDOW w AS (PARTITION BY venue, symbol_id ORDER BY recv_ts_ns, stream_seq ROWS 4 PRECEDING)")
def s13_zscore(spark, sf):
    return features.zscore(core.split_kind(me(spark, sf), "open_interest"), "oi_contracts", 5).select(*PLACE, d("value", 4))


@query(f"WITH {ME} SELECT venue, symbol_id, recv_ts_ns - recv_ts_ns % {DAY} AS open_ts_ns, round(sum(CASE WHEN price * qty >= 2000 THEN price * qty ELSE 0 END)::DOUBLE / nullif(sum(price * qty)::DOUBLE, 0), 6) AS value FROM t GROUP BY ALL")
def s10_whale_share(spark, sf):
    return features.whale_share(tr(spark, sf), 2000, DAY_NS).select(*KEY, "open_ts_ns", d("value"))


@query()
def s17_regimes(spark, sf):
    return features.regimes(daily(spark, sf), 4, 20).select(*KEY, "open_ts_ns", "vol_regime", "trend_regime")


@query()
def s3_sweep(spark, sf):
    return features.sweep(tr(spark, sf), DAY_NS).select(*PLACE, d("one_sided"), d("displacement"))


@query()
def s3_sweep_events(spark, sf):
    return features.sweep_events(tr(spark, sf), daily(spark, sf), DAY_NS, 0.5, 2.0, 5).select(*PLACE, "value")


@query()
def s9_node_distance(spark, sf):
    return bars.node_distance(daily(spark, sf), tr(spark, sf), 5.0, 10, 4).select(*KEY, "open_ts_ns", d("dist_hvn"), d("dist_lvn"))


@query()
def s9_profile_nodes(spark, sf):
    return bars.profile_nodes(tr(spark, sf), 5.0).select(*KEY, "bin", d("smooth"), "node")


@query()
def s22_correlation_penalty(spark, sf):
    t = adapters.closed_trades(spark, sf).groupBy("strategy", sc.bucket_index("ts_ns", DAY_NS).alias("day")).agg(F.sum("pnl").cast("double").alias("r"))
    return trades.correlation_penalty(t).select("strategy", "day", d("penalty", 5))


@query("""WITH x AS (SELECT l_returnflag || l_linestatus AS strategy, l_shipdate, sum(((CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) * l_extendedprice * (l_discount - 0.04))::DECIMAL(18,4))::DOUBLE AS r FROM lineitem GROUP BY ALL)
SELECT strategy, round(avg(r) / stddev_samp(r) * sqrt(365), 4) AS sharpe, round(avg(r) / sqrt(avg(least(r, 0) * least(r, 0))) * sqrt(365), 4) AS sortino FROM x GROUP BY strategy""")
def s21_performance(spark, sf):
    t = adapters.closed_trades(spark, sf).groupBy("strategy", "ts_ns").agg(F.sum("pnl").cast("double").alias("r"))
    return trades.performance(t, ["strategy"], 365).select("strategy", d("sharpe", 4), d("sortino", 4))


@query(f"WITH {ME} SELECT venue, symbol_id, recv_ts_ns, stream_seq, round(price::DOUBLE * 2, 6) AS value FROM me WHERE kind = 'open_interest'")
def prj5_funding_feature(spark, sf):
    e = core.split_kind(me(spark, sf), "open_interest").withColumns({"kind": F.lit("funding"), "rate": F.col("price").cast("double") * 2})
    return core.funding_feature(e).select(*PLACE, d("value"))


@query("SELECT p_partkey, coalesce(p_retailprice > 1200, false) AND coalesce(p_size <= 20, false) AS both_hold, coalesce(p_retailprice > 1200, false) OR coalesce(p_size <= 20, false) AS any_holds FROM part")
def prj8_rule_column(spark, sf):
    price, size = ("p_retailprice", "Gt", 1200.0), ("p_size", "Le", 20.0)
    p = adapters.table(spark, sf, "part")
    return p.select("p_partkey", screener.rule_column([price, size]).alias("both_hold"), screener.any_of([[price], [size]]).alias("any_holds"))


@query("SELECT o_orderkey, coalesce(p.v, 0)::DOUBLE AS avg_fwd FROM orders LEFT JOIN (SELECT c_custkey, 0.5 AS v FROM customer WHERE c_custkey % 2 = 0) p ON o_custkey = c_custkey")
def jn5_with_baseline(spark, sf):
    o = adapters.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("symbol"))
    return grading.with_baseline(o, _baseline(spark, sf)).select("o_orderkey", "avg_fwd")


POSITIONS = """f AS (SELECT o_orderpriority AS strategy, o_custkey AS symbol_id, epoch_us(o_orderdate) * 1000 AS ts_ns, o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END * (o_orderkey % 7 + 1) AS q, round(o_totalprice / 1000, 2) AS price FROM orders),
pos AS (SELECT strategy, symbol_id, ts_ns, seq, sum(q) OVER (PARTITION BY strategy, symbol_id ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) AS qty FROM f), endpos AS (SELECT strategy, symbol_id, ts_ns, arg_max(qty, seq) AS qty FROM pos GROUP BY ALL), mk AS (SELECT symbol_id, ts_ns, max(price) AS mark FROM f GROUP BY ALL)"""


def _positions(spark, sf):
    q = F.when(F.col("side") == "Buy", F.col("qty")).otherwise(-F.col("qty"))
    f = adapters.fills(spark, sf)
    run = Window.partitionBy("strategy", "symbol_id").orderBy("ts_ns", "seq").rowsBetween(Window.unboundedPreceding, 0)
    pos = f.withColumn("qty", F.sum(q).over(run)).groupBy("strategy", "symbol_id", "ts_ns").agg(F.max_by("qty", "seq").alias("qty"))
    return pos, f.groupBy("symbol_id", "ts_ns").agg(F.max("price").alias("mark"))


@query(f"WITH {POSITIONS} SELECT m.symbol_id, m.ts_ns, p.strategy, round(0.001 * p.qty * m.mark, 7) AS paid FROM mk m JOIN (SELECT DISTINCT strategy, symbol_id FROM endpos) s ON s.symbol_id = m.symbol_id ASOF JOIN endpos p ON p.strategy = s.strategy AND p.symbol_id = s.symbol_id AND p.ts_ns <= m.ts_ns WHERE p.qty <> 0")
def jn10_accrue_funding(spark, sf):
    pos, marks = _positions(spark, sf)
    funding = marks.select("symbol_id", "ts_ns", F.lit(0.001).alias("rate"))
    return trades.accrue_funding(funding, pos, marks, ["strategy", "symbol_id"], ["symbol_id"]).select("symbol_id", "ts_ns", "strategy", d("paid", 7))


@query(f"WITH {POSITIONS}, sp AS (SELECT strategy, symbol_id, ts_ns AS from_ns, lead(ts_ns) OVER (PARTITION BY strategy, symbol_id ORDER BY ts_ns) AS to_ns, qty FROM endpos) SELECT strategy, symbol_id, from_ns, to_ns FROM sp WHERE qty <> 0 AND to_ns - from_ns >= {30 * DAY_NS} AND NOT EXISTS (SELECT 1 FROM mk WHERE mk.symbol_id = sp.symbol_id AND mk.symbol_id % 3 > 0 AND mk.ts_ns BETWEEN from_ns AND to_ns)")
def jn11_missing_funding(spark, sf):
    pos, marks = _positions(spark, sf)
    w = Window.partitionBy("strategy", "symbol_id").orderBy("ts_ns")
    spans = pos.withColumn("to_ns", F.lead("ts_ns").over(w)).where("qty <> 0 and to_ns is not null").select("strategy", "symbol_id", F.col("ts_ns").alias("from_ns"), "to_ns")
    return trades.missing_funding(spans, marks.where("symbol_id % 3 > 0"), ["symbol_id"], 30 * DAY_NS)


@query()
def ta6_arrival_cost(spark, sf):
    c = book.book_continuity(_book(spark, sf))
    quotes = staged(book.top_of_book(c).where("best_bid is not null and best_ask is not null").select("symbol_id", "recv_ts_ns", "stream_seq", "best_bid", "bid_qty", "best_ask", "ask_qty", "mid"), "quotes")  # read twice
    o = adapters.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("symbol_id")).agg(F.min("l_orderkey").alias("order_id")).withColumns({"ts_ns": F.lit(30).cast("long"), "side": F.when(F.col("symbol_id") % 2 == 0, "Buy").otherwise("Sell"), "qty": F.lit(9.0)})
    last = quotes.select("symbol_id", "recv_ts_ns", "stream_seq", F.col("mid").alias("price"))
    return fills.arrival_cost(o, quotes, last, ["symbol_id"], 5, 0.5, 0.001).select("symbol_id", d("fill_px", 9), "filled_qty", "unfilled_qty")


@query()
def ta11_funnel_audit(spark, sf):
    o = adapters.table(spark, sf, "orders")
    stage = F.element_at(F.array(*(F.lit(s) for s in (*trades.STAGES, "Killed"))), (F.col("k") % 8 + 1).cast("int"))
    t = o.select(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderkey").alias("k"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000 + F.col("o_orderkey")).alias("ts_ns")).withColumn("to", stage)
    w = Window.partitionBy("id").orderBy("ts_ns")
    t = t.withColumns({"from": F.coalesce(F.lag("to").over(w), F.lit("Idea")), "actor_human": F.col("k") % 3 == 0, "autopsy_complete": F.col("k") % 2 == 0})
    ev = t.where("k % 5 > 0").select("id", "to", (F.col("ts_ns") - (F.col("k") % 60) * DAY_NS).alias("ts_ns"))
    return trades.funnel_audit(t, ev).groupBy("violation").agg(F.count("*").alias("n"))


@query()
def ag13_monthly_scoreboard(spark, sf):
    c = adapters.closed_trades(spark, sf).withColumns({"pnl": F.col("pnl").cast("double"), "fee": F.col("fee").cast("double")})
    ids = c.select("strategy").distinct()
    costs = c.select("strategy", "fee", (F.col("fee") * 0.1).alias("paid"), (F.col("fee") * 0.5).alias("realized"), (F.col("fee") * 0.25).alias("modeled"))
    net = c.groupBy("strategy").agg((F.sum("pnl") / 1e6).alias("live_return"))
    tracking = net.withColumns({"paper_return": F.col("live_return") * 0.9, "backtest_return": F.col("live_return") * 1.2})
    steps = ids.select(F.col("strategy").alias("id"), F.explode(F.array(F.lit(False), F.lit(False), F.lit(True))).alias("demotion"))
    bench = adapters.table(spark, sf, "part").agg(F.round(F.avg("p_retailprice"), 6).alias("return"))
    s = trades.monthly_scoreboard(c, costs, ids.withColumn("infra", F.lit(30.0)), tracking, steps, bench, 1e6)
    return s.select("section", "strategy", "metric", F.round("value", 2).alias("value"))


@query("SELECT l_suppkey AS config_hash, l_partkey % 7 AS from_ns, l_partkey % 5 AS to_ns, l_linenumber AS manifest_hashes, count(*) AS runs FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def ag14_repeated_experiments(spark, sf):
    runs = adapters.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("config_hash"), (F.col("l_partkey") % 7).alias("from_ns"), (F.col("l_partkey") % 5).alias("to_ns"), F.col("l_linenumber").alias("manifest_hashes"), F.col("l_orderkey").alias("run_id"))
    return trades.repeated_experiments(runs).drop("run_ids")


@query()
def s2_trade_size_quantile(spark, sf):
    return features.trade_size_quantile(tr(spark, sf), 3 * DAY_NS).select(*PLACE, d("value", 4))


@query()
def s8_climax(spark, sf):
    return features.climax(daily(spark, sf), 10, 1.5, 0.5).select(*KEY, "open_ts_ns", "value")


@query()
def s10_adaptive_whales(spark, sf):
    return features.whale_flow(features.adaptive_whales(tr(spark, sf), 500.0, 3 * DAY_NS, 1.0), DAY_NS).select(*PLACE, d("flow", 2))


@query()
def s11_depth(spark, sf):
    lv = staged(book.book_levels(book.book_continuity(_book(spark, sf))), "levels")
    times = lv.groupBy("symbol_id").agg(F.explode(F.sequence(F.min("from_ns"), F.max("from_ns"), F.lit(25).cast("long"))).alias("ts_ns"))
    return book.depth(book.levels_at(lv, times, ["symbol_id"], 100), 5000.0, ["symbol_id"], tick=0.5)


@query()
def s12_wall_persistence(spark, sf):
    c = staged(book.book_continuity(_book(spark, sf)), "continuity")
    mids = book.top_of_book(c).select("symbol_id", "recv_ts_ns", "mid")
    return book.wall_persistence(book.book_levels(c), mids, 5000.0, 200.0, ("symbol_id",)).select("symbol_id", "side", "price", "from_ns", "to_ns", d("value", 9))


@query()
def s14_cross_venue(spark, sf):
    t = tr(spark, sf).withColumn("pair", (F.col("symbol_id") / 6).cast("long"))
    return features.cross_venue(t.where("venue = 'okx'"), t.where("venue = 'bybit'"), "pair", 3_600_000_000_000).select("pair", "ts_ns", d("value"))


@query()
def s16_lead_lag(spark, sf):
    r = features.log_returns(daily(spark, sf)).withColumn("pair", (F.col("symbol_id") / 6).cast("long"))
    return features.lead_lag(r.where("venue = 'okx'"), r.where("venue = 'bybit'"), 3, DAY_NS, "pair").select("pair", "lag", d("corr"))


@query()
def s16_lead_lag_windows(spark, sf):
    hour = 3_600_000_000_000
    t = tr(spark, sf).withColumn("pair", (F.col("symbol_id") / 6).cast("long"))
    r = lambda v: rolling.grid_returns(t.where(F.col("venue") == v), ["pair"], "price", hour)
    return rolling.lead_lag(r("okx"), r("bybit"), 5 * DAY_NS, 6, hour, "pair").select("pair", "ts_ns", "lag", d("corr"))


@query()
def s19_persistent(spark, sf):
    c = features.cvd(tr(spark, sf)).select("symbol_id", F.col("recv_ts_ns").alias("ts_ns"), (F.col("value") > 0).alias("sat"))
    return screener.persistent(c, 2 * DAY_NS)


@query()
def s20_grade_horizons(spark, sf):
    h = {"4h": DAY_NS // 6, "1d": DAY_NS, "3d": 3 * DAY_NS}
    return grading.grade_horizons(_hits(spark, sf), _prices(spark, sf), h, _baseline(spark, sf)).select("horizon", "rule", "n", "wins", d("avg_excess"))


@query()
def s23_promotion_gates(spark, sf):
    m = _metrics(spark, sf)
    ref = m.where("bucket = 0").select("strategy", F.col("expectancy").cast("double").alias("reference_expectancy"), F.col("gross_loss").cast("double").alias("_g"))
    stage = F.element_at(F.array(*(F.lit(x) for x in ("WalkForward", "Paper", "LiveSmall", "LiveScaled"))), (F.col("bucket") % 4 + 1).cast("int"))
    rows = m.join(ref, "strategy").withColumns({
        "stage": stage, "expectancy": F.col("expectancy").cast("double"), "positive_windows": F.col("hit_rate"), "plateau": F.col("trades") % 5 > 0, "age_days": F.col("trades") % 40, "clean": F.col("trades") % 5 > 0,
        "owner": F.col("trades") % 3 == 0, "slippage_ratio": F.col("gross_loss").cast("double") / F.col("_g"), "drawdown": F.col("gross_loss").cast("double"), "budget": F.lit(2_000_000.0), "recent_expectancy": F.col("expectancy").cast("double"),
    })
    return trades.promotion_gates(rows).select("strategy", "bucket", "stage", F.array_join("reasons", ",").alias("reasons"), "demote_to")


@query()
def s23_stage_gate(spark, sf):
    m = _metrics(spark, sf).withColumn("max_drawdown", F.col("gross_loss").cast("double"))
    live, ref = m.where("bucket = 0").drop("bucket"), m.where("bucket = 1").drop("bucket")
    return trades.stage_gate(live, ref, ["strategy"], 100, 0.5, 1.1).select("strategy", F.array_join("reasons", ",").alias("reasons"), "pass")


@query("SELECT param, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, min(v) AS lo, max(v) AS hi, count(v) AS n FROM (SELECT 'p_size' AS param, p_size::DOUBLE AS v FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part) GROUP BY param")
def s24_param_stability(spark, sf):
    return trades.param_stability(adapters.table(spark, sf, "part"), ["p_size", "p_retailprice"]).select("param", d("mean"), d("sd"), "lo", "hi", "n")


@query(f"WITH {ME}, {GAPS}, x AS (SELECT venue, symbol_id, greatest(from_ns, 1704240000000000000) AS a, least(to_ns, 1704672000000000000) AS b FROM g), s AS (SELECT venue, symbol_id, sum(b - a) AS lost FROM x WHERE b > a GROUP BY ALL) SELECT k.venue, k.symbol_id, round(greatest(0, least(1, 1 - coalesce(lost, 0) / 432000000000000.0)), 6) AS coverage FROM (SELECT DISTINCT venue, symbol_id FROM me) k LEFT JOIN s ON k.venue = s.venue AND k.symbol_id = s.symbol_id")
def s26_coverage_share(spark, sf):
    g = quality.disconnect_gaps(me(spark, sf), END_NS).select(*KEY, F.col("from_ns").alias("start"), F.col("to_ns").alias("end"))
    return intervals.coverage_share(g, KEY, 1704240000000000000, 1704672000000000000, me(spark, sf)).select(*KEY, d("coverage"))


ORACLE_SQL.update(oracles.oracles(ME, BARS, GRADES, METRICS, DAY_NS))
