"""DuckDB counterparts of the queries over books, alerts, orders and specified features."""

from __future__ import annotations

#: A book per supplier and its continuity under the range rule, as ``queries._book`` makes it.
BOOK = """
bk AS MATERIALIZED (SELECT l_suppkey AS symbol_id, n, n % 50 = 1 AS snap, CASE WHEN n % 50 = 1 THEN n WHEN n % 23 = 0 THEN n + 2 ELSE n END AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'bid' ELSE 'ask' END AS side,
  (l_quantity + CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 100 END)::DOUBLE AS price, CASE WHEN l_linenumber = 1 THEN 0.0 ELSE round(l_discount * 100) END::DOUBLE AS qty, sum((n % 50 = 1)::INT) OVER (PARTITION BY l_suppkey ORDER BY n) AS epoch
  FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) AS n FROM lineitem)),
kn AS (SELECT *, max(id) OVER w AS known, lag(id) OVER (PARTITION BY symbol_id, epoch ORDER BY n) AS prior FROM bk WINDOW w AS (PARTITION BY symbol_id, epoch ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
gp AS (SELECT *, NOT snap AND id > known + 1 AS gap FROM kn),
ac AS MATERIALIZED (SELECT *, CASE WHEN snap THEN 'Snapshot' WHEN coalesce(max(gap::INT) OVER (PARTITION BY symbol_id, epoch ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'Drop' WHEN gap THEN 'Gap' WHEN id <= known THEN 'Drop' ELSE 'Apply' END AS action FROM gp),
up AS (SELECT symbol_id, epoch, n, side, price, qty FROM ac WHERE action IN ('Snapshot', 'Apply'))
"""
#: The same under the strict (s1) and the previous-id rule (s2).
STRICT = """
st AS (SELECT *, NOT snap AND id <> prior + 1 AS g1, NOT snap AND id <> prior AS g2 FROM kn),
a2 AS (SELECT *, CASE WHEN snap THEN 'Snapshot' WHEN coalesce(max(g1::INT) OVER w, 0) = 1 THEN 'Drop' WHEN g1 THEN 'Gap' ELSE 'Apply' END AS s1,
  CASE WHEN snap THEN 'Snapshot' WHEN coalesce(max(g2::INT) OVER w, 0) = 1 THEN 'Drop' WHEN g2 THEN 'Gap' ELSE 'Apply' END AS s2 FROM st WINDOW w AS (PARTITION BY symbol_id, epoch ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""
TOP = """
pr AS (SELECT e.symbol_id, e.epoch, e.n, u.side, u.price, arg_max(u.qty, u.n) AS qty FROM up e JOIN up u ON e.symbol_id = u.symbol_id AND e.epoch = u.epoch AND u.n <= e.n GROUP BY ALL),
tp AS (SELECT symbol_id, n, max(price) FILTER (WHERE side = 'bid') AS bb, arg_max(qty, price) FILTER (WHERE side = 'bid') AS bq, min(price) FILTER (WHERE side = 'ask') AS ba, arg_min(qty, price) FILTER (WHERE side = 'ask') AS aq FROM pr WHERE qty > 0 GROUP BY ALL)
"""
LEVELS = """
ep AS (SELECT symbol_id, epoch, min(n) AS first_n, min(n) FILTER (WHERE action = 'Gap') AS gap_n FROM ac WHERE action <> 'Drop' GROUP BY ALL),
ee AS (SELECT symbol_id, epoch, coalesce(gap_n, lead(first_n) OVER (PARTITION BY symbol_id ORDER BY epoch)) AS end_n FROM ep),
lv AS (SELECT u.symbol_id, u.epoch, u.side, u.price, u.qty, u.n AS from_ns, coalesce(lead(u.n) OVER (PARTITION BY u.symbol_id, u.epoch, u.side, u.price ORDER BY u.n), end_n) AS to_ns FROM up u JOIN ee ON u.symbol_id = ee.symbol_id AND u.epoch = ee.epoch),
li AS (SELECT * FROM lv WHERE qty > 0), tt AS (SELECT symbol_id, unnest(range(min(from_ns), max(from_ns) + 1, 25)) AS ts_ns FROM li GROUP BY symbol_id),
la AS (SELECT tt.*, side, price, qty FROM tt JOIN li ON tt.symbol_id = li.symbol_id AND from_ns <= ts_ns AND (to_ns IS NULL OR ts_ns < to_ns))
"""
#: An average-cost ledger of each customer's orders, fill by fill.
LEDGER = """
fl AS MATERIALIZED (SELECT o_orderpriority AS strategy, o_custkey AS symbol_id, epoch_us(o_orderdate) * 1000 AS ts_ns, o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE -1.0 END * (o_orderkey % 7 + 1)::DOUBLE AS q, round(o_totalprice / 1000 + 1e-9, 2) AS price, round(o_totalprice / 100000 + 1e-9, 4) AS fee,
  row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
lg AS (SELECT DISTINCT strategy, symbol_id, 0::BIGINT AS ts_ns, 0::BIGINT AS seq, 0::BIGINT AS n, 0.0::DOUBLE AS q, 0.0::DOUBLE AS price, 0.0::DOUBLE AS fee, 0.0::DOUBLE AS qty, 0.0::DOUBLE AS av, 0.0::DOUBLE AS op, 0.0::DOUBLE AS gross, 0.0::DOUBLE AS attr, 0.0::DOUBLE AS closing FROM fl
  UNION ALL SELECT strategy, symbol_id, ts_ns, seq, n, q, price, fee, total, CASE WHEN opening <> 0 AND total <> 0 THEN (av * rest + price * opening) / total WHEN total = 0 THEN 0.0 ELSE av END, CASE WHEN total <> 0 THEN op * (1 - share_in) + fee * (1 - share_out) ELSE 0.0 END, closing * (price - av) * dir, op * share_in + fee * share_out, closing
  FROM (SELECT *, rest + opening AS total FROM (SELECT *, CASE WHEN closing > 0 THEN closing / abs(qty) ELSE 0.0 END AS share_in, CASE WHEN closing > 0 THEN closing / abs(q) ELSE 0.0 END AS share_out, q + CASE WHEN closing > 0 THEN dir * closing ELSE 0.0 END AS opening, qty - CASE WHEN closing > 0 THEN dir * closing ELSE 0.0 END AS rest
    FROM (SELECT f.strategy, f.symbol_id, f.ts_ns, f.seq, f.n, f.q, f.price, f.fee, r.qty, r.av, r.op, CASE WHEN r.qty * f.q >= 0 THEN 0.0 ELSE least(abs(f.q), abs(r.qty)) END AS closing, CASE WHEN r.qty > 0 THEN 1.0 ELSE -1.0 END AS dir FROM lg r JOIN fl f ON f.strategy = r.strategy AND f.symbol_id = r.symbol_id AND f.n = r.n + 1))))
"""
#: Numbers of a text in six significant digits; the nudge decides ties alike in both engines.
NUMBERS = """list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '-?[0-9]+(?:\\.[0-9]+)?'), lambda x: CASE WHEN x::DOUBLE = 0 THEN '0' ELSE printf('%.5e', x::DOUBLE * (1 + 1e-13)) END))"""


def _quantile(me: str, ns: int) -> str:
    return f"WITH {me}, q AS (SELECT *, quantile_cont((price * qty)::DOUBLE, 0.95) OVER (PARTITION BY venue, symbol_id ORDER BY recv_ts_ns RANGE BETWEEN {ns} PRECEDING AND 1 PRECEDING) AS p FROM t)"


def oracles(ME: str, BARS: str, GRADES: str, METRICS: str, DAY_NS: int) -> dict[str, str]:
    day, key = f"{DAY_NS}::BIGINT", "venue, symbol_id"
    stages = ("Idea", "Hypothesis", "Backtest", "WalkForward", "Paper", "LiveSmall", "LiveScaled", "Killed")
    rank = lambda c: f"CASE {c} " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(stages[:-1])) + " END"
    flag = lambda name, cond: f"CASE WHEN {cond} THEN '{name}' END"
    legal = {
        "RiskChecked Submit": "Submitted", "Submitted Ack": "Acked", "Submitted Reject": "Rejected", "Submitted AckTimeout": "Unknown", "Acked FillPart": "PartFilled", "Acked FillComplete": "Filled", "Acked Cancel": "Cancelled",
        "PartFilled FillPart": "PartFilled", "PartFilled FillComplete": "Filled", "PartFilled Cancel": "Cancelled", "Unknown ResolveAcked": "Acked", "Unknown ResolveRejected": "Rejected", "Unknown ResolveNotFound": "Failed",
    }
    to = "CASE state || ' ' || e " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in legal.items()) + " END"
    horizons = {"4h": DAY_NS // 6, "1d": DAY_NS, "3d": 3 * DAY_NS}
    rvol = f"""{BARS}, rv AS (SELECT *, volume::DOUBLE / nullif(quantile_cont(volume::DOUBLE, 0.5) OVER (PARTITION BY venue, symbol_id ORDER BY open_ts_ns ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS rvol FROM b)"""
    returns = f"""{BARS}, lr AS (SELECT *, CASE WHEN close > 0 AND pc > 0 THEN ln(close::DOUBLE / pc::DOUBLE) END AS r FROM (SELECT *, lag(close) OVER (PARTITION BY venue, symbol_id ORDER BY open_ts_ns) AS pc FROM b))"""
    unit = f"""{returns}, rk AS (SELECT *, count(r) OVER (PARTITION BY {key} ORDER BY open_ts_ns) AS k FROM lr), u AS (SELECT *, CASE WHEN k >= 4 THEN close::DOUBLE * sqrt(sum(r * r) OVER (PARTITION BY {key} ORDER BY k RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)) END AS unit FROM rk)"""
    sweep = f"""sw AS (SELECT *, sum(qty) OVER w - coalesce(sum(qty) OVER o, 0) AS al, sum(bq) OVER w - coalesce(sum(bq) OVER o, 0) AS bu, first_value(price) OVER f AS p0 FROM (SELECT *, CASE WHEN side = 'Buy' THEN qty ELSE 0 END AS bq FROM t)
      WINDOW w AS (PARTITION BY {key} ORDER BY recv_ts_ns, stream_seq), o AS (PARTITION BY {key} ORDER BY recv_ts_ns RANGE BETWEEN UNBOUNDED PRECEDING AND {DAY_NS + 1} PRECEDING), f AS (PARTITION BY {key} ORDER BY recv_ts_ns RANGE BETWEEN {DAY_NS} PRECEDING AND CURRENT ROW)),
    sv AS (SELECT *, CASE WHEN side = 'Buy' THEN bu ELSE al - bu END AS sided, (price - p0)::DOUBLE AS moved FROM sw)"""
    return {
        "wn8_book_continuity": f"WITH {BOOK} SELECT symbol_id, action, count(*) AS n FROM ac GROUP BY ALL",
        "wn8b_book_variants": f"""WITH RECURSIVE {BOOK}, {STRICT},
            rs AS (SELECT symbol_id, n, id AS last, 'Snapshot' AS action FROM bk WHERE n = 1 UNION ALL SELECT b.symbol_id, b.n, CASE WHEN r.last IS NULL THEN b.id WHEN b.id > r.last + 1 THEN NULL WHEN b.id <= r.last THEN r.last ELSE b.id END,
              CASE WHEN r.last IS NULL THEN 'Snapshot' WHEN b.id > r.last + 1 THEN 'Gap' WHEN b.id <= r.last THEN 'Drop' ELSE 'Apply' END FROM rs r JOIN bk b ON b.symbol_id = r.symbol_id AND b.n = r.n + 1)
            SELECT symbol_id, s1 AS action, count(*) AS n, 'strict' AS rule FROM a2 GROUP BY ALL UNION ALL SELECT symbol_id, s2, count(*), 'prev' FROM a2 GROUP BY ALL UNION ALL SELECT symbol_id, action, count(*), 'reseed' FROM rs GROUP BY ALL""",
        "wn7_sequence_gaps": """WITH o AS (SELECT l_suppkey AS symbol_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) AS n FROM lineitem),
            i AS (SELECT symbol_id, n, n % 50 = 1 AS snap, CASE WHEN n % 50 <> 1 AND n % 23 = 0 THEN n + 2 ELSE n END AS id FROM o),
            p AS (SELECT *, NOT snap AND id <> lag(id) OVER w + 1 AS gap, count(*) FILTER (snap) OVER w AS epoch FROM i WINDOW w AS (PARTITION BY symbol_id ORDER BY n)),
            e AS (SELECT symbol_id, epoch, min(n) AS first_n, min(n) FILTER (gap) AS gap_n FROM p GROUP BY ALL), z AS (SELECT *, lead(first_n) OVER (PARTITION BY symbol_id ORDER BY epoch) AS next_n FROM e)
            SELECT 'S' || symbol_id AS venue_symbol, gap_n AS from_ns, coalesce(next_n, 1000000) AS to_ns, 'Venue' AS gap_kind FROM z WHERE gap_n IS NOT NULL""",
        "src12_parse_health": f"WITH {BOOK}, {STRICT} SELECT 'bybit' AS venue, count(*) FILTER (WHERE s1 <> 'Drop') AS emitted, 0::BIGINT AS dropped, count(*) FILTER (WHERE s1 = 'Gap') AS gaps, count(*) FILTER (WHERE snap AND epoch > 1) AS resyncs, 0::BIGINT AS reconnects FROM a2",
        "wn9_top_imbalance": f"WITH {BOOK}, {TOP} SELECT symbol_id, n AS recv_ts_ns, round((bq - aq) / (bq + aq), 6) AS value FROM tp WHERE bq IS NOT NULL AND aq IS NOT NULL",
        "wn10_levels_at": f"WITH {BOOK}, {LEVELS} SELECT symbol_id, ts_ns, side, count(*) AS levels, max(price) AS top, min(price) AS bottom FROM la GROUP BY ALL",
        "s11_depth": f"""WITH {BOOK}, {LEVELS}, bs AS (SELECT symbol_id, ts_ns, max(price) FILTER (WHERE side = 'bid') AS bid, min(price) FILTER (WHERE side = 'ask') AS ask FROM la GROUP BY ALL),
            dp AS (SELECT symbol_id, ts_ns, sum(CASE WHEN side = 'bid' THEN qty ELSE 0 END) AS bid_depth, sum(CASE WHEN side = 'ask' THEN qty ELSE 0 END) AS ask_depth, min(ask - bid) AS spread FROM la JOIN bs USING (symbol_id, ts_ns) WHERE abs(price - (bid + ask) / 2) <= (bid + ask) / 2 * 5000.0 / 1e4 GROUP BY ALL)
            SELECT *, round(spread / 0.5, 6) AS spread_ticks, (bid_depth - ask_depth) / nullif(bid_depth + ask_depth, 0) AS imbalance FROM dp""",
        "s12_wall_persistence": f"""WITH {BOOK}, {TOP}, z AS (SELECT *, price * qty >= 200 AS big, lead(n) OVER w AS nx, lag(price * qty >= 200, 1, false) OVER w AS pb FROM up WINDOW w AS (PARTITION BY symbol_id, epoch, side, price ORDER BY n)),
            i AS (SELECT *, sum((big AND NOT pb)::INT) OVER (PARTITION BY symbol_id, epoch, side, price ORDER BY n) AS wall FROM z),
            g AS (SELECT symbol_id, epoch, side, price, min(n) AS from_ns, max(n) AS last_n FROM i WHERE big GROUP BY symbol_id, epoch, side, price, wall), e AS (SELECT g.*, z.nx AS to_ns FROM g JOIN z ON z.symbol_id = g.symbol_id AND z.n = last_n AND z.side = g.side AND z.price = g.price)
            SELECT e.symbol_id, side, price, from_ns, to_ns, round((to_ns - from_ns) / 1e9, 9) AS value FROM e JOIN tp ON e.symbol_id = tp.symbol_id AND tp.n = from_ns WHERE to_ns IS NOT NULL AND abs(price - (bb + ba) / 2) <= (bb + ba) / 2 * 5000.0 / 1e4""",
        "ta6_arrival_cost": f"""WITH {BOOK}, {TOP}, q AS (SELECT * FROM tp WHERE bb IS NOT NULL AND ba IS NOT NULL), o AS (SELECT DISTINCT l_suppkey AS symbol_id FROM lineitem),
            f AS (SELECT o.symbol_id, o.symbol_id % 2 = 0 AS buy, arg_min(CASE WHEN o.symbol_id % 2 = 0 THEN ba ELSE bb END, q.n) FILTER (WHERE q.n >= 35) AS px, arg_min(CASE WHEN o.symbol_id % 2 = 0 THEN aq ELSE bq END, q.n) FILTER (WHERE q.n >= 35) AS top, arg_max((bb + ba) / 2, q.n) FILTER (WHERE q.n <= 35) AS lastp FROM o LEFT JOIN q ON o.symbol_id = q.symbol_id GROUP BY ALL),
            g AS (SELECT *, coalesce(px, lastp) AS touch, CASE WHEN px IS NOT NULL THEN least(9, greatest(top * 0.5, 0)) WHEN lastp IS NOT NULL THEN 9 ELSE 0 END::DOUBLE AS filled FROM f)
            SELECT symbol_id, round(CASE WHEN filled > 0 THEN touch * CASE WHEN buy THEN 1 + 0.001 ELSE 1 - 0.001 END END, 9) AS fill_px, filled AS filled_qty, 9 - filled AS unfilled_qty FROM g""",
        "st_s6_route_alerts": f"""WITH RECURSIVE {ME}, s AS (SELECT kind, symbol_id, min(recv_ts_ns) AS ts FROM me GROUP BY ALL UNION ALL SELECT s.kind, s.symbol_id, min(me.recv_ts_ns) FROM s JOIN me ON me.kind = s.kind AND me.symbol_id = s.symbol_id AND me.recv_ts_ns >= s.ts + {2 * DAY_NS} GROUP BY ALL),
            sent AS (SELECT kind, CASE WHEN kind = 'trade' AND ((ts % {day}) // 60000000000 >= 1320 OR (ts % {day}) // 60000000000 < 360) THEN 'Batched' ELSE 'Sent' END AS outcome, count(*) AS n FROM s GROUP BY ALL),
            al AS (SELECT * FROM sent UNION ALL SELECT me.kind, 'Deduped', count(*) - (SELECT sum(n) FROM sent WHERE sent.kind = me.kind) FROM me GROUP BY me.kind),
            v AS (SELECT CASE kind WHEN 'status' THEN 'P1' WHEN 'trade' THEN 'P3' ELSE 'P2' END AS severity, outcome, n FROM al WHERE n > 0)
            SELECT severity, outcome, CASE severity WHEN 'P1' THEN 'page' WHEN 'P2' THEN 'push' ELSE 'digest' END AS channel, sum(n)::BIGINT AS n FROM v GROUP BY ALL""",
        "ta9_order_lifecycle": f"""WITH RECURSIVE ev AS MATERIALIZED (SELECT l_orderkey AS client_id, seq, CASE WHEN seq = 1 THEN 'Submit' WHEN seq = 2 THEN 'Ack' WHEN l_partkey % 6 = 2 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'FillComplete' ELSE 'FillPart' END ELSE ['Submit', 'Ack', 'Fill', 'Cancel', 'AckTimeout', 'ResolveAcked'][l_partkey % 6 + 1] END AS e
              FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS seq FROM lineitem)),
            r AS (SELECT DISTINCT client_id, 0::BIGINT AS seq, 'RiskChecked' AS state, 0 AS n_illegal FROM ev UNION ALL SELECT r.client_id, ev.seq, coalesce({to}, state), n_illegal + CASE WHEN {to} IS NULL THEN 1 ELSE 0 END FROM r JOIN ev ON ev.client_id = r.client_id AND ev.seq = r.seq + 1)
            SELECT client_id, arg_max(state, seq) AS state, max(n_illegal)::INTEGER AS n_illegal, arg_max(state, seq) IN ('Filled', 'Cancelled', 'Rejected', 'Failed') AS terminal, arg_max(state, seq) = 'Unknown' AS unknown FROM r GROUP BY client_id""",
        "ta11_funnel_audit": f"""WITH s AS (SELECT o_custkey::VARCHAR AS id, o_orderkey AS k, epoch_us(o_orderdate) * 1000 + o_orderkey AS ts, [{", ".join(f"'{s}'" for s in stages)}][o_orderkey % 8 + 1] AS t FROM orders),
            ff AS (SELECT *, lag(t) OVER (PARTITION BY id ORDER BY ts) AS prev FROM s), x AS (SELECT *, coalesce(prev, 'Idea') AS f FROM ff), ev AS (SELECT id, t, max(ts - (k % 60) * {day}) AS ev FROM x WHERE k % 5 > 0 GROUP BY ALL),
            j AS (SELECT x.*, ev.ev, {rank("x.t")} AS rt, {rank("x.f")} AS rf FROM x LEFT JOIN ev ON x.id = ev.id AND x.t = ev.t), u AS (SELECT *, coalesce(rt > rf, false) AS up, t = 'Killed' AS killed FROM j),
            v AS (SELECT unnest(list_filter([{flag("FromMismatch", "prev IS NOT NULL AND prev <> f")}, {flag("AfterKilled", "f = 'Killed'")}, {flag("UnknownStage", "NOT killed AND f <> 'Killed' AND (rt IS NULL OR rf IS NULL)")}, {flag("SkipsStage", "up AND rt <> rf + 1")},
              {flag("NoEvidence", "up AND rt >= 3 AND ev IS NULL")}, {flag("StaleEvidence", f"up AND rt >= 3 AND ts - ev > 30 * {day}")}, {flag("NeedsHuman", "up AND rt >= 5 AND k % 3 <> 0")}, {flag("NotLower", "NOT killed AND NOT up AND rt >= rf")}, {flag("NoAutopsy", "killed AND k % 2 <> 0")}], lambda v: v IS NOT NULL)) AS violation FROM u)
            SELECT violation, count(*) AS n FROM v GROUP BY ALL""",
        "src7_normalize_binance": f"""WITH {ME}, e AS (SELECT 'trade' AS kind, side, symbol_id, qty::DOUBLE AS x FROM t UNION ALL SELECT 'liquidation', side, symbol_id, qty::DOUBLE FROM me WHERE kind = 'liquidation'
            UNION ALL SELECT 'mark_price', NULL, symbol_id, oi FROM me WHERE kind = 'open_interest' UNION ALL SELECT 'funding', NULL, symbol_id, 0.0001 FROM me WHERE kind = 'open_interest')
            SELECT kind, side, 'S' || symbol_id AS venue_symbol, count(*) AS n, round(sum(x), 4) AS total FROM e GROUP BY ALL""",
        "s2_trade_size_quantile": f"{_quantile(ME, 3 * DAY_NS)} SELECT {key}, recv_ts_ns, stream_seq, round(p, 4) AS value FROM q",
        "s10_adaptive_whales": f"""{_quantile(ME, 3 * DAY_NS)}, w AS (SELECT *, (CASE WHEN side = 'Buy' THEN 1 ELSE -1 END) * (price * qty)::DOUBLE AS v FROM q WHERE (price * qty)::DOUBLE >= greatest(500.0, coalesce(p, 0)))
            SELECT {key}, recv_ts_ns, stream_seq, round(sum(v) OVER (PARTITION BY {key} ORDER BY recv_ts_ns, stream_seq) - coalesce(sum(v) OVER (PARTITION BY {key} ORDER BY recv_ts_ns RANGE BETWEEN UNBOUNDED PRECEDING AND {DAY_NS + 1} PRECEDING), 0), 2) AS flow FROM w""",
        "s3_sweep": f"WITH {ME}, {sweep} SELECT {key}, recv_ts_ns, stream_seq, round(sided::DOUBLE / nullif(al::DOUBLE, 0), 6) AS one_sided, round(moved, 6) AS displacement FROM sv",
        "s3_sweep_events": f"""WITH {ME}, {BARS}, {sweep}, md AS (SELECT {key}, close_ts_ns, quantile_cont(volume::DOUBLE, 0.5) OVER (PARTITION BY {key} ORDER BY open_ts_ns ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM b),
            j AS (SELECT sv.*, md.m FROM sv ASOF JOIN md ON sv.venue = md.venue AND sv.symbol_id = md.symbol_id AND sv.recv_ts_ns >= md.close_ts_ns)
            SELECT {key}, recv_ts_ns, stream_seq, CASE WHEN side = 'Buy' THEN 1.0 ELSE -1.0 END::DOUBLE AS value FROM j WHERE sided::DOUBLE >= 0.5 * m AND moved * CASE WHEN side = 'Buy' THEN 1 ELSE -1 END >= 2.0""",
        "s8_climax": f"WITH {ME}, {rvol} SELECT {key}, open_ts_ns, coalesce(rvol >= 1.5 AND abs(delta)::DOUBLE / nullif(volume::DOUBLE, 0) >= 0.5, false) AS value FROM rv",
        "s9_profile_nodes": f"""WITH {ME}, bi AS (SELECT {key}, floor(price / 5.0)::BIGINT AS bin, sum(qty) AS volume FROM t GROUP BY ALL), sm AS (SELECT *, avg(volume::DOUBLE) OVER (PARTITION BY {key} ORDER BY bin RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smooth FROM bi),
            nb AS (SELECT *, lag(smooth) OVER w AS a, lead(smooth) OVER w AS z FROM sm WINDOW w AS (PARTITION BY {key} ORDER BY bin)) SELECT {key}, bin, round(smooth, 6) AS smooth, CASE WHEN smooth > a AND smooth > z THEN 'hvn' WHEN smooth < a AND smooth < z THEN 'lvn' END AS node FROM nb""",
        # Volume units: close times the root of the last four squared returns.
        "s9_node_distance": f"""WITH {ME}, {unit}, dy AS (SELECT {key}, recv_ts_ns // {day} AS d, floor(price / 5.0)::BIGINT AS bin, sum(qty) AS volume FROM t GROUP BY ALL), bi AS (SELECT venue, symbol_id, day, bin, sum(volume) AS volume FROM (SELECT *, unnest(range(d + 1, d + 11)) AS day FROM dy) GROUP BY ALL),
            sm AS (SELECT *, avg(volume::DOUBLE) OVER (PARTITION BY {key}, day ORDER BY bin RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smooth FROM bi), nb AS (SELECT *, lag(smooth) OVER w AS a, lead(smooth) OVER w AS z FROM sm WINDOW w AS (PARTITION BY {key}, day ORDER BY bin)),
            nd AS (SELECT venue, symbol_id, day, (bin + 0.5) * 5.0 AS mid, smooth > a AND smooth > z AS h, smooth < a AND smooth < z AS l FROM nb)
            SELECT u.venue, u.symbol_id, open_ts_ns, round(min(abs(mid - close::DOUBLE)) FILTER (WHERE h) / nullif(any_value(unit), 0), 6) AS dist_hvn, round(min(abs(mid - close::DOUBLE)) FILTER (WHERE l) / nullif(any_value(unit), 0), 6) AS dist_lvn FROM u LEFT JOIN nd ON u.venue = nd.venue AND u.symbol_id = nd.symbol_id AND close_ts_ns // {day} = nd.day GROUP BY u.venue, u.symbol_id, open_ts_ns""",
        "s7_previous_day_range": f"WITH {ME}, {unit} SELECT {key}, open_ts_ns, round((lag(high) OVER w - close)::DOUBLE / nullif(unit, 0), 6) AS dist_pdh, round((close - lag(low) OVER w)::DOUBLE / nullif(unit, 0), 6) AS dist_pdl FROM u WINDOW w AS (PARTITION BY {key} ORDER BY open_ts_ns)",
        "s6_vwap_deviation": f"WITH {ME}, {unit}, v AS (SELECT *, round((close::DOUBLE - pq::DOUBLE / volume::DOUBLE) / nullif(unit, 0), 6) AS value FROM u) SELECT {key}, open_ts_ns, CASE WHEN value = 0 THEN 0.0 ELSE value END::DOUBLE AS value FROM v",
        "s14_cross_venue": f"""WITH {ME}, g AS (SELECT venue, symbol_id // 6 AS pair, recv_ts_ns - recv_ts_ns % 3600000000000 AS ts_ns, arg_max(price, (recv_ts_ns, stream_seq))::DOUBLE AS px FROM t WHERE venue IN ('okx', 'bybit') GROUP BY ALL),
            j AS (SELECT pair, ts_ns, max(px) FILTER (WHERE venue = 'okx') AS a, max(px) FILTER (WHERE venue = 'bybit') AS b FROM g GROUP BY ALL), c AS (SELECT pair, ts_ns, last_value(a IGNORE NULLS) OVER w AS pa, last_value(b IGNORE NULLS) OVER w AS pb FROM j WINDOW w AS (PARTITION BY pair ORDER BY ts_ns ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
            SELECT pair, ts_ns, round((pa - pb) / nullif(pb, 0), 6) AS value FROM c WHERE pa IS NOT NULL AND pb IS NOT NULL""",
        "s16_lead_lag": f"""WITH {ME}, {returns}, x AS (SELECT symbol_id // 6 AS pair, open_ts_ns + lag * {day} AS bar, lag, r AS ra FROM lr, range(-3, 4) AS q(lag) WHERE venue = 'okx'), y AS (SELECT symbol_id // 6 AS pair, open_ts_ns AS bar, r AS rb FROM lr WHERE venue = 'bybit'),
            c AS (SELECT pair, lag, corr(ra, rb) AS c FROM x JOIN y USING (pair, bar) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY round(abs(c), 12) DESC, abs(lag), lag) AS n FROM c WHERE c IS NOT NULL AND NOT isnan(c))
            SELECT pair, lag::INTEGER AS lag, round(c, 6) AS corr FROM k WHERE n = 1""",
        "s16_lead_lag_windows": f"""WITH {ME}, g AS (SELECT venue, symbol_id // 6 AS pair, recv_ts_ns // 3600000000000 AS h, arg_max(price, (recv_ts_ns, stream_seq))::DOUBLE AS c FROM t WHERE venue IN ('okx', 'bybit') AND price > 0 GROUP BY ALL),
            r AS (SELECT venue, pair, h // 120 AS w, h % 120 AS i, ln(c / p) AS r FROM (SELECT *, lag(c) OVER (PARTITION BY venue, pair ORDER BY h) AS p FROM g) WHERE p IS NOT NULL), l AS (SELECT lag FROM range(-6, 7) AS q(lag)),
            a AS (SELECT pair, w, lag, sum(r) AS sx, sum(r * r) AS sxx FROM r, l WHERE venue = 'okx' AND i + lag BETWEEN 0 AND 119 GROUP BY ALL), b AS (SELECT pair, w, lag, sum(r) AS sy, sum(r * r) AS syy FROM r, l WHERE venue = 'bybit' AND i - lag BETWEEN 0 AND 119 GROUP BY ALL),
            ab AS (SELECT x.pair, x.w, lag, sum(x.r * y.r) AS sxy FROM r x, l, r y WHERE x.venue = 'okx' AND y.venue = 'bybit' AND x.pair = y.pair AND x.w = y.w AND y.i = x.i + lag GROUP BY ALL),
            c AS (SELECT a.pair, a.w, a.lag, (n * coalesce(sxy, 0) - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) AS c FROM (SELECT *, 120 - abs(lag) AS n FROM a) a JOIN b USING (pair, w, lag) LEFT JOIN ab USING (pair, w, lag) WHERE n * sxx - sx * sx > 1e-12 AND n * syy - sy * sy > 1e-12),
            k AS (SELECT *, row_number() OVER (PARTITION BY pair, w ORDER BY round(abs(c), 12) DESC, abs(lag), lag) AS n FROM c)
            SELECT pair, (w + 1) * 432000000000000 AS ts_ns, lag::INTEGER AS lag, round(c, 6) AS corr FROM k WHERE n = 1""",
        "s17_regimes": f"""WITH {ME}, {returns}, k AS (SELECT *, count(r) OVER (PARTITION BY {key} ORDER BY open_ts_ns) AS k FROM lr), v AS (SELECT *, sqrt(sum(r * r) OVER (PARTITION BY {key} ORDER BY k RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)) AS rv0 FROM k), z AS (SELECT *, round(rv0, 12) AS rv FROM v WHERE k >= 4),
            l AS (SELECT *, CASE WHEN close > 0 AND pc2 > 0 THEN ln(close::DOUBLE / pc2::DOUBLE) END AS r2 FROM (SELECT *, lag(close) OVER (PARTITION BY {key} ORDER BY open_ts_ns) AS pc2 FROM z)),
            q AS (SELECT *, quantile_cont(rv, 1.0 / 3) OVER p AS lo, quantile_cont(rv, 2.0 / 3) OVER p AS hi, round(abs(sum(r2) OVER s) / nullif(sum(abs(r2)) OVER s, 0), 9) AS er FROM l WINDOW p AS (PARTITION BY {key} ORDER BY open_ts_ns ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), s AS (PARTITION BY {key} ORDER BY open_ts_ns ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
            SELECT {key}, open_ts_ns, CASE WHEN rv <= lo THEN 'low' WHEN rv >= hi THEN 'high' WHEN lo IS NOT NULL THEN 'mid' END AS vol_regime, CASE WHEN er >= 0.3 THEN 'trend' ELSE 'range' END AS trend_regime FROM q""",
        "s19_persistent": f"""WITH {ME}, c AS (SELECT symbol_id, recv_ts_ns, stream_seq, sum(sq) OVER (PARTITION BY {key} ORDER BY recv_ts_ns, stream_seq) > 0 AS sat FROM t), r AS (SELECT *, sum(CASE WHEN sat THEN 0 ELSE 1 END) OVER (PARTITION BY symbol_id ORDER BY recv_ts_ns, stream_seq) AS run FROM c),
            h AS (SELECT symbol_id, run, recv_ts_ns AS ts, min(recv_ts_ns) OVER (PARTITION BY symbol_id, run) AS since FROM r WHERE sat) SELECT symbol_id, min(ts) AS ts_ns, min(since) AS since_ns FROM h WHERE ts - since >= {2 * DAY_NS} GROUP BY symbol_id, run""",
        "s20_grade_horizons": " UNION ALL ".join(f"SELECT * FROM (WITH {ME}, {GRADES.replace(f'ts_ns + {day}', f'ts_ns + {ns}::BIGINT')} SELECT '{name}' AS horizon, rule, n, wins, round(avg_excess, 6) AS avg_excess FROM gr)" for name, ns in horizons.items()),
        "s22_correlation_penalty": """WITH x AS (SELECT l_returnflag || l_linestatus AS strategy, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS day, sum(((CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) * l_extendedprice * (l_discount - 0.04))::DECIMAL(18,4))::DOUBLE AS r FROM lineitem GROUP BY ALL),
            c AS (SELECT a.strategy, a.day, corr(a.r, b.r) OVER (PARTITION BY a.strategy, b.strategy ORDER BY a.day RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS c FROM x a JOIN x b ON a.day = b.day AND a.strategy <> b.strategy),
            p AS (SELECT strategy, day, sum(c) AS s FROM c WHERE NOT isnan(c) AND c > 0.5 GROUP BY ALL) SELECT x.strategy, x.day, round(1 / (1 + coalesce(s, 0)), 5) AS penalty FROM x LEFT JOIN p ON p.strategy = x.strategy AND p.day = x.day""",
        "s23_stage_gate": f"""WITH {METRICS}, m AS (SELECT *, (gross_win - gross_loss) / trades AS e FROM tm), j AS (SELECT l.*, l.e / nullif(r.e, 0) AS er, l.gross_loss / nullif(r.gross_loss, 0) AS dr FROM m l LEFT JOIN m r ON l.strategy = r.strategy AND r.bucket = 1 WHERE l.bucket = 0),
            z AS (SELECT strategy, array_to_string(list_filter([{flag("min_trades", "trades < 100")}, {flag("expectancy_ratio", "NOT coalesce(er >= 0.5, false)")}, {flag("dd_ratio", "coalesce(dr > 1.1, false)")}], lambda v: v IS NOT NULL), ',') AS reasons FROM j) SELECT strategy, reasons, reasons = '' AS pass FROM z""",
        "s23_promotion_gates": f"""WITH {METRICS}, m AS (SELECT *, (gross_win - gross_loss) / trades AS e FROM tm), j AS (SELECT l.strategy, l.bucket, l.e, r.e AS ref, l.wins / l.trades::DOUBLE AS ws, l.trades % 40 AS age, l.trades % 3 = 0 AS owner, l.trades % 5 > 0 AS clean, l.gross_loss / r.gross_loss AS slip, l.gross_loss AS dd FROM m l JOIN m r ON l.strategy = r.strategy AND r.bucket = 0),
            z AS (SELECT *, ['WalkForward', 'Paper', 'LiveSmall', 'LiveScaled'][bucket % 4 + 1] AS stage, abs(e / nullif(ref, 0) - 1) AS off FROM j)
            SELECT strategy, bucket, stage, coalesce(array_to_string(list_filter(CASE stage WHEN 'WalkForward' THEN [{flag("oos_expectancy", "coalesce(e / nullif(ref, 0) < 0.5, true)")}, {flag("positive_windows", "ws < 0.7")}, {flag("plateau", "NOT clean")}]
              WHEN 'Paper' THEN [{flag("age", "age < 14")}, {flag("divergence", "coalesce(off > 0.3, true)")}, {flag("faults", "NOT clean")}, {flag("owner", "NOT owner")}]
              WHEN 'LiveSmall' THEN [{flag("age", "age < 28")}, {flag("divergence", "coalesce(off > 0.4, true)")}, {flag("slippage", "slip > 1.5")}, {flag("faults", "NOT clean")}, {flag("owner", "NOT owner")}] ELSE []::VARCHAR[] END, lambda v: v IS NOT NULL), ','), '') AS reasons,
              CASE WHEN stage IN ('LiveSmall', 'LiveScaled') AND dd >= 2000000 THEN 'Paper' WHEN stage = 'LiveScaled' AND e < 0 THEN 'LiveSmall' WHEN stage = 'Paper' AND coalesce(off > 0.5, false) THEN 'WalkForward' END AS demote_to FROM z""",
        "ta1_position_ledger": f"""WITH RECURSIVE {LEDGER} SELECT strategy, 'okx' AS venue, symbol_id, ts_ns, seq, q AS fill_qty, price, fee, qty, round(av + 1e-9, 6) AS avg, round(gross + 1e-9, 6) AS realized, round(attr + 1e-9, 6) AS attributed_fees, closing AS closed_qty, round(CASE WHEN closing > 0 THEN gross - attr ELSE 0 END + 1e-9, 6) AS net FROM lg WHERE n > 0""",
        "ta2_equity": f"""WITH RECURSIVE {LEDGER}, c AS (SELECT *, sum(gross) OVER w AS cr, sum(fee) OVER w AS cf, sum(-q * price - fee) OVER w AS cc FROM lg WHERE n > 0 WINDOW w AS (PARTITION BY strategy, symbol_id ORDER BY ts_ns, seq)),
            z AS (SELECT strategy, symbol_id, ts_ns, arg_max(qty, seq) AS qty, arg_max(av, seq) AS av, arg_max(cr, seq) AS cr, arg_max(cf, seq) AS cf, arg_max(cc, seq) AS cc FROM c GROUP BY ALL), fp AS (SELECT strategy, symbol_id, ts_ns, sum(qty * 0.001) AS paid FROM c GROUP BY ALL),
            fu AS (SELECT strategy, symbol_id, ts_ns, sum(paid) OVER (PARTITION BY strategy, symbol_id ORDER BY ts_ns) AS funding FROM fp), mk AS (SELECT symbol_id, ts_ns, max(price) AS mark FROM fl GROUP BY ALL), t AS (SELECT mk.*, k.strategy FROM mk JOIN (SELECT DISTINCT strategy, symbol_id FROM fl) k USING (symbol_id)),
            a AS (SELECT t.*, coalesce(z.qty, 0) AS qty, coalesce(z.av, 0) AS av, coalesce(cr, 0) AS cr, coalesce(cf, 0) AS cf, coalesce(cc, 0) AS cc FROM t ASOF LEFT JOIN z ON t.strategy = z.strategy AND t.symbol_id = z.symbol_id AND t.ts_ns >= z.ts_ns),
            e AS (SELECT a.*, coalesce(funding, 0) AS fd FROM a ASOF LEFT JOIN fu ON a.strategy = fu.strategy AND a.symbol_id = fu.symbol_id AND a.ts_ns >= fu.ts_ns), g AS (SELECT *, 100000 + cr + qty * (mark - av) - cf - fd AS eq FROM e)
            SELECT strategy, symbol_id, ts_ns, round(eq + 1e-7, 4) AS equity, abs(100000 + cc - fd + qty * mark - eq) < 1e-6 AS balanced FROM g""",
        "st6_verify_grounded": f"""WITH n AS (SELECT doc_id, {NUMBERS} AS ns, CASE WHEN n_chars = 0 THEN '0' ELSE printf('%.5e', n_chars::DOUBLE * (1 + 1e-13)) END AS h FROM documents) SELECT doc_id, len(ns)::INTEGER AS n_numbers, len(list_filter(ns, lambda x: x IS DISTINCT FROM h))::INTEGER AS n_ungrounded, len(list_filter(ns, lambda x: x IS DISTINCT FROM h)) = 0 AS grounded FROM n""",
        "sc7_numeric_tokens": f"SELECT doc_id, len({NUMBERS})::INTEGER AS n_numbers FROM documents",
        "ag13_monthly_scoreboard": f"""WITH {METRICS}, c2 AS (SELECT strategy, ts_ns, pnl::DOUBLE AS pnl, fee::DOUBLE AS fee FROM ct), d1 AS (SELECT strategy, ts_ns, sum(pnl) AS pnl FROM c2 GROUP BY ALL), dd AS (SELECT strategy, ts_ns, sum(pnl) OVER (PARTITION BY strategy ORDER BY ts_ns) AS eq FROM d1), d2 AS (SELECT strategy, eq, max(eq) OVER (PARTITION BY strategy ORDER BY ts_ns) AS pk FROM dd),
            p AS (SELECT strategy, sum(gross_win) - sum(gross_loss) AS net, sum(trades) AS n, sum(wins) AS w FROM tm GROUP BY ALL), mx AS (SELECT strategy, max(pk - eq) AS x FROM d2 GROUP BY ALL), f AS (SELECT strategy, sum(fee) AS fee FROM c2 GROUP BY ALL),
            o AS (SELECT 'performance' AS section, strategy, unnest(['net', 'expectancy', 'trades', 'hit_rate', 'net_return']) AS metric, unnest([net, net / n, n::DOUBLE, w / n::DOUBLE, net / 1e6]) AS value FROM p UNION ALL SELECT 'performance', strategy, 'max_drawdown', x FROM mx
              UNION ALL SELECT 'tracking', strategy, unnest(['live_return', 'paper_return', 'backtest_return', 'tracking_error']), unnest([net / 1e6, net / 1e6 * 0.9, net / 1e6 * 1.2, net / 1e6 - net / 1e6 * 1.2]) FROM p
              UNION ALL SELECT 'costs', strategy, unnest(['fees', 'slippage_vs_model', 'funding', 'infra']), unnest([fee, fee * 0.5 - fee * 0.25, fee * 0.1, 30.0]) FROM f UNION ALL SELECT 'funnel', strategy, unnest(['transitions', 'demotions']), unnest([3.0, 1.0]) FROM p UNION ALL SELECT 'benchmark', 'benchmark', 'return', (SELECT round(avg(p_retailprice), 6) FROM part))
            SELECT section, strategy, metric, round(value, 2) AS value FROM o""",
    }
