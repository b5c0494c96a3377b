"""Trade analytics: metrics, gates, allocation, ledger, sizing, compliance, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import DAY_NS, bucket, bucket_index, clamp, is_finite, round_down, signed
from tidemark.operators import core
from tidemark.operators.asof import AsOf, asof, asof_each
from tidemark.operators.core import crowded, joined, running
from tidemark.operators.scan import affine, ranked, scanned
from tidemark.staging import settled, staged

INF = float("inf")


def trade_metrics(closed: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, wins, gross win and loss, rates; the maker part alongside. Trades of zero profit do not count."""
    p, maker = F.col("pnl"), F.col("optimistic_maker")
    part = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0.0))
    m = closed.where(p != 0).groupBy(*keys).agg(
        F.count("*").alias("trades"), F.count_if(p > 0).alias("wins"), part(p > 0, p).alias("gross_win"), part(p < 0, -p).alias("gross_loss"),
        F.count_if(maker).alias("maker_trades"), part(maker & (p > 0), p).alias("maker_gross_win"), part(maker & (p < 0), -p).alias("maker_gross_loss"),
    )
    return m.withColumns({
        "hit_rate": F.col("wins") / F.col("trades"), "expectancy": (F.col("gross_win") - F.col("gross_loss")) / F.col("trades"),
        "profit_factor": F.when(F.col("gross_loss") > 0, F.try_divide("gross_win", "gross_loss")).when(F.col("gross_win") > 0, F.lit(INF)).otherwise(0.0),
        "maker_expectancy": F.when(F.col("maker_trades") > 0, F.try_divide(F.col("maker_gross_win") - F.col("maker_gross_loss"), F.col("maker_trades").cast("double"))).otherwise(0.0),
    })


def stress_expectancy(metrics: DataFrame, fees: str, mult: float) -> DataFrame:
    """Expectancy with fees ``mult`` times as high."""
    net = F.col("gross_win") - F.col("gross_loss") - F.col(fees) * (mult - 1)
    return metrics.withColumn("stress_expectancy", F.when(F.col("trades") > 0, F.try_divide(net, F.col("trades").cast("double"))).otherwise(0.0))


def gate_g1(metrics: DataFrame, min_trades: int, dd_budget: float) -> DataFrame:
    """All reasons against promotion; passes without any."""
    net = F.col("gross_win") - F.col("gross_loss")
    maker = F.col("maker_gross_win") - F.col("maker_gross_loss")
    checks = (("stress_expectancy", F.col("stress_expectancy") <= 0), ("min_trades", F.col("trades") < min_trades), ("max_drawdown", F.col("max_drawdown") > dd_budget), ("maker_dependent", (F.col("maker_trades") > 0) & (maker > 0) & (net - maker <= 0)))
    return metrics.withColumn("reasons", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks)))).withColumn("pass", F.size("reasons") == 0)


def stage_gate(live: DataFrame, reference: DataFrame, keys: list[str], min_trades: int, min_ratio: float, max_dd_ratio: float) -> DataFrame:
    """Later gates: a stage's expectancy and drawdown as ratios of those it was promoted on."""
    r = reference.select(*keys, F.col("expectancy").alias("_e"), F.col("max_drawdown").alias("_d"))
    j = live.join(r, keys, "left").withColumns({"expectancy_ratio": F.try_divide("expectancy", "_e"), "dd_ratio": F.try_divide("max_drawdown", "_d")})
    checks = (("min_trades", F.col("trades") < min_trades), ("expectancy_ratio", ~F.coalesce(F.col("expectancy_ratio") >= min_ratio, F.lit(False))), ("dd_ratio", F.coalesce(F.col("dd_ratio") > max_dd_ratio, F.lit(False))))
    return j.withColumn("reasons", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks)))).withColumn("pass", F.size("reasons") == 0).drop("_e", "_d")


def promotion_gates(rows: DataFrame) -> DataFrame:
    """``reasons`` against promotion from each later stage, and ``demote_to`` where a stage must be left at once.

    Columns: stage, expectancy, reference_expectancy (in sample, replay or paper), positive_windows (share), plateau,
    age_days, clean (no faults, reconciled), owner, slippage_ratio (realised over modelled), drawdown, budget,
    recent_expectancy (60 days). Promotion needs every criterion, whatever is unknown counts against it.
    """
    stage, ratio = F.col("stage"), F.try_divide("expectancy", "reference_expectancy")
    off = F.abs(ratio - 1)
    no = lambda c: ~F.coalesce(c, F.lit(False))
    checks = {
        "WalkForward": (("oos_expectancy", no(ratio >= 0.5)), ("positive_windows", no(F.col("positive_windows") >= 0.7)), ("plateau", no(F.col("plateau")))),
        "Paper": (("age", no(F.col("age_days") >= 14)), ("divergence", no(off <= 0.3)), ("faults", no(F.col("clean"))), ("owner", no(F.col("owner")))),
        "LiveSmall": (("age", no(F.col("age_days") >= 28)), ("divergence", no(off <= 0.4)), ("slippage", no(F.col("slippage_ratio") <= 1.5)), ("faults", no(F.col("clean"))), ("owner", no(F.col("owner")))),
    }
    found = F.array_compact(F.array(*(F.when((stage == s) & c, F.lit(n)) for s, cs in checks.items() for n, c in cs)))
    live = stage.isin("LiveSmall", "LiveScaled")
    down = F.when(live & (F.col("drawdown") >= F.col("budget")), "Paper").when((stage == "LiveScaled") & (F.col("recent_expectancy") < 0), "LiveSmall").when((stage == "Paper") & (off > 0.5), "WalkForward")
    return rows.withColumns({"reasons": found, "demote_to": down})


def kelly_cap(metrics: DataFrame, fraction: float, min_trades: int, floor: float) -> DataFrame:
    """Fractional Kelly weight from win rate and payoff; the floor while trades are few."""
    p = F.col("wins") / F.col("trades")
    losses = F.col("trades") - F.col("wins")
    b = F.try_divide(F.try_divide("gross_win", F.col("wins").cast("double")), F.try_divide("gross_loss", losses.cast("double")))
    f = F.when(b.isNull() | ~is_finite(b) | (b <= 0), 0.0).otherwise(F.greatest(p - F.try_divide(1 - p, b), F.lit(0.0)))
    return metrics.withColumn("cap", F.when(F.col("trades") < min_trades, F.lit(max(floor, 0.0))).otherwise(F.coalesce(f, F.lit(0.0)) * max(fraction, 0.0)))


def allocate(inputs: DataFrame, max_deployed: float) -> DataFrame:
    """Weights from base, fit, corr and gov factors under the caps, scaled down to what may be deployed."""
    w = F.greatest(F.col("base"), F.lit(0.0))
    for c in ("fit", "corr", "gov"):
        w = w * clamp(c, 0.0, 1.0)
    w = F.least(w, F.greatest(F.col("cap"), F.lit(0.0)))
    bad = ~is_finite("base") | ~is_finite("fit") | ~is_finite("corr") | ~is_finite("gov") | ~is_finite("cap")
    x = inputs.withColumn("weight", F.when(bad, 0.0).otherwise(w))
    total = x.agg(F.sum("weight").alias("_t"))  # one row
    scaled = x.crossJoin(F.broadcast(total)).withColumn("weight", F.when(F.col("_t") > max_deployed, F.col("weight") * F.try_divide(F.lit(max_deployed), F.col("_t"))).otherwise(F.col("weight")))
    return scaled.drop("_t")


def shrink_only(prev: DataFrame, proposed: DataFrame, key: str = "strategy") -> DataFrame:
    return proposed.join(prev.select(key, F.col("weight").alias("_prev")), key, "left").withColumn("weight", F.least("weight", "_prev")).drop("_prev")


def drawdown(equity: DataFrame, keys: list[str], ts: str = "ts_ns", value: str = "equity", seq: str | None = None) -> DataFrame:
    at_peak = running(equity, F.col(value), tuple(keys), "peak", F.max, ts, (seq,) if seq else ())
    return at_peak.withColumn("drawdown", F.col("peak") - F.col(value))


def dd_governor(df: DataFrame, budget: str, gamma: float, dd: str = "drawdown") -> DataFrame:
    ok = is_finite(dd) & is_finite(budget) & (F.col(budget) > 0)
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide(dd, budget)))
    return df.withColumn("governor", F.when(ok, F.pow(base, F.lit(gamma))).otherwise(0.0))


def daily_pnl(equity: DataFrame, keys: list[str], ts: str = "ts_ns", seq: str = "seq", value: str = "equity") -> DataFrame:
    """Against the equity at the first event of the UTC day."""
    w = Window.partitionBy(*keys, "day").orderBy(ts, seq)
    e = equity.withColumn("day", bucket(ts, DAY_NS))
    return e.withColumn("daily_pnl", F.col(value) - F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def trailing_order_count(orders: DataFrame, keys: list[str], ts: str = "ts_ns", seq: str = "seq", window_ns: int = 60_000_000_000) -> DataFrame:
    """Orders of the minute before, this one and its later peers excluded. In slices of eight windows, with the last window of the one before as context."""
    slot, last = bucket_index(ts, 8 * window_ns), F.pmod(F.col(ts), F.lit(8 * window_ns)) >= 7 * window_ns
    d = orders.withColumns({"_slot": slot}).withColumn("_s", F.explode(F.when(last, F.array(F.col("_slot"), F.col("_slot") + 1)).otherwise(F.array("_slot"))))
    w = Window.partitionBy(*keys, "_s")
    n = F.row_number().over(w.orderBy(ts, seq)) - 1
    older = F.count("*").over(w.orderBy(ts).rangeBetween(Window.unboundedPreceding, -window_ns))
    return d.withColumn("orders_last_min", n - older).where("_s = _slot or _slot is null").drop("_s", "_slot")


def performance(returns: DataFrame, keys: list[str], periods: float) -> DataFrame:
    """Sharpe and Sortino ratios of period returns (column r), share of periods with exposure, and turnover.

    Ratios over zero, as without a losing period, are what IEEE 754 makes of them: infinite, or NaN for a mean of zero.
    """
    down = F.sqrt(F.avg(F.pow(F.least("r", F.lit(0.0)), F.lit(2.0))))
    return returns.groupBy(*keys).agg((_ratio(F.avg("r"), F.stddev_samp("r")) * periods**0.5).alias("sharpe"), (_ratio(F.avg("r"), down) * periods**0.5).alias("sortino"), F.avg((F.col("r") != 0).cast("double")).alias("exposure"), F.sum(F.abs("r")).alias("abs_return"))


def _ratio(a: Column, b: Column) -> Column:
    """Division by a number that is not negative, as IEEE 754 has it."""
    return F.when(b == 0, F.when(a > 0, INF).when(a < 0, -INF).when(a == 0, float("nan"))).otherwise(F.try_divide(a, b))


def drawdown_duration(equity: DataFrame, keys: list[str], ts: str = "ts_ns", seq: str | None = None) -> DataFrame:
    """The longest time since equity was at its peak, and the deepest drawdown."""
    d = drawdown(equity, keys, ts, **({"seq": seq} if seq else {}))
    d = scanned(d, keys, {"_peak_at": ("max", F.when(F.col("drawdown") == 0, F.col(ts)), False)}, ts, (seq,) if seq else (), keep=True)
    return d.groupBy(*keys).agg(F.max(F.col(ts) - F.col("_peak_at")).alias("longest_dd_ns"), F.max("drawdown").alias("max_drawdown"))


def correlation_penalty(returns: DataFrame, threshold: float = 0.5, days: int = 60) -> DataFrame:
    """(strategy, day, penalty): 1 / (1 + the sum of a strategy's correlations above ``threshold`` with others).

    Correlations of daily returns over the last ``days`` days, on days that both have; each pair is computed once.
    Columns of ``returns``: strategy, day (a number), r, one row a strategy and day.
    """
    a, b = returns.select("day", "strategy", F.col("r").alias("_ra")), returns.select("day", F.col("strategy").alias("_other"), F.col("r").alias("_rb"))
    last = Window.partitionBy("strategy", "_other").orderBy("day").rangeBetween(-(days - 1), 0)
    c = a.join(b, "day").where(F.col("strategy") < F.col("_other")).withColumn("_c", F.corr("_ra", "_rb").over(last))
    c = c.where(~F.isnan("_c") & (F.col("_c") > threshold))
    sides = F.explode(F.array("strategy", "_other"))
    total = c.select("day", "_c", sides.alias("strategy")).groupBy("strategy", "day").agg(F.sum("_c").alias("_sum"))
    return returns.select("strategy", "day").join(total, ["strategy", "day"], "left").select("strategy", "day", (1 / (1 + F.coalesce("_sum", F.lit(0.0)))).alias("penalty"))


def param_stability(windows: DataFrame, params: list[str]) -> DataFrame:
    """Spread of fitted parameters over walk-forward windows."""
    long = windows.select(F.explode(F.array(*(F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("v")) for p in params))).alias("x")).select("x.*")
    return long.groupBy("param").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"))


class Position:
    """Average-cost position, fill by fill, as streams need it; ``fill`` folds one fill in and returns what it realised."""

    def __init__(self) -> None:
        self.qty = self.avg = self.open_fees = 0.0

    def fill(self, qty: float, price: float, fee: float) -> tuple[float, float, float]:
        """(gross realised, fees that belong to it, quantity closed)"""
        closing = 0.0 if self.qty * qty >= 0 else min(abs(qty), abs(self.qty))
        direction = 1.0 if self.qty > 0 else -1.0
        gross = closing * (price - self.avg) * direction
        share_in = closing / abs(self.qty) if closing else 0.0
        share_out = closing / abs(qty) if closing else 0.0
        attributed = self.open_fees * share_in + fee * share_out
        opening = qty + direction * closing if closing else qty
        left = self.qty - direction * closing if closing else self.qty
        total = left + opening
        if opening and total:
            self.avg = (self.avg * left + price * opening) / total
        elif not total:
            self.avg = 0.0
        self.open_fees = (self.open_fees * (1 - share_in) + fee * (1 - share_out)) if total else 0.0
        self.qty = total
        return gross, attributed, closing


QTY = "decimal(28,12)"  # of quantities: their sums are exact in any order, so a closed position is exactly 0


def position_ledger(fills: DataFrame, keys: list[str], ts: str = "ts_ns", seq: str = "seq") -> DataFrame:
    """Average-cost ledger, one row a fill: position after it, realised gross, fees attributed, net.

    Positions are exact running sums. Between two crossings of zero the position's cost and its open fees follow
    affine maps: a fill that adds adds its own, one that reduces scales both by what is left. These maps are
    composed in blocks, so any number of fills of one key spreads over tasks. Keys of up to ``core.MANY`` fills
    move once and are each one task's.
    """
    f = fills.select(*keys, ts, seq, signed(F.col("qty").cast("double")).alias("fill_qty"), F.col("price").cast("double").alias("price"), F.col("fee").cast("double").alias("fee"))
    most = f.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most <= core.MANY:
        return _ledger(f, keys, ts, seq, most)
    marked = joined(f, crowded(keys, f).withColumn("_busy", F.lit(True)), keys)
    few, many = (marked.where(c).drop("_busy") for c in ("_busy is null", "_busy"))
    return _ledger(few, keys, ts, seq, core.MANY).unionByName(_ledger(many, keys, ts, seq))


def _ledger(f: DataFrame, keys: list[str], ts: str, seq: str, most: int | None = None) -> DataFrame:
    """``position_ledger`` of its columns. No key has more than ``most`` rows; None: any number, by ranges and blocks."""
    in_place = Window.partitionBy(*keys).orderBy("_place")
    if most is None:
        f = _exact_sums(ranked(f, keys, [ts, seq], "_place"), keys)
    else:
        f = f.withColumn("_place", (F.row_number().over(Window.partitionBy(*keys).orderBy(ts, seq, F.xxhash64(*f.columns))) - 1).cast("long"))
        exact = F.col("fill_qty").cast(QTY)
        f = f.withColumn("_after", F.sum(exact).over(in_place.rowsBetween(Window.unboundedPreceding, 0)).cast(QTY))
        f = f.withColumn("_before", (F.col("_after") - exact).cast(QTY))
    q, before, after = (F.col(c).cast("double") for c in ("fill_qty", "_before", "_after"))
    crossing = (F.signum("_before") * F.signum("_after")) <= 0  # opens, closes or flips
    reduces = ~crossing & (before * q < 0)
    closing = F.when(before * q < 0, F.least(F.abs(q), F.abs(before))).otherwise(0.0)
    out = F.coalesce(F.try_divide(closing, F.abs(q)), F.lit(0.0))  # of the fill
    f = f.withColumns({
        "_closing": closing, "_out": out, "_factor": F.when(crossing, 0.0).when(reduces, after / before).otherwise(1.0),
        "_cost_in": F.when(after == 0, 0.0).when(crossing, F.col("price") * after).when(reduces, 0.0).otherwise(F.col("price") * q),
        "_fees_in": F.when(after == 0, 0.0).otherwise(F.col("fee") * (1 - out)),
    })
    f = affine(f, keys, "_place", "_factor", {"_cost": "_cost_in", "_fees": "_fees_in"}, last=None if most is None else max(most - 1, 0))
    # What a row found: what the row before it left.
    if most is None:
        prior = f.select(*keys, (F.col("_place") + 1).alias("_place"), F.col("_cost").alias("_cost_before"), F.col("_fees").alias("_fees_before"))
        f = joined(f, prior, [*keys, "_place"])
    else:
        f = f.withColumns({f"{c}_before": F.lag(c).over(in_place) for c in ("_cost", "_fees")})
    avg = F.coalesce(F.try_divide(F.col("_cost_before"), before), F.lit(0.0))
    gross = F.col("_closing") * (F.col("price") - avg) * F.signum(before)
    fees = F.coalesce(F.col("_fees_before") * F.try_divide(F.col("_closing"), F.abs(before)), F.lit(0.0)) + F.col("fee") * F.col("_out")
    f = f.withColumns({"_gross": gross + 0.0, "_attributed": fees})
    net = F.when(F.col("_closing") > 0, F.col("_gross") - F.col("_attributed")).otherwise(0.0)
    return f.select(*keys, ts, seq, "fill_qty", "price", "fee", after.alias("qty"), F.coalesce(F.try_divide(F.col("_cost"), after), F.lit(0.0)).alias("avg"), F.col("_gross").alias("realized"), F.col("_attributed").alias("attributed_fees"), F.col("_closing").alias("closed_qty"), net.alias("net"))


def _exact_sums(f: DataFrame, keys: list[str], block: int = 4096) -> DataFrame:
    """``_before`` and ``_after``: the position around each fill, by blocks of places."""
    d = f.withColumns({"_q": F.col("fill_qty").cast(QTY), "_b": F.call_function("div", F.col("_place"), F.lit(block))})
    sums = d.groupBy(*keys, "_b").agg(F.sum("_q").alias("_all"))
    start = sums.select(*keys, "_b", F.coalesce(F.sum("_all").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(QTY).alias("_start"))
    within = F.sum("_q").over(Window.partitionBy(*keys, "_b").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)).cast(QTY)
    d = joined(d.withColumn("_w", within), start, [*keys, "_b"], "inner")
    after = (F.col("_start") + F.col("_w")).cast(QTY)
    return d.withColumns({"_after": after, "_before": (after - F.col("_q")).cast(QTY)}).drop("_q", "_b", "_w", "_start")


def equity_curve(ledger: DataFrame, marks: DataFrame, funding: DataFrame, keys: list[str], start_cash: float, by_mark: list[str]) -> DataFrame:
    """Equity at each mark: start + realised + unrealised - fees - funding, and the residual of the cash identity (about 0).

    ``marks``: by_mark, ts_ns, mark; ``funding``: keys, ts_ns, paid. Fills, funding and marks are one sequence a key, folded once.
    """
    times = marks.join(ledger.select(*keys).distinct(), by_mark)
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (*keys, "ts_ns")])
    place = lambda after, seq: [*keys, "ts_ns", F.lit(after).alias("_after"), seq.cast("long").alias("_q")]
    led = ledger.select(*place(0, F.col("seq")), "realized", "fee", (-F.col("fill_qty") * F.col("price") - F.col("fee")).alias("_cash"), F.when(known, F.struct("qty", "avg")).alias("_position"))
    paid = funding.select(*place(0, F.lit(None)), "paid", F.when(known, True).alias("_funded"))
    asked = times.select(*place(1, F.lit(None)), F.struct(*times.columns).alias("_l"))  # after all of the same time
    rows = led.unionByName(paid, True).unionByName(asked, True)
    total = lambda c: ("sum", F.col(c), False)
    folds = {"_realized": total("realized"), "_fees": total("fee"), "_cashed": total("_cash"), "_funding": total("paid"), "_held": ("last", F.col("_position"), False), "_any": ("max", F.col("_funded"), False)}
    at = scanned(rows, keys, folds, "ts_ns", ("_after", "_q"), DAY_NS, busy=crowded(by_mark, ledger, funding, marks)).where("_l is not null")
    held = lambda c, name: F.when(F.col("_held").isNotNull(), F.col(c)).alias(name)
    at = at.select("_l.*", "_held.qty", "_held.avg", held("_realized", "cum_realized"), held("_fees", "cum_fees"), held("_cashed", "cum_cash"), F.when(F.col("_any"), F.col("_funding")).alias("cum_funding"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    unreal = z("qty") * (F.col("mark") - z("avg"))
    eq = start_cash + z("cum_realized") + unreal - z("cum_fees") - z("cum_funding")
    cash = start_cash + z("cum_cash") - z("cum_funding") + z("qty") * F.col("mark")
    return at.withColumns({"unrealized": unreal, "equity": eq, "residual": cash - eq})


def accrue_funding(funding: DataFrame, positions: DataFrame, marks: DataFrame, keys: list[str], by_mark: list[str]) -> DataFrame:
    """``paid`` = rate * position * mark at each funding event; none for a flat position or a rate that is not finite."""
    busy = crowded(by_mark, funding, marks, positions)
    f = asof(funding.where(is_finite("rate")), marks, by_mark, "ts_ns", "ts_ns", ["mark"], busy=busy)
    held = positions.select(*keys).distinct()
    f = asof(f.join(held, by_mark), positions, keys, "ts_ns", "ts_ns", ["qty"], busy=busy)
    return f.where("qty is not null and qty <> 0").withColumn("paid", F.col("rate") * F.col("qty") * F.coalesce("mark", F.lit(0.0)))


def missing_funding(positions: DataFrame, funding: DataFrame, keys: list[str], interval_ns: int) -> DataFrame:
    """Positions open for an interval or longer without a funding row. Columns: from_ns, to_ns."""
    long = positions.where(F.col("to_ns") - F.col("from_ns") >= interval_ns)
    f = funding.select(*keys, F.col("ts_ns").alias("_t"), F.col("ts_ns").alias("_next"))
    next_row = asof(long, f, keys, "from_ns", "_t", ["_next"], forward=True)  # the first one from the opening on
    return next_row.where("_next is null or _next > to_ns").drop("_next")


def size_orders(orders: DataFrame, vol: DataFrame, marks: DataFrame, by: list[str], per_trade_risk: float) -> DataFrame:
    """Volatility-targeted quantity with its trace. Orders carry equity, weight, risk_units, k_stop, step_size, min_notional."""
    o = asof(asof(orders, vol, by, "ts_ns", "ts_ns", ["vol"]), marks, by, "ts_ns", "ts_ns", ["mark"])
    capital = F.greatest(F.col("equity") * F.col("weight"), F.lit(0.0))
    unit = capital * per_trade_risk
    dollar_vol = F.col("vol") * F.col("mark")
    denom = F.col("k_stop") * dollar_vol
    raw = F.when((denom > 0) & is_finite("risk_units") & is_finite(unit), F.try_divide(F.greatest("risk_units", F.lit(0.0)) * unit, denom))
    raw = F.when(is_finite(raw), raw).otherwise(0.0)
    o = o.withColumns({"_raw": raw, "_cap": capital, "_unit": unit, "_dv": dollar_vol}).withColumn("_round", round_down("_raw", "step_size"))
    floored = F.coalesce(F.col("_round") * F.col("mark") < F.col("min_notional"), F.lit(True))
    trace = F.struct(F.col("_cap").alias("risk_capital"), F.col("_unit").alias("per_unit_risk"), F.col("_dv").alias("dollar_vol"), F.col("_raw").alias("raw"), F.col("_round").alias("rounded"), floored.alias("floored"))
    return o.withColumns({"qty": F.when(floored, 0.0).otherwise(F.col("_round")), "trace": trace}).drop("_raw", "_cap", "_unit", "_dv", "_round")


def allow_and_kill_flags(orders: DataFrame, allow: DataFrame, kills: DataFrame) -> DataFrame:
    """``allowed`` by (venue, symbol_id); ``killed`` by a global, venue or strategy switch (scope, target)."""
    a = allow.select("venue", "symbol_id").distinct().withColumn("_a", F.lit(True))
    k = staged(kills.select("scope", "target").distinct(), "kills")  # written: few keys, joined by their size rather than dealt by key
    v = k.where("scope = 'venue'").select(F.col("target").alias("venue")).withColumn("_v", F.lit(True))
    s = k.where("scope = 'strategy'").select(F.col("target").alias("strategy")).withColumn("_s", F.lit(True))
    g = k.agg(F.coalesce(F.bool_or(F.col("scope") == "global"), F.lit(False)).alias("_g"))  # one row
    o = orders.join(a, ["venue", "symbol_id"], "left").join(v, "venue", "left").join(s, "strategy", "left").crossJoin(F.broadcast(g))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return o.withColumns({"allowed": yes("_a"), "killed": yes("_g") | yes("_v") | yes("_s")}).drop("_a", "_v", "_s", "_g")


def order_compliance(orders: DataFrame, limits: dict[str, float]) -> DataFrame:
    """The first rule that an order breaks, null if none.

    Orders carry mode_allows, allowed, qty, price, side, position_qty, mark,
    gross_exposure, orders_last_min, strategy_pnl, portfolio_pnl, killed, reconciled.
    """
    notional = F.abs("qty") * F.col("price")
    after = F.abs(F.col("position_qty") + F.when(F.col("side") == "Buy", F.abs("qty")).otherwise(-F.abs("qty"))) * F.col("mark")
    deviation = F.try_divide(F.abs(F.col("price") - F.col("mark")), F.col("mark"))
    rules = (
        ("RG-1", ~F.col("mode_allows")), ("RG-2", ~F.col("allowed")), ("RG-3", notional > limits["max_order_notional"]), ("RG-4", after > limits["max_position_notional"]),
        ("RG-5", F.col("gross_exposure") + notional > limits["max_gross"]), ("RG-6", (F.col("mark") > 0) & (deviation > limits["max_px_dev"])), ("RG-7", F.col("orders_last_min") >= limits["max_orders_per_min"]),
        ("RG-8", F.col("strategy_pnl") < -limits["strategy_loss"]), ("RG-9", F.col("portfolio_pnl") < -limits["portfolio_loss"]), ("RG-10", F.col("killed")), ("RG-11", ~F.col("reconciled")),
    )
    return orders.withColumn("reject", F.coalesce(*(F.when(c, F.lit(n)) for n, c in rules)))


def compliance_inputs(orders: DataFrame, positions: DataFrame, marks: DataFrame, exposure: DataFrame, strategy_pnl: DataFrame, portfolio_pnl: DataFrame, allow: DataFrame, kills: DataFrame, internal: DataFrame, venue: DataFrame, tol: float, window_ns: int = 60_000_000_000) -> DataFrame:
    """What ``order_compliance`` reads, joined to each order as it was known when the order came.

    ``orders``: portfolio, strategy, venue, symbol_id, ts_ns, seq, side, qty, price, mode_allows. The others carry ts_ns
    and their keys: positions (position_qty) and the P&L of the day so far count strictly before the order; marks (mark)
    and exposure (portfolio, gross_exposure) up to its time. What is not known counts as zero, an unknown
    venue as reconciled.

    Orders are written after each move, and what was written and shuffled before is given back: one plan of all the
    joins would run what stands before a join once for its rows and once for its slices, and hold all shuffles to the end.
    Symbols of up to ``core.MANY`` rows are each one task's.
    """
    o = settled(trailing_order_count(allow_and_kill_flags(orders, allow, kills), ["strategy"], "ts_ns", "seq", window_ns), "counted")
    busy = crowded(["symbol_id"], o, positions, marks)
    by = ["strategy", "venue", "symbol_id"]
    if busy.isEmpty():
        known = asof_each(o, "ts_ns", ["symbol_id"], [AsOf(positions, by, "ts_ns", ["position_qty"], "seq", strict=True), AsOf(marks, ["symbol_id"], "ts_ns", ["mark"])])
    else:
        held = settled(asof(o, positions, by, "ts_ns", "ts_ns", ["position_qty"], "seq", strict=True, busy=busy), "held", o)
        o, known = held, asof(held, marks, ["symbol_id"], "ts_ns", "ts_ns", ["mark"], busy=busy)
    o = settled(known, "marked", o)

    def pnl(rows: DataFrame, name: str) -> AsOf:
        return AsOf(rows.select(name, "ts_ns", "seq", F.col("daily_pnl").alias(f"{name}_pnl"), F.lit(True).alias(f"_{name}")), [name], "ts_ns", [f"{name}_pnl", f"_{name}"], "seq", strict=True, within=True)

    exposed = AsOf(exposure, ["portfolio"], "ts_ns", ["gross_exposure"])
    o = settled(asof_each(o, "ts_ns", ["portfolio"], [exposed, pnl(portfolio_pnl, "portfolio")], DAY_NS), "exposed", o)
    o = asof_each(o, "ts_ns", ["strategy"], [pnl(strategy_pnl, "strategy")], DAY_NS)
    for name in ("strategy", "portfolio"):
        o = o.withColumn(f"{name}_pnl", F.when(F.col(f"_{name}"), F.col(f"{name}_pnl")).otherwise(0.0)).drop(f"_{name}")
    off = reconcile(internal, venue, tol, ("venue", "symbol_id")).select("venue").distinct().withColumn("_off", F.lit(True))
    clean = internal.select("venue").union(venue.select("venue")).distinct().join(off, "venue", "left").select("venue", F.col("_off").isNull().alias("reconciled"))
    clean = staged(clean, "venues")
    return o.join(clean, "venue", "left").withColumn("reconciled", F.coalesce("reconciled", F.lit(True))).fillna(0.0, ["position_qty", "mark", "gross_exposure"])


# Legal order transitions, "state event" to next state.
TRANSITIONS = {
    "RiskChecked Submit": "Submitted", "Submitted Ack": "Acked", "Submitted Reject": "Rejected", "Submitted AckTimeout": "Unknown",
    "Acked FillPart": "PartFilled", "Acked FillComplete": "Filled", "Acked Cancel": "Cancelled",
    "PartFilled FillPart": "PartFilled", "PartFilled FillComplete": "Filled", "PartFilled Cancel": "Cancelled",
    "Unknown ResolveAcked": "Acked", "Unknown ResolveRejected": "Rejected", "Unknown ResolveNotFound": "Failed",
}
TERMINAL = ("Filled", "Cancelled", "Rejected", "Failed")


def order_lifecycle(order_events: DataFrame, keys: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """Final state, illegal events and whether the order is terminal or unknown, by folding each order's events.

    Events: client_id, seq, event, complete (fills). A venue with an Unknown order is frozen.
    """
    legal = F.create_map(*(F.lit(x) for pair in TRANSITIONS.items() for x in pair))
    name = F.when(F.col("event") == "Fill", F.when(F.col("complete"), "FillComplete").otherwise("FillPart")).otherwise(F.col("event"))
    evs = order_events.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", name.alias("e")))), lambda x: x["e"]).alias("evs"))
    start = F.struct(F.lit("RiskChecked").alias("state"), F.array().cast("array<string>").alias("illegal"))

    def step(acc, e):
        to = F.try_element_at(legal, F.concat_ws(" ", acc["state"], e))
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), F.when(to.isNull(), F.concat(acc["illegal"], F.array(F.concat_ws(" on ", acc["state"], e)))).otherwise(acc["illegal"]).alias("illegal"))

    out = evs.withColumn("_a", F.aggregate("evs", start, step)).select(*keys, "_a.state", "_a.illegal")
    return out.withColumns({"terminal": F.col("state").isin(*TERMINAL), "unknown": F.col("state") == "Unknown"})


def reconcile(internal: DataFrame, venue: DataFrame, tol: float, keys: tuple[str, ...] = ("symbol_id",)) -> DataFrame:
    """Symbols whose quantities differ by more than ``tol``; a missing side counts as zero."""
    j = internal.select(*keys, F.col("qty").alias("internal_qty")).join(venue.select(*keys, F.col("qty").alias("venue_qty")), list(keys), "full_outer").fillna(0.0, ["internal_qty", "venue_qty"])
    return j.where(F.abs(F.col("internal_qty") - F.col("venue_qty")) > tol)


def reconciliation_status(internal: DataFrame, venue: DataFrame, tol: float) -> DataFrame:
    """Per venue: clean, and the symbols that diverge."""
    both = internal.select("venue").union(venue.select("venue")).distinct()
    d = reconcile(internal, venue, tol, ("venue", "symbol_id")).groupBy("venue").agg(F.sort_array(F.collect_list("symbol_id")).alias("diverged"))
    return both.join(d, "venue", "left").withColumns({"clean": F.col("diverged").isNull(), "diverged": F.coalesce("diverged", F.array().cast(dict(d.dtypes)["diverged"]))})


# Promotion stages in order; a killed strategy never comes back.
STAGES = ("Idea", "Hypothesis", "Backtest", "WalkForward", "Paper", "LiveSmall", "LiveScaled")
WITH_EVIDENCE = STAGES[3:]


def funnel_audit(transitions: DataFrame, evidence: DataFrame, stages: tuple[str, ...] = STAGES, human: tuple[str, ...] = ("LiveSmall", "LiveScaled"), proof: tuple[str, ...] = WITH_EVIDENCE, max_age_ns: int = 30 * DAY_NS) -> DataFrame:
    """Violations of the promotion rules, one row each.

    ``transitions``: id, from, to, actor_human, autopsy_complete, ts_ns; ``evidence``: id, to, ts_ns.
    """
    rank = F.create_map(*(F.lit(x) for i, s in enumerate(stages) for x in (s, i)))
    r = lambda c: F.try_element_at(rank, c)
    ev = evidence.groupBy("id", "to").agg(F.max("ts_ns").alias("ev_ns"))
    t = transitions.join(ev, ["id", "to"], "left")
    w = Window.partitionBy("id").orderBy("ts_ns")
    t = t.withColumns({"_prev": F.lag("to").over(w), "_up": F.coalesce(r(F.col("to")) > r(F.col("from")), F.lit(False))})
    killed = F.col("to") == "Killed"
    checks = (
        ("FromMismatch", F.col("_prev").isNotNull() & (F.col("_prev") != F.col("from"))), ("AfterKilled", F.col("from") == "Killed"), ("UnknownStage", ~killed & (F.col("from") != "Killed") & (r(F.col("to")).isNull() | r(F.col("from")).isNull())),
        ("SkipsStage", F.col("_up") & (r(F.col("to")) != r(F.col("from")) + 1)), ("NoEvidence", F.col("_up") & F.col("to").isin(*proof) & F.col("ev_ns").isNull()), ("StaleEvidence", F.col("_up") & F.col("to").isin(*proof) & (F.col("ts_ns") - F.col("ev_ns") > max_age_ns)),
        ("NeedsHuman", F.col("_up") & F.col("to").isin(*human) & ~F.coalesce("actor_human", F.lit(False))), ("NotLower", ~killed & ~F.col("_up") & (r(F.col("to")) >= r(F.col("from")))), ("NoAutopsy", killed & ~F.coalesce("autopsy_complete", F.lit(False))),
    )
    found = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks)))
    return t.withColumn("violation", F.explode(found)).select("id", "from", "to", "ts_ns", "violation")


def repeated_experiments(runs: DataFrame) -> DataFrame:
    same = ["config_hash", "from_ns", "to_ns", "manifest_hashes"]
    return runs.groupBy(*same).agg(F.count("*").alias("runs"), F.sort_array(F.collect_list("run_id")).alias("run_ids")).where("runs > 1")


def monthly_scoreboard(trades: DataFrame, costs: DataFrame, infra: DataFrame, tracking: DataFrame, transitions: DataFrame, benchmark: DataFrame, capital: float) -> DataFrame:
    """One tidy table (section, strategy, metric, value); a section without rows says "no data".

    ``trades``: strategy, ts_ns, pnl, optimistic_maker; ``costs``: strategy, fee, paid (funding), realized and modeled
    slippage; ``infra``: strategy, infra; ``tracking``: strategy and its live, paper and backtest returns;
    ``transitions``: id, demotion; ``benchmark``: return.
    """
    net = F.col("gross_win") - F.col("gross_loss")
    m = trade_metrics(trades, ["strategy"]).withColumns({"net": net, "net_return": net / capital})
    equity = running(trades.groupBy("strategy", "ts_ns").agg(F.sum("pnl").alias("pnl")), F.col("pnl"), ("strategy",), "equity", ts="ts_ns", seq=())
    worst = drawdown(equity, ["strategy"]).groupBy("strategy").agg(F.max("drawdown").alias("max_drawdown"))
    spent = costs.groupBy("strategy").agg(F.sum("fee").alias("fees"), F.sum(F.col("realized") - F.col("modeled")).alias("slippage_vs_model"), F.sum("paid").alias("funding"))
    steps = transitions.groupBy(F.col("id").alias("strategy")).agg(F.count("*").alias("transitions"), F.count_if("demotion").alias("demotions"))

    def tidy(df, section, metrics):
        return df.select(F.lit(section).alias("section"), F.col("strategy").cast("string").alias("strategy"), F.explode(F.array(*(F.struct(F.lit(x).alias("metric"), F.col(x).cast("double").alias("value")) for x in metrics))).alias("_x")).select("section", "strategy", "_x.*")

    parts = [
        tidy(m.join(worst, "strategy", "left"), "performance", ["net", "net_return", "max_drawdown", "expectancy", "trades", "hit_rate"]),
        tidy(tracking.withColumn("tracking_error", F.col("live_return") - F.col("backtest_return")), "tracking", ["live_return", "paper_return", "backtest_return", "tracking_error"]),
        tidy(spent.join(infra, "strategy", "full_outer"), "costs", ["fees", "slippage_vs_model", "funding", "infra"]), tidy(steps, "funnel", ["transitions", "demotions"]), tidy(benchmark.select(F.lit("benchmark").alias("strategy"), "return"), "benchmark", ["return"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    names = out.sparkSession.createDataFrame([(s,) for s in ("performance", "tracking", "costs", "funnel", "benchmark")], "section string")
    empty = names.join(out.select("section").distinct(), "section", "left_anti").select("section", F.lit(None).cast("string").alias("strategy"), F.lit("no data").alias("metric"), F.lit(None).cast("double").alias("value"))
    return out.unionByName(empty)
