"""Raw venue frames to events, as a batch or streaming job over JSON lines.

Input: venue, recv_ts_ns, stream_seq, payload (text). A frame is parsed once with
the union of the venue's fields, all as text; each topic is a projection; numbers
may be given as text or number. Malformed frames (bad JSON or a required field
missing) go out with kind ``malformed``; unknown topics are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import LEVELS, bad_levels, fnv1a64, ms_to_ns, number, object_levels, pair_levels, whole
from tidemark.operators.book import book_continuity
from tidemark.staging import staged
from tidemark.streaming import ordered

FIELDS = {
    "price": "double", "qty": "double", "side": "string", "trade_id": "bigint", "bids": LEVELS, "asks": LEVELS, "first_seq": "bigint", "last_seq": "bigint", "seq": "bigint", "depth": "int", "reason": "string",
    "rate": "double", "interval_s": "bigint", "next_funding_ts_ns": "bigint", "mark": "double", "index": "double", "oi_contracts": "double", "oi_notional": "double", "status_kind": "string", "detail": "string",
}
PAIRS = "array<array<string>>"


def _event(df: DataFrame, kind: str, symbol: Column | str, exch: Column | None = None, required: tuple[str, ...] = (), **fields: Column) -> DataFrame:
    """One topic's rows in the common schema; rows without a required field become malformed."""
    sym = F.col(symbol) if isinstance(symbol, str) else symbol
    cols = {n: fields.get(n, F.lit(None)).cast(t) for n, t in FIELDS.items()}
    bad = sym.isNull()
    for n in required:
        bad = bad | cols[n].isNull()
    for n in ("bids", "asks"):
        if n in fields:
            bad = bad | F.coalesce(bad_levels(cols[n]), F.lit(False))
    out = df.select("venue", sym.alias("venue_symbol"), F.coalesce(exch if exch is not None else F.lit(0), F.lit(0)).cast("long").alias("exch_ts_ns"), "recv_ts_ns", "stream_seq", F.when(bad, "malformed").otherwise(kind).alias("kind"), *(c.alias(n) for n, c in cols.items()))
    return out


def _side(c: Column | str, buy: str, sell: str, default: str | None = None) -> Column:
    x = F.upper(F.col(c) if isinstance(c, str) else c)
    return F.when(x == buy.upper(), "Buy").when(x == sell.upper(), "Sell").otherwise(default)


def _parsed(raw: DataFrame, schema: str) -> DataFrame:
    return raw.withColumn("j", F.from_json("payload", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


MAP = "map<string,string>"


def _get(m: str, *names: str) -> Column:
    """The first of some keys that a map has. Maps keep keys apart that differ in case only, struct fields would not."""
    return F.coalesce(*(F.try_element_at(F.col(m), F.lit(n)) for n in names))


def _pairs(text: Column) -> Column:
    """Levels of a side; an empty one is not parsed."""
    return F.when(text == "[]", F.array().cast(LEVELS)).otherwise(pair_levels(F.from_json(text, PAIRS)))


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is worked out once a row: filters and projections above do not repeat it, as they would a plain one."""
    return df.withColumn(name, F.explode(F.array(value)))


def _case(when: Column, kind: str, symbol: Column, exch: Column | None = None, required: tuple[str, ...] = (), **fields: Column) -> tuple:
    return when, kind, symbol, exch, required, fields


def _events(df: DataFrame, cases: list[tuple]) -> DataFrame:
    """What ``_event`` gives for each case, in one pass: a row comes out once for every case that it is."""
    e = df.withColumn("_i", F.explode(F.array(*(F.when(c[0], i) for i, c in enumerate(cases))))).where("_i is not null")

    def choose(values: dict[int, Column]) -> Column:
        out = F.lit(None)
        for i, v in reversed(values.items()):
            out = F.when(F.col("_i") == i, v).otherwise(out)
        return out

    syms, times = ({i: c[k] for i, c in enumerate(cases) if c[k] is not None} for k in (2, 3))
    cols = {n: choose({i: c[5][n].cast(t) for i, c in enumerate(cases) if n in c[5]}).cast(t) for n, t in FIELDS.items()}
    e = e.select("_i", "venue", choose(syms).alias("venue_symbol"), F.coalesce(choose(times), F.lit(0)).cast("long").alias("exch_ts_ns"), "recv_ts_ns", "stream_seq", choose({i: F.lit(c[1]) for i, c in enumerate(cases)}).alias("kind"), *(c.alias(n) for n, c in cols.items()))
    bad = F.col("venue_symbol").isNull() | F.coalesce(bad_levels(F.col("bids")), F.lit(False)) | F.coalesce(bad_levels(F.col("asks")), F.lit(False))
    for i, c in enumerate(cases):
        for n in c[4]:
            bad = bad | ((F.col("_i") == i) & F.col(n).isNull())
    return e.withColumn("kind", F.when(bad, "malformed").otherwise(F.col("kind"))).drop("_i")


def binance(raw: DataFrame) -> DataFrame:
    x = _held(_held(raw, "j", F.from_json("payload", MAP)), "d", F.coalesce(F.from_json(_get("j", "data"), MAP), F.col("j")))
    exch = ms_to_ns(whole(_get("d", "E")))
    of = lambda e: _get("d", "e") == e
    x = _held(x, "o", F.when(of("forceOrder"), F.from_json(_get("d", "o"), MAP)))
    levels = lambda k: _pairs(_get("d", k))
    num = lambda k: number(_get("d", k))
    sym, mark = _get("d", "s"), of("markPriceUpdate")
    return _events(x, [
        _case(of("aggTrade"), "trade", sym, F.coalesce(ms_to_ns(whole(_get("d", "T"))), exch), ("price", "qty"), price=num("p"), qty=num("q"), side=F.when(_get("d", "m") == "true", "Sell").otherwise("Buy"), trade_id=F.coalesce(whole(_get("d", "a")), F.lit(0))),
        _case(of("depthUpdate"), "book_delta", sym, exch, (), bids=levels("b"), asks=levels("a"), first_seq=F.coalesce(whole(_get("d", "U")), F.lit(0)), last_seq=F.coalesce(whole(_get("d", "u")), F.lit(0))),
        _case(mark, "mark_price", sym, exch, (), mark=F.coalesce(num("p"), F.lit(0.0)), index=num("i")),
        _case(mark & num("r").isNotNull(), "funding", sym, exch, (), rate=num("r"), interval_s=F.lit(28_800), next_funding_ts_ns=F.coalesce(ms_to_ns(whole(_get("d", "T"))), F.lit(0))),
        _case(of("forceOrder"), "liquidation", _get("o", "s"), exch, (), price=F.coalesce(number(_get("o", "p")), F.lit(0.0)), qty=F.coalesce(number(_get("o", "q")), F.lit(0.0)), side=_side(_get("o", "S"), "BUY", "SELL", "Sell")),
        _case(F.col("j").isNull(), "malformed", F.lit(None).cast("string")),
    ])


def _corrupt(parsed: DataFrame) -> DataFrame:
    return _event(parsed.where("j._bad is not null or j is null"), "malformed", F.lit(None).cast("string"))


def bybit(raw: DataFrame) -> DataFrame:
    """Trades apart, since their ids go through Python: a frame of theirs has the topic's name in it, or an escape."""
    data = _get("j", "data")
    exch = ms_to_ns(whole(_get("j", "ts")))
    topic = lambda *names: reduce(lambda a, b: a | b, [F.startswith(_get("j", "topic"), F.lit(x)) for x in names])
    is_trade, is_liq, is_book, is_tick = topic("publicTrade."), topic("liquidation.", "allLiquidation."), topic("orderbook."), topic("tickers.")
    as_list = F.when(F.startswith(F.trim(data), F.lit("[")), data).otherwise(F.concat(F.lit("["), data, F.lit("]")))
    many = F.from_json(as_list, f"array<{MAP}>")
    one = F.when(is_book | is_tick, F.from_json(data, MAP))  # null where a frame is malformed
    items = lambda df, of: _held(df, "_items", of).withColumn("d", F.explode("_items")).drop("_items")
    frames = lambda df: _held(df, "j", F.from_json("payload", MAP))
    t = items(frames(raw.where(F.contains("payload", F.lit("publicTrade.")) | F.contains("payload", F.lit("\\")))).where(is_trade), many)
    x = items(frames(raw).where(F.col("j").isNull() | is_liq | is_book | is_tick), F.when(is_liq, many).otherwise(F.array(one)))
    snap = F.coalesce(_get("j", "type"), F.lit("delta")) == "snapshot"
    book = {"bids": _pairs(_get("d", "b")), "asks": _pairs(_get("d", "a"))}
    u, num = whole(_get("d", "u")), lambda *n: number(_get("d", *n))
    return _union([
        _event(t, "trade", _get("d", "s"), ms_to_ns(whole(_get("d", "T"))), ("price", "qty", "side"), price=num("p"), qty=num("v"), side=_side(_get("d", "S"), "Buy", "Sell"), trade_id=fnv1a64(_get("d", "i"))),
        _events(x, [
            _case(is_book & snap, "book_snapshot", _get("d", "s"), exch, ("seq",), **book, seq=u, depth=F.lit(0), reason=F.lit("Init")),
            _case(is_book & ~snap, "book_delta", _get("d", "s"), exch, ("last_seq",), **book, first_seq=u, last_seq=u),
            _case(is_tick & num("fundingRate").isNotNull(), "funding", _get("d", "symbol"), exch, (), rate=num("fundingRate"), interval_s=F.lit(0), next_funding_ts_ns=F.coalesce(ms_to_ns(whole(_get("d", "nextFundingTime"))), F.lit(0))),
            _case(is_tick & num("markPrice").isNotNull(), "mark_price", _get("d", "symbol"), exch, (), mark=num("markPrice"), index=num("indexPrice")),
            _case(is_tick & num("openInterest").isNotNull(), "open_interest", _get("d", "symbol"), exch, (), oi_contracts=num("openInterest"), oi_notional=num("openInterestValue")),
            _case(is_liq, "liquidation", _get("d", "symbol", "s"), exch, ("price", "qty", "side"), price=num("price", "p"), qty=num("size", "v"), side=_side(_get("d", "side", "S"), "Buy", "Sell")),
            _case(F.col("j").isNull(), "malformed", F.lit(None).cast("string")),
        ]),
    ])


def okx(raw: DataFrame) -> DataFrame:
    item = f"struct<instId:string,tradeId:string,px:string,sz:string,side:string,ts:string,bids:{PAIRS},asks:{PAIRS},seqId:string,prevSeqId:string,fundingRate:string,nextFundingTime:string,oi:string,oiCcy:string,markPx:string,details:array<struct<bkPx:string,sz:string,side:string>>>"
    p = _parsed(raw, f"arg struct<channel:string,instId:string>, action string, data array<{item}>, _bad string")
    d = p.select("*", F.explode("j.data").alias("d"))
    of = lambda *c: d.where(F.col("j.arg.channel").isin(*c))
    b = of("books", "books5", "books-l2-tbt")
    sym, exch = F.coalesce("d.instId", "j.arg.instId"), ms_to_ns(whole("d.ts"))
    book = {"bids": pair_levels("d.bids"), "asks": pair_levels("d.asks")}
    snap = F.coalesce(F.col("j.action"), F.lit("update")) == "snapshot"
    liq = of("liquidation-orders").select("*", F.explode("d.details").alias("x"))
    zero = lambda c: F.coalesce(number(c), F.lit(0.0))
    return _union([
        _event(of("trades"), "trade", "d.instId", exch, ("price", "qty", "side"), price=number("d.px"), qty=number("d.sz"), side=_side("d.side", "buy", "sell"), trade_id=F.coalesce(fnv1a64("d.tradeId"), F.lit(0))),
        _event(b.where(snap), "book_snapshot", sym, exch, (), **book, seq=F.coalesce(whole("d.seqId"), F.lit(0)), depth=F.lit(0), reason=F.lit("Init")),
        _event(b.where(~snap), "book_delta", sym, exch, (), **book, first_seq=whole("d.prevSeqId"), last_seq=F.coalesce(whole("d.seqId"), F.lit(0))),
        _event(of("funding-rate"), "funding", "d.instId", None, (), rate=zero("d.fundingRate"), interval_s=F.lit(0), next_funding_ts_ns=F.coalesce(ms_to_ns(whole("d.nextFundingTime")), F.lit(0))),
        _event(of("open-interest"), "open_interest", "d.instId", None, (), oi_contracts=zero("d.oi"), oi_notional=number("d.oiCcy")),
        _event(of("mark-price"), "mark_price", "d.instId", None, (), mark=zero("d.markPx")),
        _event(liq, "liquidation", F.coalesce("d.instId", F.lit("")), None, (), price=zero("x.bkPx"), qty=zero("x.sz"), side=_side("x.side", "buy", "sell", "Sell")),
        _corrupt(p),
    ])


def coinbase(raw: DataFrame) -> DataFrame:
    trade = "struct<trade_id:string,product_id:string,price:string,size:string,side:string>"
    update = "struct<side:string,price_level:string,new_quantity:string>"
    p = _parsed(raw, f"channel string, events array<struct<type:string,product_id:string,trades:array<{trade}>,updates:array<{update}>>>, _bad string")
    e = p.select("*", F.explode("j.events").alias("e"))
    t = e.where("j.channel = 'market_trades'").select("*", F.explode("e.trades").alias("d"))
    b = e.where("j.channel = 'l2_data'")
    zero = lambda c: F.coalesce(number(c), F.lit(0.0))
    levels = lambda *s: F.coalesce(F.transform(F.filter("e.updates", lambda u: u["side"].isin(*s)), lambda u: F.struct(zero(u["price_level"]).alias("price"), zero(u["new_quantity"]).alias("qty"))), F.array().cast(LEVELS))
    book = {"bids": levels("bid"), "asks": levels("offer", "ask")}
    snap = F.coalesce(F.col("e.type"), F.lit("update")) == "snapshot"
    seq = F.col("stream_seq")  # the feed has no ids of its own, so gaps cannot be seen
    return _union([
        _event(t, "trade", "d.product_id", None, (), price=zero("d.price"), qty=zero("d.size"), side=_side("d.side", "BUY", "SELL", "Buy"), trade_id=F.coalesce(fnv1a64("d.trade_id"), F.lit(0))),
        _event(b.where(snap), "book_snapshot", "e.product_id", None, (), **book, seq=seq, depth=F.lit(0), reason=F.lit("Init")),
        _event(b.where(~snap), "book_delta", "e.product_id", None, (), **book, first_seq=seq, last_seq=seq),
        _corrupt(p),
    ])


def kraken(raw: DataFrame) -> DataFrame:
    lv = "array<struct<price:string,qty:string>>"
    d = _parsed(raw, f"feed string, product_id string, seq string, time string, side string, price string, qty string, bids {lv}, asks {lv}, markPrice string, funding_rate string, openInterest string, _bad string")
    exch, sym, seq = ms_to_ns(whole("j.time")), F.col("j.product_id"), F.coalesce(whole("j.seq"), F.lit(0))
    of = lambda f: d.where(F.col("j.feed") == f)
    zero = lambda c: F.coalesce(number(c), F.lit(0.0))
    ask = F.coalesce(F.col("j.side"), F.lit("buy")) == "sell"
    level = F.array(F.struct(zero("j.price").alias("price"), zero("j.qty").alias("qty")))
    none = F.array().cast(LEVELS)
    tick = of("ticker")
    return _union([
        _event(of("trade"), "trade", sym, exch, (), price=zero("j.price"), qty=zero("j.qty"), side=_side(F.coalesce("j.side", F.lit("buy")), "buy", "sell", "Buy"), trade_id=seq),
        _event(of("book_snapshot"), "book_snapshot", sym, exch, (), bids=object_levels("j.bids"), asks=object_levels("j.asks"), seq=seq, depth=F.lit(0), reason=F.lit("Init")),
        _event(of("book"), "book_delta", sym, exch, (), bids=F.when(ask, none).otherwise(level), asks=F.when(ask, level).otherwise(none), first_seq=seq, last_seq=seq),
        _event(tick.where(number("j.markPrice").isNotNull()), "mark_price", sym, exch, (), mark=number("j.markPrice")),
        _event(tick.where(number("j.funding_rate").isNotNull()), "funding", sym, exch, (), rate=number("j.funding_rate"), interval_s=F.lit(0), next_funding_ts_ns=F.lit(0)),
        _event(tick.where(number("j.openInterest").isNotNull()), "open_interest", sym, exch, (), oi_contracts=number("j.openInterest")),
        _corrupt(d),
    ])


def hyperliquid(raw: DataFrame) -> DataFrame:
    p = _parsed(raw, "channel string, data string, _bad string")
    t = p.where("j.channel = 'trades'").select("*", F.explode(F.from_json("j.data", "array<struct<coin:string,side:string,px:string,sz:string,time:string,tid:string>>")).alias("d"))
    b = p.where("j.channel = 'l2Book'").withColumn("d", F.from_json("j.data", "struct<coin:string,time:string,levels:array<array<struct<px:string,sz:string>>>>"))
    ctx = "markPx:string,oraclePx:string,funding:string,openInterest:string"
    a = p.where("j.channel = 'activeAssetCtx'").withColumn("d", F.from_json("j.data", f"struct<coin:string,{ctx},ctx:struct<{ctx}>>"))
    a = a.withColumn("c", F.coalesce("d.ctx", F.struct("d.markPx", "d.oraclePx", "d.funding", "d.openInterest")))
    zero = lambda c: F.coalesce(number(c), F.lit(0.0))
    levels = lambda i: object_levels(F.try_element_at("d.levels", F.lit(i)), "px", "sz")
    return _union([
        _event(t, "trade", "d.coin", ms_to_ns(whole("d.time")), (), price=zero("d.px"), qty=zero("d.sz"), side=_side("d.side", "B", "A", "Buy"), trade_id=F.coalesce(whole("d.tid"), F.lit(0))),
        _event(b, "book_snapshot", "d.coin", ms_to_ns(whole("d.time")), (), bids=levels(1), asks=levels(2), seq=F.col("stream_seq"), depth=F.lit(0), reason=F.lit("Periodic")),
        _event(a.where(number("c.markPx").isNotNull()), "mark_price", "d.coin", None, (), mark=number("c.markPx"), index=number("c.oraclePx")),
        _event(a.where(number("c.funding").isNotNull()), "funding", "d.coin", None, (), rate=number("c.funding"), interval_s=F.lit(3_600), next_funding_ts_ns=F.lit(0)),
        _event(a.where(number("c.openInterest").isNotNull()), "open_interest", "d.coin", None, (), oi_contracts=number("c.openInterest")),
        _corrupt(p),
    ])


VENUE_JOBS = {"binance_futures": binance, "bybit": bybit, "okx": okx, "coinbase": coinbase, "kraken_futures": kraken, "hyperliquid": hyperliquid}


#: How a venue's book updates tell that one is missing; the others send whole books or no ids.
SYNC_RULES = {"binance_futures": "reseed", "bybit": "strict", "okx": "prev", "kraken_futures": "range"}


def synchronised(events: DataFrame, venue: str, delay: str = "10 seconds") -> DataFrame:
    """Book events checked for continuity: a gap goes out as a ``GapDetected`` status, what cannot be
    applied is left out, and a snapshot after the first says ``GapResync``.

    Where a venue sends updates only, the first one, and the one after a gap, stands for a snapshot.
    The book events of a stream are put in order first (``tidemark.streaming.ordered``), ``delay`` behind the newest.
    """
    if venue not in SYNC_RULES:
        return events
    rule, keys = SYNC_RULES[venue], ("venue", "venue_symbol")
    is_book = F.col("kind").isin("book_snapshot", "book_delta")
    if not events.isStreaming:
        events = staged(events, "events")  # read twice: frames are parsed once
    books = events.where(is_book)
    c = ordered.book_continuity(books, rule, keys, delay) if events.isStreaming else book_continuity(books, rule, keys)
    action, nil = F.col("action"), F.lit(None)
    gap, snap = action == "Gap", action == "Snapshot"
    own_id = F.coalesce("seq", "last_seq")
    fields = {
        "kind": F.when(gap, "status").when(snap, "book_snapshot").otherwise("book_delta"), "status_kind": F.when(gap, "GapDetected"),
        "detail": F.when(gap, F.concat(F.lit("book gap before "), F.col("first_seq").cast("string"), F.lit(" to "), F.col("last_seq").cast("string"))),
        "reason": F.when(snap, F.when(F.col("epoch") > 1, "GapResync").otherwise("Init")), "seq": F.when(snap, own_id),
        "depth": F.when(snap, F.size("bids") + F.size("asks") if venue == "bybit" else F.lit(0)),
        "first_seq": F.when(action == "Apply", F.col("last_seq") if rule == "prev" else F.col("first_seq")), "last_seq": F.when(action == "Apply", F.col("last_seq")),
        "bids": F.when(~gap, F.col("bids")).otherwise(nil), "asks": F.when(~gap, F.col("asks")).otherwise(nil),
    }
    types = dict(events.dtypes)
    out = c.where(action != "Drop").select(*(fields[x].cast(types[x]).alias(x) if x in fields else F.col(x) for x in events.columns))
    return events.where(~is_book).unionByName(out)


def normalize_frames(raw: DataFrame, venue: str) -> DataFrame:
    """Events of one venue's frames. Those of a stream come as they arrive, not checked for continuity: ``synchronised`` does that."""
    events = VENUE_JOBS[venue](raw.where(F.col("venue") == venue) if "venue" in raw.columns else raw.withColumn("venue", F.lit(venue)))
    return events if raw.isStreaming else synchronised(events, venue)


def parse_health(normalized: DataFrame) -> DataFrame:
    """Per venue: events emitted, malformed frames dropped, gaps, resyncs and reconnects."""
    k, s = F.col("kind"), F.col("status_kind")
    return normalized.groupBy("venue").agg(
        F.count_if(k != "malformed").alias("emitted"), F.count_if(k == "malformed").alias("dropped"), F.count_if(s == "GapDetected").alias("gaps"),
        F.count_if((k == "book_snapshot") & (F.col("reason") == "GapResync")).alias("resyncs"), F.count_if(s == "Connected").alias("reconnects"),
    )
