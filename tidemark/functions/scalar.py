"""Scalar column functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VENUES = ("binance_futures", "bybit", "okx", "hyperliquid", "coinbase", "kraken_futures")  # fixed values: codes 1..6 in this order
DAY_NS = 86_400_000_000_000
MINUTE_NS = 60_000_000_000
LEVELS = "array<struct<price:double,qty:double>>"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bucket(x: Column | str, width: int) -> Column:
    """Start of the bucket of ``width`` that holds ``x``; right for negative values too."""
    return col(x) - F.pmod(col(x), F.lit(width))


def bucket_index(x: Column | str, width: int) -> Column:
    return F.call_function("div", bucket(x, width), F.lit(width))


def is_finite(x: Column | str) -> Column:
    v = col(x).cast("double")
    return F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))


def clamp(x: Column | str, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(lo)), F.lit(hi))


def round_down(x: Column | str, step: Column | str) -> Column:
    """To a multiple of ``step``; unchanged for a step of zero or less."""
    s = col(step)
    return F.when(s > 0, F.floor(col(x) / s) * s).otherwise(col(x))


def signed(x: Column | str, side: Column | str = "side") -> Column:
    return F.when(col(side) == "Buy", col(x)).otherwise(-col(x))


def number(x: Column | str) -> Column:
    """A JSON field given as text or number, null if it is neither."""
    return col(x).cast("string").try_cast("double")


def whole(x: Column | str) -> Column:
    return col(x).cast("string").try_cast("bigint")


def ms_to_ns(x: Column | str) -> Column:
    """Saturating: beyond the range the largest or smallest value."""
    top = F.when(col(x) < 0, F.lit(-(2**63))).otherwise(F.lit(2**63 - 1)).cast("long")
    return F.when(col(x).isNotNull(), F.coalesce(F.try_multiply(col(x), F.lit(1_000_000).cast("long")), top))


def pair_levels(x: Column | str) -> Column:
    """[[price, qty], ...] as levels; an absent side is empty."""
    return F.coalesce(F.transform(col(x), lambda p: F.struct(number(F.try_element_at(p, F.lit(1))).alias("price"), number(F.try_element_at(p, F.lit(2))).alias("qty"))), F.array().cast(LEVELS))


def object_levels(x: Column | str, price: str = "price", qty: str = "qty") -> Column:
    return F.coalesce(F.transform(col(x), lambda p: F.struct(number(p[price]).alias("price"), number(p[qty]).alias("qty"))), F.array().cast(LEVELS))


def bad_levels(x: Column) -> Column:
    return F.exists(x, lambda p: p["price"].isNull() | p["qty"].isNull())


def venue_code(slug: Column | str) -> Column:
    """1..6; an unknown venue is an error."""
    codes = F.create_map(*(F.lit(v) for i, name in enumerate(VENUES, 1) for v in (name, i)))
    code = F.try_element_at(codes, col(slug))
    return F.when(code.isNotNull(), code).otherwise(F.raise_error(F.concat(F.lit("unknown venue: "), F.coalesce(col(slug), F.lit("null")))).cast("int"))


def venue_slug(code: Column | str) -> Column:
    names = F.array(*(F.lit(v) for v in VENUES))
    ok = col(code).between(1, len(VENUES))
    return F.when(ok, F.element_at(names, F.greatest(col(code), F.lit(1)).cast("int"))).otherwise(F.raise_error(F.concat(F.lit("unknown venue code: "), F.coalesce(col(code).cast("string"), F.lit("null")))))


def in_quiet_hours(ns: Column | str, start_min: int, end_min: int) -> Column:
    """Whether the minute of the day lies in [start, end); wraps midnight if start > end."""
    minute = F.floor(F.pmod(col(ns), F.lit(DAY_NS)) / MINUTE_NS)
    return (minute >= start_min) & (minute < end_min) if start_min <= end_min else (minute >= start_min) | (minute < end_min)


def regime_fit(mask: Column | str, vol: Column | str, trend: Column | str, penalty: float) -> Column:
    """1 for an empty mask or a label that is in it, else the penalty within [0, 1]."""
    hit = (F.size(col(mask)) <= 0) | F.array_contains(col(mask), col(vol)) | F.array_contains(col(mask), col(trend))
    return F.when(F.coalesce(hit, F.lit(False)), F.lit(1.0)).otherwise(F.lit(min(max(penalty, 0.0), 1.0)))


def draw(seed: int, rep: Column | str, i: Column | str) -> Column:
    """Counter-based pseudo-random number in [0, 2**32): the same in any engine that has md5."""
    text = F.concat_ws(":", F.lit(str(seed)), col(rep).cast("string"), col(i).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def numeric_tokens(text: Column | str) -> Column:
    """Numbers in a text, each in six significant digits."""
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1))
    return F.transform(found, lambda x: six_digits(x.try_cast("double")))


def six_digits(x: Column) -> Column:
    """A canonical text of a number at six significant digits: two numbers that agree there have the same text.

    The nudge takes halves away from zero whatever the engine's way of rounding.
    """
    return F.when(x == 0, F.lit("0")).otherwise(F.format_string("%.5e", x * (1 + 1e-13)))


@F.pandas_udf(T.LongType())
def fnv1a64(text: pd.Series) -> pd.Series:
    """FNV-1a of the UTF-8 bytes, as a signed 64-bit number. For compatibility; prefer xxhash64."""

    def one(s: str | None) -> int | None:
        if s is None:
            return None
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h - 2**64 if h >= 2**63 else h

    return text.map(one).astype("Int64")
