"""Exact rolling order statistics and cross-correlations: keys are cut in slices of their axis, numpy works within a slice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import bucket_index
from tidemark.operators.core import running
from tidemark.operators.scan import scanned


def ranked_in(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The ``k``-th smallest (from 0) of ``values[lo:hi]`` for every question, all at once.

    A wavelet matrix: values are numbered in order and dealt bit by bit, the highest first;
    how many zeros lie in a question's range tells which half its answer is in. Each level is
    thrown away after use, so room is a few arrays and time (values + questions) x bits.
    """
    distinct, code = np.unique(values, return_inverse=True)
    found = np.zeros(len(k), np.int64)
    for bit in reversed(range((len(distinct) - 1).bit_length())):
        zero = (code >> bit) & 1 == 0
        before = np.concatenate([[0], np.cumsum(zero)])
        low, high = before[lo], before[hi]
        left = k < high - low
        found += np.where(left, 0, 1 << bit)
        k = np.where(left, k, k - (high - low))
        lo, hi = np.where(left, low, before[-1] + lo - low), np.where(left, high, before[-1] + hi - high)
        code = np.concatenate([code[zero], code[~zero]])
    return distinct[found]


def interpolated(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, q: float) -> np.ndarray:
    """The ``q``-quantile of each ``values[lo:hi]`` between its two nearest ranks; NaN for an empty one."""
    place = q * np.maximum(hi - lo - 1, 0)
    down, some = np.floor(place).astype(np.int64), hi > lo
    out = np.full(len(lo), np.nan)
    a = ranked_in(values, lo[some], hi[some], down[some]) if some.any() else np.empty(0)
    b = ranked_in(values, lo[some], hi[some], np.ceil(place[some]).astype(np.int64)) if some.any() else a
    share = (place - down)[some]
    out[some] = np.where(a == b, a, (1 - share) * a + share * b)
    return out


CHUNK = 32_768  # rows that numpy takes at once, of as many whole slices


def _begins(rows: pa.Table, columns: list[str]) -> np.ndarray:
    """Whether each row differs from the row before it in ``columns``; nulls are equal, and so are NaN."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for c in columns:
        v = rows[c].combine_chunks()
        a, b = v.slice(1), v.slice(0, max(len(v) - 1, 0))
        differ = pc.not_equal(a, b)
        if pa.types.is_floating(v.type):
            differ = pc.and_not(differ, pc.and_(pc.is_nan(a), pc.is_nan(b)))
        new[1:] |= pc.or_(pc.fill_null(differ, False), pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)
    return new


def _whole_slices(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``columns`` in tables of whole slices, with the number of each row's slice."""
    held, n, want = [], 0, CHUNK
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n < want:
            continue
        rows = pa.Table.from_batches(held)
        begins = np.flatnonzero(_begins(rows, columns))
        end = int(begins[-1])  # what comes before is whole, the last slice may go on
        if end:
            yield rows.slice(0, end), np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        held, n = rows.slice(end).to_batches(), len(rows) - end
        want = max(CHUNK, 2 * n)
    if held:
        rows = pa.Table.from_batches(held)
        yield rows, np.cumsum(_begins(rows, columns)) - 1


def quantiles(df: DataFrame, keys: list[str], value: Column, wanted: dict[str, float], at: str, back: int, upto: int = -1, least: int = 60_000_000_000) -> DataFrame:
    """``df`` with quantiles (name to share) of ``value`` over the key's rows whose ``at`` is within ``at - back`` to ``at + upto``.

    Null values don't count; a row without any has null. Rows without ``at`` are left out. A task
    holds two slices of a key, each as long as the window (or ``least``), and takes n log n steps for
    n rows, however many of them a window has. Short slices are answered many at a time.
    """
    slot = bucket_index(at, max(back, least))
    d = df.where(F.col(at).isNotNull()).withColumn("_x", value.cast("double"))
    d = d.withColumn("_s", F.explode(F.array(slot, slot + 1))).withColumn("_own", F.col("_s") == slot)
    names, cut = df.columns, [*keys, "_s"]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in _whole_slices(batches, cut):
            axis, own, known = rows[at].to_numpy(), rows["_own"].to_numpy(), rows["_x"].is_valid().to_numpy()
            # Times by number, so that slice and time are one number.
            times, number = np.unique(np.concatenate([axis[known], axis[own] - back, axis[own] + upto]), return_inverse=True)
            n, m, base = int(known.sum()), int(own.sum()), group * len(times)
            place = base[known] + number[:n]
            order = np.argsort(place, kind="stable")
            place, values = place[order], rows["_x"].drop_null().to_numpy()[order]
            lo, hi = np.searchsorted(place, base[own] + number[n : n + m], "left"), np.searchsorted(place, base[own] + number[n + m :], "right")
            out = rows.select(names).filter(pa.array(own))
            for name, q in wanted.items():
                out = out.append_column(name, pa.array(interpolated(values, lo, hi, q), pa.float64(), mask=hi <= lo))
            yield from out.to_batches(CHUNK)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", `{n}` double" for n in wanted)
    return d.repartition(*cut).sortWithinPartitions(*cut, at).mapInArrow(answer, schema)


def quantiles_of_last(df: DataFrame, keys: list[str], value: Column, wanted: dict[str, float], order: str, n: int, least: int = 4096) -> DataFrame:
    """``quantiles`` over the ``n`` rows before each row in ``order``, which has no ties: places are the axis."""
    placed = running(df, F.lit(1).cast("long"), tuple(keys), "_place", ts=order, seq=())
    return quantiles(placed, keys, value, wanted, "_place", n, -1, least).drop("_place")


def grid_returns(prices: DataFrame, by: list[str], price: str, grid_ns: int, ts: str = "recv_ts_ns", seq: str = "stream_seq", slice_ns: int = 86_400_000_000_000) -> DataFrame:
    """(by, ts_ns, r): log return of each grid second (``grid_ns``) with a price, to the last price before; others' return is zero."""
    step = bucket_index(ts, grid_ns) * grid_ns
    last = prices.where(F.col(price) > 0).groupBy(*by, step.alias("ts_ns")).agg(F.max_by(price, F.struct(ts, seq)).cast("double").alias("_c"))
    d = scanned(last, by, {"_before": ("last", F.col("_c"), True)}, "ts_ns", (), slice_ns)
    return d.where("_before is not null").select(*by, "ts_ns", F.log(F.col("_c") / F.col("_before")).alias("r"))


def correlations(x: np.ndarray, y: np.ndarray, max_lag: int) -> np.ndarray:
    """Correlation of x[t] and y[t + lag] over the t at which both exist, for lags -max_lag..max_lag; NaN where one does not vary.

    Products come from one pair of Fourier transforms, the moments of the overlapping parts from running sums.
    """
    n = len(x)
    room = 1 << int(n + max_lag).bit_length()
    raw = np.fft.irfft(np.conj(np.fft.rfft(x, room)) * np.fft.rfft(y, room), room)
    lags = np.arange(-max_lag, max_lag + 1)
    sxy, m = raw[lags % room], (n - np.abs(lags)).astype(float)
    first, end = np.maximum(0, -lags), n - np.maximum(0, lags)  # of x; of y the same plus lag

    def part(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0.0], np.cumsum(v)])
        return run[b] - run[a]

    sx, sxx = part(x, first, end), part(x * x, first, end)
    sy, syy = part(y, first + lags, end + lags), part(y * y, first + lags, end + lags)
    vx, vy = m * sxx - sx * sx, m * syy - sy * sy
    still = (vx <= 1e-12 * m * max(float(x @ x), 1e-300)) | (vy <= 1e-12 * m * max(float(y @ y), 1e-300))
    return np.where(still, np.nan, (m * sxy - sx * sy) / np.sqrt(np.where(still, 1.0, vx * vy)))


def lead_lag(a: DataFrame, b: DataFrame, window_ns: int, max_lag: int, grid_ns: int = 1_000_000_000, by: str = "symbol_id") -> DataFrame:
    """(by, ts_ns, lag, corr): for each window of ``window_ns`` (``ts_ns`` is its end) the lag, in grid steps, at which returns of
    ``a`` go best with returns of ``b`` that many steps later; positive: ``a`` leads. Ties go to the shorter, then the smaller lag.

    ``a`` and ``b`` are ``grid_returns``; a window that either has nothing in, or in which nothing correlates, gives no row.
    One task holds one window of one key: window_ns / grid_ns numbers.
    """
    n = window_ns // grid_ns
    if n * grid_ns != window_ns or not 0 <= max_lag < n:
        raise ValueError("a window is a whole number of grid steps, more than the largest lag")
    part = lambda d, i: d.select(by, "ts_ns", F.col("r").alias("r"), F.lit(i).alias("side"))
    both = part(a, 0).unionByName(part(b, 1)).withColumn("_w", bucket_index("ts_ns", window_ns))
    kind = both.schema[by].dataType.simpleString()

    def best(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        xy, w = np.zeros((2, n)), key[1].as_py()
        xy[rows["side"].to_numpy(), (rows["ts_ns"].to_numpy() - w * window_ns) // grid_ns] = rows["r"].to_numpy()
        c = correlations(xy[0], xy[1], max_lag)
        lags = [i for i in range(2 * max_lag + 1) if not np.isnan(c[i])]
        i = max(lags, key=lambda i: (round(abs(c[i]), 12), -abs(i - max_lag), -i), default=None)
        found = [] if i is None else [i]
        columns = [pa.array([key[0].as_py()] * len(found), rows.schema.field(by).type), pa.array([(w + 1) * window_ns] * len(found), pa.int64())]
        return pa.Table.from_arrays([*columns, pa.array([i - max_lag for i in found], pa.int32()), pa.array([float(c[i]) for i in found], pa.float64())], [by, "ts_ns", "lag", "corr"])

    return both.groupBy(by, "_w").applyInArrow(best, f"`{by}` {kind}, ts_ns long, lag int, corr double")
