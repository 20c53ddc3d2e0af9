"""Column builders over daily series windows.

A daily table holds one row per (symbol, trading day), so a symbol's window is bounded by the
calendar however large the table is. Builders that share a window share one sort.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tapeworks.functions.numbers import ratio


def series(*keys: str, order: Sequence[str] = ("data_date",)) -> WindowSpec:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy(*order)


def _tail(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def rows_in(w: WindowSpec, n: int) -> Column:
    return F.count(F.lit(1)).over(_tail(w, n))


def sma(value: Column, n: int, w: WindowSpec) -> Column:
    """Mean of the last ``n`` rows; NULL until there are ``n`` rows."""
    return F.when(rows_in(w, n) == n, F.avg(value).over(_tail(w, n)))


def tail_sum(value: Column, n: int, w: WindowSpec) -> Column:
    """Sum over the last up-to-``n`` rows, NULLs skipped, 0 when all are NULL."""
    return F.coalesce(F.sum(value).over(_tail(w, n)), F.lit(0.0))


def running(value: Column, w: WindowSpec) -> Column:
    return F.sum(F.coalesce(value, F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))


def true_range(high: Column, low: Column, close: Column, w: WindowSpec) -> Column:
    prev = F.lag(close).over(w)
    return F.greatest(high - low, F.abs(high - prev), F.abs(low - prev))


def atr(tr: str, n: int, w: WindowSpec) -> Column:
    """Mean of the last ``n`` true ranges; needs ``n + 1`` rows."""
    return F.when(rows_in(w, n + 1) == n + 1, F.avg(tr).over(_tail(w, n)))


def lowest(value: Column, n: int, w: WindowSpec) -> Column:
    return F.min(value).over(_tail(w, n))


def highest(value: Column, n: int, w: WindowSpec, min_rows: int) -> Column:
    return F.when(rows_in(w, max(n, min_rows)) >= min_rows, F.max(value).over(_tail(w, n)))


def change(value: Column, n: int, w: WindowSpec) -> Column:
    """Relative change against ``n`` rows back; NULL if that base is missing or not positive."""
    base = F.lag(value, n).over(w)
    return F.when(base > 0, ratio(value - base, base))


def difference(value: Column, n: int, w: WindowSpec) -> Column:
    return value - F.lag(value, n).over(w)


def volatility(returns: str, n: int, w: WindowSpec) -> Column:
    """Sample deviation of the last ``n`` one-row returns."""
    frame = _tail(w, n)
    return F.when(F.count(returns).over(frame) == n, F.stddev_samp(returns).over(frame))


def range_position(value: Column, n: int, w: WindowSpec) -> Column:
    lo, hi = F.min(value).over(_tail(w, n)), F.max(value).over(_tail(w, n))
    return F.when((rows_in(w, n) == n) & (hi > lo), ratio(value - lo, hi - lo))


def flow_ratio(net: Column, volume: Column, n: int, w: WindowSpec) -> Column:
    """Net over traded volume in the last ``n`` rows; NULL if the rows or the volume are missing."""
    den = F.sum(volume).over(_tail(w, n))
    return F.when((rows_in(w, n) == n) & (den > 0),
                  ratio(F.coalesce(F.sum(net).over(_tail(w, n)), F.lit(0.0)), den))


def first_last_change(value: Column, n: int, w: WindowSpec) -> Column:
    """Last minus first known value of the last ``n`` rows; 0 below two known values."""
    frame = _tail(w, n)
    diff = F.last(value, ignorenulls=True).over(frame) - F.first(value, ignorenulls=True).over(frame)
    return F.when(F.count(value).over(frame) >= 2, diff).otherwise(F.lit(0))


def slope(y: str, x: str, n: int, w: WindowSpec) -> Column:
    frame = _tail(w, n)
    return F.when(F.count(y).over(frame) == n, F.regr_slope(y, x).over(frame))


def rolling_quantile(value: str, q: float, n: int, min_rows: int, w: WindowSpec) -> Column:
    """Quantile of up to ``n`` preceding rows, the current one excluded; frame bounded by ``n``."""
    frame = w.rowsBetween(-n, -1)
    return F.when(F.count(value).over(frame) >= min_rows, F.percentile(value, q).over(frame))


def rolling_z(value: str, n: int, w: WindowSpec, eps: float = 1e-9) -> Column:
    """Deviation from the preceding ``n`` rows; 0 with fewer than two of them."""
    frame = w.rowsBetween(-n, -1)
    z = (F.col(value) - F.avg(value).over(frame)) / (F.stddev_pop(value).over(frame) + eps)
    return F.when(F.count(value).over(frame) < 2, F.lit(0.0)).otherwise(z)


def rolling_rank(value: str, n: int, w: WindowSpec) -> Column:
    """Share of the preceding ``n`` values that are <= the current one; 0.5 without history.

    The frame is bounded by ``n``, so the collected array is too.
    """
    past = F.collect_list(value).over(w.rowsBetween(-n, -1))
    hits = F.size(F.filter(past, lambda p: p <= F.col(value)))
    return F.when(F.size(past) == 0, F.lit(0.5)).otherwise(ratio(hits, F.size(past)))


def run_start(sign: str, w: WindowSpec) -> Column:
    """1 where a run of equal signs begins, else 0; its running sum numbers the runs."""
    return F.when(F.lag(sign).over(w).eqNullSafe(F.col(sign)), 0).otherwise(1)


def signed_run(sign: str, run: str, *keys: str, order: Sequence[str] = ("data_date",)) -> Column:
    """Length so far of the current run times its sign; 0 or NULL breaks a run."""
    w = Window.partitionBy(*(keys or ("symbol",)), run).orderBy(*order)
    return F.coalesce(F.row_number().over(w) * F.col(sign), F.lit(0))


def market_day_sum(value: Column, n: int, day_no: str = "day_no", *keys: str) -> Column:
    """Sum over the last ``n`` market days; days without a row count 0, no row at all is NULL."""
    w = Window.partitionBy(*(keys or ("symbol",))).orderBy(day_no).rangeBetween(-(n - 1), 0)
    return F.when(F.col(day_no) >= n, F.sum(value).over(w))


def asof_base(value: str, lookback: int, day_no: str = "day_no", *keys: str) -> Column:
    """Last known (date, value) at least ``lookback`` market days back, as a STRUCT."""
    w = (Window.partitionBy(*(keys or ("symbol",))).orderBy(day_no)
         .rangeBetween(Window.unboundedPreceding, -lookback))
    known = F.when(F.col(value).isNotNull(), F.struct("data_date", F.col(value).alias("v")))
    return F.last(known, ignorenulls=True).over(w)
