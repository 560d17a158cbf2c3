"""Frames over the bars of a symbol, and rolling functions with their warm-up.

Every frame counts bars, not time. All share one partitioning and order, so that any
number of them needs one shuffle and one sort. `i` is a bar's place from 0 in its
symbol and `n` the symbol's number of bars. Windows are by symbol, or by what
dealt_by() names while columns are made: operators.blocks has them by blocks of a symbol.
"""

from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .guards import divide, zero_filled


_KEYS = ContextVar("keys", default=("symbol",))


@contextmanager
def dealt_by(*keys: str):
    """Windows made inside are partitioned by these columns."""
    was = _KEYS.set(keys)
    try:
        yield
    finally:
        _KEYS.reset(was)


def by_symbol():
    return Window.partitionBy(*_KEYS.get())


def in_order():
    return by_symbol().orderBy("time")


def to_here():
    return in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def last(k: int):
    """The current bar and the k - 1 before it."""
    return in_order().rowsBetween(-(k - 1), 0)


def before(k: int):
    """The k bars before the current one."""
    return in_order().rowsBetween(-k, -1)


def full(value: Column, k: int) -> Column:
    """Null until k bars are there."""
    return F.when(F.col("i") >= k - 1, value)


def rolling_mean(x: Column, k: int) -> Column:
    return full(F.avg(x).over(last(k)), k)


def rolling_std(x: Column, k: int) -> Column:
    """Population deviation."""
    return full(F.stddev_pop(x).over(last(k)), k)


def rolling_max(x: Column, k: int) -> Column:
    return full(F.max(x).over(last(k)), k)


def rolling_min(x: Column, k: int) -> Column:
    return full(F.min(x).over(last(k)), k)


def rolling_mean_of_nulls(x: Column, k: int) -> Column:
    """A null counts as 0."""
    return rolling_mean(zero_filled(x), k)


def delay(x: Column, k: int) -> Column:
    return F.lag(x, k).over(in_order()) if k else x


def delta(x: Column, k: int) -> Column:
    return x - delay(x, k)


def forward_return(close: Column, ahead: int) -> Column:
    """(close in `ahead` bars - close) / close; null at the end of a series or where close is 1e-12 or less."""
    later = F.lead(close, ahead).over(in_order()) if ahead else close
    return F.when(close > 1e-12, F.try_divide(later - close, close))


def true_range(high: Column, low: Column, close: Column) -> Column:
    """The largest of the bar's range and its distances from the close before; null in the first bar."""
    was = F.lag(close).over(in_order())
    return F.when(F.col("i") >= 1, F.greatest(F.abs(high - low), F.abs(high - was), F.abs(low - was)))


def volume_mean(k: int = 5) -> Column:
    """0 during warm-up."""
    return F.when(F.col("i") >= k - 1, F.avg("volume").over(last(k))).otherwise(0.0)


def volume_upper_quartile(k: int = 20) -> Column:
    """The value at place int(0.75 k) - 1 of the last k volumes in order (14 of 20); 0 during warm-up."""
    ordered = F.array_sort(F.collect_list("volume").over(last(k)))
    return F.when(F.col("i") >= k - 1, F.get(ordered, F.lit(int(0.75 * k) - 1))).otherwise(0.0)


def ts_rank(x: Column, k: int) -> Column:
    """The share of the last k values that are no larger than the current one."""
    seen = F.collect_list(x).over(last(k))
    return full(F.size(F.filter(seen, lambda v: v <= x)) / F.size(seen), k)


def ts_corr(x: Column, y: Column, k: int) -> Column:
    return full(correlation(x, y, last(k)), k)


def correlation(x: Column, y: Column, frame, whole=None) -> Column:
    """Pearson's correlation of the pairs in a frame in which both are there; 0 where either does not vary; in [-1, 1].

    Values are taken from their mean over `whole` (the symbol), so that sums of squares lose no digits.
    """
    whole = whole or by_symbol()
    there = x.isNotNull() & y.isNotNull()
    x, y = F.when(there, x - F.avg(x).over(whole)), F.when(there, y - F.avg(y).over(whole))
    n, sx, sy = F.count(x).over(frame), F.sum(x).over(frame), F.sum(y).over(frame)
    vx = F.sum(x * x).over(frame) - F.try_divide(sx * sx, n)
    vy = F.sum(y * y).over(frame) - F.try_divide(sy * sy, n)
    both = F.sum(x * y).over(frame) - F.try_divide(sx * sy, n)
    flat = (F.max(x).over(frame) <= F.min(x).over(frame)) | (F.max(y).over(frame) <= F.min(y).over(frame))
    size = F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))
    r = F.when((n < 2) | flat | (size < 1e-15), 0.0).otherwise(F.try_divide(both, size))
    return F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))


def rank(x: Column) -> Column:
    """Place among all symbols at one time, from 0 to 1."""
    return F.when(x.isNotNull(), F.percent_rank().over(Window.partitionBy("time").orderBy(x)))


def scale(x: Column) -> Column:
    """x over the sum of absolute values of all symbols at one time."""
    return divide(x, F.sum(F.abs(x)).over(Window.partitionBy("time")))


def log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))
