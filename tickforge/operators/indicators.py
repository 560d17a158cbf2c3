"""Technical indicators of candle series, one nullable set of columns on each candle's row."""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W
from .blocks import affine, affine_twice, windowed


@dataclass(frozen=True)
class Recurrence:
    """An indicator: window columns of `before` bars back, states along the symbol, and what it adds.

    columns: functions that make the window columns. first: states, as maps (a, b) of the
    state before (see blocks.affine). between: columns of them. second: states that read
    these. adds: the indicator's columns.
    """

    adds: dict[str, Column]
    first: dict[str, tuple[Column, Column]]
    columns: dict[str, Callable[[], Column]] = field(default_factory=dict)
    before: int = 0
    between: dict[str, Column] = field(default_factory=dict)
    second: dict[str, tuple[Column, Column]] = field(default_factory=dict)


def applied(candles: DataFrame, *parts: Recurrence) -> DataFrame:
    """Adds what all recurrences give, each stage of all of them in one pass over blocks of bars; rows keep `block`."""
    gathered = lambda name: {k: v for p in parts for k, v in getattr(p, name).items()}
    rows = windowed(candles, lambda: {k: make() for k, make in gathered("columns").items()}, max(p.before for p in parts))
    first, second = gathered("first"), gathered("second")
    if second:
        rows = affine_twice(rows, first, gathered("between"), second)
    elif first:
        rows = affine(rows, first)
    return rows.select(*candles.columns, *[c.alias(k) for k, c in gathered("adds").items()], *(["block"] if "block" not in candles.columns else []))


def _bollinger(period: int = 20, width: float = 2.0) -> Recurrence:
    mean, std = F.col("_bb_mean"), F.col("_bb_std")
    return Recurrence(
        {"bb_upper": mean + width * std, "bb_middle": mean, "bb_lower": mean - width * std},
        {},
        {"_bb_mean": lambda: W.rolling_mean(F.col("close"), period), "_bb_std": lambda: W.rolling_std(F.col("close"), period)},
        period - 1,
    )


def bollinger(candles: DataFrame, *parameters) -> DataFrame:
    """Adds bb_upper, bb_middle, bb_lower: the mean of `period` (20) closes and `width` (2) population deviations around it."""
    return applied(candles, _bollinger(*parameters))


def smoothed(x: Column, period: int, rate: float | None = None, start: int = 0) -> tuple[Column, Column]:
    """The map of a mean of `period` values from bar `start` on that then moves on by y + rate * (x - y), or as Wilder's does by (x - y) / period.

    It is there from bar start + period - 1 on.
    """
    rate = rate or 1.0 / period
    k = F.col("i") - start
    a = F.when(k <= 0, 0.0).when(k < period - 1, 1.0).when(k == period - 1, 1.0 / period).otherwise(1.0 - rate)
    b = F.when(k < 0, 0.0).when(k < period - 1, x).when(k == period - 1, x / period).otherwise(x * rate)
    return a, b


def _ema(x: Column, period: int, start: int = 0) -> tuple[Column, Column]:
    return smoothed(x, period, 2.0 / (period + 1), start)


def _given(ready: Column, **columns: Column) -> dict[str, Column]:
    return {k: F.when(ready, c) for k, c in columns.items()}


def _true_range() -> Column:
    return W.true_range(F.col("high"), F.col("low"), F.col("close"))


def _keltner(ema_period: int = 20, atr_period: int = 10, width: float = 2.0) -> Recurrence:
    middle, atr = F.col("_kc_middle"), F.col("_kc_atr")
    ready = (F.col("i") >= max(ema_period, atr_period + 1)) & (F.col("n") > max(ema_period, atr_period))
    return Recurrence(
        _given(ready, kc_upper=middle + width * atr, kc_middle=middle, kc_lower=middle - width * atr),
        {"_kc_middle": _ema(F.col("close"), ema_period), "_kc_atr": smoothed(F.col("_tr"), atr_period, start=1)},
        {"_tr": _true_range},
        1,
    )


def keltner(candles: DataFrame, *parameters) -> DataFrame:
    """Adds kc_upper, kc_middle, kc_lower: an exponential mean and two average true ranges around it."""
    return applied(candles, _keltner(*parameters))


def _macd(fast: int = 12, slow: int = 26, signal: int = 9) -> Recurrence:
    dif, dea = F.col("_dif"), F.col("_dea")
    ready = (F.col("i") >= slow + signal - 2) & (F.col("n") >= slow + signal)
    return Recurrence(
        _given(ready, dif=dif, dea=dea, bar=2.0 * (dif - dea)),
        {"_fast": _ema(F.col("close"), fast), "_slow": _ema(F.col("close"), slow)},
        between={"_dif": F.col("_fast") - F.col("_slow")},
        second={"_dea": _ema(dif, signal, slow - 1)},
    )


def macd(candles: DataFrame, *parameters) -> DataFrame:
    """Adds dif, dea, bar (twice their difference); null in series of fewer than 35 bars."""
    return applied(candles, _macd(*parameters))


def _kdj(period: int = 9) -> Recurrence:
    high, low, warm = F.col("_h"), F.col("_l"), F.col("i") < period - 1
    rsv = F.when(F.abs(high - low) < 1e-9, 50.0).otherwise(F.try_divide(F.col("close") - low, high - low) * 100.0)
    third = 1.0 / 3.0
    by_thirds = lambda x: (F.when(warm, 0.0).otherwise(1.0 - third), F.when(warm, 50.0).otherwise(third * x))
    k, d = F.col("_k"), F.col("_d")
    return Recurrence(
        _given(~warm & (F.col("n") >= period + 1), k=k, d=d, j=3.0 * k - 2.0 * d),
        {"_k": by_thirds(rsv)},
        {"_h": lambda: W.rolling_max(F.col("high"), period), "_l": lambda: W.rolling_min(F.col("low"), period)},
        period - 1,
        second={"_d": by_thirds(k)},
    )


def kdj(candles: DataFrame, *parameters) -> DataFrame:
    """Adds k, d, j: the close's place in the range of nine bars, smoothed twice by thirds from 50; 3k - 2d."""
    return applied(candles, _kdj(*parameters))


def _adx(period: int = 14) -> Recurrence:
    up, down, atr = F.col("_up"), F.col("_down"), F.col("_atr")
    index = lambda moved: F.when(atr > 0, F.try_divide(100.0 * F.col(moved), atr)).otherwise(0.0)
    plus, minus = F.col("_pdi"), F.col("_mdi")
    moved = lambda one, other: smoothed(F.when((one > other) & (one > 0), one).otherwise(0.0), period, start=1)
    return Recurrence(
        _given((F.col("i") >= 2 * period) & (F.col("n") >= 2 * period + 1), adx=F.col("_adx"), plus_di=plus, minus_di=minus),
        {"_atr": smoothed(F.col("_tr"), period, start=1), "_plus": moved(up, down), "_minus": moved(down, up)},
        {"_tr": _true_range, "_up": lambda: W.delta(F.col("high"), 1), "_down": lambda: -W.delta(F.col("low"), 1)},
        1,
        {"_pdi": index("_plus"), "_mdi": index("_minus")},
        {"_adx": smoothed(F.when(plus + minus > 0, F.try_divide(100.0 * F.abs(plus - minus), plus + minus)).otherwise(0.0), period, start=period)},
    )


def adx(candles: DataFrame, *parameters) -> DataFrame:
    """Adds adx, plus_di, minus_di from the bar after the first 28 on."""
    return applied(candles, _adx(*parameters))


def _rsi(period: int = 2) -> Recurrence:
    change, gain, loss = F.col("_change"), F.col("_gain"), F.col("_loss")
    value = F.when(loss < 1e-9, 100.0).otherwise(100.0 - F.try_divide(F.lit(100.0), 1.0 + F.try_divide(gain, loss)))
    only = lambda x: smoothed(F.when(x > 0, x).otherwise(0.0), period, start=1)
    return Recurrence(_given(F.col("i") >= period, rsi=value), {"_gain": only(change), "_loss": only(-change)}, {"_change": lambda: W.delta(F.col("close"), 1)}, 1)


def rsi(candles: DataFrame, *parameters) -> DataFrame:
    """Adds rsi over two changes, 100 where the average loss is below 1e-9."""
    return applied(candles, _rsi(*parameters))


def all_indicators(candles: DataFrame) -> DataFrame:
    """Candles (with i and n) with every indicator's columns; recurrences take two passes over blocks of bars."""
    return applied(candles, _bollinger(), _keltner(), _macd(), _kdj(), _adx(), _rsi())


def regime(indicated: DataFrame) -> DataFrame:
    """(symbol, regime): one label for each series with bb_* and adx columns, by its last bars.

    The labels are those of the list below, whose conditions are tried in order; a
    series of fewer than 60 bars has too little data.
    """
    too_short, narrow, choppy, bull, bear, tired = LABELS
    from_end = F.col("n") - 1 - F.col("i")
    bw = F.try_divide(F.col("bb_upper") - F.col("bb_lower"), F.col("bb_middle"))
    rows = indicated.select("symbol", "i", "n", "close", "adx", bw.alias("bw"), from_end.alias("e"))
    last = lambda x, cond=None: F.max_by(x, F.when(F.col(x).isNotNull() & (F.lit(True) if cond is None else cond), F.col("i")))
    mean = lambda cond, x: F.avg(F.when(cond, F.col(x)))
    # Bands exist from the 20th bar to the end, so the last 20 of them are the last 20 bars.
    by = rows.groupBy("symbol").agg(
        F.max("n").alias("n"),
        F.coalesce(last("adx"), F.lit(0.0)).alias("adx"),
        last("adx", F.col("e") >= 3).alias("was"),
        F.coalesce(last("bw"), F.lit(0.02)).alias("bw"),
        F.count("bw").alias("bands"),
        mean(F.col("e") < 20, "bw").alias("bw20"),
        mean(F.col("e") < 10, "close").alias("ma"),
        mean((F.col("e") >= 3) & (F.col("e") < 13), "close").alias("ma_was"),
    )
    by = by.withColumns(
        {
            "was": F.coalesce("was", "adx"),
            "bw_ma": F.when(F.col("bands") >= 20, F.col("bw20")).otherwise(F.col("bw")),
            "slope": F.when(F.col("ma_was") > 0, F.try_divide(F.col("ma") - F.col("ma_was"), F.col("ma_was"))).otherwise(0.0),
        }
    )
    wide = F.col("bw") > F.col("bw_ma")
    label = (
        F.when(F.col("n") < 60, too_short)
        .when((F.col("adx") < 15) & (F.col("bw") < F.col("bw_ma") * 0.75), narrow)
        .when(F.col("adx") < 20, choppy)
        .when((F.col("adx") > 25) & (F.col("slope") > 0.003) & wide, bull)
        .when((F.col("adx") > 25) & (F.col("slope") < -0.003) & wide, bear)
        .when((F.col("adx") > 30) & (F.col("adx") < F.col("was")), tired)
        .otherwise(choppy)
    )
    return by.select("symbol", label.alias("regime"))


#: Too little data, narrow range, choppy, one-sided rise, one-sided fall, exhausted trend.
LABELS = ("数据不足", "窄幅整理", "震荡市", "单边牛市", "单边熊市", "趋势衰竭")
