"""Signals and positions from the composite score."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SignalConfig, TurtleConfig
from ..functions import windows as W
from ..functions.guards import finite_or_null
from . import blocks
from .blocks import affine, placed, windowed
from .factors import CATEGORIES
from .machines import Turtle, positions
from .orders import quantiles_before

#: What the categories are called in a reason.
NAMES = {"momentum": "动量↑", "volatility": "波动", "volume_score": "量价", "trend": "趋势"}


def dominant_category() -> Column:
    """The category of largest absolute contribution, the later on ties; momentum that is negative has its arrow down."""
    columns = [c if c != "volume" else "volume_score" for c in CATEGORIES]
    most = F.greatest(*[F.abs(c) for c in columns])
    out = F.when(F.col("total").isNull(), F.lit(None).cast("string"))
    for c in reversed(columns):
        name = F.lit(NAMES[c])
        out = out.when(F.abs(c) == most, F.when(F.col(c) < 0, F.replace(name, F.lit("↑"), F.lit("↓"))).otherwise(name))
    return out


def _signal(cond: Column, kind, rule: str, bound: Column, level=None, category=None) -> Column:
    none = F.lit(None).cast("string")
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    fields = {"kind": kind, "rule": F.lit(rule), "level": none if level is None else level, "bound": bound, "category": none if category is None else category}
    return F.when(cond, F.struct(*[v.alias(k) for k, v in fields.items()]))


def _quantile(scored: DataFrame, config: SignalConfig) -> DataFrame:
    w = config.quantile_window
    first, last = lambda: F.first("total", True).over(W.last(6)), lambda: F.last("total", True).over(W.last(6))
    moving = lambda: (F.col("i") >= 5) & (F.count("total").over(W.last(6)) >= 3)
    rows = windowed(scored, lambda: {"_up": moving() & (last() > first()), "_down": moving() & (last() < first())}, 5).drop("block")
    # Scores that are there make a sequence of their own, in which the last ones are counted.
    rows = placed(rows.where("total IS NOT NULL"), place="_j", number="_all")
    rows = quantiles_before(rows, "total", w, {"_p80": 0.8, "_p60": 0.6, "_p40": 0.4, "_p20": 0.2}, "_past", "_j", "_all")
    t = F.col("total")
    ready = (F.col("n") >= w + 5) & (F.col("_all") >= w) & (F.col("_past") >= w // 2)
    level = (
        F.when((t > F.col("_p80")) & F.col("_up"), "p80")
        .when((t > F.col("_p60")) & (t > 0), "p60")
        .when((t < F.col("_p20")) & F.col("_down"), "p20")
        .when((t < F.col("_p40")) & (t < 0), "p40")
    )
    rows = rows.withColumn("_level", F.when(ready, level))
    level = F.col("_level")
    bound = F.when(level == "p80", F.col("_p80")).when(level == "p60", F.col("_p60")).when(level == "p20", F.col("_p20")).otherwise(F.col("_p40"))
    kind = F.when(level.isin("p80", "p60"), "Buy").otherwise("Sell")
    return _given_out(rows, [_signal(level.isNotNull(), kind, "quantile", bound, level, dominant_category())], 0)


def _reversal(scored: DataFrame) -> DataFrame:
    rows = windowed(scored, lambda: {"_t1": W.delay(F.col("total"), 1), "_t2": W.delay(F.col("total"), 2)}, 2)
    t, p, q = F.col("total"), F.col("_t1"), F.col("_t2")
    ready = (F.col("i") >= 3) & (F.col("n") >= 5)
    up, down = ready & (p <= 0) & (t > 0) & (t > p) & (p > q), ready & (p >= 0) & (t < 0) & (t < p) & (p < q)
    return _given_out(rows, [_signal(up, "Buy", "reversal", p), _signal(down, "Sell", "reversal", p)], 1)


def _divergence(scored: DataFrame, config: SignalConfig) -> DataFrame:
    w = config.divergence_lookback
    columns = lambda: {
        "_ph": F.max("close").over(W.before(w)),
        "_pl": F.min("close").over(W.before(w)),
        "_sh": F.max("total").over(W.before(w)),
        "_sl": F.min("total").over(W.before(w)),
        "_5": F.count("total").over(W.last(5)) == 5,
        "_t4": W.delay(F.col("total"), 4),
    }
    rows = windowed(scored, columns, max(w, 4))
    t, close = F.col("total"), F.col("close")
    ready = (F.col("i") >= w) & (F.col("n") >= w + 5) & F.col("_5")
    top = ready & (close >= F.col("_ph") * 0.995) & (t < F.col("_sh") * 0.9) & (t < F.col("_t4"))
    bottom = ready & (close <= F.col("_pl") * 1.005) & (t > F.col("_sl") * 1.1) & (t > F.col("_t4"))
    return _given_out(rows, [_signal(top, "Sell", "divergence", F.col("_sh")), _signal(bottom, "Buy", "divergence", F.col("_sl"))], 3)


def _given_out(rows: DataFrame, found: list[Column], at: int) -> DataFrame:
    """A row for each signal; _at, from `at` on, is its rule's place among those of a bar."""
    pairs = [F.when(s.isNotNull(), F.struct(F.lit(at + k).alias("_at"), s.alias("s"))) for k, s in enumerate(found)]
    out = rows.select("symbol", "time", F.col("close").alias("price"), "total", F.explode(F.array_compact(F.array(*pairs))).alias("p"))
    return out.select("symbol", "time", "p.s.kind", "price", "p.s.rule", "p.s.level", "p.s.bound", "p.s.category", "total", "p._at")


def quantile_signals(scored: DataFrame, config: SignalConfig = SignalConfig()) -> DataFrame:
    """Signals (symbol, time, kind, price, rule, level, bound, category, total) where the score leaves the quantiles of those before.

    level is p80, p60, p20 or p40, and bound its value: the place int((m - 1) q) of the last
    `quantile_window` scores before, in order; half as many must be there. Bars without a
    score are passed over.
    """
    return _quantile(scored, config).drop("_at")


def reversal_signals(scored: DataFrame) -> DataFrame:
    """Signals where the score crosses 0 after two moves in the same direction; bound is the score before."""
    return _reversal(scored).drop("_at")


def divergence_signals(scored: DataFrame, config: SignalConfig = SignalConfig()) -> DataFrame:
    """Signals where the price is at an extreme of the bars before and the score is not, and has turned for 5 bars."""
    return _divergence(scored, config).drop("_at")


def all_signals(scored: DataFrame, config: SignalConfig = SignalConfig()) -> DataFrame:
    """Signals of the rules that are switched on, with seq, their order by time and then by rule.

    A rule gives a bar each kind once at most. Signals are numbered by spans of time, so
    that no task gets all of a symbol's.
    """
    found = [_quantile(scored, config)] if config.quantile else []
    found += [_reversal(scored)] if config.reversal else []
    found += [_divergence(scored, config)] if config.divergence else []
    rows = reduce(DataFrame.unionByName, found or [_reversal(scored.limit(0))])
    rows = placed(rows, place="_seq", number="_signals", ties=("_at",))
    return rows.withColumn("seq", F.col("_seq") + 1).drop("_at", "_seq", "_signals")


def paired(signals: DataFrame, closes: DataFrame | None = None) -> DataFrame:
    """Adds pnl_pct to each Buy that a later Sell closes, in the order of seq.

    A Sell closes all Buys that are open, at the candle's close of its time (closes:
    symbol, time, close), or else its own price.
    """
    rows = signals
    if closes is not None:
        rows = rows.join(closes.select("symbol", "time", F.col("close").alias("_close")), ["symbol", "time"], "left")
        rows = rows.withColumn("_exit", F.coalesce("_close", "price")).drop("_close")
    else:
        rows = rows.withColumn("_exit", F.col("price"))
    # Backwards in seq, the exit that comes next is a state that each Sell sets anew.
    sell, given = F.col("kind") == "Sell", F.col("_exit").isNotNull()
    back = rows.withColumn("i", -F.col("seq").cast("int")).withColumn("block", F.floor(F.col("i") / blocks.SIZE).cast("int")).repartition("symbol", "block")
    sets = lambda x: (F.when(sell & given, 0.0).otherwise(1.0), F.when(sell & given, x).otherwise(0.0))
    back = affine(back, {"_comes": sets(F.col("_exit")), "_any": sets(F.lit(1.0))})
    pnl = F.when((F.col("kind") == "Buy") & (F.col("_any") > 0), F.try_divide(F.col("_comes") - F.col("price"), F.col("price")) * 100)
    return back.withColumn("pnl_pct", pnl).drop("_exit", "_comes", "_any", "i", "block")


def rolling_z(scored: DataFrame, lookback: int = 60) -> DataFrame:
    """Adds alpha_std and alpha_z of the last `lookback` bars from bar `lookback` on, if a third of them have a score."""
    total = finite_or_null(F.col("total"))
    count = lambda: F.count(total).over(W.last(lookback))
    ready = lambda: (F.col("i") >= lookback) & (count() >= lookback // 3) & (count() > 0)
    columns = lambda: {
        "alpha_std": F.when(ready(), F.greatest(F.stddev_pop(total).over(W.last(lookback)), F.lit(1e-12))),
        "_mean": F.avg(total).over(W.last(lookback)),
    }
    rows = windowed(scored, columns, lookback)
    return rows.withColumn("alpha_z", F.when(total.isNotNull(), (total - F.col("_mean")) / F.col("alpha_std"))).drop("_mean")


def turtle_actions(scored: DataFrame, config: TurtleConfig = TurtleConfig()) -> DataFrame:
    """(symbol, time, action, price, alpha_score, alpha_z, alpha_std, position_pct, units, max_units, level, avg_entry, pnl_pct).

    Entry when the score's z exceeds `entry_z`; Add when the score exceeds that of the last
    entry or add by `add_step` deviations, up to `max_units`; Exit of all when it falls
    `stop` deviations under that of the entry. After each, `cooldown` bars pass before
    the next Entry or Add, bars without a score included; an Exit does not wait. A
    position that is open in the end has no Exit. level is the bound that was crossed.
    """
    acted = positions(rolling_z(scored, config.lookback), Turtle(config)).where("action IS NOT NULL")
    return acted.select(
        "symbol", "time", "action", F.col("close").alias("price"), F.col("total").alias("alpha_score"), F.coalesce("alpha_z", F.lit(0.0)).alias("alpha_z"),
        F.coalesce("alpha_std", F.lit(1e-6)).alias("alpha_std"), "position_pct", "units", F.lit(config.max_units).alias("max_units"), "level", "avg_entry", "pnl_pct",
    )
