"""The strategies, each a lazy plan from candles to its outputs."""

from pyspark.sql import DataFrame

from ..config import FactorConfig, SignalConfig, TurtleConfig
from ..operators import factors, indicators, rules, signals
from ..sources.candles import with_places


def strategy(candles: DataFrame, name: str = "default", factor: FactorConfig = FactorConfig(), signal: SignalConfig = SignalConfig(), turtle: TurtleConfig = TurtleConfig()) -> dict[str, DataFrame]:
    """The outputs of a strategy over candles (symbol, time, open, high, low, close, volume), by name.

    All have indicators, regime and rule_signals. `factor` and `hybrid` add evals, scores
    and signals with their profit; `turtle` evals, scores and actions. Factors and scores
    are computed at once and kept in the shared folder; all else runs when it is used.
    """
    bars = with_places(candles)
    indicated = indicators.all_indicators(bars)
    out = {"indicators": indicated, "regime": indicators.regime(indicated), "rule_signals": rules.rule_signals(bars)}
    if name in ("factor", "hybrid", "turtle"):
        rows, out["scores"] = factors.evaluation(bars, factor)
        out["evals"] = factors.with_series(factors.evaluate(rows, factor), rows)
        if name == "turtle":
            out["actions"] = signals.turtle_actions(out["scores"], turtle)
        else:
            out["signals"] = signals.paired(signals.all_signals(out["scores"], signal), bars)
    return out
