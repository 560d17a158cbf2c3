"""Candles and running means from an event stream."""

from collections.abc import Iterator

import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def streamed_candles(events: DataFrame, symbol: Column, ts: str, price: Column, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """One candle for each symbol and window of time, given out once no event `late` or less behind can change it."""
    rows = events.select(symbol.alias("symbol"), F.col(ts).cast("timestamp").alias("ts"), price.cast("double").alias("p")).where("p IS NOT NULL")
    return (
        rows.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(F.min_by("p", "ts").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "ts").alias("close"), F.count("*").cast("double").alias("volume"))
        .select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")
    )


def streamed_ema(candles: DataFrame, period: int = 12) -> DataFrame:
    """(symbol, time, close, ema) for a stream of closes (symbol, time, close): state is a count and a value for each symbol.

    The mean begins with that of the first `period` closes. Bars of a batch are taken in
    the order of time.
    """
    rate = 2.0 / (period + 1)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, value = state.get if state.exists else (0, 0.0)
        for part in parts:
            part = part.sort_values("time")
            out = []
            for close in part["close"]:
                seen += 1
                if seen <= period:
                    value += close / period
                else:
                    value = close * rate + value * (1 - rate)
                out.append(value if seen >= period else None)
            yield pd.DataFrame({"symbol": part["symbol"], "time": part["time"], "close": part["close"], "ema": pd.Series(out, index=part.index, dtype="float64")})
        state.update((seen, value))

    return candles.select("symbol", "time", "close").groupBy("symbol").applyInPandasWithState(
        step, "symbol string, time long, close double, ema double", "seen long, value double", "append", "NoTimeout"
    )
