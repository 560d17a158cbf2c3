"""Positions and fetches of a stream, by state that outlives batches and restarts."""

from collections.abc import Iterator

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import TurtleConfig
from ..operators.machines import Turtle
from ..sources.candles import time_to_live

ACTIONS = "symbol string, time long, action string, price double, alpha_score double, alpha_z double, units int, position_pct double, avg_entry double, pnl_pct double"


def rolling_z(totals: np.ndarray, places: np.ndarray, lookback: int) -> tuple[np.ndarray, np.ndarray]:
    """(z, deviation) of the bars at `places`, whose totals follow `lookback` - 1 earlier ones; see signals.rolling_z()."""
    finite = np.isfinite(totals)
    windows = np.lib.stride_tricks.sliding_window_view(np.where(finite, totals, 0.0), lookback)
    there = np.lib.stride_tricks.sliding_window_view(finite, lookback)
    count = there.sum(1)
    mean = windows.sum(1) / np.maximum(count, 1)
    apart = np.where(there, windows - mean[:, None], 0.0)
    ready = (places >= lookback) & (count >= lookback // 3) & (count > 0)
    std = np.where(ready, np.maximum(np.sqrt((apart**2).sum(1) / np.maximum(count, 1)), 1e-12), np.nan)
    own = totals[lookback - 1 :]
    return np.where(np.isfinite(own), (own - mean) / std, np.nan), std


class TurtleStream(StatefulProcessor):
    """Bars wait until the watermark has passed them, and are then taken in the order of time.

    State of a symbol: the bars that wait, with a timer at the first one's time; how many
    were taken, the machine's position, and the last totals, which frames reach back to.
    """

    def __init__(self, config: TurtleConfig):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "time long, close double, total double")
        self.machine = handle.getValueState("machine", "taken long, position array<double>, totals array<double>")

    def _wake_at(self, time: int) -> None:
        """One timer is enough: it takes all bars that the watermark has passed by then."""
        timers = list(self.handle.listTimers())
        if not timers or time * 1000 < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(time * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            bars = list(zip(part["time"].tolist(), part["close"].tolist(), part["total"].tolist()))
            self.waiting.appendList(bars)
            first = min(b[0] for b in bars) if first is None else min(first, *(b[0] for b in bars))
        if first is not None:
            self._wake_at(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs() // 1000
        waiting = {b[0]: tuple(b) for b in self.waiting.get()}
        bars = sorted(b for t, b in waiting.items() if t <= reached)
        rest = [b for t, b in waiting.items() if t > reached]
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(b[0] for b in rest) * 1000)
        if not bars:
            return
        config, turtle = self.config, Turtle(self.config)
        back = config.lookback - 1
        taken, position, totals = self.machine.get() if self.machine.exists() else (0, [0.0] * turtle.width, [np.nan] * back)
        time, close, total = map(np.array, zip(*bars))
        places = np.arange(taken, taken + len(time))
        all_totals = np.r_[np.array(totals, float), total.astype(float)]
        z, std = rolling_z(all_totals, places, config.lookback)
        done, position = turtle.run({"i": places.astype(float), "total": total.astype(float), "alpha_z": z, "alpha_std": std, "close": close.astype(float)}, np.array(position, float))
        self.machine.update((int(taken + len(time)), position.tolist(), all_totals[len(all_totals) - back :].tolist()))
        out = pd.DataFrame({"symbol": key[0], "time": time, **{k: done[k] for k in ("action", "units", "position_pct", "avg_entry", "pnl_pct")}, "price": close, "alpha_score": total, "alpha_z": np.nan_to_num(z, nan=0.0)})
        out = out[out["action"].notna()]
        if len(out):
            yield out[[c.split()[0] for c in ACTIONS.split(", ")]].astype({"units": "int32"})


def streamed_turtle(scored: DataFrame, config: TurtleConfig = TurtleConfig(), late: str = "0 seconds") -> DataFrame:
    """The actions of signals.turtle_actions() for a stream of scored bars (symbol, time in seconds, close, total).

    A bar counts once no bar `late` or less behind can come before it; of repeated times
    the last counts that arrives until then. Bars without a symbol, a time or a close are left out.
    The session's state must be kept by RocksDB.
    """
    rows = scored.select("symbol", "time", F.col("close").cast("double").alias("close"), F.coalesce(F.col("total").cast("double"), F.lit(float("nan"))).alias("total"))
    rows = rows.dropna(subset=["symbol", "time", "close"]).withColumn("at", F.timestamp_seconds("time")).withWatermark("at", late)
    return rows.groupBy("symbol").transformWithStateInPandas(TurtleStream(config), ACTIONS, "Append", "EventTime")


class Fetches(StatefulProcessor):
    """State of a symbol: when it was fetched last. It is let go after the longest time for which a copy can be fresh."""

    def __init__(self, let_go_ms: int):
        self.let_go_ms = let_go_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fetched = handle.getValueState("fetched", "at long", ttlDurationMs=self.let_go_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values("asked_at", kind="stable")
        before = last = self.fetched.get()[0] if self.fetched.exists() else None
        fetch = []
        for at, live in zip(asked["asked_at"].tolist(), asked["ttl"].tolist()):
            fetch.append(last is None or at - last > live)
            if fetch[-1]:
                last = at
        if last != before:
            self.fetched.update((last,))
        yield pd.DataFrame({"symbol": key[0], "asked_at": asked["asked_at"], "fetch": fetch})


def streamed_fetches(requests: DataFrame, let_go_ms: int = 2 * 3600 * 1000) -> DataFrame:
    """(symbol, asked_at, fetch) for a stream of requests (symbol, asked_at in seconds): whether the copy that the last fetch left has outlived its time by then.

    How long a copy lives is sources.candles.time_to_live() of the moment of the request.
    A symbol's state is let go when it was not fetched for `let_go_ms` of the machine's
    clock, so requests that are replayed later than that apart may be fetched once more.
    Requests of a batch are taken in the order of time; those without a symbol or a time are left out.
    Spark runs batches without rows for as long as state may be let go: where a stream
    must end by itself, spark.sql.streaming.noDataMicroBatches.enabled is to be false.
    """
    rows = requests.select("symbol", F.col("asked_at").cast("long").alias("asked_at")).dropna()
    rows = rows.withColumn("ttl", time_to_live(F.col("asked_at")))
    return rows.groupBy("symbol").transformWithStateInPandas(Fetches(let_go_ms), "symbol string, asked_at long, fetch boolean", "Append", "ProcessingTime")
