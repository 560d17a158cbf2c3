"""Machines that open, add to and close a position, run on blocks of bars apart from each other.

What a machine does in a block depends on the position that it comes with. Every block
is first run from the state without one; the blocks' ends are then followed along the
symbol, a row a block. Where a block is reached in another state than it was run from,
and that state neither passes through it unchanged nor ends alike, it is run again from
that state. As soon as a position is closed within a block, what follows is what was
found before, so few blocks are run again; each round settles one more at least.
"""

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TurtleConfig
from ..sources.shared import kept
from . import blocks
from .blocks import whole_groups

Columns = dict[str, np.ndarray]


class Machine(ABC):
    """A state is an array of doubles, all 0 without a position."""

    reads: list[str]
    adds: dict[str, str]
    width: int

    @abstractmethod
    def run(self, bars: Columns, state: np.ndarray) -> tuple[dict[str, list], np.ndarray]:
        """What the machine does on the bars of a block, a list for each of `adds`, and the state in the end."""

    @abstractmethod
    def summary(self, bars: Columns) -> np.ndarray:
        """What after() must know of a block."""

    @abstractmethod
    def after(self, summary: np.ndarray, first: int, state: np.ndarray, end: np.ndarray) -> np.ndarray | None:
        """The state after a block whose first place is `first`, from `state`; None if it takes a run to know. `end` is that from no position."""


def first_true(holds: Callable[[slice], np.ndarray], begin: int, end: int) -> int | None:
    """The first place from `begin` on that holds, looked for in steps that double."""
    step = 64
    while begin < end:
        upto = min(end, begin + step)
        at = np.flatnonzero(holds(slice(begin, upto)))
        if len(at):
            return begin + int(at[0])
        begin, step = upto, 2 * step
    return None


def following(places: np.ndarray, begin: int) -> int | None:
    """The first of ascending places that is no smaller than `begin`."""
    at = int(np.searchsorted(places, begin))
    return int(places[at]) if at < len(places) else None


@dataclass(frozen=True)
class Turtle(Machine):
    """See signals.turtle_actions(). State: units, score and price at entry, score of the last action, place from which Entry and Add are free."""

    config: TurtleConfig
    reads = ["i", "total", "alpha_z", "alpha_std", "close"]
    adds = {"action": "string", "position_pct": "double", "pnl_pct": "double", "level": "double", "avg_entry": "double", "units": "int"}
    width = 5

    def _prepared(self, bars: Columns):
        total = bars["total"]
        there = np.isfinite(total) & (bars["i"] >= self.config.lookback)
        return total, there, np.nan_to_num(bars["alpha_z"], nan=0.0), np.where(np.isnan(bars["alpha_std"]), 1e-6, bars["alpha_std"])

    def run(self, bars, state):
        c = self.config
        total, there, z, std = self._prepared(bars)
        close, begin, rows, pause = bars["close"], int(bars["i"][0]), len(total), max(c.cooldown, 1)
        out = {k: [None] * rows for k in self.adds}
        units, entry, price, last, free = int(state[0]), *map(float, state[1:])
        entries = np.flatnonzero(there & (z > c.entry_z))
        place, leave = 0, -1  # leave: the place of the next exit, not yet looked for where it is -1

        def note(t, *values):
            for k, v in zip(self.adds, values):
                out[k][t] = v

        while True:
            at = max(place, int(free) - begin)
            if not units:
                t = following(entries, at)
                if t is None:
                    break
                units, entry, price, last, leave = 1, float(total[t]), float(close[t]), float(total[t]), -1
                note(t, "Entry", c.unit_share * 100.0, None, c.entry_z, price, 1)
            else:
                if leave == -1:
                    leave = first_true(lambda s: there[s] & (total[s] < entry - c.stop * std[s]), place, rows)
                add = None
                if units < c.max_units:
                    add = first_true(lambda s: there[s] & (total[s] > last + c.add_step * std[s]), at, rows if leave is None else leave)
                if add is not None:
                    t, level = add, last + c.add_step * float(std[add])
                    price, units, last = (price * units + float(close[t])) / (units + 1), units + 1, float(total[t])
                    note(t, "Add", units * c.unit_share * 100.0, None, level, price, units)
                elif leave is not None:
                    t = leave
                    note(t, "Exit", 0.0, (float(close[t]) - price) / price * 100.0 if price else None, entry - c.stop * float(std[t]), None, 0)
                    units, entry, price, last = 0, 0.0, 0.0, 0.0
                else:
                    break
            place, free = t + 1, begin + t + pause
        return out, np.array([units, entry, price, last, free])

    def summary(self, bars):
        c = self.config
        total, there, z, std = self._prepared(bars)
        low, high = (total + c.stop * std)[there], (total - c.add_step * std)[there]
        entries = bars["i"][there & (z > c.entry_z)]
        return np.array([low.min(initial=np.inf), high.max(initial=-np.inf), entries[0] if len(entries) else np.inf])

    def after(self, summary, first, state, end):
        low, high, entry = summary
        if not state[0]:
            return np.array([*end[:4], max(end[4], state[4])]) if state[4] <= max(entry, first) else None
        apart = 1e-9 * (1 + abs(state[1]) + abs(state[3]))
        stays = low > state[1] + apart and (state[0] >= self.config.max_units or high < state[3] - apart)
        return state if stays else None


@dataclass(frozen=True)
class Squeeze(Machine):
    """See rules.squeeze_trades(). State: whether a position is open, and the highest price of its entries."""

    reads = ["_ready", "_squeezed", "_surge", "_pulled", "_death", "_stop", "close", "bb_middle"]
    adds = {"squeeze_buy": "boolean", "squeeze_sell": "boolean"}
    width = 2

    def _prepared(self, bars: Columns):
        ready, squeezed, surge, pulled, death = (bars[c] == 1 for c in self.reads[:5])
        close, stop = bars["close"], bars["_stop"]
        with np.errstate(invalid="ignore"):
            leaves = ready & (death | (close < bars["bb_middle"]))
        return ready, close, stop, leaves, ready & surge & squeezed, ready & surge & pulled

    def run(self, bars, state):
        ready, close, stop, leaves, enters, repeats = self._prepared(bars)
        enter, repeat, rows = np.flatnonzero(enters), np.flatnonzero(repeats), len(close)
        buy, sell = [False] * rows, [False] * rows
        is_open, highest, place = bool(state[0]), float(state[1]), 0
        while True:
            if not is_open:
                t = following(enter, place)
                if t is None:
                    break
                buy[t], is_open, highest, place = True, True, float(close[t]), t + 1
                continue
            again = following(repeat, place)
            leave = first_true(lambda s: leaves[s] | ready[s] & (close[s] < highest - stop[s]), place, rows if again is None else again + 1)
            if leave is not None:
                sell[leave], is_open, place = True, False, leave
                # The bar may enter anew; if it does not, the search goes on behind it.
            elif again is not None:
                buy[again], highest, place = True, max(highest, float(close[again])), again + 1
            else:
                break
        return {"squeeze_buy": buy, "squeeze_sell": sell}, np.array([is_open, highest if is_open else 0.0])

    def summary(self, bars):
        ready, close, stop, leaves, _, repeats = self._prepared(bars)
        return np.array([leaves.any() or repeats.any(), (close + stop)[ready].min(initial=np.inf)], float)

    def after(self, summary, first, state, end):
        if not state[0]:
            return end
        return state if not summary[0] and summary[1] > state[1] * (1 + 1e-9) + 1e-9 else None


def _bars(table: pa.Table, names: list[str]) -> Columns:
    out = {}
    for c in names:
        column = table.column(c)
        if pa.types.is_boolean(column.type):
            column = column.cast(pa.int8())
        out[c] = column.to_numpy().astype(np.float64)
    return out


def positions(rows: DataFrame, machine: Machine) -> DataFrame:
    """Adds what a machine does to rows with i and block; they are kept in the shared folder, as several rounds read them."""
    size, names = blocks.SIZE, machine.reads
    base = kept(rows)
    kind = rows.schema["symbol"].dataType.simpleString()
    sorted_blocks = lambda df: df.repartition("symbol", "block").sortWithinPartitions("symbol", "block", "i")
    bars = base.select("symbol", "block", *dict.fromkeys(["i", *names]))
    lists = lambda values: pa.array([list(map(float, v)) for v in values], pa.list_(pa.float64()))

    def groups(batches):
        for table, begins in whole_groups(batches, ["symbol", "block"]):
            for s, e in zip(begins, [*begins[1:], table.num_rows]):
                part = table.slice(s, e - s)
                yield part, _bars(part, names)

    def try_out(batches):
        for part, own in groups(batches):
            none = np.zeros(machine.width)
            end = machine.run(own, none)[1]
            yield pa.RecordBatch.from_arrays(
                [part.column("symbol").slice(0, 1).combine_chunks(), part.column("block").slice(0, 1).combine_chunks(), *map(lists, ([none], [end], [end], [machine.summary(own)]))],
                names=["symbol", "block", "start", "end", "free_end", "summary"],
            )

    def run_again(batches):
        for part, own in groups(batches):
            start = np.array(part.column("want")[0].as_py())
            yield pa.RecordBatch.from_arrays(
                [part.column("symbol").slice(0, 1).combine_chunks(), part.column("block").slice(0, 1).combine_chunks(), lists([machine.run(own, start)[1]])], names=["symbol", "block", "new_end"]
            )

    def along(batches):
        symbol, state = object(), None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("symbol", "block", "start", "end", "free_end", "summary")]
            want, again = [], []
            for s, block, start, end, free_end, summary in zip(*columns):
                if s != symbol:
                    symbol, state = s, np.zeros(machine.width)
                want.append(state)
                known = np.array(end) if state.tolist() == start else machine.after(np.array(summary), block * size, state, np.array(free_end))
                again.append(known is None)
                state = np.array(end) if known is None else known
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(want), pa.array(again)], names=[*batch.schema.names, "want", "again"])

    fields = f"symbol {kind}, block int, start array<double>, end array<double>, free_end array<double>, summary array<double>"
    known = sorted_blocks(bars).mapInArrow(try_out, fields)
    while True:
        followed = kept(known.repartition("symbol").sortWithinPartitions("symbol", "block").mapInArrow(along, f"{fields}, want array<double>, again boolean"))
        todo = followed.where("again")
        if todo.isEmpty():
            break
        ends = sorted_blocks(bars.join(todo.select("symbol", "block", "want"), ["symbol", "block"])).mapInArrow(run_again, f"symbol {kind}, block int, new_end array<double>")
        redone = followed.join(ends, ["symbol", "block"], "left")
        new = F.col("again")
        known = redone.select("symbol", "block", F.when(new, F.col("want")).otherwise(F.col("start")).alias("start"), F.when(new, F.col("new_end")).otherwise(F.col("end")).alias("end"), "free_end", "summary")
    kept_names = base.columns

    def act(batches):
        for table, begins in whole_groups(batches, ["symbol", "block"]):
            own = _bars(table, names)
            made: dict[str, list] = {k: [] for k in machine.adds}
            for s, e in zip(begins, [*begins[1:], table.num_rows]):
                done, _ = machine.run({k: v[s:e] for k, v in own.items()}, np.array(table.column("want")[s].as_py()))
                for k, v in done.items():
                    made[k] += v
            kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}
            arrays = [pa.array(made[k], kinds[t]) for k, t in machine.adds.items()]
            yield from pa.Table.from_arrays([*(table.column(c) for c in kept_names), *arrays], names=[*kept_names, *machine.adds]).to_batches()

    out = sorted_blocks(base.join(followed.select("symbol", "block", "want"), ["symbol", "block"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return out.mapInArrow(act, f"{schema}, " + ", ".join(f"{k} {t}" for k, t in machine.adds.items()))
