"""Order statistics of sliding frames of any size."""

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame

from . import blocks
from .blocks import in_blocks, whole_groups


class RangeOrder:
    """Values of which any range can be asked for its k-th smallest, or how many are no larger than a value.

    A wavelet matrix: a row of bits for each bit of the values' ranks, the highest first,
    each stably parted by the one above. An answer follows one range through the rows,
    so many questions are a few array operations a bit, however wide their ranges are.
    """

    def __init__(self, values: np.ndarray):
        self.distinct, rank = np.unique(values, return_inverse=True)
        self.bits = max(1, int(len(self.distinct) - 1).bit_length()) if len(self.distinct) else 1
        self.zeros, self.split = [], []
        for b in range(self.bits - 1, -1, -1):
            zero = (rank >> b & 1) == 0
            self.zeros.append(np.r_[0, np.cumsum(zero)])
            self.split.append(int(zero.sum()))
            rank = np.concatenate([rank[zero], rank[~zero]])

    def kth(self, begin: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest, from 0, of the values at places begin to end - 1, which are more than k."""
        begin, end, k, rank = (np.array(x, np.int64) for x in (begin, end, k, np.zeros(len(begin))))
        for zeros, split in zip(self.zeros, self.split):
            b, e = zeros[begin], zeros[end]
            low = k < e - b
            begin, end = np.where(low, b, split + begin - b), np.where(low, e, split + end - e)
            k, rank = np.where(low, k, k - (e - b)), rank * 2 + ~low
        return self.distinct[rank]

    def no_larger(self, begin: np.ndarray, end: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many values at places begin to end - 1 are no larger than each of `value`."""
        above = np.searchsorted(self.distinct, value, side="right")
        begin, end, out = (np.array(x, np.int64) for x in (begin, end, np.zeros(len(begin))))
        everything = above >= 1 << self.bits
        found = end - begin
        for at, (zeros, split) in enumerate(zip(self.zeros, self.split)):
            one = (above >> (self.bits - 1 - at) & 1) == 1
            b, e = zeros[begin], zeros[end]
            out += np.where(one, e - b, 0)
            begin, end = np.where(one, split + begin - b, b), np.where(one, split + end - e, e)
        return np.where(everything, found, out)


def ordered(rows: DataFrame, value: str, window: int, adds: list[str], give: Callable[[RangeOrder, np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]], current: bool, place: str = "i", number: str = "n") -> DataFrame:
    """Adds doubles (NaN: null) that `give` finds from the order of a frame of `window` values by place, by blocks of bars.

    The frame ends with the current row (`current`) or with the one before. give gets the
    block's values as a RangeOrder, each row's frame as its begin and end, and the values.
    """
    size = blocks.SIZE
    dealt = in_blocks(rows.drop("block"), window, 0, place, number).sortWithinPartitions("symbol", "block", place)

    def run(batches):
        for table, begins in whole_groups(batches, ["symbol", "block"]):
            values = table.column(value).to_numpy().astype(np.float64)
            made = [np.full(len(values), np.nan) for _ in adds]
            for s, e in zip(begins, np.r_[begins[1:], len(values)]):
                end = np.arange(e - s) + current
                for out, part in zip(made, give(RangeOrder(values[s:e]), np.maximum(end - window, 0), end, values[s:e])):
                    out[s:e] = part
            mine = table.column("block").to_numpy() == table.column(place).to_numpy() // size
            out = pa.Table.from_arrays([*table.columns, *(pa.array(x, from_pandas=True) for x in made)], names=[*table.column_names, *adds])
            yield from out.filter(pa.array(mine)).to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    return dealt.mapInArrow(run, f"{fields}, " + ", ".join(f"`{a}` double" for a in adds))


def rolling_place(rows: DataFrame, value: str, window: int, nth: int, add: str) -> DataFrame:
    """Adds the nth smallest (from 0) of the last `window` values; null until they are there."""

    def give(order, begin, end, values):
        out = np.full(len(values), np.nan)
        full = np.flatnonzero(end - begin == window)
        out[full] = order.kth(begin[full], end[full], np.full(len(full), nth))
        return [out]

    return ordered(rows, value, window, [add], give, True)


def rolling_rank(rows: DataFrame, value: str, window: int, add: str) -> DataFrame:
    """Adds the share of the last `window` values that are no larger than the current one; null until they are there."""

    def give(order, begin, end, values):
        share = order.no_larger(begin, end, values) / window
        return [np.where(end - begin == window, share, np.nan)]

    return ordered(rows, value, window, [add], give, True)


def quantiles_before(rows: DataFrame, value: str, window: int, shares: dict[str, float], count: str, place: str, number: str) -> DataFrame:
    """Adds, for each name, the value at place int((m - 1) q) of the m values before in order, of the last `window`; and m as `count`."""

    def give(order, begin, end, values):
        m = end - begin
        some = np.flatnonzero(m > 0)
        out = []
        for q in shares.values():
            part = np.full(len(values), np.nan)
            part[some] = order.kth(begin[some], end[some], np.floor((m[some] - 1) * q).astype(np.int64))
            out.append(part)
        return [*out, m.astype(np.float64)]

    return ordered(rows, value, window, [*shares, count], give, False, place, number)
