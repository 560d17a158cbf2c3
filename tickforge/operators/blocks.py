"""Series cut into blocks of bars, so that the work on one symbol spreads over tasks.

Bars have a place `i` in their symbol of `n` bars; block i div SIZE is what a task
works on. A window function gets its frame's first bars copied in from the block
before; a recurrence's blocks are composed to maps of its state, whose scan gives each
block the state that it starts from.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W

#: Bars of a block.
SIZE = 4096

#: Seconds whose bars are counted and numbered together: 48 days, some 1,100 hourly bars.
WIDTH = 1 << 22


def placed(bars: DataFrame, width: int = WIDTH, place: str = "i", number: str = "n", ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds `place`, each bar's place from 0 in the order of time (and of `ties`), and `number`, its symbol's number of bars.

    Bars are counted by symbol and span of `width` seconds. The counts alone, a row a
    span, are added up along the symbol; each span's bars are then numbered from what
    lies before it. Of rows with one (symbol, time) one must be left. Rows without a
    symbol make no series and are left out.
    """
    span = F.floor(F.col("time") / width)
    rows = bars.where("symbol IS NOT NULL").withColumn("_span", span)
    along = Window.partitionBy("symbol").orderBy("_span")
    counts = rows.groupBy("symbol", "_span").agg(F.count("*").alias("_count"))
    heads = counts.select(
        "symbol",
        "_span",
        F.coalesce(F.sum("_count").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_count").over(Window.partitionBy("symbol")).alias("_all"),
    )
    # A span's head comes before its bars, so that one exchange brings them together.
    own = Window.partitionBy("symbol", "_span")
    both = rows.unionByName(heads, allowMissingColumns=True)
    nth = F.row_number().over(own.orderBy(F.col("_before").isNull(), "time", *ties))
    numbered = both.withColumns({place: (F.max("_before").over(own) + nth - 2).cast("int"), number: F.max("_all").over(own).cast("int")})
    return numbered.where("_before IS NULL").select(*bars.columns, place, number)


def in_blocks(rows: DataFrame, before: int = 0, after: int = 0, place: str = "i", number: str = "n") -> DataFrame:
    """Adds `block`, and deals rows by symbol and block: each once in its own, and once more where it is one of the `before` rows before or the `after` rows after."""
    i = F.col(place)
    first, last = F.greatest(F.floor((i - after) / SIZE), F.lit(0)), F.least(F.floor((i + before) / SIZE), F.floor((F.col(number) - 1) / SIZE))
    return rows.withColumn("block", F.explode(F.sequence(first.cast("int"), last.cast("int")))).repartition("symbol", "block")


def own(place: str = "i") -> Column:
    """Whether a row of in_blocks() is in its own block."""
    return F.col("block") == F.floor(F.col(place) / SIZE)


def windowed(rows: DataFrame, columns: Callable[[], dict[str, Column]], before: int, after: int = 0, place: str = "i", number: str = "n") -> DataFrame:
    """Adds window columns whose frames reach `before` rows back and `after` rows ahead at most.

    `columns` makes them from the functions of functions.windows, whose windows are by
    block while it runs. The rows keep `block` and lie by it, in the order of time.
    """
    with W.dealt_by("symbol", "block"):
        made = columns()
    return in_blocks(rows.drop("block"), before, after, place, number).withColumns(made).where(own(place))


def blocked(rows: DataFrame) -> DataFrame:
    """Rows with i and block, dealt by symbol and block, whatever of them is there already."""
    if "block" in rows.columns:
        return rows
    return in_blocks(rows if {"i", "n"} <= set(rows.columns) else placed(rows))


def changes(table: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Places at which any of the keys differs from the row before, the first included."""
    new = np.zeros(table.num_rows, bool)
    if table.num_rows:
        new[0] = True
    for k in keys:
        column = table.column(k)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        if not pa.types.is_integer(column.type):
            column = column.dictionary_encode()
            column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).indices
        values = pc.fill_null(column, -1).to_numpy(zero_copy_only=False)
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of sorted rows, and where each group begins; a task holds a batch and one group more."""
    held: list[pa.Table] = []

    def given() -> tuple[pa.Table, np.ndarray]:
        table = pa.concat_tables(held).combine_chunks()
        held.clear()
        return table, changes(table, keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        last = int(changes(table, keys)[-1])
        if last or held and len(changes(pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), table.slice(0, 1)]), keys)) > 1:
            if last:
                held.append(table.slice(0, last))
            yield given()
        held.append(table.slice(last))
    if held:
        yield given()


def compose(a: np.ndarray, b: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maps x -> a x + b of each row after those before it in its group, by doubling; a and b hold a row for each recurrence."""
    a, b = a.copy(), b.copy()
    n = a.shape[1]
    place = np.arange(n) - np.repeat(begins, np.diff(np.r_[begins, n]))
    step, most = 1, int(place.max(initial=0))
    while step <= most:
        on = np.flatnonzero(place >= step)
        b[:, on] += a[:, on] * b[:, on - step]
        a[:, on] *= a[:, on - step]
        step *= 2
    return a, b


def _lists(values: np.ndarray) -> pa.Array:
    """A list of doubles for each column of `values`."""
    width, n = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values.T).ravel()))


def _matrix(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([table.column(c).to_numpy().astype(np.float64) for c in names])


Maps = dict[str, tuple[Column, Column]]


def _coded(rows: DataFrame, maps: Maps) -> tuple[DataFrame, list[str], list[str]]:
    """Rows with the maps as columns of doubles, and these columns' names."""
    a, b = [f"_a{k}" for k in range(len(maps))], [f"_b{k}" for k in range(len(maps))]
    values = zip([*a, *b], [*(x for x, _ in maps.values()), *(y for _, y in maps.values())])
    return rows.withColumns({k: F.coalesce(v.cast("double"), F.lit(float("nan"))) for k, v in values}), a, b


def starts(rows: DataFrame, maps: Maps, name: str = "_start") -> DataFrame:
    """(symbol, block, `name`): the states of affine() before each block, in the order of the maps.

    Each block's maps are composed to one; these, one row a block, stream along the
    symbol, and only the last state is carried.
    """
    coded, a_names, b_names = _coded(rows, maps)
    spread = coded.select("symbol", "block", "i", *a_names, *b_names).sortWithinPartitions("symbol", "block", "i")
    kind = rows.schema["symbol"].dataType.simpleString()

    def summarise(batches):
        for table, begins in whole_groups(batches, ["symbol", "block"]):
            a, b = compose(_matrix(table, a_names), _matrix(table, b_names), begins)
            ends = np.r_[begins[1:], table.num_rows] - 1
            some = table.take(pa.array(ends))
            yield from pa.Table.from_arrays([some.column("symbol"), some.column("block"), _lists(a[:, ends]), _lists(b[:, ends])], names=["symbol", "block", "a", "b"]).to_batches()

    def along(batches):
        symbol, state = object(), None
        for batch in batches:
            a, b = (np.array(batch.column(c).to_pylist(), np.float64).reshape(batch.num_rows, -1) for c in "ab")
            out = np.zeros_like(b)
            for r, s in enumerate(batch.column("symbol").to_pylist()):
                if s != symbol:
                    symbol, state = s, np.zeros(a.shape[1])
                out[r] = state
                state = a[r] * state + b[r]
            yield pa.RecordBatch.from_arrays([batch.column("symbol"), batch.column("block"), _lists(out.T)], names=["symbol", "block", name])

    blocks = spread.mapInArrow(summarise, f"symbol {kind}, block int, a array<double>, b array<double>").repartition("symbol").sortWithinPartitions("symbol", "block")
    return blocks.mapInArrow(along, f"symbol {kind}, block int, {name} array<double>")


def replayed(rows: DataFrame, maps: Maps, name: str = "_start") -> DataFrame:
    """Adds the states of affine() from those before each block, in the column `name`, which goes; where it is null they are 0."""
    coded, a_names, b_names = _coded(rows, maps)
    fields, names = [f for f in rows.schema.fields if f.name != name], list(maps)

    def replay(batches):
        for table, begins in whole_groups(batches, ["symbol", "block"]):
            a, b = compose(_matrix(table, a_names), _matrix(table, b_names), begins)
            given = [x or [0.0] * len(names) for x in table.column(name).take(pa.array(begins)).to_pylist()]
            start = np.array(given, np.float64).reshape(len(begins), -1).T
            state = a * np.repeat(start, np.diff(np.r_[begins, table.num_rows]), axis=1) + b
            yield from pa.Table.from_arrays([*(table.column(f.name) for f in fields), *map(pa.array, state)], names=[*(f.name for f in fields), *names]).to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return coded.mapInArrow(replay, f"{schema}, " + ", ".join(f"`{n}` double" for n in names))


def longer(rows: DataFrame) -> DataFrame:
    """Rows of symbols of more than one block, whose blocks alone have a state before them."""
    return rows.where(F.col("n") > SIZE) if "n" in rows.columns else rows


def affine(rows: DataFrame, maps: Maps) -> DataFrame:
    """Adds states x_i = a_i x_(i-1) + b_i along each symbol, for each name its (a, b); before the first bar x is 0.

    `rows` have i and block, as windowed() leaves them. Blocks are composed to one map
    each, the maps scanned along the symbol, and each block then replays from the state
    that it starts with. No step is a call for a bar, and none but the scan of blocks
    needs a symbol's rows together.
    """
    before = starts(longer(rows), maps)
    return replayed(rows.join(before, ["symbol", "block"], "left").sortWithinPartitions("symbol", "block", "i").select(*rows.columns, "_start"), maps)


def affine_twice(rows: DataFrame, first: Maps, between: dict[str, Column], second: Maps) -> DataFrame:
    """affine() of `first`, columns of its states, and affine() of `second`, which reads these; rows are dealt and sorted once."""
    many = longer(rows)
    before = starts(many, first)
    joined = lambda df, states: df.join(states, ["symbol", "block"], "left")
    again = replayed(joined(many, before).sortWithinPartitions("symbol", "block", "i").select(*rows.columns, "_start"), first).withColumns(between)
    both = before.join(starts(again, second, "_start2"), ["symbol", "block"])
    spread = joined(rows, both).sortWithinPartitions("symbol", "block", "i").select(*rows.columns, "_start", "_start2")
    return replayed(replayed(spread, first).withColumns(between), second, "_start2")
