"""The factor library, and its evaluation into a composite score."""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FactorConfig
from ..functions import windows as W
from ..functions.guards import clamp, divide, finite, subtract, zero_filled
from ..sources.shared import kept
from . import blocks
from .blocks import in_blocks, whole_groups, windowed

CATEGORIES = ("momentum", "volatility", "volume", "trend")


@dataclass(frozen=True)
class Factor:
    """direction: 1 or -1, or 0 to take the sign of the mean information coefficient.

    value makes the column, from functions of functions.windows; `before` is how many
    bars it looks back.
    """

    name: str
    category: str
    direction: int
    value: Callable[[], Column]
    before: int = 64


def library(documented: bool = False) -> list[Factor]:
    """The twelve built-in factors, over candles with i and n.

    Four are computed otherwise than their descriptions say: ret_20d looks back over 5
    bars, vol_ratio is the mean over the volume, atr_pct and ret_std count the missing
    change of the first bar as 0. `documented` gives them as described.
    """
    close, high, low, volume = (zero_filled(F.col(c)) for c in ("close", "high", "low", "volume"))
    change = lambda: W.delta(close, 1)
    ret = lambda: divide(change(), W.delay(close, 1))
    back = lambda k: divide(W.delta(close, k), W.delay(close, k))
    mean = lambda k: W.rolling_mean(close, k)
    volume5 = lambda: W.rolling_mean(volume, 5)
    high_over_low = F.when(low > 1e-9, F.try_divide(high, low) - 1).otherwise(0.0)
    fill = (lambda x, k: W.full(x, k + 1)) if documented else (lambda x, k: x)
    entries = [
        ("ret_5d", "momentum", 1, lambda: back(5)),
        ("ret_20d", "momentum", 1, lambda: back(20 if documented else 5)),
        ("macd_dif", "momentum", 1, lambda: subtract(mean(12), mean(26))),
        ("ma_disp_20", "momentum", 1, lambda: divide(subtract(close, mean(20)), mean(20))),
        ("atr_pct", "volatility", -1, lambda: divide(fill(W.rolling_mean_of_nulls(F.abs(change()), 14), 14), close)),
        ("bb_width", "volatility", 0, lambda: divide(2 * W.rolling_std(close, 20), mean(20))),
        ("hl_vol", "volatility", -1, lambda: W.rolling_std(high_over_low, 10)),
        ("ret_std", "volatility", -1, lambda: fill(W.rolling_std(zero_filled(ret()), 20), 20)),
        ("vol_ratio", "volume", 0, lambda: divide(volume, volume5()) if documented else divide(volume5(), volume)),
        ("vol_trend", "volume", 1, lambda: divide(subtract(volume5(), W.delay(volume5(), 5)), volume5(), least=1e-9)),
        ("ma_cross", "trend", 1, lambda: subtract(mean(5), mean(20))),
        ("slope_10", "trend", 1, lambda: back(10)),
    ]
    return [Factor(*x, before=26) for x in entries]


def _reach(factors: list[Factor]) -> int:
    return max((f.before for f in factors), default=0)


def factor_frame(candles: DataFrame, factors: list[Factor] | None = None) -> DataFrame:
    """Candles with one column for each factor, by blocks of bars. All share one shuffle and one sort."""
    factors = factors or library()
    return windowed(candles, lambda: {f.name: f.value() for f in factors}, _reach(factors))


def _ahead(config: FactorConfig) -> Column:
    return W.forward_return(F.col("close"), config.forward)


def long_factors(candles: DataFrame, config: FactorConfig, factors: list[Factor] | None = None, keep: tuple[str, ...] = ("symbol", "time", "i", "n")) -> DataFrame:
    """The columns `keep` with factor, x and ahead (the forward return): a row for each bar and factor."""
    factors = factors or library()
    wide = windowed(candles, lambda: {f.name: f.value() for f in factors} | {"ahead": _ahead(config)}, _reach(factors), config.forward)
    return _unpivoted(wide, factors, {"x": ""}, (*keep, "ahead"))


def _unpivoted(wide: DataFrame, factors: list[Factor], columns: dict[str, str], keep: tuple[str, ...]) -> DataFrame:
    """A row for each factor; `columns` gives each value's name and the prefix of its wide columns."""
    pairs = F.array(*[F.struct(F.lit(f.name).alias("factor"), *[F.col(f"{prefix}{f.name}").alias(c) for c, prefix in columns.items()]) for f in factors])
    return wide.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.*")


def _running(op: np.ufunc, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """op over each chunk's values from its begin to each place, and from each place to its end; values: (chunks, places, series)."""
    return op.accumulate(values, axis=1), op.accumulate(values[:, ::-1], axis=1)[:, ::-1]


def rolling_correlation(x: np.ndarray, y: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Pearson's correlation of the w rows before each row, and how many pairs they hold; x (rows, series), y (rows,), missing ones NaN.

    Rows are cut into chunks of w. A frame is the end of one chunk and the begin of the
    next, whose moments about their own chunk's mean are running sums; they are merged by
    the difference of their means. So the work is linear whatever w is, and no sum
    holds a value from outside its frame. 0 where either side does not vary.
    """
    rows, series = x.shape
    chunks = -(-(rows + 1) // w) + 1
    there = np.isfinite(x) & np.isfinite(y)[:, None]

    def cut(values: np.ndarray, missing: float) -> np.ndarray:
        out = np.full((chunks * w, series), missing)
        out[:rows] = np.where(there, values, missing)
        return out.reshape(chunks, w, series)

    # Frame of row t: rows t - w to t - 1, from place s of one chunk to the end, and of the next chunk up to place s - 1.
    t = np.arange(rows)
    first, place = np.divmod(np.maximum(t - w, 0), w)
    after = place > 0

    def both(tail: np.ndarray, head: np.ndarray, nothing: float) -> tuple[np.ndarray, np.ndarray]:
        return tail[first, place], np.where(after[:, None], head[first + 1, np.maximum(place - 1, 0)], nothing)

    def extreme(op: np.ufunc, values: np.ndarray, missing: float) -> np.ndarray:
        head, tail = _running(op, cut(values, missing))
        return op(*both(tail, head, missing))

    wide_y = np.broadcast_to(y[:, None], x.shape)
    n = cut(np.ones_like(x), 0.0)
    held = n.sum(axis=1, keepdims=True)
    with np.errstate(all="ignore"):
        center = [np.where(held > 0, cut(v, 0.0).sum(axis=1, keepdims=True) / held, 0.0) for v in (x, wide_y)]
        dx, dy = ((cut(v, 0.0) - m) * n for v, m in zip((x, wide_y), center))
        moments = [both(*_running(np.add, v)[::-1], 0.0) for v in (n, dx, dy, dx * dx, dy * dy, dx * dy)]
        (na, nb), (xa, xb), (ya, yb), (xxa, xxb), (yya, yyb), (xya, xyb) = moments
        total = na + nb
        one = lambda s, k: np.where(k > 0, s / k, 0.0)
        apart_x = (center[0][first, 0] + one(xa, na)) - (center[0][first + 1, 0] + one(xb, nb))
        apart_y = (center[1][first, 0] + one(ya, na)) - (center[1][first + 1, 0] + one(yb, nb))
        share = one(na * nb, total)
        vx = xxa - one(xa * xa, na) + xxb - one(xb * xb, nb) + share * apart_x**2
        vy = yya - one(ya * ya, na) + yyb - one(yb * yb, nb) + share * apart_y**2
        xy = xya - one(xa * ya, na) + xyb - one(xb * yb, nb) + share * apart_x * apart_y
        flat = (extreme(np.maximum, x, -np.inf) <= extreme(np.minimum, x, np.inf)) | (extreme(np.maximum, wide_y, -np.inf) <= extreme(np.minimum, wide_y, np.inf))
        size = np.sqrt(np.maximum(vx, 0) * np.maximum(vy, 0))
        r = np.where((total < 2) | flat | (size < 1e-15), 0.0, np.clip(xy / size, -1, 1))
    return r, total


def _coefficients(table: pa.Table, begins: np.ndarray, names: list[str], config: FactorConfig, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's rolling coefficients of the columns `names` with `ahead` (NaN: none), group by group, and which rows are in their own block."""
    w = config.window
    column = lambda c: table.column(c).to_numpy().astype(np.float64)
    x, y = np.stack([column(c) for c in names], axis=1), column("ahead")
    i, n, block = (table.column(c).to_numpy() for c in ("i", "n", "block"))
    out = np.full(x.shape, np.nan)
    for s, e in zip(begins, np.r_[begins[1:], table.num_rows]):
        if w and e - s > w:
            r, pairs = rolling_correlation(x[s:e], y[s:e], w)
            inside = (i[s:e] >= w) & (i[s:e] < n[s:e] - config.forward) & (np.arange(e - s) >= w)
            out[s:e] = np.where(inside[:, None] & (pairs >= w // 3), r, np.nan)
    return out, block == i // size


def _with_coefficients(rows: DataFrame, names: list[str], keys: list[str], out_names: list[str], config: FactorConfig, size: int) -> DataFrame:
    """Adds the coefficients of each of `names`; of sorted rows of blocks with `window` rows before, those in their own block stay."""

    def run(batches):
        for table, begins in whole_groups(batches, keys):
            ic, mine = _coefficients(table, begins, names, config, size)
            made = pa.Table.from_arrays([*table.columns, *(pa.array(c, from_pandas=True) for c in ic.T)], names=[*table.column_names, *out_names])
            yield from made.filter(pa.array(mine)).to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, " + ", ".join(f"`{n}` double" for n in out_names))


def wide_ics(candles: DataFrame, config: FactorConfig, factors: list[Factor] | None = None) -> DataFrame:
    """Candles with each factor, `ahead`, and ic_ and each factor's name: all in one pass over blocks of bars."""
    factors = factors or library()
    with W.dealt_by("symbol", "block"):
        made = {f.name: f.value() for f in factors} | {"ahead": _ahead(config)}
    rows = in_blocks(candles.drop("block"), _reach(factors) + config.window, config.forward).withColumns(made)
    rows = rows.sortWithinPartitions("symbol", "block", "i")
    return _with_coefficients(rows, [f.name for f in factors], ["symbol", "block"], [f"ic_{f.name}" for f in factors], config, blocks.SIZE)


def long_ics(candles: DataFrame, config: FactorConfig, factors: list[Factor] | None = None, keep: tuple[str, ...] = ("symbol", "time", "i", "n")) -> DataFrame:
    """rolling_ic() of long_factors(), computed side by side and unpivoted in the end."""
    factors = factors or library()
    return _unpivoted(wide_ics(candles, config, factors), factors, {"x": "", "ic": "ic_"}, (*keep, "ahead"))


def rolling_ic(rows: DataFrame, config: FactorConfig) -> DataFrame:
    """Adds ic: the correlation of factor and forward return over the `window` bars before, for bars with a label after them.

    Null where fewer than a third of the window's pairs are there. The labels of the
    last bars before look ahead over the current one, as they do in the definition. Rows
    are those of long_factors(); a series is worked on by blocks of bars.
    """
    dealt = in_blocks(rows, config.window).sortWithinPartitions("symbol", "block", "factor", "i")
    return _with_coefficients(dealt, ["x"], ["symbol", "block", "factor"], ["ic"], config, blocks.SIZE).drop("block")


def evaluate(ics: DataFrame, config: FactorConfig) -> DataFrame:
    """(symbol, factor, ic_mean, ir, weight, is_valid) from the last `window` coefficients of each factor.

    Fewer than a third of them: all 0 and not valid. Valid: |ir| > 0.3 or |mean| > 0.02;
    the weight is then |mean|. A task passes on no more than its last `window`
    coefficients of a factor. The series itself is left to with_series().
    """
    by_time = Window.partitionBy("symbol", "factor").orderBy(F.desc("time"))
    there = ics.where("ic IS NOT NULL").select("symbol", "factor", "time", "ic")
    last = there.withColumn("_p", F.row_number().over(by_time)).where(F.col("_p") <= config.window)
    by = last.groupBy("symbol", "factor").agg(F.count("ic").alias("c"), F.avg("ic").alias("m"), F.stddev_pop("ic").alias("s"))
    all_ = ics.groupBy("symbol", "factor").agg(F.count("*").alias("_rows"))
    return all_.join(by, ["symbol", "factor"], "left").withColumn("c", F.coalesce("c", F.lit(0))).select("symbol", "factor", *_judged(config))


def with_weights(ics: DataFrame, config: FactorConfig) -> DataFrame:
    """Adds what evaluate() finds for a factor to each of its rows, which are kept in the shared folder, as all later steps read them again."""
    ics = kept(ics)
    return ics.join(evaluate(ics, config), ["symbol", "factor"], "left")


def _judged(config: FactorConfig) -> list[Column]:
    enough = (F.col("c") >= config.window // 3) & (F.col("c") > 0)
    mean = F.when(enough, F.col("m")).otherwise(0.0)
    ir = F.when(enough & (F.col("s") > 1e-9), F.try_divide("m", "s")).otherwise(0.0)
    valid = (F.abs(ir) > 0.3) | (F.abs(mean) > 0.02)
    return [mean.alias("ic_mean"), ir.alias("ir"), valid.alias("is_valid"), F.when(valid, F.abs(mean)).otherwise(0.0).alias("weight")]


def with_series(evals: DataFrame, ics: DataFrame) -> DataFrame:
    """Adds ic_series, each factor's coefficients in the order of time."""
    series = F.transform(F.array_sort(F.collect_list(F.struct("time", "ic"))), lambda x: x["ic"])
    return evals.join(ics.groupBy("symbol", "factor").agg(series.alias("ic_series")), ["symbol", "factor"], "left")


#: Ranks that percentile_approx may be off by, as a share of a series; the bracket around a wanted rank is four times as wide.
OFF = 1e-3

#: Series of fewer values are counted whole: in them one place is more than the brackets' width.
FEW = 2000


def cutoffs(rows: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(symbol, factor, _m, _lo, _hi): how many values a factor has, and those at the places int((m - 1) q) of their order.

    Exact selection without a sort: mergeable sketches bracket both places; one more pass
    counts what lies below the brackets and each distinct value in them; the place is
    then found in these counts, well under a hundredth of the values. A bracket that
    missed its place would be an error, not another value.
    """
    by = ["symbol", "factor"]
    rows = rows.where("x IS NOT NULL").select(*by, "x")
    ends = [min(max(q + d * 4 * OFF, 0.0), 1.0) for q in (low, high) for d in (-1, 1)]
    seen = rows.groupBy(*by).agg(F.count("*").alias("_m"), F.min("x").alias("_least"), F.max("x").alias("_most"), F.percentile_approx("x", ends, int(1 / OFF)).alias("_e"))
    seen = seen.withColumn("_e", F.when(F.col("_m") < FEW, F.array("_least", "_most", "_least", "_most")).otherwise(F.col("_e")))
    x = F.col("x")
    # Both brackets of a value: null if it lies above, 0 below, 1 inside.
    side = lambda k: F.when(x < F.get("_e", F.lit(2 * k)), 0).when(x <= F.get("_e", F.lit(2 * k + 1)), 1)
    sides = F.array(*[F.struct(F.lit(k).alias("q"), side(k).alias("inside")) for k in (0, 1)])
    found = rows.join(seen.select(*by, "_e"), by).select(*by, "x", F.inline(sides)).where("inside IS NOT NULL")
    counts = found.groupBy(*by, "q", F.when(F.col("inside") == 1, x).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by, "q").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    place = F.floor((F.col("_m") - 1) * F.when(F.col("q") == 0, F.lit(low)).otherwise(F.lit(high)))
    at = counts.withColumn("upto", upto).join(seen.select(*by, "_m"), by).where((F.col("upto") > place) & (F.col("upto") - F.col("c") <= place))
    value = lambda k: F.max(F.when(F.col("q") == k, F.col("v")))
    missed = F.raise_error(F.lit("a quantile's bracket missed its place")).cast("double")
    return at.groupBy(*by).agg(F.max("_m").alias("_m"), *[F.coalesce(value(k), missed).alias(n) for k, n in enumerate(("_lo", "_hi"))])


def winsorized(rows: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Adds w: x clamped between the values at places int((m - 1) q) of the factor's m values in order; over the whole series."""
    return _clamped(rows, low, high).drop("_m", "_lo", "_hi")


def _clamped(rows: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    return rows.join(cutoffs(rows, low, high), ["symbol", "factor"], "left").withColumn("w", clamp(F.col("x"), F.col("_lo"), F.col("_hi")))


def normals(rows: DataFrame) -> DataFrame:
    """(symbol, factor, _m, _lo, _hi, _mean, _std): cut-offs, and moments of the values between them; _std is 1e-9 at least."""
    by = ["symbol", "factor"]
    return _clamped(rows).groupBy(*by).agg(
        F.coalesce(F.max("_m"), F.lit(0)).alias("_m"), F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.avg("w").alias("_mean"), F.greatest(F.stddev_pop("w"), F.lit(1e-9)).alias("_std")
    )


def _z(x: Column, direction: Column, ic_mean: Column, stats: Callable[[str], Column]) -> Column:
    turn = F.when(direction != 0, direction.cast("double")).otherwise(F.signum(F.coalesce(ic_mean, F.lit(0.0))))
    w = clamp(x, stats("_lo"), stats("_hi"))
    return F.when(stats("_m") < 2, w).otherwise((w - stats("_mean")) / stats("_std") * turn)


def zscores(rows: DataFrame, factors: list[Factor] | None = None) -> DataFrame:
    """Adds z: winsorised values in population deviations (1e-9 at least) from the mean, turned by the factor's direction.

    Rows hold ic_mean, whose sign turns factors of direction 0. A factor of fewer than two values keeps them as they are.
    """
    direction = F.create_map(*[x for f in factors or library() for x in (F.lit(f.name), F.lit(f.direction))])
    own_direction = F.coalesce(F.try_element_at(direction, F.col("factor")), F.lit(1))
    out = rows.join(normals(rows), ["symbol", "factor"], "left")
    return out.withColumn("z", _z(F.col("x"), own_direction, F.col("ic_mean"), F.col)).drop("_m", "_lo", "_hi", "_mean", "_std")


def contributions(factors: list[Factor] | None = None) -> list[Column]:
    """Sums over a bar's factors of weight times z, for each category and in all; null where none of some weight has a z."""
    category = F.create_map(*[x for f in factors or library() for x in (F.lit(f.name), F.lit(f.category))])
    there = finite(F.col("z")) & (F.coalesce("weight", F.lit(0.0)) != 0)
    mine = F.try_element_at(category, F.col("factor"))
    part = lambda c: F.sum(F.when(there, F.when(mine == c, F.col("weight") * F.col("z")).otherwise(0.0)))
    return [part(c).alias(n) for c, n in zip(CATEGORIES, SCORES)]


#: The columns of CATEGORIES' scores.
SCORES = ("momentum", "volatility", "volume_score", "trend")


def _total() -> Column:
    return F.col("momentum") + F.col("volatility") + F.col("volume_score") + F.col("trend")


def synthesize(scored: DataFrame, factors: list[Factor] | None = None, keep: tuple[str, ...] = ("symbol", "time")) -> DataFrame:
    """One row for each bar, with momentum, volatility, volume_score, trend and total; all null where no factor contributes."""
    return scored.groupBy(*keep).agg(*contributions(factors)).withColumn("total", _total())


def alpha_scores(candles: DataFrame, config: FactorConfig = FactorConfig(), factors: list[Factor] | None = None) -> DataFrame:
    """Candles with momentum, volatility, volume_score, trend and total, null where a bar has no score.

    Factors and coefficients are computed once, by blocks of bars, and kept in the shared
    folder. Weights, cut-offs and moments are aggregates over that table, a row for each
    symbol and factor; a symbol's are joined to its bars as one row, so that the score
    is a projection. The scores are kept too, as all that is made of them reads them more
    than once.
    """
    return evaluation(candles, config, factors)[1]


def evaluation(candles: DataFrame, config: FactorConfig = FactorConfig(), factors: list[Factor] | None = None) -> tuple[DataFrame, DataFrame]:
    """(coefficients, scores): what long_ics() and alpha_scores() give, from factors that are computed once."""
    factors = factors or library()
    wide = kept(wide_ics(candles, config, factors))
    long = _unpivoted(wide, factors, {"x": "", "ic": "ic_"}, ("symbol", "time"))
    known = evaluate(long, config).join(normals(long), ["symbol", "factor"], "left")
    place = F.array_position(F.array(*[F.lit(f.name) for f in factors]), F.col("factor"))
    values = ("weight", "ic_mean", "_m", "_lo", "_hi", "_mean", "_std")
    by_symbol = known.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), *values))).alias("_known"))
    rows = wide.join(by_symbol, "symbol", "left")
    direction = F.array(*[F.lit(f.direction) for f in factors])

    def share(x: Column, at: Column) -> Column:
        """Weight times z of the factor at a place, null where it does not count."""
        stats = F.get("_known", at)
        z = _z(x, F.get(direction, at), stats["ic_mean"], lambda c: stats[c])
        return F.when(finite(z) & (F.coalesce(stats["weight"], F.lit(0.0)) != 0), stats["weight"] * z)

    rows = rows.withColumn("_share", F.transform(F.array(*[F.col(f.name) for f in factors]), share))
    counts = F.exists("_share", lambda x: x.isNotNull())

    def part(category: str) -> Column:
        terms = [F.coalesce(F.get("_share", F.lit(k)), F.lit(0.0)) for k, f in enumerate(factors) if f.category == category]
        return F.when(counts, sum(terms, F.lit(0.0)))

    scored = rows.select(*[c for c in candles.columns if c != "block"], *[part(c).alias(n) for c, n in zip(CATEGORIES, SCORES)])
    return long, kept(scored.withColumn("total", _total()))
