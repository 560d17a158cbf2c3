"""Joins and totals over candles, signals and actions."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import WIDTH


def merged_history(older: DataFrame, newer: DataFrame, key: tuple[str, ...] = ("symbol", "time")) -> DataFrame:
    """The older rows whose bar is not among the newer ones, and all newer ones."""
    return older.join(newer.select(*key).distinct(), list(key), "left_anti").unionByName(newer)


def merged_series(older: DataFrame, newer: DataFrame, series: list[str], key: tuple[str, ...] = ("symbol", "time")) -> DataFrame:
    """merged_history(), but the columns `series` are the older ones' wherever those have the bar."""
    rows = merged_history(older, newer, key)
    was = older.select(*key, F.lit(True).alias("_was"), *[F.col(c).alias(f"_{c}") for c in series])
    rows = rows.join(was, list(key), "left")
    kept = {c: F.when(F.col("_was"), F.col(f"_{c}")).otherwise(F.col(c)) for c in series}
    return rows.withColumns(kept).drop("_was", *[f"_{c}" for c in series])


def nearest_bar(asked: DataFrame, bars: DataFrame, width: int = WIDTH) -> DataFrame:
    """Adds near, the time of the symbol's bar that is nearest to `at`, the earlier of two; null for a symbol without bars or a null `at`.

    Questions and bars are dealt by symbol and span of `width` seconds. Spans tell each
    other, a row a span, the last bar before and the first bar after them; within a span
    the neighbours of a question are those in its order. So a symbol's bars spread over
    tasks, the work is linear, and there is no join of ranges.
    """
    span = lambda t: F.floor(t / width)
    asked = asked.withColumn("_n", F.monotonically_increasing_id())
    questions = asked.select("symbol", span(F.col("at")).alias("_span"), F.col("at").alias("_t"), F.struct(*asked.columns).alias("_q"))
    there = bars.select("symbol", span(F.col("time")).alias("_span"), F.col("time").alias("_t"), F.col("time").alias("_bar"))
    ends = there.groupBy("symbol", "_span").agg(F.min("_bar").alias("_first"), F.max("_bar").alias("_last"))
    spans = ends.unionByName(questions.select("symbol", "_span").distinct(), allowMissingColumns=True).groupBy("symbol", "_span").agg(F.max("_first").alias("_first"), F.max("_last").alias("_last"))
    along = lambda order: Window.partitionBy("symbol").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    heads = spans.select("symbol", "_span", F.max("_last").over(along("_span")).alias("_before"), F.min("_first").over(along(F.desc("_span"))).alias("_after"))
    rows = there.unionByName(questions, allowMissingColumns=True).unionByName(heads, allowMissingColumns=True)
    own = Window.partitionBy("symbol", "_span")
    asks = F.col("_q").isNotNull()
    upto = lambda *order: F.last("_bar", True).over(own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    was, comes = F.coalesce(upto("_t", asks), F.max("_before").over(own)), F.coalesce(upto(F.desc("_t"), asks.desc()), F.max("_after").over(own))
    rows = rows.withColumns({"_b": was, "_a": comes}).where("_q IS NOT NULL")
    nearer = F.when(F.col("_b").isNull() | (F.col("_a") - F.col("_t") < F.col("_t") - F.col("_b")), F.col("_a")).otherwise(F.col("_b"))
    return rows.select("_q.*", F.when(F.col("_t").isNotNull(), nearer).alias("near")).drop("_n")


def tints(signals: DataFrame) -> DataFrame:
    """(symbol, time, kind): the kind of the last signal of each bar, of those whose tags are in brackets."""
    tagged = signals.where(F.col("tags").startswith("买(") | F.col("tags").startswith("卖("))
    return tagged.groupBy("symbol", "time").agg(F.max_by("kind", "seq").alias("kind"))


def closed_profit(signals: DataFrame) -> DataFrame:
    """(symbol, pnl, closed): the sum of pnl_pct of closed Buys, 0 if there are none, and their number."""
    mine = F.when(F.col("kind") == "Buy", F.col("pnl_pct"))
    return signals.groupBy("symbol").agg(F.coalesce(F.sum(mine), F.lit(0.0)).alias("pnl"), F.count(mine).alias("closed"))


def exits(actions: DataFrame) -> DataFrame:
    """(symbol, exits, win_rate, pnl) of Exit actions; win_rate is null without any."""
    pnl = F.when(F.col("action") == "Exit", F.col("pnl_pct"))
    won = F.when(pnl.isNotNull(), (pnl > 0).cast("double"))
    return actions.groupBy("symbol").agg(F.count_if(F.col("action") == "Exit").alias("exits"), F.avg(won).alias("win_rate"), F.coalesce(F.sum(pnl), F.lit(0.0)).alias("pnl"))


def factor_summary(evals: DataFrame, scored: DataFrame) -> DataFrame:
    """(symbol, valid_factors, last_total): how many factors are valid, and the last score that is there."""
    last = scored.groupBy("symbol").agg(F.max_by("total", F.when(F.col("total").isNotNull(), F.col("time"))).alias("last_total"))
    return evals.groupBy("symbol").agg(F.count_if("is_valid").alias("valid_factors")).join(last, "symbol", "full")


def fixed(x: Column, digits: int) -> Column:
    """A number with that many digits after the point, rounded half to even on its exact binary value."""
    import pandas as pd

    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def text(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if pd.isna(v) else f"{v:.{digits}f}")

    return text(x)


def as_json(bars: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """(symbol, json): each symbol's bars as the array `candles`, and each of `lists` (symbol and any columns) that is not empty.

    For series that fit into one document.
    """

    def gathered(df: DataFrame, name: str) -> DataFrame:
        first = ["seq"] if "seq" in df.columns else ["time"] if "time" in df.columns else []
        row = F.struct(*first, *[c for c in df.columns if c not in ("symbol", *first)])
        return df.groupBy("symbol").agg(F.array_sort(F.collect_list(row)).alias(name))

    out = gathered(bars, "candles")
    for name, df in lists.items():
        out = out.join(gathered(df, name), "symbol", "left")
    return out.select("symbol", F.to_json(F.struct(*[c for c in out.columns if c != "symbol"])).alias("json"))
