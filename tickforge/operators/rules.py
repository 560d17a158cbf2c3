"""Rule events on indicators, their confirmation, and their pairing into trades."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from .blocks import affine, blocked, windowed
from .indicators import all_indicators
from .machines import Squeeze, positions

#: The tags of confirmations, and what they join of.
KDJ_UP, MACD_UP, SUPPORT, KDJ_DOWN, MACD_DOWN, PRESSURE = "kdj↑", "macd↑", "支撑", "kdj↓", "macd↓", "压力"
J_BUY, J_SELL = "KDJ J超卖(买)", "KDJ J超买(卖)"


def _count(*conditions: Column) -> Column:
    """How many conditions hold; a null does not."""
    return sum((F.coalesce(c, F.lit(False)).cast("int") for c in conditions[1:]), F.coalesce(conditions[0], F.lit(False)).cast("int"))


def events(indicated: DataFrame) -> DataFrame:
    """Adds the events of each bar as counts: kdj_buy, kdj_sell, j_buy, j_sell, macd_buy, macd_sell, sr_buy, sr_sell.

    A bar's event may count twice where two of its rules hold. Events of KDJ and MACD need
    the bar before; those of support and pressure the bar's bands, from bar 50 on.
    """
    c = F.col
    k, d, j, dif, dea, bar, close = (c(x) for x in ("k", "d", "j", "dif", "dea", "bar", "close"))
    rows = windowed(indicated, lambda: {f"_{x}": W.delay(c(x), 1) for x in ("k", "d", "j", "dif", "dea", "bar")}, 1)
    pk, pd_, pj, pdif, pdea, pbar = (c(f"_{x}") for x in ("k", "d", "j", "dif", "dea", "bar"))
    near = (c("i") >= 50) & c("bb_lower").isNotNull() & c("kc_lower").isNotNull()
    rows = rows.withColumns(
        {
            "kdj_buy": _count((pk <= pd_) & (k > d), (k < 20) & (k > pk)),
            "kdj_sell": _count((pk >= pd_) & (k < d), (j > 100) & (k < pk)),
            "j_buy": _count((pj < 0) & (j > pj), (pj < -5) & (j > pj)),
            "j_sell": _count((pj > 100) & (j < pj), (pj > 105) & (j < pj)),
            "macd_buy": _count((pdif <= pdea) & (dif > dea) & (dif > -0.02), (pbar <= 0) & (bar > 0)),
            "macd_sell": _count((pdif >= pdea) & (dif < dea) & (dif < 0.02), (pbar >= 0) & (bar < 0)),
            "sr_buy": _count(near & (close <= c("kc_lower") * 1.02), near & (close <= c("bb_lower") * 1.02), near & close.between(c("kc_middle") * 0.99, c("kc_middle") * 1.01)),
            "sr_sell": _count(near & (close >= c("kc_upper") * 0.98), near & (close >= c("bb_upper") * 0.98)),
        }
    )
    return rows.drop("_k", "_d", "_j", "_dif", "_dea", "_bar")


def confirmed(evented: DataFrame, within: int = 3) -> DataFrame:
    """Adds buy_tags and sell_tags, the atoms of what confirms a bar, in order and once each; empty where nothing does.

    An event of one kind is confirmed by one of another in the same bar or the
    `within` - 1 before, never after.
    """
    recent = lambda x: F.max(x).over(W.last(within)) > 0
    rows = windowed(evented, lambda: {f"_{x}": recent(x) for x in ("macd_buy", "macd_sell", "sr_buy", "sr_sell")}, within - 1)

    def tags(side: str, up: str, line: str, level: str) -> Column:
        kdj, macd = F.col(f"kdj_{side}") > 0, F.col(f"macd_{side}") > 0
        pair = lambda cond, a, b: F.when(cond, F.array(F.lit(a), F.lit(b))).otherwise(F.array().cast("array<string>"))
        found = F.array(pair(kdj & F.col(f"_macd_{side}"), up, line), pair(kdj & F.col(f"_sr_{side}"), up, level), pair(macd & F.col(f"_sr_{side}"), line, level))
        return F.array_distinct(F.flatten(found))

    rows = rows.withColumns({"buy_tags": tags("buy", KDJ_UP, MACD_UP, SUPPORT), "sell_tags": tags("sell", KDJ_DOWN, MACD_DOWN, PRESSURE)})
    return rows.drop("_macd_buy", "_macd_sell", "_sr_buy", "_sr_sell")


def _grouped(bars: DataFrame, j_lines: bool) -> DataFrame:
    """One row for each trade (part 0, grp the number of sells before it), and each bar's J events (parts 3 and 4, grp the bar)."""
    sell = (F.size("sell_tags") > 0).cast("double")
    rows = affine(blocked(bars), {"_sells": (F.lit(1.0), sell)})  # sells up to and in this bar
    event = lambda cond, part, grp, side, tags=None, times=None: F.when(
        cond,
        F.struct(
            F.lit(part).alias("part"),
            grp.cast("bigint").alias("grp"),
            F.lit(side).alias("side"),
            (F.array().cast("array<string>") if tags is None else F.col(tags)).alias("tags"),
            (F.lit(1) if times is None else F.col(times)).alias("times"),
        ),
    )
    found = [event(F.size("buy_tags") > 0, 0, F.col("_sells"), "b", "buy_tags"), event(F.size("sell_tags") > 0, 0, F.col("_sells") - 1, "s", "sell_tags")]
    if j_lines:
        found += [event(F.col("j_buy") > 0, 3, F.col("i"), "j", None, "j_buy"), event(F.col("j_sell") > 0, 4, F.col("i"), "j", None, "j_sell")]
    rows = rows.select("symbol", "time", "close", F.explode(F.array_compact(F.array(*found))).alias("e")).select("symbol", "time", "close", "e.*")
    mine = lambda side, x: F.when(F.col("side") == side, F.col(x))
    tags = F.array_sort(F.collect_list(F.when(F.col("side") == "b", F.struct("time", "tags"))))
    return rows.groupBy("symbol", "part", "grp").agg(
        F.min(mine("b", "time")).alias("buy_time"),
        F.avg(mine("b", "close")).alias("entry"),
        F.nullif(F.count(mine("b", "time")), F.lit(0)).alias("buys"),
        F.array_distinct(F.flatten(F.transform(tags, lambda x: x["tags"]))).alias("buy_tags"),
        F.max(mine("s", "time")).alias("sell_time"),
        F.max(mine("s", "close")).alias("exit"),
        F.max(mine("s", "tags")).alias("sell_tags"),
        F.max(mine("j", "time")).alias("j_time"),
        F.max(mine("j", "close")).alias("j_close"),
        F.max(mine("j", "times")).alias("times"),
    ).withColumn("pnl_pct", F.try_divide(F.col("exit") - F.col("entry"), F.col("entry")) * 100)


def trades(confirmed_bars: DataFrame) -> DataFrame:
    """(symbol, grp, buy_time, entry, buys, buy_tags, sell_time, exit, sell_tags, pnl_pct): each sell with the buys it closes.

    A sell closes all buys since the sell before it; in one bar the sell comes first. A
    sell without buys stands alone (entry null), as do the buys after the last sell
    (exit null). Numbers of the running count of sells are the groups, so there is no
    state but a sum.
    """
    return _grouped(confirmed_bars, False).drop("part", "j_time", "j_close", "times")


def rule_signals(candles: DataFrame) -> DataFrame:
    """(symbol, seq, time, kind, price, tags, pnl_pct) of all rules, seq in the order: lone sells, pairs, open buys, J buys, J sells.

    From candles with i and n. tags is the joined tags in brackets, or the J line's text.
    """
    tag = lambda side, column: F.concat(F.lit(f"{side}("), F.array_join(column, " & "), F.lit(")"))
    row = lambda part, sub, time, kind, price, tags, pnl=None: F.struct(
        F.lit(part).alias("part"),
        F.lit(sub).alias("sub"),
        F.col(time).alias("time"),
        F.lit(kind).alias("kind"),
        F.col(price).alias("price"),
        tags.alias("tags"),
        (F.lit(None).cast("double") if pnl is None else F.col(pnl)).alias("pnl_pct"),
    )
    bought, sold = tag("买", "buy_tags"), tag("卖", "sell_tags")
    lone = F.array(row(0, 0, "sell_time", "Sell", "exit", sold))
    pair = F.array(row(1, 0, "buy_time", "Buy", "entry", bought, "pnl_pct"), row(1, 1, "sell_time", "Sell", "exit", sold))
    held = F.array(row(2, 0, "buy_time", "Buy", "entry", bought))
    j_line = lambda part, kind, text: F.array_repeat(row(part, 0, "j_time", kind, "j_close", F.lit(text)), F.col("times"))
    rows = (
        F.when(F.col("part") == 3, j_line(3, "Buy", J_BUY))
        .when(F.col("part") == 4, j_line(4, "Sell", J_SELL))
        .when(F.col("buy_time").isNull(), lone)
        .when(F.col("sell_time").isNull(), held)
        .otherwise(pair)
    )
    grouped = _grouped(confirmed(events(all_indicators(candles))), True)
    out = grouped.select("symbol", "grp", F.explode(rows).alias("r"))
    seq = F.row_number().over(Window.partitionBy("symbol").orderBy("r.part", "grp", "r.sub"))
    return out.select("symbol", seq.alias("seq"), "r.time", "r.kind", "r.price", "r.tags", "r.pnl_pct")


def squeeze_trades(indicated: DataFrame) -> DataFrame:
    """Adds squeeze_buy, squeeze_sell: entries on a breakout from narrow bands on high volume, re-entries, and exits.

    From bar 50 on. Entry: close over the upper band, volume over twice its 5-bar mean
    and over its upper quartile, and a bandwidth under 0.85 of its 20-bar mean; while
    holding, further entries need a close within the bands in the last 5 bars. Exit of
    all: close under the middle, or 1.5 average true ranges under the highest entry, or
    a death cross of KDJ or MACD. A bar may exit and enter again.
    """
    bw = F.try_divide(F.col("bb_upper") - F.col("bb_lower"), F.col("bb_middle"))
    rows = indicated.withColumn("_bw", bw)
    lag = lambda x: W.delay(F.col(x), 1)
    falls = lambda x, y: F.coalesce((lag(x) >= lag(y)) & (F.col(x) < F.col(y)), F.lit(False))
    columns = lambda: {
        "_ready": (F.col("i") >= 50) & F.col("bb_upper").isNotNull() & F.col("kc_upper").isNotNull(),
        "_squeezed": F.col("_bw") < 0.85 * F.sum("_bw").over(W.last(20)) / 20,
        "_surge": (F.col("close") > F.col("bb_upper")) & (F.col("volume") > 2 * W.volume_mean()) & (F.col("volume") > W.volume_upper_quartile()),
        "_pulled": F.max((F.col("close") <= F.col("bb_upper")).cast("int")).over(W.last(5)) == 1,
        "_death": falls("k", "d") | falls("dif", "dea"),
        "_stop": 1.5 * (F.col("kc_upper") - F.col("kc_middle")) / 2,
    }
    return positions(windowed(rows, columns, 20), Squeeze()).drop("_bw", *Squeeze.reads[:6])
