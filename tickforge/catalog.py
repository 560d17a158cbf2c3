"""The registered queries of the market engine, with the SQL that DuckDB answers them by.

Candles are the hourly ones of `events`, one symbol for each event type, unless a query
says otherwise. Doubles are rounded to six places on both sides.
"""

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import FactorConfig
from .functions import guards as G
from .functions import windows as W
from .operators import factors, indicators, orders, rules, signals, tables
from .operators.blocks import windowed
from .oracles import FACTORS, composed
from .plans.strategies import strategy
from .sources import candles as S
from .sources import instruments as I
from .sources.shared import shared_folder
from .sources.store import CandleStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CONFIG = FactorConfig()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_places(S.hourly_candles(table(spark, sf_dir, "events")))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def register(name: str, build: Callable[[DataFrame], DataFrame], columns: str, sql: str | None, digits: int = 6, source: Query = hourly) -> None:
    """A query over candles: the columns of build(source), and its SQL, whose doubles carry a trailing ~."""
    names = [c.rstrip("~") for c in columns.split()]
    QUERIES[name] = lambda spark, sf_dir: rounded(build(source(spark, sf_dir)).select(*names), digits)
    if sql is not None:
        chosen = ", ".join(f"round({c[:-1]}, {digits}) AS {c[:-1]}" if c.endswith("~") else c for c in columns.split())
        SQL[name] = composed(f"SELECT {chosen} FROM ({sql})")


same = lambda df: df
OHLCV = "symbol time open~ high~ low~ close~ volume~"

# Candles
register("candles_hourly", same, OHLCV, "SELECT * FROM hourly", source=lambda s, d: S.hourly_candles(table(s, d, "events")))
register("candles_daily", same, OHLCV, "SELECT * FROM daily", 4, lambda s, d: S.daily_candles(table(s, d, "orders")))
register("candles_tail", lambda c: S.tail(c, 180), OHLCV, "SELECT * FROM hourly QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) <= 180")

# Rolling functions
_close = lambda: F.col("close")
_W = "WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 9 PRECEDING), b AS (PARTITION BY symbol ORDER BY i)"


def _rolling(name: str, column: Callable[[], Column], sql: str) -> None:
    _adding(name, lambda c: windowed(c, lambda: {"v": column()}, 20, 5), sql)


def _adding(name: str, build: Callable[[DataFrame], DataFrame], sql: str) -> None:
    register(name, build, "symbol time v~", f"SELECT symbol, time, {sql} AS v FROM c {_W}")


_rolling("rolling_mean", lambda: W.rolling_mean(_close(), 10), "CASE WHEN i >= 9 THEN avg(close) OVER w END")
_rolling("rolling_std", lambda: W.rolling_std(_close(), 10), "CASE WHEN i >= 9 THEN stddev_pop(close) OVER w END")
_rolling("rolling_max", lambda: W.rolling_max(_close(), 10), "CASE WHEN i >= 9 THEN max(close) OVER w END")
_rolling("rolling_min", lambda: W.rolling_min(_close(), 10), "CASE WHEN i >= 9 THEN min(close) OVER w END")
_rolling("rolling_mean_of_nulls", lambda: W.rolling_mean_of_nulls(F.when(_close() > 50, _close()), 10), "CASE WHEN i >= 9 THEN avg(CASE WHEN close > 50 THEN close ELSE 0 END) OVER w END")
_rolling("delta", lambda: W.delta(_close(), 5), "close - lag(close, 5) OVER b")
_rolling("delay", lambda: W.delay(_close(), 5), "lag(close, 5) OVER b")
_rolling("forward_return", lambda: W.forward_return(_close(), 5), "CASE WHEN close > 1e-12 THEN (lead(close, 5) OVER b - close) / close END")
_rolling("true_range", lambda: W.true_range(F.col("high"), F.col("low"), _close()), "CASE WHEN i >= 1 THEN greatest(abs(high - low), abs(high - lag(close) OVER b), abs(low - lag(close) OVER b)) END")
_rolling("volume_mean", lambda: W.volume_mean(), "CASE WHEN i >= 4 THEN avg(volume) OVER (PARTITION BY symbol ORDER BY i ROWS 4 PRECEDING) ELSE 0 END")
_adding("volume_upper_quartile", lambda c: orders.rolling_place(c, "volume", 20, 14, "v").withColumn("v", F.coalesce("v", F.lit(0.0))), "CASE WHEN i >= 19 THEN list_sort(list(volume) OVER (PARTITION BY symbol ORDER BY i ROWS 19 PRECEDING))[15] ELSE 0 END")
_adding("ts_rank", lambda c: orders.rolling_rank(c, "close", 10, "v"), "CASE WHEN i >= 9 THEN len(list_filter(list(close) OVER w, lambda v: v <= close)) / 10::DOUBLE END")
_adding("log_of_volume", lambda c: c.withColumn("v", W.log(F.col("volume") - 1)), "CASE WHEN volume > 1 THEN ln(volume - 1) END")
_adding("cross_rank", lambda c: c.withColumn("v", W.rank(_close())), "percent_rank() OVER (PARTITION BY time ORDER BY close)")
_adding("cross_scale", lambda c: c.withColumn("v", W.scale(_close())), "CASE WHEN sum(abs(close)) OVER (PARTITION BY time) > 1e-12 THEN close / sum(abs(close)) OVER (PARTITION BY time) END")
register(
    "ts_corr",
    lambda c: windowed(c, lambda: {"v": W.ts_corr(_close(), F.col("volume"), 10)}, 20),
    "symbol time v~",
    """SELECT symbol, time, CASE WHEN i >= 9 THEN CASE WHEN flat OR sqrt(greatest(xx - x * x / 10, 0) * greatest(yy - y * y / 10, 0)) < 1e-15 THEN 0
         ELSE least(greatest((xy - x * y / 10) / sqrt(greatest(xx - x * x / 10, 0) * greatest(yy - y * y / 10, 0)), -1), 1) END END AS v
       FROM (SELECT symbol, time, i, sum(u) OVER w AS x, sum(v) OVER w AS y, sum(u * u) OVER w AS xx, sum(v * v) OVER w AS yy, sum(u * v) OVER w AS xy,
           max(u) OVER w <= min(u) OVER w OR max(v) OVER w <= min(v) OVER w AS flat
         FROM (SELECT *, close - avg(close) OVER (PARTITION BY symbol) AS u, volume - avg(volume) OVER (PARTITION BY symbol) AS v FROM c) WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 9 PRECEDING))""",
)
register(
    "guarded_arithmetic",
    lambda c: c.withColumns(
        {
            "quotient": G.divide(_close(), F.col("volume") - 1),
            "difference": G.subtract(F.col("high"), F.when(F.col("volume") > 1, F.col("low"))),
            "clamped": G.clamp(_close(), F.lit(20.0), F.lit(80.0)),
            "size": F.abs(F.col("open") - _close()),
            "sign": F.signum(F.col("open") - _close()),
            "rose": F.when(_close() >= F.col("open"), "up").otherwise("down"),
        }
    ),
    "symbol time quotient~ difference~ clamped~ size~ sign~ rose",
    """SELECT symbol, time, CASE WHEN abs(volume - 1) > 1e-12 THEN close / (volume - 1) END AS quotient, high - CASE WHEN volume > 1 THEN low END AS difference,
         least(greatest(close, 20), 80) AS clamped, abs(open - close) AS size, sign(open - close)::DOUBLE AS sign, CASE WHEN close >= open THEN 'up' ELSE 'down' END AS rose FROM c""",
)

# Indicators
register("bollinger", indicators.bollinger, "symbol time bb_upper~ bb_middle~ bb_lower~", "SELECT * FROM bb")
register("keltner", indicators.keltner, "symbol time kc_upper~ kc_middle~ kc_lower~", "SELECT * FROM kc")
register("macd", indicators.macd, "symbol time dif~ dea~ bar~", "SELECT * FROM md")
register("kdj", indicators.kdj, "symbol time k~ d~ j~", "SELECT * FROM kdj")
register("adx", indicators.adx, "symbol time adx~ plus_di~ minus_di~", "SELECT * FROM ad")
register("rsi", indicators.rsi, "symbol time rsi~", "SELECT * FROM rs")
register("regime", lambda c: indicators.regime(indicators.all_indicators(c)), "symbol regime", "SELECT * FROM regimes")


# Rules
def _events(c: DataFrame) -> DataFrame:
    return rules.events(indicators.all_indicators(c))


register("kdj_events", _events, "symbol time kdj_buy kdj_sell j_buy j_sell", "SELECT * FROM ev")
register("macd_events", _events, "symbol time macd_buy macd_sell", "SELECT * FROM ev")
register("sr_events", _events, "symbol time sr_buy sr_sell", "SELECT * FROM ev")
register(
    "rules_confirmed",
    lambda c: rules.confirmed(_events(c)).select("symbol", "time", F.array_join("buy_tags", " & ").alias("buys"), F.array_join("sell_tags", " & ").alias("sells")),
    "symbol time buys sells",
    "SELECT symbol, time, array_to_string(buy_tags, ' & ') AS buys, array_to_string(sell_tags, ' & ') AS sells FROM cf",
)
register("rule_trades", lambda c: rules.trades(rules.confirmed(_events(c))), "symbol grp buy_time entry~ buys sell_time exit~ pnl_pct~", "SELECT symbol, grp::BIGINT AS grp, buy_time, entry, buys, sell_time, exit, pnl_pct FROM trade_rows")
register("rule_signals", rules.rule_signals, "symbol seq time kind price~ tags pnl_pct~", "SELECT * FROM rule_out")
register("squeeze_trades", lambda c: rules.squeeze_trades(indicators.all_indicators(c)), "symbol time squeeze_buy squeeze_sell", "SELECT * FROM sqz")

# Factors
for _f in FACTORS:
    register(f"factor_{_f}", factors.factor_frame, f"symbol time {_f}~", f"SELECT symbol, time, {_f} FROM f")
register("factor_frame", factors.factor_frame, "symbol time " + " ".join(f"{f}~" for f in FACTORS), "SELECT * FROM f")
register(
    "factor_described",
    lambda c: factors.factor_frame(c, factors.library(documented=True)),
    "symbol time ret_20d~ vol_ratio~ atr_pct~ ret_std~",
    """SELECT symbol, time, CASE WHEN abs(c20) > 1e-12 THEN (close - c20) / c20 END AS ret_20d, CASE WHEN abs(v5) > 1e-12 THEN volume / v5 END AS vol_ratio,
         CASE WHEN i >= 14 AND abs(close) > 1e-12 THEN avg(abs(close - c1)) OVER (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING) / close END AS atr_pct,
         CASE WHEN i >= 20 THEN stddev_pop(r1) OVER (PARTITION BY symbol ORDER BY i ROWS 19 PRECEDING) END AS ret_std FROM f1""",
)


def _ic(c: DataFrame) -> DataFrame:
    return factors.long_ics(c, CONFIG)


register("rolling_ic", _ic, "symbol factor time ic~", "SELECT * FROM ic")
register("factor_eval", lambda c: factors.evaluate(_ic(c), CONFIG), "symbol factor ic_mean~ ir~ weight~ is_valid", "SELECT * FROM fe")
register("winsorized", lambda c: factors.winsorized(factors.long_factors(c, CONFIG)), "symbol factor time w~", "SELECT * FROM wz")
register("zscores", lambda c: factors.zscores(factors.with_weights(_ic(c), CONFIG)), "symbol factor time z~", "SELECT * FROM zs")
_SCORES = "symbol time momentum~ volatility~ volume_score~ trend~ total~"
register("alpha_scores", factors.alpha_scores, _SCORES, "SELECT * FROM sc")

# Signals and positions
_SIGNAL = "symbol time kind price~ rule level bound~ category total~"
_scored = lambda f: lambda c: f(factors.alpha_scores(c))
register("sig_quantile", _scored(signals.quantile_signals), _SIGNAL, "SELECT * FROM qs")
register("sig_reversal", _scored(signals.reversal_signals), _SIGNAL, "SELECT * FROM rv")
register("sig_divergence", _scored(signals.divergence_signals), _SIGNAL, "SELECT * FROM dv")
register("sig_all", _scored(signals.all_signals), _SIGNAL + " seq", "SELECT * FROM sg")


def _paired(c: DataFrame) -> DataFrame:
    return signals.paired(signals.all_signals(factors.alpha_scores(c)))


register("sig_paired", _paired, "symbol seq time kind price~ pnl_pct~", "SELECT * FROM pr")
register("alpha_rolling_z", _scored(signals.rolling_z), "symbol time alpha_std~ alpha_z~", "SELECT * FROM zr")
_ACTION = "symbol time action price~ alpha_score~ alpha_z~ alpha_std~ position_pct~ units max_units level~ avg_entry~ pnl_pct~"
register("turtle_actions", _scored(signals.turtle_actions), _ACTION, "SELECT * FROM ta")

# Totals and joins
register("summary_rules", lambda c: tables.closed_profit(rules.rule_signals(c)), "symbol pnl~ closed", "SELECT symbol, coalesce(sum(pnl_pct) FILTER (kind = 'Buy'), 0) AS pnl, count(pnl_pct) FILTER (kind = 'Buy') AS closed FROM rule_out GROUP BY symbol")
register("summary_signals", lambda c: tables.closed_profit(_paired(c)), "symbol pnl~ closed", "SELECT symbol, coalesce(sum(pnl_pct), 0) AS pnl, count(pnl_pct) AS closed FROM pr GROUP BY symbol", 5)
register("summary_turtle", lambda c: tables.exits(_scored(signals.turtle_actions)(c)), "symbol exits win_rate~ pnl~", "SELECT symbol, count(*) FILTER (action = 'Exit') AS exits, avg((pnl_pct > 0)::INTEGER) FILTER (pnl_pct IS NOT NULL) AS win_rate, coalesce(sum(pnl_pct), 0) AS pnl FROM ta GROUP BY symbol")


def _factor_summary(c: DataFrame) -> DataFrame:
    rows = _ic(c)
    return tables.factor_summary(factors.evaluate(rows, CONFIG), factors.alpha_scores(c))


register("summary_factors", _factor_summary, "symbol valid_factors last_total~", "SELECT symbol, valid_factors, last_total FROM (SELECT symbol, count(*) FILTER (is_valid) AS valid_factors FROM fe GROUP BY symbol) JOIN (SELECT symbol, arg_max(total, i) FILTER (total IS NOT NULL) AS last_total FROM sc GROUP BY symbol) USING (symbol)")
register("tint_map", lambda c: tables.tints(rules.rule_signals(c)), "symbol time kind", "SELECT symbol, time, arg_max(kind, seq) AS kind FROM rule_out WHERE starts_with(tags, '买(') OR starts_with(tags, '卖(') GROUP BY symbol, time")
register(
    "history_merge",
    lambda c: tables.merged_history(c.where("i < 200"), c.where("i >= 100").withColumn("close", -F.col("close"))),
    "symbol time close~",
    "SELECT symbol, time, CASE WHEN i >= 100 THEN -close ELSE close END AS close FROM c",
)
register(
    "nearest_bar",
    lambda c: tables.nearest_bar(c.select("symbol", (F.col("time") + 5000).alias("at")), c).withColumnRenamed("at", "asked"),
    "symbol asked near",
    """SELECT q.symbol, q.asked, arg_min(b.time, (abs(b.time - q.asked), b.time)) AS near FROM (SELECT symbol, time + 5000 AS asked FROM c) q
       JOIN c b ON b.symbol = q.symbol GROUP BY q.symbol, q.asked""",
)
register(
    "price_at_signal",
    lambda c: rules.rule_signals(c).join(c.select("symbol", "time", "close"), ["symbol", "time"], "left"),
    "symbol seq time kind close~",
    "SELECT r.symbol, r.seq, r.time, r.kind, c.close FROM rule_out r LEFT JOIN c ON c.symbol = r.symbol AND c.time = r.time",
)


def _bundle(c: DataFrame) -> DataFrame:
    """The whole documents, read back: a row for each element of each list."""
    read = "candles array<struct<time: bigint, close: double>>, signals array<struct<seq: int, time: bigint, kind: string, price: double>>"
    made = tables.as_json(c.select("symbol", "time", "close"), {"signals": rules.rule_signals(c)}).select("symbol", F.from_json("json", read).alias("d"))
    candle = made.select("symbol", F.lit("candles").alias("list"), F.posexplode("d.candles").alias("place", "x")).select("symbol", "list", "place", "x.time", F.lit(None).cast("string").alias("kind"), F.col("x.close").alias("value"))
    signal = made.select("symbol", F.lit("signals").alias("list"), F.posexplode("d.signals").alias("place", "x")).select("symbol", "list", "place", "x.time", "x.kind", F.col("x.price").alias("value"))
    return candle.union(signal)


register(
    "json_bundle",
    _bundle,
    "symbol list place time kind value~",
    "SELECT symbol, 'candles' AS list, i AS place, time, NULL::VARCHAR AS kind, close AS value FROM c UNION ALL SELECT symbol, 'signals', seq - 1, time, kind, price FROM rule_out",
)


def _cache_through(c: DataFrame) -> DataFrame:
    """Stored are the bars up to place 300; symbols whose last event is younger than the time to live count as fresh."""
    now = F.lit(1704270600)
    meta = c.groupBy("symbol").agg(F.max("time").alias("fetched_at"), F.count("*").alias("day_count"))
    return S.cached_or_fetched(c.where("i <= 300").drop("i", "n"), meta.withColumn("fetched_at", F.when(F.length("symbol") > 5, now - 60).otherwise(F.lit(0))), c.drop("i", "n"), now, 100)


register(
    "cache_through",
    _cache_through,
    "symbol time close~",
    """SELECT symbol, time, close FROM c WHERE CASE WHEN length(symbol) > 5 AND n >= 100 THEN i <= 300 AND i > least(n - 1, 300) - 100 ELSE true END""",
)


def _store(c: DataFrame) -> CandleStore:
    """A store of its own in the shared folder."""
    name = f"store_{uuid.uuid4().hex}"
    return CandleStore(c.sparkSession, name, f"{shared_folder(c.sparkSession)}/{name}", buckets=32)


def _store_upserted(c: DataFrame) -> DataFrame:
    """Stored are the bars up to place 300; those of long symbols are then replaced by their bars from place 100 on."""
    store = _store(c)
    store.upsert(c.where("i <= 300"), 0)
    store.upsert(c.where("i >= 100 AND length(symbol) > 5"), 60)
    return store.read().join(store.meta, "symbol")


register(
    "store_upserted",
    _store_upserted,
    f"{OHLCV} day_count fetched_at",
    """SELECT *, count(*) OVER (PARTITION BY symbol) AS day_count, CASE WHEN length(symbol) > 5 AND n > 100 THEN 60 ELSE 0 END AS fetched_at
       FROM c WHERE CASE WHEN length(symbol) > 5 AND n > 100 THEN i >= 100 ELSE i <= 300 END""",
)


def _store_through(c: DataFrame) -> DataFrame:
    """As cache_through, but what is not fresh is stored and read back; with what is then known of each symbol."""
    store, now = _store(c), 1704270600
    store.upsert(c.where("i <= 300"), F.when(F.length("symbol") > 5, F.lit(now - 60)).otherwise(0))
    return store.through(c, now, 100).join(store.meta, "symbol")


register(
    "store_through",
    _store_through,
    "symbol time close~ day_count fetched_at",
    """SELECT symbol, time, close, upto + 1 AS day_count, 1704270600 - CASE WHEN kept THEN 60 ELSE 0 END AS fetched_at
       FROM (SELECT *, CASE WHEN kept THEN least(n - 1, 300) ELSE n - 1 END AS upto FROM (SELECT *, length(symbol) > 5 AND n >= 100 AS kept FROM c))
       WHERE i <= upto AND i > upto - 100""",
)


def _store_joined(c: DataFrame) -> DataFrame:
    """Each bar beside that of a day before: two stored tables, which are dealt alike."""
    today, before = _store(c), _store(c)
    today.upsert(c, 0)
    before.upsert(c.withColumn("time", F.col("time") + 86400), 0)
    day_before = before.candles.select("symbol", "span", "time", F.col("close").alias("day_before"))
    return today.candles.join(day_before, ["symbol", "span", "time"]).withColumn("change", F.col("close") - F.col("day_before"))


register(
    "store_joined",
    _store_joined,
    "symbol time close~ day_before~ change~",
    "SELECT a.symbol, a.time, a.close, b.close AS day_before, a.close - b.close AS change FROM c AS a JOIN c AS b ON a.symbol = b.symbol AND a.time = b.time + 86400",
)


def _strategies(c: DataFrame) -> DataFrame:
    """Every output of each strategy: its rows, and how many symbols it has."""
    out = None
    for name in ("default", "factor", "turtle"):
        for part, df in strategy(c.drop("i", "n"), name).items():
            one = df.groupBy(F.lit(name).alias("strategy"), F.lit(part).alias("part")).agg(F.count("*").alias("rows"), F.countDistinct("symbol").alias("symbols"))
            out = out.union(one) if out else one
    return out


_PARTS = {"indicators": "ind", "regime": "regimes", "rule_signals": "rule_out", "evals": "fe", "scores": "sc", "signals": "pr", "actions": "ta"}
_OF = {"default": ("indicators", "regime", "rule_signals"), "factor": ("indicators", "regime", "rule_signals", "evals", "scores", "signals"), "turtle": ("indicators", "regime", "rule_signals", "evals", "scores", "actions")}
register(
    "strategy_outputs",
    _strategies,
    "strategy part rows symbols",
    " UNION ALL ".join(f"SELECT '{name}' AS strategy, '{part}' AS part, count(*) AS rows, count(DISTINCT symbol) AS symbols FROM {_PARTS[part]}" for name, parts in _OF.items() for part in parts),
)


def _strategy_values(c: DataFrame) -> DataFrame:
    """What the hybrid strategy gives out and the turtle's actions, by value: a row for each of an output's, with its time, a label and a number."""
    at = {
        "indicators": ("time", F.lit(None).cast("string"), "dif"),
        "regime": (F.lit(None).cast("long"), "regime", F.lit(None).cast("double")),
        "rule_signals": ("time", F.concat("kind", F.lit(" "), "tags"), "price"),
        "evals": (F.size("ic_series").cast("long"), "factor", "weight"),
        "scores": ("time", F.lit(None).cast("string"), "total"),
        "signals": ("time", "kind", "pnl_pct"),
        "actions": ("time", "action", "position_pct"),
    }
    out = []
    for name, parts in (("hybrid", _OF["factor"]), ("turtle", ("actions",))):
        given = strategy(c.drop("i", "n"), name)
        for part in parts:
            df = given[part]
            time, label, value = (x if isinstance(x, Column) else F.col(x) for x in at[part])
            out.append(df.select(F.lit(name).alias("strategy"), F.lit(part).alias("part"), "symbol", time.alias("time"), label.alias("label"), value.alias("value")))
    return reduce(DataFrame.union, out)


_VALUES = {
    "indicators": ("time, NULL", "dif", "md"),
    "regime": ("NULL, regime", "NULL", "regimes"),
    "rule_signals": ("time, kind || ' ' || tags", "price", "rule_out"),
    "evals": ("(SELECT max(n) FROM c WHERE c.symbol = fe.symbol), factor", "weight", "fe"),
    "scores": ("time, NULL", "total", "sc"),
    "signals": ("time, kind", "pnl_pct", "pr"),
    "actions": ("time, action", "position_pct", "ta"),
}
register(
    "strategy_values",
    _strategy_values,
    "strategy part symbol time label value~",
    " UNION ALL ".join(
        f"SELECT '{name}' AS strategy, '{part}' AS part, symbol, t::BIGINT AS time, l::VARCHAR AS label, v::DOUBLE AS value FROM (SELECT symbol, {_VALUES[part][0]}, {_VALUES[part][1]} FROM {_VALUES[part][2]}) x(symbol, t, l, v)"
        for name, parts in (("hybrid", _OF["factor"]), ("turtle", ("actions",)))
        for part in parts
    ),
)

# Parameters other than the defaults, series of coefficients, merged series, lists left out
register("macd_fast", lambda c: indicators.macd(c, 6, 13, 5), "symbol time dif~ dea~ bar~", "SELECT * FROM md_fast")
register("rsi_long", lambda c: indicators.rsi(c, 9), "symbol time rsi~", "SELECT * FROM rs_long")
register(
    "bollinger_narrow",
    lambda c: indicators.bollinger(c, 10, 1.5),
    "symbol time bb_upper~ bb_middle~ bb_lower~",
    """SELECT symbol, time, CASE WHEN i >= 9 THEN m + 1.5 * s END AS bb_upper, CASE WHEN i >= 9 THEN m END AS bb_middle, CASE WHEN i >= 9 THEN m - 1.5 * s END AS bb_lower
       FROM (SELECT *, avg(close) OVER w AS m, stddev_pop(close) OVER w AS s FROM c WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 9 PRECEDING))""",
)


def _series(c: DataFrame) -> DataFrame:
    ics = _ic(c)
    return factors.with_series(factors.evaluate(ics, CONFIG), ics).select("symbol", "factor", "is_valid", F.posexplode("ic_series").alias("place", "ic"))


register("factor_series", _series, "symbol factor is_valid place ic~", "SELECT symbol, factor, is_valid, (row_number() OVER (PARTITION BY symbol, factor ORDER BY time) - 1)::INTEGER AS place, ic FROM ic JOIN fe USING (symbol, factor)")
register(
    "history_series",
    lambda c: tables.merged_series(*(part.select("symbol", "time", "close", (F.col("close") * k).alias("line")) for part, k in ((c.where("i < 200"), 2), (c.where("i >= 100").withColumn("close", -F.col("close")), 5))), ["line"]),
    "symbol time close~ line~",
    "SELECT symbol, time, CASE WHEN i >= 100 THEN -close ELSE close END AS close, CASE WHEN i < 200 THEN 2 * close ELSE -5 * close END AS line FROM c",
)


def _keys(c: DataFrame) -> DataFrame:
    """The lists that each symbol's document has: none that would be empty."""
    bought = rules.rule_signals(c).where("kind = 'Buy' AND price < 30")
    made = tables.as_json(c.select("symbol", "time"), {"cheap": bought, "nothing": c.where("false").select("symbol", "time")})
    return made.select("symbol", F.array_join(F.array_sort(F.json_object_keys("json")), ",").alias("keys"))


register("json_lists", _keys, "symbol keys", "SELECT symbol, 'candles' || CASE WHEN symbol IN (SELECT symbol FROM rule_out WHERE kind = 'Buy' AND price < 30) THEN ',cheap' ELSE '' END AS keys FROM c GROUP BY symbol")


# Scalar functions and stores, on other tables
def _other(name: str, build: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = build, sql


_other(
    "symbol_route",
    lambda s, d: table(s, d, "customer").select("c_custkey", F.lpad((F.col("c_custkey") * 797 % 1000000).cast("string"), 6, "0").alias("code")).withColumn("routed", S.exchange_symbol(F.col("code"))),
    """SELECT *, CASE WHEN code LIKE '6%' THEN 'sh' || code WHEN code LIKE '0%' OR code LIKE '3%' THEN 'sz' || code END AS routed
       FROM (SELECT c_custkey, lpad((c_custkey * 797 % 1000000)::VARCHAR, 6, '0') AS code FROM customer)""",
)
_other(
    "instrument_search",
    lambda s, d: I.search(table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("symbol"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("market")), "12"),
    "SELECT c_custkey::VARCHAR AS symbol, c_name AS name, c_mktsegment AS market FROM customer WHERE contains(c_custkey::VARCHAR, '12') OR contains(c_name, '12') ORDER BY symbol LIMIT 20",
)
_other(
    "instrument_search_many",
    lambda s, d: I.search_many(
        table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("symbol"), F.col("c_name").alias("name")),
        table(s, d, "supplier").select(F.substring("s_name", -3, 3).alias("keyword")).union(table(s, d, "part").select(F.substring("p_name", 1, 2))).union(table(s, d, "nation").select(F.col("n_nationkey").cast("string"))),
    ),
    """SELECT DISTINCT keyword, c_custkey::VARCHAR AS symbol, c_name AS name
       FROM (SELECT right(s_name, 3) AS keyword FROM supplier UNION SELECT left(p_name, 2) FROM part UNION SELECT n_nationkey::VARCHAR FROM nation) k
       JOIN customer ON contains(c_custkey::VARCHAR, keyword) OR contains(c_name, keyword) WHERE keyword <> ''""",
)
_other(
    "market_open",
    lambda s, d: table(s, d, "events").select("event_id", S.epoch_seconds(F.col("ts")).alias("at")).select("event_id", S.market_open(F.col("at")).alias("open"), S.time_to_live(F.col("at")).alias("ttl")),
    """SELECT event_id, open, CASE WHEN open THEN 300 ELSE 7200 END AS ttl FROM (SELECT event_id,
         isodow(l) <= 5 AND (hour(l) IN (9, 10) OR (hour(l) = 11 AND minute(l) <= 30) OR hour(l) IN (13, 14) OR (hour(l) = 15 AND minute(l) = 0)) AS open
       FROM (SELECT event_id, ts + INTERVAL 8 HOUR AS l FROM events))""",
)
_other(
    "url_encoded",
    lambda s, d: table(s, d, "events").select("event_id", G.percent_encoded(F.concat_ws(" *~é", "event_type", "props")).alias("coded")),
    "SELECT event_id, url_encode(event_type || ' *~é' || props) AS coded FROM events WHERE event_type IS NOT NULL AND props IS NOT NULL",
)
_other(
    "cache_upsert",
    lambda s, d: S.upserted(
        table(s, d, "orders").where("o_orderdate < '1998-04-01'").groupBy(F.col("o_custkey").alias("symbol")).agg(F.max("o_orderkey").alias("fetched_at"), F.count("*").alias("day_count")),
        table(s, d, "orders").where("o_orderdate >= '1998-04-01'").groupBy(F.col("o_custkey").alias("symbol")).agg(F.max("o_orderkey").alias("fetched_at"), F.count("*").alias("day_count")),
    ),
    """SELECT symbol, fetched_at, day_count FROM (SELECT o_custkey AS symbol, (o_orderdate >= '1998-04-01')::INTEGER AS part, max(o_orderkey) AS fetched_at, count(*) AS day_count FROM orders WHERE o_orderdate IS NOT NULL GROUP BY ALL)
       QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY fetched_at DESC, part DESC) = 1""",
)
_other(
    "cache_fresh",
    lambda s, d: S.fresh(
        table(s, d, "events").groupBy(F.col("user_id").alias("symbol")).agg(F.count("*").alias("day_count"), F.max(S.epoch_seconds(F.col("ts"))).alias("fetched_at")),
        F.lit(1704270600),
        3,
    ).select("symbol", "day_count"),
    """SELECT symbol, day_count FROM (SELECT user_id AS symbol, count(*) AS day_count, max(floor(epoch(ts)))::BIGINT AS f FROM events GROUP BY user_id)
       WHERE day_count >= 3 AND 1704270600 - f <= 7200""",
)
_other(
    "vendor_decode",
    lambda s, d: S.decoded_vendor_rows(
        table(s, d, "orders").select(
            F.col("o_orderpriority").alias("symbol"),
            F.lit(None).cast("array<array<string>>").alias("qfqday"),
            F.array(F.array(F.substring(F.col("o_orderdate").cast("string"), 1, 10), *[F.when(F.col("o_orderkey") % 10 == 9, "?").otherwise(F.col(c).cast("string")) for c in ("o_totalprice", "o_custkey", "o_totalprice", "o_custkey", "o_orderkey")])).alias("day"),
        )
    ),
    """SELECT o_orderpriority AS symbol, floor(epoch(o_orderdate) / 86400)::BIGINT * 86400 AS time, o_totalprice AS open, o_totalprice AS high, o_custkey::DOUBLE AS low, o_custkey::DOUBLE AS close, o_orderkey::DOUBLE AS volume
       FROM orders WHERE o_orderkey % 10 <> 9""",
)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
