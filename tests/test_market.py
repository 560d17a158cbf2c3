import datetime
import math
import random

import pytest

from pyspark.sql import functions as F

from tickforge.config import FactorConfig, SignalConfig, TurtleConfig
from tickforge.functions import guards as G
from tickforge.functions import windows as W
from tickforge.operators import factors, indicators, rules, signals, tables
from tickforge.plans.strategies import strategy
from tickforge.sources import candles as S

from . import loops

GATES = [1, 2, 3, 8, 9, 10, 19, 20, 21, 25, 26, 28, 29, 33, 34, 35, 36, 60, 130]


def series():
    out = []
    for n in GATES:
        out += loops.walk(n, n, f"W{n}")
    return out + loops.flat(70) + loops.flat(70, "Z", 0.0, 0.0) + loops.walk(200, 5, "L")


def bars(spark, rows):
    return S.with_places(spark.createDataFrame(rows, S.CANDLES).repartition(3))


def by_symbol(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def close_to(a, b):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


INDICATORS = [
    (indicators.bollinger, loops.bollinger, ("bb_upper", "bb_middle", "bb_lower")),
    (indicators.keltner, loops.keltner, ("kc_upper", "kc_middle", "kc_lower")),
    (indicators.macd, loops.macd, ("dif", "dea", "bar")),
    (indicators.kdj, loops.kdj, ("k", "d", "j")),
    (indicators.adx, loops.adx, ("adx", "plus_di", "minus_di")),
    (indicators.rsi, loops.rsi, ("rsi",)),
]


def test_indicators_equal_loops_at_every_gate(spark):
    rows = series()
    together = {(r.symbol, r.time): r for r in indicators.all_indicators(bars(spark, rows)).collect()}
    for add, loop, columns in INDICATORS:
        got = {(r.symbol, r.time): r for r in add(bars(spark, rows)).collect()}
        assert len(got) == len(rows)
        for symbol, own in by_symbol(rows).items():
            for r, want in zip(own, loop(own)):
                for k, c in enumerate(columns):
                    w = None if want is None else want[k]
                    assert close_to(got[r[0], r[1]][c], w), (c, symbol, len(own), r[1])
                    assert close_to(together[r[0], r[1]][c], w)


def test_bands_are_ordered_and_rsi_is_bounded(spark):
    df = indicators.all_indicators(bars(spark, series()))
    assert df.where("bb_lower > bb_middle OR bb_middle > bb_upper OR kc_lower > kc_upper OR rsi < 0 OR rsi > 100").count() == 0


def test_regimes_of_short_and_flat_series(spark):
    got = {r.symbol: r.regime for r in indicators.regime(indicators.all_indicators(bars(spark, series()))).collect()}
    assert got["W36"] == indicators.LABELS[0] and got["F"] == indicators.LABELS[2]
    assert set(got.values()) <= set(indicators.LABELS) and len(got) == len(GATES) + 3


def test_rules_pair_like_the_walk(spark):
    rows = loops.walk(400, 3, "A") + loops.walk(300, 4, "B")
    confirmed = rules.confirmed(rules.events(indicators.all_indicators(bars(spark, rows))))
    flags = confirmed.select("symbol", "time", "close", (F.size("buy_tags") > 0).alias("b"), (F.size("sell_tags") > 0).alias("s")).collect()
    got = {}
    for t in rules.trades(confirmed).collect():
        got.setdefault(t.symbol, []).append((t.buy_time, t.buys, t.entry, t.sell_time))
    for symbol, own in by_symbol([tuple(r) for r in flags]).items():
        want = loops.pairs([r[1:] for r in own])
        assert len(want) == len(got[symbol]) > 5
        for (times, entry, sell), (buy_time, buys, mean, sold) in zip(want, sorted(got[symbol], key=lambda x: (x[3] is None, x[3]))):
            assert (times[0] if times else None, len(times) or None, sell) == (buy_time, buys, sold) and close_to(entry, mean)


def test_a_sell_of_the_same_bar_comes_first(spark):
    rows = spark.createDataFrame(
        [("A", 1, 10.0, ["x"], []), ("A", 2, 11.0, ["y"], ["s"]), ("A", 3, 12.0, [], ["s"]), ("A", 4, 13.0, [], ["s"])],
        "symbol string, time long, close double, buy_tags array<string>, sell_tags array<string>",
    )
    got = sorted(tuple(r) for r in rules.trades(rows).select("grp", "buy_time", "entry", "sell_time", "pnl_pct").collect())
    assert got[:2] == [(0, 1, 10.0, 2, pytest.approx(10.0)), (1, 2, 11.0, 3, pytest.approx(100 / 11))] and got[2][:4] == (2, None, None, 4)


def test_squeeze_machine_equals_the_loop(spark):
    rows, rng = [], random.Random(1)
    for symbol in ("A", "B", "C"):
        own = loops.walk(500, ord(symbol), symbol)
        calm = [(s, t, 50 + (o - 50) * 0.02, 50 + (h - 50) * 0.02, 50 + (l_ - 50) * 0.02, 50 + (c - 50) * 0.02, v) for s, t, o, h, l_, c, v in own]
        for i in range(60, 500, 61):  # quiet, then breakouts on high volume with closes in between
            for j in range(i - 25, i):
                s, t, *_, v = calm[j]
                calm[j] = (s, t, 50.0, 50.01, 49.99, 50.0 + 0.001 * (j % 3), 1000.0)
            for j, rise in ((i, 0.5), (i + 1, 0.5), (i + 2, 3.0), (i + 3, 3.5)):
                s, t, *_, v = calm[j]
                calm[j] = (s, t, 50.0, 50.5 + rise, 50.0, 50.0 + rise + 0.1 * rng.random(), 90000.0 * 3 ** (j - i))
        rows += calm
    got = {(r.symbol, r.time): (r.squeeze_buy, r.squeeze_sell) for r in rules.squeeze_trades(indicators.all_indicators(bars(spark, rows))).collect()}
    for own in by_symbol(rows).values():
        want = loops.squeeze(own, loops.bollinger(own), loops.keltner(own), loops.macd(own), loops.kdj(own))
        assert [got[r[0], r[1]] for r in own] == want
    assert sum(b for b, _ in got.values()) > 2 and sum(s for _, s in got.values()) > 0


def test_rule_signals_are_complete(spark):
    b = bars(spark, loops.walk(400, 3, "A"))
    got = sorted(rules.rule_signals(b).collect(), key=lambda r: r.seq)
    assert [r.seq for r in got] == list(range(1, len(got) + 1))
    assert {r.kind for r in got} == {"Buy", "Sell"} and any(r.tags.startswith("买(") and r.pnl_pct is not None for r in got)


def test_guards(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, 1e-13), (nan, 1.0), (1.0, inf), (None, 1.0)], "x double, y double")
    got = df.select(G.divide(F.col("x"), F.col("y")).alias("q"), G.subtract(F.col("x"), F.col("y")).alias("d"), G.clamp(F.col("x"), F.lit(2.0), F.lit(3.0)).alias("c")).collect()
    assert [r.q for r in got] == [0.5, None, None, None, None, None]
    assert [r.d for r in got][:3] == [-1.0, 1.0, 1.0 - 1e-13] and [r.d for r in got][3:] == [None] * 3
    assert got[0].c == 2.0 and got[5].c is None


def test_correlation_of_lines_and_constants(spark):
    rows = [("A", i, float(i), 2.0 * i, 10.0 - i, 5.0) for i in range(5)]
    df = spark.createDataFrame(rows, "symbol string, time long, x double, y double, z double, k double").withColumn("i", F.col("time"))
    got = df.select("time", *[W.ts_corr(F.col("x"), F.col(c), 5).alias(c) for c in "yzk"]).where("time = 4").first()
    assert close_to(got.y, 1) and close_to(got.z, -1) and got.k == 0.0


def test_factors_of_a_ramp(spark):
    rows = [("A", 1_000_000 + i * 86400, 10 + 0.1 * i, 10.5 + 0.1 * i, 9.8 + 0.1 * i, 10.2 + 0.1 * i, 1e6 + 5e5 * math.sin(i)) for i in range(120)]
    got = sorted(factors.factor_frame(bars(spark, rows)).collect(), key=lambda r: r.time)
    first = {"ret_5d": 5, "ret_20d": 5, "macd_dif": 25, "ma_disp_20": 19, "atr_pct": 13, "bb_width": 19, "hl_vol": 9, "ret_std": 19, "vol_ratio": 4, "vol_trend": 9, "ma_cross": 19, "slope_10": 10}
    for name, i in first.items():
        assert next(k for k, r in enumerate(got) if r[name] is not None) == i
    c = [r[5] for r in rows]
    assert close_to(got[50].ret_5d, (c[50] - c[45]) / c[45]) and got[50].ret_20d == got[50].ret_5d
    assert close_to(got[50].vol_ratio, loops.mean([r[6] for r in rows[46:51]]) / rows[50][6])
    assert close_to(got[13].atr_pct, sum(abs(c[j] - c[j - 1]) for j in range(1, 14)) / 14 / c[13])
    described = sorted(factors.factor_frame(bars(spark, rows), factors.library(True)).collect(), key=lambda r: r.time)
    assert described[19].ret_20d is None and close_to(described[50].ret_20d, (c[50] - c[30]) / c[30])
    assert close_to(described[50].vol_ratio, 1 / got[50].vol_ratio) and described[13].atr_pct is None and described[19].ret_std is None


def test_rolling_ic_equals_the_loop(spark):
    rows = loops.walk(160, 9, "A") + loops.flat(90)
    config = FactorConfig(days=90)
    ics = factors.rolling_ic(factors.long_factors(bars(spark, rows), config), config)
    wide = {(r.symbol, r.time): r for r in factors.factor_frame(bars(spark, rows)).collect()}
    got = {(r.symbol, r.factor, r.time): r.ic for r in ics.collect()}
    w, ahead = config.window, config.forward
    for symbol, own in by_symbol(rows).items():
        n, c = len(own), [r[5] for r in own]
        for name in ("ret_5d", "hl_vol", "bb_width"):
            x = [wide[r[0], r[1]][name] for r in own]
            for t in range(n):
                want = None
                if w <= t < n - ahead:
                    pair = [(x[j], (c[j + ahead] - c[j]) / c[j]) for j in range(t - w, t) if x[j] is not None and c[j] > 1e-12]
                    if len(pair) >= w // 3:
                        mx, my = loops.mean([p for p, _ in pair]), loops.mean([q for _, q in pair])
                        den = math.sqrt(sum((p - mx) ** 2 for p, _ in pair) * sum((q - my) ** 2 for _, q in pair))
                        want = 0.0 if den < 1e-15 or len(pair) < 2 else sum((p - mx) * (q - my) for p, q in pair) / den
                assert want is None and got[symbol, name, own[t][1]] is None or abs(got[symbol, name, own[t][1]] - want) < 1e-7
    evals = factors.evaluate(ics, config).collect()
    assert len(evals) == 24 and all(e.weight == (abs(e.ic_mean) if e.is_valid else 0) for e in evals)
    assert factors.with_series(factors.evaluate(ics, config), ics).where("size(ic_series) = 160").count() == 12


def ic_rows(spark, values):
    return spark.createDataFrame([("A", "f", i, v) for i, v in enumerate(values)], "symbol string, factor string, time long, ic double")


def test_screening(spark):
    good = ic_rows(spark, [None] * 10 + [0.05 + 0.02 * math.sin(0.001 * i) for i in range(90)])
    noise = ic_rows(spark, [None] * 10 + [0.01 * math.sin(i) for i in range(90)])
    few = ic_rows(spark, [None] * 90 + [0.5] * 10)
    a, b, c = (factors.evaluate(x, FactorConfig()).first() for x in (good, noise, few))
    assert a.is_valid and a.weight > 0 and not b.is_valid and b.weight == 0
    assert (c.ic_mean, c.ir, c.weight, c.is_valid) == (0, 0, 0, False)


def test_normalising_and_blending(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0, 7.0, 8.0, 9.0, 10.0]
    rows = spark.createDataFrame([("A", "ret_5d", i, v) for i, v in enumerate(values)], "symbol string, factor string, time long, x double")
    got = [r.w for r in factors.winsorized(rows).orderBy("time").collect()]
    assert max(got) == 10.0 and got[0] == 1.0
    z = factors.zscores(rows.withColumn("ic_mean", F.lit(0.05)))
    assert max(r.z for r in z.collect()) < 50
    z = spark.createDataFrame([("A", "ret_5d", 0, 1.0, 0.05), ("A", "ret_5d", 1, -1.0, 0.05), ("A", "ret_5d", 2, None, 0.05), ("A", "hl_vol", 0, 2.0, 0.0)], "symbol string, factor string, time long, z double, weight double")
    got = {r.time: r for r in factors.synthesize(z).collect()}
    assert set(got) == {0, 1, 2} and got[2].total is None and close_to(got[0].total, 0.05) and close_to(got[1].momentum, -0.05) and got[0].volatility == 0


def scored(spark, totals, rows=None):
    rows = rows or loops.flat(len(totals), "A")
    data = [(*r, t, 0.0, 0.0, 0.0, t) for r, t in zip(rows, totals)]
    schema = "symbol string, time long, open double, high double, low double, close double, volume double, momentum double, volatility double, volume_score double, trend double, total double"
    return S.with_places(spark.createDataFrame(data, schema))


def test_reversals(spark):
    got = signals.reversal_signals(scored(spark, [-0.5, -0.3, -0.1, 0.0, 0.2])).collect()
    assert [(r.kind, r.time) for r in got] == [("Buy", 1_000_000 + 4 * 86400)]
    assert signals.reversal_signals(scored(spark, [0.0] * 5)).count() == 0
    assert signals.reversal_signals(scored(spark, [0.5, 0.3, None, 0.1, -0.2, -0.3])).count() == 0


def test_short_series_give_no_signals(spark):
    assert signals.quantile_signals(scored(spark, [0.5, 0.6, 0.7])).count() == 0
    assert signals.divergence_signals(scored(spark, [0.0] * 5)).count() == 0
    assert signals.turtle_actions(scored(spark, [0.5, 0.6, 0.7]), TurtleConfig(lookback=10)).count() == 0


def test_quantiles_and_divergence_equal_the_loop(spark):
    rng = random.Random(8)
    rows = loops.walk(300, 12, "A")
    totals = [None if rng.random() < 0.05 else rng.gauss(0, 1) for _ in rows]
    df = scored(spark, totals, rows)
    got = {r.time: (r.kind, r.level) for r in signals.quantile_signals(df).collect()}
    want, seen = {}, []
    for i, t in enumerate(totals):
        if t is None:
            continue
        past = sorted(seen[-120:])
        seen.append(t)
        if len(past) < 60:
            continue
        q = lambda p: past[int((len(past) - 1) * p)]
        recent = [x for x in totals[max(0, i - 5) : i + 1] if x is not None]
        up, down = len(recent) >= 3 and recent[-1] > recent[0], len(recent) >= 3 and recent[-1] < recent[0]
        level = "p80" if t > q(0.8) and up else "p60" if t > q(0.6) and t > 0 else "p20" if t < q(0.2) and down else "p40" if t < q(0.4) and t < 0 else None
        if level:
            want[rows[i][1]] = ("Buy" if level in ("p80", "p60") else "Sell", level)
    assert got == want and len(got) > 50
    want = set()
    for i in range(20, 300):
        five, past = totals[i - 4 : i + 1], [x for x in totals[i - 20 : i] if x is not None]
        if None in five or not past:
            continue
        c, prices = rows[i][5], [r[5] for r in rows[i - 20 : i]]
        if c >= max(prices) * 0.995 and five[-1] < max(past) * 0.9 and five[-1] < five[0]:
            want.add((rows[i][1], "Sell"))
        if c <= min(prices) * 1.005 and five[-1] > min(past) * 1.1 and five[-1] > five[0]:
            want.add((rows[i][1], "Buy"))
    assert {(r.time, r.kind) for r in signals.divergence_signals(df).collect()} == want and len(want) > 5
    both = signals.all_signals(df, SignalConfig(divergence=False)).collect()
    assert {r.rule for r in both} == {"quantile", "reversal"}
    assert signals.all_signals(df, SignalConfig(quantile=False, reversal=False, divergence=False)).count() == 0


def test_pairing_of_signals(spark):
    rows = [("A", 1, 1, "Buy", 10.0), ("A", 2, 2, "Buy", 12.0), ("A", 3, 3, "Sell", 11.0), ("A", 4, 4, "Buy", 20.0), ("B", 1, 1, "Sell", 5.0)]
    df = spark.createDataFrame(rows, "symbol string, seq int, time long, kind string, price double")
    closes = spark.createDataFrame([("A", 3, 15.0)], "symbol string, time long, close double")
    got = {(r.symbol, r.seq): r.pnl_pct for r in signals.paired(df, closes).collect()}
    assert got == {("A", 1): pytest.approx(50), ("A", 2): pytest.approx(25), ("A", 3): None, ("A", 4): None, ("B", 1): None}
    got = {(r.symbol, r.seq): r.pnl_pct for r in signals.paired(df).collect()}
    assert got["A", 1] == pytest.approx(10)


TURTLES = {
    "entry": ([0.0] * 65 + [2, 2.5, 3, 2.8, 3.2, 3.5, 3.8], TurtleConfig(cooldown=1)),
    "stop": ([0.0] * 65 + [3, 3.2, 3.5, -1, -1.5, -2, -2.5], TurtleConfig(cooldown=1)),
    "cooldown": ([0.0] * 65 + [3 + 0.3 * i for i in range(8)], TurtleConfig()),
    "cycle": ([0.0] * 65 + [2, 2.5, 3] + [3.5 + 0.5 * i for i in range(6)] + [-2, -2.5, -3], TurtleConfig(cooldown=1)),
    "clamp": ([0.0] * 65 + [3.0 + i for i in range(8)], TurtleConfig(add_step=0.3, max_units=3, cooldown=1)),
    "nulls": ([0.1 * (i % 5) if i % 4 else None for i in range(90)] + [5.0, None, None, None, 6.0, float("nan"), 7.0, 8.0, -9.0, -9.0, 5.0, 6.0, 7.0, 9.0], TurtleConfig()),
}


@pytest.mark.parametrize("name", TURTLES)
def test_turtle_equals_the_loop(spark, name):
    totals, c = TURTLES[name]
    totals = [None if t is None else float(t) for t in totals]
    rows = loops.walk(len(totals), 2, "A")
    got = [(r.time, r.action, r.units, r.pnl_pct) for r in signals.turtle_actions(scored(spark, totals, rows), c).orderBy("time").collect()]
    want = loops.turtle(rows, totals, c.entry_z, c.add_step, c.stop, c.max_units, c.cooldown, c.lookback)
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(close_to(g[3], w[3]) for g, w in zip(got, want))
    assert got[0][1] == "Entry" and max(g[2] for g in got) <= c.max_units
    if name in ("stop", "cycle"):
        assert got[-1][1] == "Exit" and got[-1][3] is not None


def test_symbols_do_not_meet(spark):
    a, b = loops.walk(150, 1, "A"), loops.walk(170, 2, "B")
    one = {r.time: r.total for r in factors.alpha_scores(bars(spark, a)).collect()}
    two = {r.time: r.total for r in factors.alpha_scores(bars(spark, a + b)).where("symbol = 'A'").collect()}
    assert one.keys() == two.keys() and all(close_to(one[t], two[t]) for t in one) and any(one.values())


def test_strategies(spark):
    rows = spark.createDataFrame(loops.walk(220, 6, "A"), S.CANDLES)
    assert set(strategy(rows)) == {"indicators", "regime", "rule_signals"} == set(strategy(rows, "alpha"))
    assert set(strategy(rows, "hybrid")) - set(strategy(rows)) == {"evals", "scores", "signals"}
    got = strategy(rows, "turtle")
    assert "actions" in got and got["evals"].count() == 12


def test_sources(spark):
    rows = [["2024-01-02", "1", "2", "3", "0.5", "10"], ["2024-13-02", "1", "2", "3", "0.5", "10"], ["2024-01-03", "1", "x", "3", "0.5", "10"], ["2024-01-04", "1", "2"]]
    df = spark.createDataFrame([("A", None, rows), ("B", [rows[0]], rows[1:])], "symbol string, qfqday array<array<string>>, day array<array<string>>")
    at = int(datetime.datetime(2024, 1, 2, tzinfo=datetime.timezone.utc).timestamp())
    assert sorted(map(tuple, S.decoded_vendor_rows(df).collect())) == [("A", at, 1.0, 3.0, 0.5, 2.0, 10.0), ("B", at, 1.0, 3.0, 0.5, 2.0, 10.0)]
    codes = spark.createDataFrame([("600000",), ("000001",), ("300001",), ("900001",), ("60000",)], "c string")
    assert [r[0] for r in codes.select(S.exchange_symbol(F.col("c"))).collect()] == ["sh600000", "sz000001", "sz300001", None, None]
    day = lambda d, h, m: int(datetime.datetime(2024, 1, d, h - 8, m, tzinfo=datetime.timezone.utc).timestamp())
    cases = {day(2, 9, 0): True, day(2, 11, 30): True, day(2, 11, 31): False, day(2, 12, 0): False, day(2, 15, 0): True, day(2, 15, 1): False, day(6, 10, 0): False, day(5, 8, 59): False}
    times = spark.createDataFrame([(t,) for t in cases], "t long")
    assert {r.t: r.o for r in times.select("t", S.market_open(F.col("t")).alias("o")).collect()} == cases
    assert spark.range(1).select(S.request_url("u", F.lit("600000"), 5)).first()[0] == "u?param=sh600000%2Cday%2C%2C%2C5%2Cqfq"


def test_store_and_history(spark, tmp_path):
    path = str(tmp_path / "store")
    a, b = loops.walk(5, 1, "A"), loops.walk(4, 2, "B")
    S.write_store(spark.createDataFrame(a + b, S.CANDLES), path)
    S.write_store(spark.createDataFrame(a[:2], S.CANDLES), path)
    assert S.read_store(spark, path).groupBy("symbol").count().orderBy("symbol").collect()[0]["count"] == 2
    assert S.read_store(spark, path, ["B"]).count() == 4
    meta = spark.createDataFrame([("A", 2, 0), ("B", 4, 10**9)], "symbol string, day_count int, fetched_at long")
    fetched = spark.createDataFrame(a + b, S.CANDLES)
    got = S.cached_or_fetched(S.read_store(spark, path), meta, fetched, F.lit(10**9 + 60), 3)
    assert {r.symbol: r["count"] for r in got.groupBy("symbol").count().collect()} == {"A": 5, "B": 3}
    old = spark.createDataFrame([("A", 1, 1.0, 9.0), ("A", 2, 2.0, 9.5)], "symbol string, time long, close double, rsi double")
    new = spark.createDataFrame([("A", 2, 7.0, 8.0), ("A", 3, 3.0, 8.5)], old.schema)
    assert sorted(map(tuple, tables.merged_history(old, new).collect())) == [("A", 1, 1.0, 9.0), ("A", 2, 7.0, 8.0), ("A", 3, 3.0, 8.5)]
    assert sorted(map(tuple, tables.merged_series(old, new, ["rsi"]).select("symbol", "time", "close", "rsi").collect()))[1] == ("A", 2, 7.0, 9.5)
    asked = spark.createDataFrame([("A", 0), ("A", 5), ("A", 6), ("A", 99), ("N", 1)], "symbol string, at long")
    near = spark.createDataFrame([("A", 2), ("A", 4), ("A", 8)], "symbol string, time long")
    assert {(r.symbol, r.at): r.near for r in tables.nearest_bar(asked, near).collect()} == {("A", 0): 2, ("A", 5): 4, ("A", 6): 4, ("A", 99): 8, ("N", 1): None}


def test_totals_and_text(spark):
    acts = spark.createDataFrame([("A", "Entry", None), ("A", "Exit", 5.0), ("A", "Exit", -2.0), ("B", "Entry", None)], "symbol string, action string, pnl_pct double")
    assert {r.symbol: tuple(r)[1:] for r in tables.exits(acts).collect()} == {"A": (2, 0.5, 3.0), "B": (0, None, 0.0)}
    text = spark.createDataFrame([(2.675,), (0.125,), (None,)], "x double").select(tables.fixed(F.col("x"), 2)).collect()
    assert [r[0] for r in text] == ["2.67", "0.12", None]
    b = bars(spark, loops.walk(3, 1, "A"))
    doc = tables.as_json(b.select("symbol", "time", "close"), {"signals": b.limit(0).select("symbol", "time")}).first().json
    assert '"candles":[' in doc and "signals" not in doc


def test_empty_candles(spark):
    none = bars(spark, [])
    assert indicators.all_indicators(none).count() == 0 and factors.alpha_scores(none).count() == 0 and rules.rule_signals(none).count() == 0
