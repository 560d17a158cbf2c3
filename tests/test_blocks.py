"""Long series in many blocks: the same results as by one block or a plain loop."""

import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tickforge.config import FactorConfig, SignalConfig, TurtleConfig
from tickforge.functions import windows as W
from tickforge.operators import blocks, factors, indicators, machines, orders, rules, signals
from tickforge.sources import candles as S

from . import loops
from .test_market import INDICATORS, bars, by_symbol, close_to, scored


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(blocks, "SIZE", 37)


def rows_of(df, *columns):
    return {(r.symbol, r.time): tuple(r[c] for c in columns) for r in df.select("symbol", "time", *columns).collect()}


def same(a, b):
    assert a.keys() == b.keys() and a
    for key, x in a.items():
        assert all(close_to(p, q) if isinstance(p, float) or isinstance(q, float) else p == q for p, q in zip(x, b[key])), (key, x, b[key])


def exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("hashpartitioning(")[1] for line in text.splitlines() if "hashpartitioning(" in line]


def test_places_by_spans_of_time(spark):
    rng = random.Random(3)
    rows = [(s, t, 1.0, 1.0, 1.0, 1.0, 1.0) for s in "AB" for t in rng.sample(range(-5000, 5000), 300)] + [("C", 7, 1.0, 1.0, 1.0, 1.0, 1.0)]
    got = blocks.placed(spark.createDataFrame(rows, S.CANDLES).repartition(3), width=100).collect()
    for own in by_symbol([(r.symbol, r.time, r.i, r.n) for r in got]).values():
        assert [r[2] for r in own] == list(range(len(own))) and {r[3] for r in own} == {len(own)}
    assert len(got) == 601
    assert blocks.placed(spark.createDataFrame([(None, 1, 1.0, 1.0, 1.0, 1.0, 1.0)], S.CANDLES)).collect() == []


def test_indicators_over_many_blocks(spark, small):
    rows = loops.walk(400, 1, "A") + loops.walk(36, 2, "B") + loops.walk(38, 3, "C") + loops.flat(111)
    df = bars(spark, rows)
    together = {(r.symbol, r.time): r for r in indicators.all_indicators(df).collect()}
    for _, loop, columns in INDICATORS:
        for own in by_symbol(rows).values():
            for r, want in zip(own, loop(own)):
                for k, c in enumerate(columns):
                    assert close_to(together[r[0], r[1]][c], None if want is None else want[k]), (c, r)


def test_bars_are_not_dealt_by_symbol_alone(spark):
    df = bars(spark, loops.walk(300, 1, "A"))
    for out in (factors.factor_frame(df), indicators.bollinger(df), factors.long_ics(df, FactorConfig())):
        keys = [x.split("), ")[0].split(") ")[0] for x in exchanges(out)]
        assert any("block#" in k for k in keys)
        assert sum(k.count("#") == 1 for k in keys) <= 1  # the counts of spans of time, a row a span, are added up along the symbol


def test_states_are_those_of_a_loop(spark, small):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=500) * 0.8, rng.normal(size=500)
    rows = [("AB"[k % 2], k, float(a[k]), float(b[k])) for k in range(500)]
    df = blocks.blocked(spark.createDataFrame(rows, "symbol string, time long, a double, b double").repartition(4))
    got = rows_of(blocks.affine(df, {"x": (F.col("a"), F.col("b")), "count": (F.lit(1.0), F.lit(1.0))}), "x", "count")
    for s in range(2):
        x = 0.0
        for nth, k in enumerate(range(s, 500, 2), 1):
            x = a[k] * x + b[k]
            assert got["AB"[s], k] == (pytest.approx(x, rel=1e-12, abs=1e-12), nth)


def test_scores_and_signals_over_many_blocks(spark, monkeypatch):
    rows = loops.walk(330, 6, "A") + loops.walk(80, 7, "B")
    config, outs = FactorConfig(days=90), []
    for size in (4096, 37):
        monkeypatch.setattr(blocks, "SIZE", size)
        df = bars(spark, rows)
        ics = {(r.symbol, r.factor, r.time): (r.x, r.ic) for r in factors.long_ics(df, config).collect()}
        alike = {(r.symbol, r.factor, r.time): (r.x, r.ic) for r in factors.rolling_ic(factors.long_factors(df, config), config).collect()}
        same(ics, alike)
        scores = factors.alpha_scores(df, config)
        total = rows_of(scores, "momentum", "volatility", "volume_score", "trend", "total")
        steps = factors.zscores(factors.with_weights(factors.rolling_ic(factors.long_factors(df, config), config), config))
        same(total, rows_of(factors.synthesize(steps), "momentum", "volatility", "volume_score", "trend", "total"))
        found = signals.all_signals(scores, SignalConfig(quantile_window=50))
        paired = {(r.symbol, r.seq): (r.time, r.kind, r.rule, r.level, r.pnl_pct) for r in signals.paired(found, df).collect()}
        z = rows_of(signals.rolling_z(scores, 30), "alpha_std", "alpha_z")
        trades = {(r.symbol, r.seq): (r.time, r.kind, r.tags, r.pnl_pct) for r in rules.rule_signals(df).collect()}
        outs.append((ics, total, paired, z, trades))
    for one, other in zip(*outs):
        same(one, other)
    assert len(outs[0][2]) > 40 and any(p[4] is not None for p in outs[0][2].values()) and len(outs[0][4]) > 20


@pytest.mark.parametrize("size", [8, 64])
def test_turtle_over_many_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(blocks, "SIZE", size)
    rng = random.Random(size)
    for c in (TurtleConfig(lookback=20), TurtleConfig(lookback=12, cooldown=11, max_units=2, stop=6.0), TurtleConfig(lookback=10, cooldown=0, entry_z=0.5, stop=0.5)):
        totals, level = [], 0.0
        for k in range(420):
            level = 0.97 * level + rng.gauss(0, 1)
            totals.append(None if rng.random() < 0.05 else level + (6.0 if 150 < k < 260 else 0.0))
        rows = loops.walk(len(totals), 2, "A")
        got = [(r.time, r.action, r.units, r.pnl_pct) for r in signals.turtle_actions(scored(spark, totals, rows), c).orderBy("time").collect()]
        want = loops.turtle(rows, totals, c.entry_z, c.add_step, c.stop, c.max_units, c.cooldown, c.lookback)
        assert [g[:3] for g in got] == [w[:3] for w in want] and all(close_to(g[3], w[3]) for g, w in zip(got, want)) and len(got) > 5


def test_squeeze_over_many_blocks():
    """Blocks of the machine against the loop's rule, from any state that a block can be reached in."""
    rng, machine = np.random.default_rng(4), machines.Squeeze()
    for _ in range(40):
        n = 60
        price = 50 + np.cumsum(rng.normal(size=n))
        bars = {c: (rng.random(n) < p).astype(float) for c, p in zip(machine.reads, (0.9, 0.3, 0.3, 0.5, 0.03))}
        bars |= {"_stop": rng.random(n) * 3 + 1, "close": price, "bb_middle": price - rng.random(n) * 4 + 0.2}
        is_open, want = None, []
        for k in range(n):
            buy = sell = False
            ready, squeezed, surge, pulled, death = (bars[c][k] == 1 for c in machine.reads[:5])
            if ready:
                if is_open is not None and (price[k] < bars["bb_middle"][k] or price[k] < is_open - bars["_stop"][k] or death):
                    sell, is_open = True, None
                if surge and (pulled if is_open is not None else squeezed):
                    buy, is_open = True, price[k] if is_open is None else max(is_open, price[k])
            want.append((buy, sell))
        state, got = np.zeros(2), []
        for s in range(0, n, 7):
            part = {k: v[s : s + 7] for k, v in bars.items()}
            done, end = machine.run(part, state)
            known = machine.after(machine.summary(part), s, state, machine.run(part, np.zeros(2))[1])
            assert known is None or known.tolist() == end.tolist()
            got += list(zip(done["squeeze_buy"], done["squeeze_sell"]))
            state = end
        assert got == want


def test_order_statistics_of_ranges():
    rng = np.random.default_rng(2)
    values = np.r_[rng.integers(0, 9, 200), rng.normal(size=101), [5.0] * 60].astype(float)
    order = orders.RangeOrder(values)
    begin = rng.integers(0, 300, 500)
    end = begin + rng.integers(1, 60, 500)
    k = (rng.random(500) * (end - begin)).astype(int)
    asked = np.r_[values[rng.integers(0, len(values), 480)], rng.normal(size=18), [-1e9, 1e9]]
    assert order.kth(begin, end, k).tolist() == [sorted(values[b:e])[j] for b, e, j in zip(begin, end, k)]
    assert order.no_larger(begin, end, asked).tolist() == [(values[b:e] <= x).sum() for b, e, x in zip(begin, end, asked)]
    one = orders.RangeOrder(np.array([3.0]))
    assert one.kth(np.array([0]), np.array([1]), np.array([0])).tolist() == [3.0] and one.no_larger(np.array([0]), np.array([1]), np.array([2.0])).tolist() == [0]


def test_rolling_order_over_many_blocks(spark, small):
    rows = loops.walk(150, 4, "A") + loops.walk(9, 5, "B")
    df = bars(spark, rows)
    by_rank, by_place = rows_of(orders.rolling_rank(df, "close", 50, "v"), "v"), rows_of(orders.rolling_place(df, "volume", 50, 36, "v"), "v")
    same(by_rank, rows_of(df.withColumn("v", W.ts_rank(F.col("close"), 50)), "v"))
    for own in by_symbol(rows).values():
        for k, r in enumerate(own):
            assert by_place[r[0], r[1]][0] == (sorted(x[6] for x in own[k - 49 : k + 1])[36] if k >= 49 else None)


def test_correlations_of_frames():
    rng = np.random.default_rng(7)
    for w, n in ((5, 3), (5, 5), (5, 6), (7, 100), (60, 400)):
        x, y = rng.normal(size=(n, 3)) * [1, 1e-6, 1e3] + [0, 1e4, -1e6], rng.normal(size=n)
        x[rng.random(x.shape) < 0.2], y[rng.random(n) < 0.1] = np.nan, np.nan
        x[n // 2 :, 2] = 4.0
        r, pairs = factors.rolling_correlation(x, y, w)
        for t in range(w, n):
            for s in range(3):
                on = np.isfinite(x[t - w : t, s]) & np.isfinite(y[t - w : t])
                p, q = x[t - w : t, s][on], y[t - w : t][on]
                assert pairs[t, s] == on.sum()
                want = 0.0 if len(p) < 2 or p.max() <= p.min() or q.max() <= q.min() else np.corrcoef(p, q)[0, 1]
                assert math.isclose(r[t, s], want, rel_tol=1e-6, abs_tol=1e-6)


def test_cutoffs_are_the_values_of_the_whole_order(spark):
    rng = np.random.default_rng(9)
    series = {
        "few": rng.normal(size=50), "one": np.array([4.0]), "many": rng.normal(size=30_000), "ties": np.r_[np.zeros(9000), rng.integers(-3, 4, 900)].astype(float),
        "wide": np.r_[rng.normal(size=5000), 1e300, -1e300, np.full(40, 1e12)], "heavy": rng.standard_cauchy(20_000),
    }
    rows = [("A", f, k, float(x)) for f, v in series.items() for k, x in enumerate(v)] + [("A", "few", 99, None), ("A", "none", 1, None)]
    got = {r.factor: (r._m, r._lo, r._hi) for r in factors.cutoffs(spark.createDataFrame(rows, "symbol string, factor string, time long, x double").repartition(5)).collect()}
    place = lambda v, q: float(np.sort(v)[int((len(v) - 1) * q)])
    assert got == {f: (len(v), place(v, 0.01), place(v, 0.99)) for f, v in series.items()}
