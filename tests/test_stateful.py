import math
import random

import pytest

from pyspark.sql import functions as F

from tickforge.config import TurtleConfig
from tickforge.operators import signals
from tickforge.sources.candles import time_to_live
from tickforge.streaming.positions import streamed_fetches, streamed_turtle

from . import loops

CONFIG = TurtleConfig(lookback=10, cooldown=2)
SCORED = "symbol string, time long, close double, total double"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def scored(n, seed, symbol):
    rng, total, out = random.Random(seed), 0.0, []
    for i in range(n):
        total = 0.9 * total + rng.gauss(0, 1)
        out.append((symbol, 1_000_000 + 60 * i, 50 + rng.random(), None if rng.random() < 0.05 else math.nan if rng.random() < 0.05 else total))
    return out


def streamed(spark, tmp_path, build, schema, batches, restart_after=()):
    """Rows that the stream gives out when `batches` come one by one; it is stopped and started anew after the named ones."""
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        if k in restart_after or k == len(batches) - 1:
            stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
            q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
            assert q.awaitTermination(100)
            assert q.exception() is None
    return spark.read.parquet(out)


def actions(rows):
    return sorted((r.symbol, r.time, r.action, r.units, None if r.pnl_pct is None else round(r.pnl_pct, 6)) for r in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_positions_do_not_depend_on_batches_restarts_or_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = {s: scored(120, seed * 10 + k, s) for k, s in enumerate("AB")}
    both = sorted((r for own in rows.values() for r in own), key=lambda r: r[1])
    cuts = sorted(rng.sample(range(20, 220), 3))
    batches = [both[a:b] for a, b in zip([0, *cuts], [*cuts, len(both)])]
    for part in batches:
        rng.shuffle(part)
    batches.append([("end", 10_000_000, 1.0, None)])
    got = streamed(spark, tmp_path, lambda s: streamed_turtle(s, CONFIG, "10 minutes"), SCORED, batches, restart_after={1})
    want = []
    for s, own in rows.items():
        bars = [(s, t, 0, 0, 0, close, 0) for _, t, close, _ in own]
        for time, action, units, pnl in loops.turtle(bars, [r[3] for r in own], lookback=10, cooldown=2):
            want.append((s, time, action, units, None if pnl is None else round(pnl, 6)))
    assert actions(got.collect()) == sorted(want, key=lambda r: r[:3]) and len(want) > 10


def test_late_bars_are_put_in_their_place(spark, tmp_path):
    rows = scored(100, 5, "A")
    late = rows[:40] + rows[45:60], rows[40:45] + rows[60:], [("end", 10_000_000, 1.0, None)]
    got = streamed(spark, tmp_path, lambda s: streamed_turtle(s, CONFIG, "1 hour"), SCORED, list(late))
    batch = spark.createDataFrame([(*r, i, 100) for i, r in enumerate(rows)], SCORED + ", i int, n int").withColumn("block", F.lit(0))
    want = signals.turtle_actions(batch.drop("block"), CONFIG)
    assert actions(got.collect()) == actions(want.collect()) != []


@pytest.fixture
def ends(spark):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_fetches_equal_the_loop(spark, tmp_path, ends):
    rng = random.Random(3)
    rows = sorted(((rng.choice("AB"), 1_704_157_200 + rng.randrange(0, 12 * 3600)) for _ in range(120)), key=lambda r: r[1])
    live = {r.t: r.ttl for r in spark.createDataFrame([(t,) for _, t in rows], "t long").select("t", time_to_live(F.col("t")).alias("ttl")).collect()}
    last, want = {}, []
    for s, t in rows:
        fetch = s not in last or t - last[s] > live[t]
        want.append((s, t, fetch))
        if fetch:
            last[s] = t
    batches = [rows[:31], rows[31:32], [(None, 5), ("A", None)], rows[32:]]
    got = streamed(spark, tmp_path, streamed_fetches, "symbol string, asked_at long", batches, restart_after={0})
    assert sorted((r.symbol, r.asked_at, r.fetch) for r in got.collect()) == sorted(want)
    assert {f for *_, f in want} == {True, False}


def test_state_that_is_let_go_is_fetched_again(spark, tmp_path, ends):
    batches = [[("A", 1_704_157_200)], [("A", 1_704_157_201)]]
    got = streamed(spark, tmp_path, lambda r: streamed_fetches(r, let_go_ms=1), "symbol string, asked_at long", batches, restart_after={0})
    assert [r.fetch for r in got.orderBy("asked_at").collect()] == [True, True]
