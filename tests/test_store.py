import os
import uuid

import pytest

from pyspark.sql import functions as F

from tickforge.sources.candles import market_open
from tickforge.sources.store import WITHOUT_EXCHANGE, CandleStore

BARS = "symbol string, time long, open double, high double, low double, close double, volume double"
DAY = 86400


def bars(spark, symbols, n, price=1.0, first=0):
    return spark.createDataFrame([(s, (first + t) * DAY, *[price] * 5) for s in symbols for t in range(n)], BARS)


@pytest.fixture
def store(spark, tmp_path):
    return CandleStore(spark, f"t{uuid.uuid4().hex}", str(tmp_path / "store"), buckets=8, span=100 * DAY)


def held(store):
    return {(r.symbol, r.time // DAY): r.close for r in store.read().collect()}


def parquet_of(folder):
    return {os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def test_bars_of_a_symbol_are_replaced_and_others_stay(spark, store):
    store.upsert(bars(spark, ["A", "B"], 350), 10)
    store.upsert(bars(spark, ["B", "C"], 30, 2.0), 20)
    want = {("A", t): 1.0 for t in range(350)} | {(s, t): 2.0 for s in "BC" for t in range(30)}
    assert held(store) == want
    assert {tuple(r) for r in store.meta.collect()} == {("A", 350, 10), ("B", 30, 20), ("C", 30, 20)}


def test_only_touched_buckets_are_written(spark, store, tmp_path):
    folder = str(tmp_path / "store" / "candles")
    store.upsert(bars(spark, [f"S{k}" for k in range(40)], 5), 10)
    before = parquet_of(folder)
    written = store.upsert(bars(spark, ["S7"], 5, 3.0), 20)
    after = parquet_of(folder)
    assert len(written) == 1 and len(before) == 8 and len(before & after) == 7
    assert held(store) == {(f"S{k}", t): 3.0 if k == 7 else 1.0 for k in range(40) for t in range(5)}


def test_buckets_that_lose_all_rows_are_emptied(spark, store):
    store.upsert(bars(spark, ["A"], 350), 10)
    store.upsert(bars(spark, ["A"], 1, 2.0), 20)
    assert held(store) == {("A", 0): 2.0}


def test_nulls_repeats_nothing_and_other_columns(spark, store):
    assert store.upsert(bars(spark, [], 0), 10) == [] and store.read().count() == 0 and store.meta.count() == 0
    odd = bars(spark, ["A", None], 3).union(bars(spark, ["A"], 2)).withColumn("part", F.lit("x")).withColumn("span", F.lit(None))
    store.upsert(odd, 10)
    assert held(store) == {("A", t): 1.0 for t in range(3)} and tuple(store.meta.first()) == ("A", 3, 10)


def test_a_folder_is_opened_again_by_another_name(spark, store, tmp_path):
    store.upsert(bars(spark, ["A", "B"], 5), 10)
    again = CandleStore(spark, f"t{uuid.uuid4().hex}", str(tmp_path / "store"), buckets=8, span=100 * DAY)
    again.upsert(bars(spark, ["B"], 5, 2.0), 20)
    assert held(again) == {(s, t): 1.0 if s == "A" else 2.0 for s in "AB" for t in range(5)}


def test_stored_tables_are_joined_without_an_exchange(spark, store, tmp_path):
    other = CandleStore(spark, f"t{uuid.uuid4().hex}", str(tmp_path / "other"), buckets=8, span=100 * DAY)
    for s in (store, other):
        s.upsert(bars(spark, ["A", "B"], 250), 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set(WITHOUT_EXCHANGE, "false")
    try:
        joined = store.candles.join(other.candles.select("symbol", "span", "time", F.col("close").alias("other")), ["symbol", "span", "time"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset(WITHOUT_EXCHANGE)


def test_the_filter_on_symbols_reaches_the_scan(spark, store):
    store.upsert(bars(spark, ["A", "B"], 5), 10)
    rows = store.read(["B"])
    assert {r.symbol for r in rows.collect()} == {"B"}
    assert "PushedFilters: [In(symbol, [B])" in rows._jdf.queryExecution().toString() or "EqualTo(symbol,B)" in rows._jdf.queryExecution().toString()


def test_a_read_through_the_store_fetches_what_is_not_fresh(spark, store):
    now = 1_704_160_800  # a Tuesday, 10:00 in UTC+8: fresh for five minutes
    assert spark.range(1).select(market_open(F.lit(now))).first()[0]
    store.upsert(bars(spark, ["fresh"], 5), now - 300)
    store.upsert(bars(spark, ["old", "unasked"], 5), now - 301)
    store.upsert(bars(spark, ["short"], 2), now)
    fetched = bars(spark, ["fresh", "old", "short", "new"], 4, 2.0, first=3)
    got = {(r.symbol, r.time // DAY): r.close for r in store.through(fetched, now, 3).collect()}
    assert got == {("fresh", t): 1.0 for t in (2, 3, 4)} | {(s, t): 2.0 for s in ("old", "short", "new") for t in (4, 5, 6)}
    assert {r.symbol: (r.day_count, r.fetched_at) for r in store.meta.collect()} == {
        "fresh": (5, now - 300), "unasked": (5, now - 301), "old": (4, now), "short": (4, now), "new": (4, now)
    }
