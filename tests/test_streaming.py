from pyspark.sql import functions as F

from tickforge.sources import candles as S
from tickforge.streaming.candles import streamed_candles, streamed_ema

from . import loops


def drain(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_streamed_candles_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    late = events.orderBy(F.desc("ts")).limit(1).select("ts").first().ts
    far = events.limit(1).withColumn("ts", F.lit(late).cast("timestamp_ntz") + F.expr("INTERVAL 30 DAYS")).withColumn("event_type", F.lit("end"))
    events.unionByName(far).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = drain(streamed_candles(stream, F.col("event_type"), "ts", F.col("value")), "candles", tmp_path)
    got = {(r.symbol, r.t): (r.open, r.high, r.low, r.close, r.volume) for r in got.withColumn("t", F.unix_seconds("start")).collect() if r.symbol != "end"}
    want = {(r.symbol, r.time): (r.open, r.high, r.low, r.close, r.volume) for r in S.hourly_candles(events).collect()}
    assert got == want and len(got) > 500


def test_streamed_mean_equals_the_batch(spark, tmp_path):
    bars = S.with_places(S.hourly_candles(spark.read.parquet("/root/testdata/sf0.001/events.parquet")))
    path = str(tmp_path / "in")
    for part in range(3):  # three batches in the order of time
        bars.where(f"i % 1000 >= {part * 60} AND i % 1000 < {part * 60 + 60}").select("symbol", "time", "close").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("symbol string, time long, close double").option("maxFilesPerTrigger", 1).parquet(path)
    got = {(r.symbol, r.time): r.ema for r in drain(streamed_ema(stream), "ema", tmp_path).collect()}
    for symbol in {r.symbol for r in bars.select("symbol").distinct().collect()}:
        own = bars.where(F.col("symbol") == symbol).where("i < 180").orderBy("time").collect()
        for r, want in zip(own, loops.smooth([r.close for r in own], 0, 12, 2 / 13)):
            have = got[r.symbol, r.time]
            assert want is None and (have is None or have != have) or abs(have - want) < 1e-9
