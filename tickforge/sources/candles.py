"""Candle tables: derived from events and orders, decoded from vendor rows, and kept in a table by symbol."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.guards import percent_encoded
from ..functions.windows import by_symbol
from ..operators.blocks import placed

CANDLES = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("time", T.LongType(), False)]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]
)
PRICES = ("open", "high", "low", "close", "volume")


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    return ((ts - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")).cast("interval second")).cast("bigint")


def with_places(candles: DataFrame) -> DataFrame:
    """Adds i, each bar's place from 0, and n, the symbol's number of bars; see blocks.placed()."""
    return placed(candles)


def bars(rows: DataFrame, symbol: Column, time: Column, order: Column, price: Column) -> DataFrame:
    """One candle for each symbol and time: first, highest, lowest and last price in `order`, and the number of rows as volume.

    One aggregation that Spark combines before the shuffle; rows without a price or a
    time are left out.
    """
    rows = rows.select(symbol.alias("symbol"), time.alias("time"), order.alias("_o"), price.cast("double").alias("_p"))
    return (
        rows.where("time IS NOT NULL AND _p IS NOT NULL")
        .groupBy("symbol", "time")
        .agg(
            F.min_by("_p", "_o").alias("open"),
            F.max("_p").alias("high"),
            F.min("_p").alias("low"),
            F.max_by("_p", "_o").alias("close"),
            F.count("*").cast("double").alias("volume"),
        )
    )


def hourly_candles(events: DataFrame) -> DataFrame:
    seconds = epoch_seconds(F.col("ts"))
    return bars(events, F.col("event_type"), seconds - F.pmod(seconds, F.lit(3600)), F.col("ts"), F.col("value"))


def daily_candles(orders: DataFrame) -> DataFrame:
    seconds = epoch_seconds(F.col("o_orderdate"))
    return bars(orders, F.col("o_orderpriority"), seconds - F.pmod(seconds, F.lit(86400)), F.col("o_orderkey"), F.col("o_totalprice"))


def date_seconds(text: Column) -> Column:
    """Midnight UTC of a yyyy-MM-dd date; null for anything else."""
    strict = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    return F.date_diff(strict, F.lit("1970-01-01").cast("date")).cast("bigint") * 86400


def decoded_vendor_rows(replies: DataFrame) -> DataFrame:
    """Candles of vendor replies: symbol, and array<array<string>> in qfqday (preferred) or day.

    A row holds date, open, close, high, low, volume as text, in this order; rows with
    a cell that is missing or no number are dropped.
    """
    rows = replies.select("symbol", F.explode(F.coalesce("qfqday", "day")).alias("r"))
    cell = lambda k: F.get("r", F.lit(k)).try_cast("double")
    candles = rows.select(
        "symbol",
        date_seconds(F.get("r", F.lit(0))).alias("time"),
        cell(1).alias("open"),
        cell(3).alias("high"),
        cell(4).alias("low"),
        cell(2).alias("close"),
        cell(5).alias("volume"),
    )
    return candles.dropna(subset=["time", *PRICES])


def exchange_symbol(code: Column) -> Column:
    """sh before codes of six characters that begin with 6, sz before those with 0 or 3; null for others."""
    six = F.octet_length(code) == 6
    return F.when(six & code.startswith("6"), F.concat(F.lit("sh"), code)).when(six & code.rlike("^[03]"), F.concat(F.lit("sz"), code))


def market_open(seconds: Column) -> Column:
    """Whether the market is open at these UTC seconds: UTC+8, Monday to Friday, 9:00-11:30 and 13:00-15:00, the ends' minutes included."""
    local = seconds + 8 * 3600
    minute = F.floor(F.pmod(local, F.lit(86400)) / 60)
    weekday = F.pmod(F.floor(local / 86400) + 3, F.lit(7))  # 1 January 1970 was a Thursday; Monday is 0
    return (weekday <= 4) & (minute.between(9 * 60, 11 * 60 + 30) | minute.between(13 * 60, 15 * 60))


def time_to_live(seconds: Column) -> Column:
    """Seconds for which stored candles count as fresh."""
    return F.when(market_open(seconds), 5 * 60).otherwise(2 * 3600)


def tail(candles: DataFrame, n: int) -> DataFrame:
    """The most recent n bars of each symbol."""
    place = F.row_number().over(by_symbol().orderBy(F.desc("time")))
    return candles.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def upserted(stored: DataFrame, new: DataFrame, key: str = "symbol", at: str = "fetched_at") -> DataFrame:
    """Rows of both, the latest of each key; of equally late ones the new."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc("_new")))
    return both.withColumn("_place", place).where("_place = 1").drop("_place", "_new")


def fresh(stored: DataFrame, now: Column, least: int) -> DataFrame:
    """Stored symbols (symbol, day_count, fetched_at in seconds) with `least` days or more that are no older than the time to live."""
    return stored.where((F.col("day_count") >= least) & (now - F.col("fetched_at") <= time_to_live(now)))


def write_store(candles: DataFrame, path: str) -> None:
    """Replaces the symbols that `candles` holds, and leaves others: partitions by symbol are overwritten one by one."""
    writer = candles.repartition("symbol").sortWithinPartitions("time").write.partitionBy("symbol")
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_store(spark: SparkSession, path: str, symbols: list[str] | None = None) -> DataFrame:
    """The stored candles; only the partitions of the named symbols are read."""
    stored = spark.read.schema(CANDLES).parquet(path)
    return stored.where(F.col("symbol").isin(symbols)) if symbols else stored


def cached_or_fetched(stored: DataFrame, meta: DataFrame, fetched: DataFrame, now: Column, days: int) -> DataFrame:
    """The last `days` bars of symbols whose stored candles are fresh, and of all others those fetched."""
    good = fresh(meta, now, days).select("symbol")
    return tail(stored.join(good, "symbol", "left_semi"), days).unionByName(fetched.join(good, "symbol", "left_anti"))


def request_url(base: str, code: Column, days: int) -> Column:
    return F.concat(F.lit(f"{base}?param="), percent_encoded(F.concat(exchange_symbol(code), F.lit(f",day,,,{days},qfq"))))
