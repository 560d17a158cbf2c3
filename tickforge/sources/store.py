"""Candles kept in bucketed tables, beside a table of how many bars of each symbol there are and when they were fetched."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .candles import PRICES, fresh, tail
from .shared import kept

#: The setting, to be "false", by which joins of stores need no exchange.
WITHOUT_EXCHANGE = "spark.sql.requireAllClusterKeysForCoPartition"


class CandleStore:
    """Two tables in `folder`, known to the session as {name}_candles and {name}_meta.

    Candles are bucketed by (symbol, span), a span being `span` seconds, and sorted by
    time: a symbol that holds much of the table lies in many buckets, and tables with the
    same buckets are joined by symbol, span and time without an exchange, if the session
    says that a part of a join's keys will do for that (WITHOUT_EXCHANGE; it is left to the
    session, as it holds for all of its joins). Each bucket is a partition of its own,
    named by `part`, so that one bucket can be replaced.

    A folder that holds tables already is opened as it is; `buckets` and `span` must then
    be those that it was made with. One writer at a time. Rows without a symbol or a time
    are left out; of repeated times any row stays.
    """

    def __init__(self, spark: SparkSession, name: str, folder: str, buckets: int = 64, span: int = 1 << 25):
        self.spark, self.buckets, self.span = spark, buckets, span
        self.candles_table, self.meta_table = f"{name}_candles", f"{name}_meta"
        prices = ", ".join(f"{p} DOUBLE" for p in PRICES)
        self._create(self.candles_table, f"{folder}/candles", f"symbol STRING, span BIGINT, time BIGINT, {prices}", "symbol, span", "symbol, time")
        self._create(self.meta_table, f"{folder}/meta", "symbol STRING, day_count BIGINT, fetched_at BIGINT", "symbol", "symbol")

    def _create(self, table: str, path: str, columns: str, by: str, order: str) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({columns}, part INT) USING parquet OPTIONS (partitionOverwriteMode 'dynamic') "
            f"PARTITIONED BY (part) CLUSTERED BY ({by}) SORTED BY ({order}) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )
        # Writing no rows makes the folder where it is missing; partitions that lie in it are looked for.
        self.spark.table(table).limit(0).write.insertInto(table)
        self.spark.sql(f"MSCK REPAIR TABLE {table}")

    def _part(self, *by: str) -> Column:
        return F.pmod(F.hash(*by), F.lit(self.buckets)).cast("int")

    def spanned(self, df: DataFrame) -> DataFrame:
        """Adds span, by which stored candles are bucketed, to rows with a time."""
        return df.withColumn("span", F.floor(F.col("time") / self.span))

    @property
    def candles(self) -> DataFrame:
        """(symbol, span, time, open, high, low, close, volume)"""
        return self.spark.table(self.candles_table).drop("part")

    @property
    def meta(self) -> DataFrame:
        """(symbol, day_count, fetched_at)"""
        return self.spark.table(self.meta_table).drop("part")

    def read(self, symbols: list[str] | None = None) -> DataFrame:
        """Stored candles; the filter on symbols reaches the files' scan."""
        rows = self.candles.drop("span")
        return rows if symbols is None else rows.where(F.col("symbol").isin(symbols))

    def upsert(self, candles: DataFrame, fetched_at: int | Column) -> list[int]:
        """Replaces all bars of the symbols that `candles` holds, and tells the candle buckets that were written.

        Other buckets' files are not touched. What comes is computed once and kept in the
        shared folder; of what is stored, the symbols are read, and the buckets they lie in. The symbols' bars are replaced before what is
        known of them, so that after a failure between the two they are fetched once more.
        """
        at = F.lit(fetched_at) if isinstance(fetched_at, int) else fetched_at
        rows = candles.where("symbol IS NOT NULL AND time IS NOT NULL").dropDuplicates(["symbol", "time"])
        rows = self.spanned(rows.select("symbol", "time", *PRICES, at.cast("bigint").alias("fetched_at")))
        rows = kept(rows.withColumn("part", self._part("symbol", "span")))
        meta = rows.groupBy("symbol").agg(F.count("*").alias("day_count"), F.max("fetched_at").alias("fetched_at"))
        written = self._replace(self.candles_table, rows.drop("fetched_at"), ["symbol", "span"])
        self._replace(self.meta_table, meta.withColumn("part", self._part("symbol")), ["symbol"])
        return written

    def _replace(self, table: str, rows: DataFrame, by: list[str]) -> list[int]:
        stored, symbols = self.spark.table(table), rows.select("symbol").distinct()
        coming = self._parts(rows)
        touched = sorted(coming | self._parts(stored.join(symbols, "symbol", "left_semi")))
        if not touched:
            return []
        others = stored.where(F.col("part").isin(touched)).join(symbols, "symbol", "left_anti")
        emptied = set(touched) - coming - self._parts(others)
        # A dynamic overwrite moves finished files in place of the old ones, so the table may be read meanwhile.
        merged = others.unionByName(rows).repartition(self.buckets, *by)
        merged.select(*stored.columns).write.insertInto(table, overwrite=True)
        empty = ", ".join(f"CAST(NULL AS {kind})" for c, kind in stored.dtypes if c != "part")
        for part in emptied:
            self.spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (part = {part}) SELECT {empty} WHERE false")
        self.spark.catalog.refreshTable(table)
        return touched

    @staticmethod
    def _parts(rows: DataFrame) -> set[int]:
        """The buckets that rows lie in: as many as there are buckets at most."""
        return {r.part for r in rows.select("part").distinct().collect()}

    def through(self, fetched: DataFrame, now: int, days: int) -> DataFrame:
        """The last `days` bars of each symbol that is fresh or in `fetched`; of those not fresh, fetched bars replace the stored ones first."""
        good = fresh(self.meta, F.lit(now), days).select("symbol")
        self.upsert(fetched.join(good, "symbol", "left_anti"), now)
        # What was missing is stored by now, and the table of what is known has it.
        names = fresh(self.meta, F.lit(now), days).select("symbol").union(fetched.select("symbol")).distinct()
        return tail(self.read().join(names, "symbol", "left_semi"), days)
