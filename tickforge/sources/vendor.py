"""Recorded vendor replies as a data source: spark.read.format("vendor_replies").load(folder)."""

import json
import re

from pyarrow import fs

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

REPLIES = "symbol string, qfqday array<array<string>>, day array<array<string>>"


def folder(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


class Reply(InputPartition):
    def __init__(self, symbol: str, path: str):
        super().__init__(symbol)
        self.symbol, self.path = symbol, path


class ReplyReader(DataSourceReader):
    """A partition for each symbol's file; filters on the symbol leave out files before any is opened."""

    def __init__(self, path: str):
        self.path, self.wanted = path, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("symbol",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self):
        store, path = folder(self.path)
        files = store.get_file_info(fs.FileSelector(path))
        named = [(f.base_name.removesuffix(".json"), f.path) for f in files if f.base_name.endswith(".json")]
        return [Reply(s, p) for s, p in sorted(named) if self.wanted is None or s in self.wanted]

    def read(self, partition):
        if partition is None:  # no file is left
            return
        store, _ = folder(self.path)
        with store.open_input_stream(partition.path) as f:
            reply = json.loads(f.read())
        for body in (reply.get("data") or {}).values():
            text = lambda rows: None if rows is None else [[None if c is None else str(c) for c in r if not isinstance(c, (dict, list))] for r in rows]
            yield partition.symbol, text(body.get("qfqday")), text(body.get("day"))


class VendorReplies(DataSource):
    """Files {symbol}.json, each a reply {"data": {code: {"qfqday" or "day": [[date, open, close, high, low, volume, ...], ...]}}}."""

    @classmethod
    def name(cls):
        return "vendor_replies"

    def schema(self):
        return REPLIES

    def reader(self, schema):
        return ReplyReader(self.options["path"])


def vendor_replies(spark: SparkSession, path: str, symbols: list[str] | None = None) -> DataFrame:
    """(symbol, qfqday, day) of recorded replies; only the named symbols' files are opened."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VendorReplies)
    replies = spark.read.format("vendor_replies").load(path)
    return replies.where(F.col("symbol").isin(symbols)) if symbols is not None else replies


def dropped(replies: DataFrame, candles: DataFrame) -> DataFrame:
    """(symbol, rows, dropped): how many rows each symbol's replies hold, and how many of them are not among its decoded candles."""
    rows = replies.groupBy("symbol").agg(F.sum(F.coalesce(F.size(F.coalesce("qfqday", "day")), F.lit(0))).alias("rows"))
    kept = candles.groupBy("symbol").agg(F.count("*").alias("kept"))
    return rows.join(kept, "symbol", "left").select("symbol", "rows", (F.col("rows") - F.coalesce("kept", F.lit(0))).alias("dropped"))
