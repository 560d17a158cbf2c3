"""Contiguous shards of nearly equal bytes from global prefix sums."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import load, saved


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals the documents, in the order of their ids, into shards that are cut at equal byte targets.

    Rows are range-partitioned by id; each partition's total bytes and rows give
    the prefix at which it starts, and a running sum inside it gives each row's
    own. The row whose middle byte lies in the s-th of `shards` equal parts goes to
    shard s, so a shard's bytes differ from the target by one document at most.

    Returns id, size, text_crc32, shard, slot. A null or empty text has the size 1.
    Rows that repeat an id (or have none: they come first) keep the order in which
    they are read, so one id may lie on both sides of a cut. Equal texts are not
    held together: the order of ids decides. Only the id and the text are read, so
    further columns of any name do no harm. No rows give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = saved(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    ranged = saved(rows.repartitionByRange("doc_id", "row").withColumn("part", F.spark_partition_id()))

    # One row for each partition, so their order fits in one task and their table in a broadcast.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = (
        ranged.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        .select(
            "part",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(whole).alias("all_bytes"),
        )
    )
    inner = Window.partitionBy("part").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        ranged.withColumn("upto", F.sum("size").over(inner))
        .withColumn("nth", F.count("*").over(inner))
        .join(F.broadcast(parts), "part")
        .withColumn("middle", 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size"))
        .withColumn("shard", F.expr(f"cast(middle * {int(shards)} div (2 * all_bytes) as int)"))
        .withColumn("nth", F.col("rows_before") + F.col("nth") - 1)
    )
    starts = placed.groupBy("shard").agg(F.min("nth").alias("first"))
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("nth") - F.col("first")).alias("slot")
    )


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document in one of 8 shards of near equal bytes, in the order of doc_id."""
    return shard_by_bytes(load(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


OP7_SQL = r"""
WITH RECURSIVE bits(b, v, k) AS (
  SELECT b::UBIGINT, b::UBIGINT, 0 FROM range(256) t(b)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), steps AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
s AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::UBIGINT),
      lambda a, x: xor(a >> 8, t[(xor(a, x) & 255)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM documents, steps
), p AS (
  SELECT *, (2 * sum(size) OVER (ORDER BY doc_id) - size)::BIGINT AS middle, (sum(size) OVER ())::BIGINT AS all_bytes FROM s
), q AS (SELECT *, (middle * 8 // (2 * all_bytes))::INTEGER AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard FROM q
"""
