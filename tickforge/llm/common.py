"""What the operators share: tables kept in the shared folder, words and hashes in Arrow batches."""

import ctypes
import gc
import pickle
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that are worked on at once inside a task.
CHUNK_BYTES = 4 << 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the one that spark.checkpoint.dir names.

    Where it is unset, a session on one machine gets a temporary one. On a cluster that
    is an error: each machine would write to a disk that it alone can read.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tickforge-"))
    return context.getCheckpointDir()


def saved(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Writes the rows as Parquet to the shared folder and reads them back.

    The lineage ends there: lost executors cost no more than the files' reading.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of saved() that nothing reads any more.

    Spark deletes a shuffle's files once its plan is no longer referred to, which the
    driver finds out when it collects garbage: it is asked to, so that finished steps
    free their disk before the next one fills it.
    """
    spark = tables[0].sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for table in tables:
        path = jvm.org.apache.hadoop.fs.Path(table.kept_at)
        path.getFileSystem(conf).delete(path, True)
    tidy(spark)


def tidy(spark: SparkSession) -> None:
    """Has Spark free the disk of shuffles and broadcasts that nothing refers to any more.

    The listeners' queue refers to the last query's plan until another query has ended,
    so a query without a job goes first.
    """
    spark.sql("VALUES 1").collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget_part(table: DataFrame, part: str) -> None:
    """Deletes the files of one partition ("column=value") of a table of saved(), as forget() does a whole table."""
    files = table.limit(0)
    files.kept_at = f"{table.kept_at}/{part}"
    forget(files)


def broadcast(spark: SparkSession, value):
    """A function that gives the value in a task, where its class needs no installed package."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)


def crc_of_id(column: str = "doc_id"):
    """CRC-32 of an id's decimal text; of no bytes where the id is null."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def release() -> None:
    """Gives freed memory back, which two workers and the JVM of an executor share."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES):
    """Parts of a batch whose texts hold about `limit` bytes at most, a single long text excepted.

    Parts are copies: some Arrow kernels misread slices of a batch.
    """
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // limit
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    for start, end in zip(starts, np.r_[starts[1:], batch.num_rows]):
        yield batch.take(pa.array(np.arange(start, end))) if len(starts) > 1 else batch
        release()


def split_words(texts: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """All words (runs of other bytes than ASCII white space) one after another, and how many each text has.

    `lower` folds A-Z only. A null text has no words.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    full = pc.binary_length(flat).to_numpy() > 0
    before = np.r_[0, np.cumsum(full)]
    return flat.filter(pa.array(full)), np.diff(before[offsets - offsets[0]])


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word is hashed once."""
    coded = words.dictionary_encode()
    if not len(coded.dictionary):
        return np.zeros(0, np.uint64)
    table = np.fromiter(
        (xxhash.xxh3_64_intdigest(x) for x in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary)
    )
    return table[coded.indices.to_numpy()]


BASE = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def rolling_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes, in log2(k) vector steps; mixed so that all bits serve."""
    total, width, step, length = None, 0, words, 1
    while True:
        if k & 1:
            if total is None:
                total, width = step, length
            else:
                n = max(0, len(step) - width)
                total = total[:n] * _power(length) + step[width : width + n]
                width += length
        k >>= 1
        if not k:
            return mix(total)
        n = max(0, len(step) - length)
        step = step[:n] * _power(length) + step[length : length + n]
        length *= 2


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit over all."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def inside(lengths: np.ndarray, k: int, total: int) -> np.ndarray:
    """Which of the `total - k + 1` windows of k words lie in one text."""
    n = max(0, total - k + 1)
    text = np.repeat(np.arange(len(lengths)), lengths)
    return text[:n] == text[k - 1 : k - 1 + n]


def joined_words(words: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words joined by one space, and the byte places where each begins and ends."""
    if not len(words):
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
    length = pc.binary_length(words).to_numpy().astype(np.int64) + 1
    end = np.cumsum(length) - 1
    one = pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words)
    return pc.binary_join(one, pa.scalar(" ", words.type))[0].as_buffer().to_pybytes(), end - length + 1, end


def numbered(keys: DataFrame, by: list[str], name: str) -> DataFrame:
    """The rows with their place, from 0, in the order of `by`; ties in any order. Kept in the shared folder.

    Range partitions are counted, and each starts at the sum of those before it: one
    row a partition passes through one task, the rows themselves never do.
    """
    from pyspark.sql import Window

    ranged = saved(keys.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        ranged.groupBy("_part").agg(F.count("*").alias("_rows")).select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*by)).cast("long") - 1
    placed = ranged.withColumn("_nth", nth).join(F.broadcast(parts), "_part").withColumn(name, F.col("_nth") + F.col("_before"))
    out = saved(placed.drop("_part", "_nth", "_before"))
    forget(ranged)
    return out
