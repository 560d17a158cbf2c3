"""Exact nearest neighbours by a block matrix join of int8 tiles with error bounds."""

import heapq
from itertools import groupby

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import load, saved

#: Queries of a tile whose products are held at once.
ROWS = 256


def usable(vector: Column) -> Column:
    """True for vectors that are not null, not zero and hold finite numbers only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(table: pa.Table) -> np.ndarray:
    lists = table.column("v").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale, length of the coded vector, length of what the code leaves out."""
    scale = np.abs(x).max(axis=1) / 127
    code = np.rint(x / scale[:, None]).astype(np.int8)
    near = code * scale[:, None]
    return code, scale, np.linalg.norm(near, axis=1), np.linalg.norm(x - near, axis=1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows in double precision, summed from the first component on."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def tile(q: np.ndarray, q_row: np.ndarray, c: np.ndarray, c_row: np.ndarray, c_id: np.ndarray, k: int):
    """For each query its k nearest candidates of the tile: arrays of query index, candidate index, score.

    The int8 product differs from the true one by |left out q| |c| + |coded q| |left out c|
    at most. What cannot reach the k-th largest lower bound is dropped; the rest is
    computed in double precision.
    """
    qc, qs, qn, qe = quantise(q)
    cc, cs, cn, ce = quantise(c)
    c_length = np.linalg.norm(c, axis=1)
    right = cc.astype(np.float32).T  # sums of products of codes are integers that float32 holds exactly up to 1000 components
    kind = np.float32 if q.shape[1] <= 1000 else np.float64
    out = []
    for s in range(0, len(q), ROWS):
        e = s + ROWS
        near = (qc[s:e].astype(kind) @ right.astype(kind, copy=False)).astype(np.float64) * qs[s:e, None] * cs
        bound = (np.outer(qe[s:e], c_length) + np.outer(qn[s:e], ce)) * (1 + 1e-9) + 1e-300
        # Products or lengths that overflow leave no bound: such candidates survive.
        low, high = np.nan_to_num(near - bound, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.nan_to_num(near + bound, nan=np.inf, posinf=np.inf, neginf=-np.inf)
        own = q_row[s:e, None] == c_row
        low[own] = high[own] = -np.inf
        if len(c) > k:
            least = np.partition(low, len(c) - k, axis=1)[:, len(c) - k]
        else:
            least = np.full(len(low), -np.inf)
        i, j = np.nonzero((high >= least[:, None]) & ~own)
        score = exact(q[s:e][i], c[j])
        by = np.lexsort((c_id[j], -score, i))
        i, j, score = i[by], j[by], score[by]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        keep = nth < k
        out.append((i[keep] + s, j[keep], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*out))


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    query_block: int = 16384,
    candidate_block: int = 16384,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product for each query row.

    `queries` is the condition that makes a row of `vectors` a query; every row is a
    candidate for all queries but itself. Rows are dealt by hash into blocks of about
    the given sizes; each pair of a query block and a candidate block is a tile, to
    which both blocks are shuffled, so a task holds two blocks whatever the table's
    size. Tiles' results, k a query, are merged by heaps. Nothing is approximate in the
    end: bounds only spare products, so recall is 1.

    Ties go to the smaller vec_id. Vectors that are null, zero, empty or hold null or
    non-finite components take no part; those of another dimension than a query's are
    no candidates for it. Rows that share a vec_id are rows of their own. With fewer
    candidates all are returned; no usable rows give no rows. Sums that overflow are
    infinite scores; sums of opposite infinities are no numbers and come last.
    """
    rows = saved(
        vectors.where(usable(F.col(vector_col)))
        .select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("dim", F.size("v"))
    )
    asked, total = rows.agg(F.count_if("asks"), F.count("*")).first()
    q_blocks, c_blocks = max(1, -(-asked // query_block)), max(1, -(-total // candidate_block))
    in_block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.where("asks").select("dim", "vec_id", "row", "v", in_block(q_blocks).alias("qb"), every(c_blocks).alias("cb"))
    right = rows.select("dim", "vec_id", "row", "v", in_block(c_blocks).alias("cb"), every(q_blocks).alias("qb"))

    def products(q: pa.Table, c: pa.Table) -> pa.Table:
        names = ["query_row", "query_id", "vec_id", "score"]
        if not q.num_rows or not c.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())], names=names)
        number = lambda t, name: t.column(name).to_numpy()
        i, j, score = tile(_matrix(q), number(q, "row"), _matrix(c), number(c, "row"), number(c, "vec_id"), k)
        return pa.Table.from_arrays([pa.array(number(q, "row")[i]), pa.array(number(q, "vec_id")[i]), pa.array(number(c, "vec_id")[j]), pa.array(score)], names=names)

    found = (
        left.groupBy("dim", "qb", "cb")
        .cogroup(right.groupBy("dim", "qb", "cb"))
        .applyInArrow(products, "query_row long, query_id long, vec_id long, score double")
    )

    def merged(batches):
        def stream():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        out: list[tuple] = []
        names = ["query_id", "rank", "vec_id", "score"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)
        for _, group in groupby(stream(), key=lambda r: r[0]):
            best = heapq.nsmallest(k, group, key=lambda r: (-r[3], r[2]))
            out += [(q, n, v, s) for n, (_, q, v, s) in enumerate(best, 1)]
            if len(out) > 20_000:
                yield pack()
                out = []
        if out:
            yield pack()

    dealt = found.repartition("query_row").sortWithinPartitions("query_row")
    return dealt.mapInArrow(merged, "query_id long, rank int, vec_id long, score double")


def op6_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of all vectors to each whose vec_id is divisible by 20."""
    return nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM p
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
