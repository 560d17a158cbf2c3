"""Exact top-k search by inner product over a pivot-distance index."""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast, forget, load, saved

#: Components are multiplied by this and rounded down.
SCALE = 1024

#: Rows of a block, and queries whose products with a block are held at once.
BLOCK, ROWS = 2048, 256

#: Pivots at most, rows that they are chosen from at most, and steps of distance that a pivot's rows are counted in.
PIVOTS, SAMPLE, STEPS = 64, 4096, 512

#: Share of the largest lengths by which bounds are loosened; distances in doubles are nearer to the true ones than that.
SLACK = 1e-6

#: Components beyond this are kept as doubles, in blocks that no bound spares.
LARGEST = 2**31 - 1


def usable(vector: Column) -> Column:
    """True for vectors that are not null and hold finite numbers only."""
    return F.coalesce(~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def scaled(vectors: DataFrame, queries: Column, id_col: str, vector_col: str) -> DataFrame:
    """(row, vec_id, asks, large, norm2, v), kept: usable vectors' integer components as 32-bit numbers, or as doubles where they are `large`."""
    rows = vectors.where(usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.coalesce(queries, F.lit(False)).alias("asks"), F.col(vector_col).cast("array<double>").alias("v")
    )

    def pack(batches):
        for batch in batches:
            lists = batch.column("v")
            x, size = lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy()
            with np.errstate(over="ignore"):
                whole = np.floor(SCALE * x)
            own = np.repeat(np.arange(len(size)), size)
            large = np.bincount(own[np.abs(whole) > LARGEST], minlength=len(size)) > 0
            norm2 = np.bincount(own, np.where(large[own], 0, whole) ** 2, len(size))
            end = np.cumsum(size)
            kept = [(x[e - n : e].astype("<f8") if big else whole[e - n : e].astype("<i4")).tobytes() for e, n, big in zip(end, size, large)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("asks"), pa.array(large), pa.array(norm2), pa.array(kept, pa.binary())], names=["vec_id", "asks", "large", "norm2", "v"]
            )

    packed = rows.mapInArrow(pack, "vec_id long, asks boolean, large boolean, norm2 double, v binary")
    return saved(packed.withColumn("row", F.monotonically_increasing_id()))


def matrix(kept: list[bytes], width: int) -> np.ndarray:
    """32-bit rows as doubles, cut or filled up with 0 to `width` components."""
    out = np.zeros((len(kept), width))
    kept = [x[: 4 * width] for x in kept]
    sizes = np.fromiter(map(len, kept), np.int64, len(kept)) // 4
    flat = np.frombuffer(b"".join(kept), "<i4")
    if (sizes == width).all():
        out[:] = flat.reshape(len(kept), width)
    else:
        out[np.repeat(np.arange(len(kept)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def integers(kept: bytes, large: bool) -> list[int]:
    """A row's components as unbounded integers."""
    if not large:
        return np.frombuffer(kept, "<i4").tolist()
    return [math.floor(SCALE * x) if abs(x) < 2.0**900 else int(x) * SCALE for x in np.frombuffer(kept, "<f8").tolist()]


@dataclass(frozen=True)
class Pivots:
    """Points that rows are keyed by: `place` with one component more, which brings each row to the length `radius`.

    With it, a query's distance to a row falls as their inner product rises: its square is
    |q|^2 + radius^2 - 2 q.v.
    """

    place: np.ndarray
    radius: float

    @property
    def width(self) -> int:
        return self.place.shape[1] - 1

    def distances(self, rows: np.ndarray, lifted: bool) -> np.ndarray:
        """Of each row to each pivot; queries are not lifted to the radius."""
        last = np.sqrt(np.maximum(0, self.radius**2 - (rows**2).sum(axis=1))) if lifted else np.zeros(len(rows))
        rows = np.c_[rows, last]
        square = (rows**2).sum(axis=1)[:, None] + (self.place**2).sum(axis=1) - 2 * rows @ self.place.T
        return np.sqrt(np.maximum(0, square))

    @property
    def step(self) -> float:
        """Width of a step of distance; no row is farther from a pivot than twice the radius."""
        return max(2 * self.radius, 1.0) * (1 + SLACK) / STEPS


def choose(sample: np.ndarray, radius: float, number: int) -> Pivots:
    """Pivots far from each other, moved to the middle of what is next to them; the same for the same sample."""
    lifted = np.c_[sample, np.sqrt(np.maximum(0, radius**2 - (sample**2).sum(axis=1)))]
    chosen, far = [0], ((lifted - lifted[0]) ** 2).sum(axis=1)
    while len(chosen) < number and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((lifted - lifted[chosen[-1]]) ** 2).sum(axis=1))
    place = lifted[chosen]
    for _ in range(5):
        near = ((place**2).sum(axis=1) - 2 * lifted @ place.T).argmin(axis=1)
        held = np.bincount(near, minlength=len(place))
        middle = np.zeros_like(place)
        np.add.at(middle, near, lifted)
        place = np.where(held[:, None] > 0, middle / np.maximum(held, 1)[:, None], place)
    return Pivots(place, radius)


@dataclass(frozen=True)
class Annuli:
    """Ranges of distance from a pivot, each of `parts` blocks of rows. `of` gives a pivot's step its annulus."""

    of: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    parts: np.ndarray

    def bounds(self, to_pivots: np.ndarray) -> np.ndarray:
        """The least distance that each annulus' rows can have from queries so far from the pivots, by the triangle inequality."""
        d = to_pivots[:, self.pivot]
        return np.maximum(np.maximum(d - self.high, self.low - d), 0)


def annuli(counts: np.ndarray, step: float, block: int) -> Annuli:
    """Neighbouring steps of each pivot (counts: rows by pivot and step) joined to annuli of about a block's rows; larger steps are annuli of several blocks."""
    of, pivot, low, high, parts = np.full(counts.shape, -1), [], [], [], []
    for p, own in enumerate(counts):
        rows = 0
        for s in np.flatnonzero(own):
            if not rows or rows + own[s] > block:
                pivot.append(p)
                low.append(s * step)
                high.append(0.0)
                parts.append(0)
                rows = 0
            rows += int(own[s])
            of[p, s], high[-1], parts[-1] = len(pivot) - 1, (s + 1) * step, -(-rows // block)
    return Annuli(of, *(np.array(x, t) for x, t in ((pivot, np.int64), (low, float), (high, float), (parts, np.int64))))


def best_products(q: pa.Table, block: pa.Table, k: int) -> pa.Table:
    """Each query's k rows of largest inner product in a block, of those that reach the query's `least`; ties to smaller ids."""
    ids = block.column("vec_id").combine_chunks()
    null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    rows, kept, q_row, q_kept = block.column("row").to_numpy(), block.column("v").to_pylist(), q.column("row").to_numpy(), q.column("v").to_pylist()
    least = q.column("least").to_pylist()
    exactly = any(block.column("large").to_pylist() + q.column("large").to_pylist())
    if not exactly:
        width = min(max(map(len, kept)), max(map(len, q_kept))) // 4
        c, a = matrix(kept, width), matrix(q_kept, width)
        exactly = float(np.abs(c).max(initial=0)) * float(np.abs(a).max(initial=0)) * width >= 2**53
    if exactly:
        c = [integers(x, big) for x, big in zip(kept, block.column("large").to_pylist())]
        a = [integers(x, big) for x, big in zip(q_kept, q.column("large").to_pylist())]
    at, nth, scores = [], [], []
    for i in range(len(q_row)):
        if exactly:
            score = np.array([min(max(sum(x * y for x, y in zip(a[i], v)), -(2**63)), 2**63 - 1) for v in c], np.int64)
        else:
            if i % ROWS == 0:
                products = (a[i : i + ROWS] @ c.T).astype(np.int64)
            score = products[i % ROWS]
        on = np.flatnonzero((rows != q_row[i]) & (score >= (-(2**63) if least[i] is None else least[i])))
        if len(on) > k:
            on = on[score[on] >= np.partition(score[on], len(on) - k)[len(on) - k]]
        on = on[np.lexsort((ids[on], null[on], ~score[on]))[:k]]  # ~x falls as x rises, for the least of longs too
        at.append(np.full(len(on), i))
        nth.append(on)
        scores.append(score[on])
    at, nth, scores = (np.concatenate(x) for x in (at, nth, scores))
    who = q.take(pa.array(at))
    return pa.Table.from_arrays([who.column("row"), who.column("vec_id"), pa.array(ids[nth], mask=null[nth]), pa.array(scores)], names=["row", "query_id", "vec_id", "score"])


def indexed(rows: DataFrame, pivots: Pivots, block: int) -> tuple[DataFrame, Annuli]:
    """The rows, kept with the annulus and the part of it that they lie in, and all annuli (PIVOTS * STEPS at most).

    Rows that are large or longer than the pivots have a further, last annulus, which no bound spares.
    """
    held = broadcast(rows.sparkSession, pivots)

    def key(batches):
        p = held()
        for batch in batches:
            fits = ~batch.column("large").to_numpy(zero_copy_only=False) & (pc.binary_length(batch.column("v")).to_numpy() <= 4 * p.width)
            own = np.flatnonzero(fits)
            d = p.distances(matrix(batch.column("v").take(pa.array(own)).to_pylist(), p.width), True)
            near = d.argmin(axis=1)
            step = np.minimum((d[np.arange(len(d)), near] / p.step).astype(np.int64), STEPS - 1)
            pivot, steps = np.full(batch.num_rows, -1), np.zeros(batch.num_rows, np.int64)
            pivot[own], steps[own] = near, step
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(steps)], names=[*batch.schema.names, "pivot", "step"])

    keyed = saved(rows.mapInArrow(key, "vec_id long, asks boolean, large boolean, norm2 double, v binary, row long, pivot long, step long"))
    found = keyed.groupBy("pivot", "step").count().toArrow()
    pivot, step, count = (found.column(c).to_numpy() for c in ("pivot", "step", "count"))
    counts = np.zeros((len(pivots.place), STEPS), np.int64)
    counts[pivot[pivot >= 0], step[pivot >= 0]] = count[pivot >= 0]
    made = annuli(counts, pivots.step, block)
    large = int(count[pivot < 0].sum())
    if large:
        made = Annuli(made.of, *(np.append(x, y) for x, y in ((made.pivot, 0), (made.low, -np.inf), (made.high, np.inf), (made.parts, -(-large // block)))))
    places = broadcast(rows.sparkSession, made)

    def dealt(batches):
        a = places()
        for batch in batches:
            pivot, step, row = (batch.column(c).to_numpy() for c in ("pivot", "step", "row"))
            of = np.where(pivot >= 0, a.of[pivot, step], len(a.pivot) - 1)
            mixed = (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            part = mixed.astype(np.int64) % a.parts[of]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "large", "v")), pa.array(of), pa.array(part)], names=["row", "vec_id", "large", "v", "annulus", "part"])

    return keyed.mapInArrow(dealt, "row long, vec_id long, large boolean, v binary, annulus long, part long"), made


def routed(queries: DataFrame, pivots: Pivots, made: Annuli, first: int, last: int) -> DataFrame:
    """Each query at the blocks of its `first`-th to `last`-th nearest annuli, as far as they can hold a row that reaches its `least`."""
    held = broadcast(queries.sparkSession, (pivots, made))

    def route(batches):
        p, a = held()
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                some = batch.take(pa.array(np.arange(s, min(s + ROWS, batch.num_rows))))
                large = some.column("large").to_numpy(zero_copy_only=False)
                norm = np.sqrt(some.column("norm2").to_numpy())
                kept = [b"" if big else x for x, big in zip(some.column("v").to_pylist(), large)]
                # Components of a query beyond the pivots' width meet none of the rows that have bounds.
                bound = a.bounds(p.distances(matrix(kept, p.width), False))
                cut = np.minimum(norm, 1e150)
                least = some.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
                square = cut**2 + p.radius**2 - 2 * least
                reach = np.where(np.isnan(least), np.inf, np.sqrt(np.maximum(0, square))) + 2 * SLACK * (cut + p.radius)
                bound[large], reach[large] = 0, np.inf
                order = np.argsort(bound, axis=1, kind="stable")[:, first:last]
                near = np.take_along_axis(bound, order, axis=1) <= reach[:, None]
                query, nth = np.nonzero(near)
                annulus = order[query, nth]
                n = a.parts[annulus]
                query, annulus = np.repeat(query, n), np.repeat(annulus, n)
                part = np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n)
                for o in range(0, len(query), 4096):
                    e = slice(o, o + 4096)
                    who = some.take(pa.array(query[e]))
                    yield pa.RecordBatch.from_arrays(
                        [*(who.column(c) for c in ("row", "vec_id", "large", "v")), pa.array(annulus[e]), pa.array(part[e]), who.column("least")],
                        names=["row", "vec_id", "large", "v", "annulus", "part", "least"],
                    )

    return queries.mapInArrow(route, "row long, vec_id long, large boolean, v binary, annulus long, part long, least long")


def searched(index: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """(row, query_id, vec_id, score): the k best rows for each query in each block it is routed to.

    Blocks and queries are dealt and sorted together, each block before its queries; a
    task holds one block and streams over the queries.
    """
    both = index.withColumns({"least": F.lit(None).cast("long"), "asks": F.lit(False)}).unionByName(asks.withColumn("asks", F.lit(True)))
    dealt = both.repartition("annulus", "part").sortWithinPartitions("annulus", "part", "asks")

    def run(batches):
        key, block = None, []
        for batch in batches:
            annulus, part = batch.column("annulus").to_numpy(), batch.column("part").to_numpy()
            asking = batch.column("asks").to_numpy(zero_copy_only=False)
            change = np.flatnonzero((annulus[1:] != annulus[:-1]) | (part[1:] != part[:-1]) | (asking[1:] != asking[:-1])) + 1
            for at in np.split(np.arange(batch.num_rows), change):
                if not len(at):
                    continue
                if (annulus[at[0]], part[at[0]]) != key:
                    key, block = (annulus[at[0]], part[at[0]]), []
                some = pa.Table.from_batches([batch.take(pa.array(at))])
                if not asking[at[0]]:
                    block.append(some)
                elif block:
                    block = [pa.concat_tables(block).combine_chunks()]
                    yield from best_products(some, block[0], k).to_batches()

    return dealt.mapInArrow(run, "row long, query_id long, vec_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_last("vec_id")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame,
    queries: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    pivots: int = PIVOTS,
    sample: int = SAMPLE,
    block: int = BLOCK,
    rounds: tuple[int, ...] = (1, 16),
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest integer inner product for each query row.

    Components become floor(1024 x). Rows are keyed by their nearest pivot and the distance
    to it, and each pivot's rows are cut into annuli of about `block` rows; one that more
    rows share, such as copies of one vector, is dealt to several blocks. A query expands
    its annuli from the nearest on: the nearest `rounds[0]`, the next `rounds[1]`, then all
    others. After each round it knows a score that k rows reach, and by the triangle
    inequality leaves out every annulus that cannot hold a row that reaches it too. So
    the result is exact, however far the bounds help.

    Pivots are chosen from `sample` rows, those of smallest hash; they decide how much is
    left out, not what is found. The driver gets the sample, and counts by pivot and step
    of distance. Ties go to the smaller vec_id, a null one being largest. Vectors that
    are null or hold null or non-finite components take no part; where lengths differ,
    missing components count as 0. Rows that share a vec_id are rows of their own. Sums
    beyond a long's range are given as its ends. No usable rows give no rows.
    """
    spark = vectors.sparkSession
    rows = scaled(vectors, queries, id_col, vector_col)
    small = rows.where("NOT large")
    total, radius2 = rows.agg(F.count("*"), F.coalesce(F.max(F.when(~F.col("large"), F.col("norm2"))), F.lit(0.0))).first()
    seen = [r.v for r in small.select("v", F.xxhash64("row").alias("h")).orderBy("h").limit(sample).collect()]
    usual = 4 * sorted(map(len, seen))[len(seen) // 2] if seen else 0
    seen = [x for x in seen if len(x) <= usual]
    width = max([1, *(len(x) // 4 for x in seen)])
    chosen = choose(matrix(seen or [b""], width), math.sqrt(radius2), max(1, min(pivots, total // block)))
    index, made = indexed(rows, chosen, block)
    index = saved(index)
    asking = rows.where("asks").select("row", "vec_id", "large", "norm2", "v")
    best, first = None, 0
    for last in (*np.cumsum(rounds).tolist(), len(made.pivot)):
        if first >= len(made.pivot):
            break
        if best is None:
            known = asking.withColumn("least", F.lit(None).cast("long"))
        else:
            kth = best.groupBy("row").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
            known = asking.join(kth, "row", "left")
        found = searched(index, routed(known, chosen, made, first, last), k)
        was, best = best, saved(ranked(found.unionByName(best.drop("rank")) if best is not None else found, k))
        if was is not None:
            forget(was)
        first = last
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return best.select("query_id", "rank", "vec_id", "score")


def op13_pivots(spark, sf_dir: str) -> DataFrame:
    """The 10 vectors of highest integer inner product to each whose vec_id is divisible by 100; see top_k() for nulls, ties, repeats and empty tables."""
    return top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r <> c.r
)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank, vec_id, score FROM p QUALIFY rank <= 10
"""
