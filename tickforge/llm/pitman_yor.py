"""Scoring texts with a hierarchical Pitman-Yor model whose seating is sampled by Gibbs."""

import pickle
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, crc_of_id, forget, forget_part, load, mix, release, saved, split_words, tidy
from .seating import Tables, gammas, uniforms

#: The hash of the end token; no word can be a line feed.
END = xxhash.xxh3_64_intdigest(b"\n")
#: Tokens whose pairs a task adds up before it hands them on.
GATHERED = 2_000_000
#: Places of pairs that a task holds before it asks for them: two tasks share an executor's memory with its heap.
PLACES = 1 << 19
#: Training tokens of a shard of pairs, about.
SHARD = 1 << 20
#: Shards in which tokens are counted, before it is known how many there are.
COUNTED = 1 << 10
#: Ranks whose sums one block has.
RANGE = 1 << 11
#: A token's key is its rank, or its hash with this bit set, which makes it negative.
RARE = np.uint64(1 << 63)


@dataclass(frozen=True)
class Tokens:
    """Tokens of some texts, each text followed by the end token."""

    known: np.ndarray  # hashes of the distinct tokens
    token: np.ndarray  # of each token: its place in `known`
    text: np.ndarray  # of each token: its text
    before: np.ndarray  # of each token: the place in `known` of the token before it; the end token before a text


def tokens(texts: pa.Array) -> Tokens:
    words, count = split_words(texts, lower=True)
    coded = words.dictionary_encode()
    distinct = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    known = np.fromiter([*map(xxhash.xxh3_64_intdigest, distinct), END], np.uint64, len(distinct) + 1)
    ends = np.cumsum(count + 1) - 1
    token = np.full(len(words) + len(count), len(known) - 1, np.int64)
    own = np.ones(len(token), bool)
    own[ends] = False
    token[own] = coded.indices.to_numpy()
    return Tokens(known, token, np.repeat(np.arange(len(count)), count + 1), np.r_[len(known) - 1, token[:-1]] if len(token) else token)


def place_of(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Each key's place in the sorted table, or the table's length."""
    at = np.searchsorted(table, keys)
    return np.where(table[np.minimum(at, len(table) - 1)] == keys, at, len(table)) if len(table) else at


@dataclass(frozen=True)
class Ranks:
    """The commonest tokens' hashes in rising order, and the rank of each."""

    hashes: np.ndarray
    rank: np.ndarray

    def keys(self, known: np.ndarray) -> np.ndarray:
        at, by = np.empty(len(known), np.int64), np.argsort(known)
        at[by] = place_of(self.hashes, known[by])
        found = at < len(self.hashes)
        return np.where(found, self.rank[np.minimum(at, len(self.rank) - 1)] if len(self.rank) else 0, (known | RARE).view(np.int64))


def count_tokens(docs: DataFrame) -> DataFrame:
    """How often each token occurs: rows (w, n) of a shard's tokens each, by their hashes, as bytes of 64-bit integers.

    Tasks add up what they read and hand on a block of bytes for each shard.
    """

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def flush():
            (w,), n = summed([np.concatenate([x[0] for x in held])], np.concatenate([x[1] for x in held]))
            by, edges = dealt(w, COUNTED)
            full = pa.array(np.flatnonzero(np.diff(edges)))
            columns = [pa.array(np.arange(COUNTED, dtype=np.int32)), cut(w[by], edges), cut(n[by], edges)]
            return pa.RecordBatch.from_arrays([c.take(full) for c in columns], names=["shard", "w", "n"])

        for batch in batches:
            for part in chunks(batch):
                t = tokens(part.column("text"))
                n = np.bincount(t.token, minlength=len(t.known))
                held.append((t.known[n > 0].view(np.int64), n[n > 0].astype(np.int64)))
                rows += len(held[-1][0])
                if rows >= GATHERED // 2:
                    yield flush()
                    held, rows = [], 0
        if rows:
            yield flush()

    def merge(key, table):
        (w,), n = summed([opened(table.column("w"))], opened(table.column("n")))
        return pa.table([pa.array([x.tobytes()], pa.binary()) for x in (w, n)], names=["w", "n"])

    return docs.select("text").mapInArrow(count, "shard int, w binary, n binary").groupBy("shard").applyInArrow(merge, "w binary, n binary")


def least_count(counted: DataFrame, count: str, most: int, times: str = "1") -> int:
    """A count that `most` rows at most have or exceed, from a histogram in steps of a 64th of a power of two. A row stands for `times` rows."""
    step = F.ceil(F.log2(count) * 64)
    rows, least = 0, 1 << 62
    for r in counted.groupBy(step.alias("s")).agg(F.expr(f"sum({times})").alias("rows"), F.min(count).alias("least")).orderBy(F.desc("s")).collect():
        rows += r.rows
        if rows > most:
            break
        least = r.least
    return least


def rank_tokens(docs: DataFrame, most: int) -> tuple[Ranks, int]:
    """Ranks for `most` of the commonest tokens at most, by their counts over all texts; and how many tokens there are."""
    counts = saved(count_tokens(docs))
    often = counts.select("n").mapInArrow(cell_counts, "n long, cells long").groupBy("n").agg(F.sum("cells").alias("cells"))
    least, total = least_count(often, "n", most, "cells"), often.agg(F.sum(F.col("n") * F.col("cells"))).first()[0] or 0

    def common(batches):
        for b in batches:
            w, n = opened(b.column("w")), opened(b.column("n"))
            yield pa.RecordBatch.from_arrays([pa.array(w[n >= least]), pa.array(n[n >= least])], names=["w", "n"])

    top = counts.mapInArrow(common, "w long, n long").toArrow()
    hashes, n = top.column("w").to_numpy(), top.column("n").to_numpy()
    by = np.lexsort((hashes, -n))
    hashes = hashes[by].view(np.uint64)
    order = np.argsort(hashes)
    forget(counts)
    return Ranks(hashes[order], order.astype(np.int64)), total


def cut(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of the values between each two edges."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(values.tobytes())])


def opened(column, kind=np.int64) -> np.ndarray:
    """The values of all that cut() gave, one after another."""
    return np.frombuffer(b"".join(column.drop_null().to_pylist()), kind)


def edges_of(column, kind=np.int64) -> np.ndarray:
    """The edges in opened() of what each row holds."""
    return np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64) // np.dtype(kind).itemsize)]


def sides(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """History and token of pairs of ranked tokens, which are history << 32 | token."""
    return pair >> 32, pair & 0xFFFFFFFF


def dealt(key: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys by their shard, else as they are, and the edges of the shards."""
    shard = (mix(key.view(np.uint64)) % np.uint64(shards)).astype(np.uint16 if shards < 1 << 16 else np.int64)
    by = np.argsort(shard, kind="stable")
    return by, np.searchsorted(shard[by], np.arange(shards + 1))


def summed(keys: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct keys in rising order, and each one's sum."""
    by = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    keys = [k[by] for k in keys]
    first = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]) if len(n) else np.zeros(0, np.int64)
    return [k[first] for k in keys], np.add.reduceat(n[by], first) if len(n) else n


def count_pairs(docs: DataFrame, ranks: Ranks, shards: int) -> DataFrame:
    """How often token w follows token h, by their keys, dealt into shards by the pair; kept in the shared folder.

    Of each shard one row (shard, single, pair, n) has its pairs of ranked tokens in
    rising order: those that occur once, and the others with their counts, as bytes of
    64-bit integers. Pairs with a rare token are rows (h, w, c) of their own.
    Tasks add up what they read and hand on a block of bytes for each shard.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks.hashes, ranks.rank))

    def count(batches):
        ranks = Ranks(*shared.value)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def blocks(key, h, w, n):
            by, edges = dealt(key, shards)
            full = pa.array(np.flatnonzero(np.diff(edges)))
            second = pa.nulls(shards, pa.binary()) if w is None else cut(w[by], edges)
            columns = [pa.array(np.arange(shards, dtype=np.int32)), cut(h[by], edges), second, cut(n[by], edges)]
            return pa.RecordBatch.from_arrays([c.take(full) for c in columns], names=["shard", "h", "w", "n"])

        def flush():
            h, w = (np.concatenate([x[i] for x in held]) for i in range(2))
            ranked = (h >= 0) & (w >= 0)
            pair, n = np.unique(h[ranked] << 32 | w[ranked], return_counts=True)
            yield blocks(pair, pair, None, n)
            (h, w), n = summed([h[~ranked], w[~ranked]], np.ones(len(h) - ranked.sum(), np.int64))
            yield blocks(mixed(h, w).view(np.int64), h, w, n)

        for batch in batches:
            for part in chunks(batch):
                t = tokens(part.column("text"))
                keys = ranks.keys(t.known)
                held.append((keys[t.before], keys[t.token]))
                rows += len(t.token)
                if rows >= GATHERED:
                    yield from flush()
                    held, rows = [], 0
        if rows:
            yield from flush()

    def merge(key, table):
        rare = pc.is_valid(table.column("w"))
        ranked, rare = table.filter(pc.invert(rare)), table.filter(rare)
        (pair,), n = summed([opened(ranked.column("h"))], opened(ranked.column("n")))
        (h, w), c = summed([opened(rare.column("h")), opened(rare.column("w"))], opened(rare.column("n")))
        many, rows = n > 1, len(c)
        ours = [pa.array([x.tobytes()], pa.binary()) for x in (pair[~many], pair[many], n[many])]
        columns = [pa.concat_arrays([x, pa.nulls(rows, pa.binary())]) for x in ours] + [pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(x)]) for x in (h, w, c)]
        return pa.table([pa.array(np.full(rows + 1, key[0].as_py(), np.int32)), *columns], names=["shard", "single", "pair", "n", "h", "w", "c"])

    found = docs.select("text").mapInArrow(count, "shard int, h binary, w binary, n binary")
    out = saved(found.groupBy("shard").applyInArrow(merge, "shard int, single binary, pair binary, n binary, h long, w long, c long"))
    shared.destroy()
    return out


def blocks_of(table: DataFrame, key: str, shards: int) -> DataFrame:
    """The rows of a table of 64-bit columns as blocks: a row has those of one shard of the key, a column's values as bytes."""
    names, kinds = table.columns, [np.float64 if t == "double" else np.int64 for _, t in table.dtypes]

    def pack(batches):
        held: list[list[np.ndarray]] = []
        rows = 0

        def flush():
            values = [np.concatenate([x[i] for x in held]) for i in range(len(names))]
            by, edges = dealt(values[names.index(key)], shards)
            full = pa.array(np.flatnonzero(np.diff(edges)))
            columns = [pa.array(np.arange(shards, dtype=np.int32)), *(cut(x[by], edges) for x in values)]
            return pa.RecordBatch.from_arrays([c.take(full) for c in columns], names=["shard", *names])

        for b in batches:
            held.append([np.array(c.to_numpy(), k) for c, k in zip(b.columns, kinds)])
            rows += b.num_rows
            if rows >= PLACES:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    return table.mapInArrow(pack, ", ".join(["shard int", *(f"{c} binary" for c in names)]))


def mixed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(h.view(np.uint64)) + w.view(np.uint64)


def sums_by_rank(packed: DataFrame, columns: list[str], tally, names: list[str], size: int) -> DataFrame:
    """(key, *names): of each ranked key the sums of what tally(batch) has, an array by rank for each name; none where the first is zero.

    Tasks add up what they read and hand on a block of bytes for each RANGE of ranks.
    """
    parts, many = -(-size // RANGE), len(names)

    def count(batches):
        sums = np.zeros((many, size), np.int64)
        for b in batches:
            sums += tally(b)
        keys = np.flatnonzero(sums[0])
        edges = np.searchsorted(keys, np.arange(parts + 1) * RANGE)
        blocks = [pa.array(np.arange(parts, dtype=np.int32)), cut((keys % RANGE).astype(np.uint16), edges), cut(sums[:, keys].T.ravel(), edges * many)]
        full = pa.array(np.flatnonzero(np.diff(edges)))
        yield pa.RecordBatch.from_arrays([x.take(full) for x in blocks], names=["part", "at", "sums"])

    def add(key, table):
        at, sums = opened(table.column("at"), np.uint16), opened(table.column("sums")).reshape(-1, many)
        sums = [np.bincount(at, x, RANGE).astype(np.int64) for x in sums.T]
        keys = np.flatnonzero(sums[0])
        return pa.table([pa.array(key[0].as_py() * RANGE + keys), *(pa.array(x[keys]) for x in sums)], names=["key", *names])

    found = packed.select(*columns).mapInArrow(count, "part int, at binary, sums binary")
    return found.groupBy("part").applyInArrow(add, ", ".join(f"{x} long" for x in ["key", *names]))


def tallied(packed: DataFrame, side: int, size: int) -> DataFrame:
    """(key, n, single, again, twice) of ranked histories (side 0) or tokens (1): customers, cells of one, of more and of two."""

    def tally(b):
        one, more, n = sides(opened(b.column("single")))[side], sides(opened(b.column("pair")))[side], opened(b.column("n"))
        one, again = np.bincount(one, minlength=size), np.bincount(more, minlength=size)
        return np.stack([one + np.bincount(more, n, size).astype(np.int64), one, again, np.bincount(more[n == 2], minlength=size)])

    return sums_by_rank(packed, ["single", "pair", "n"], tally, ["n", "single", "again", "twice"], size)


def seats_of(packed: DataFrame, side: int, size: int) -> DataFrame:
    """(key, t): tables of the cells of ranked histories (side 0) or tokens (1)."""

    def tally(b):
        return np.bincount(sides(opened(b.column("pair")))[side], opened(b.column("t")), size).astype(np.int64)[None]

    return sums_by_rank(packed, ["pair", "t"], tally, ["t"], size)


def cell_counts(batches):
    """(n, cells): how many cells have n customers; some rows an n."""
    for b in batches:
        n, cells = np.unique(opened(b.column("n")), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(cells)], names=["n", "cells"])


def discount_of(once: float, twice: float) -> float:
    return float(np.clip(once / max(1.0, once + 2 * twice), 0.1, 0.95))


def _unsigned(column) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


@dataclass(frozen=True)
class PitmanYor:
    """A model: what was counted, and the seating in each of its samples.

    Cells have h, w, n, tables (the sum over the samples). packed: those of ranked
    tokens by shard, as bytes of 64-bit integers, pair (h << 32 | w), n and tables; these
    two are null where all are one customer's. rare: the others. restaurants: h, customers,
    sampled (tables of each sample). roots: w, count, sampled (customers at the root).
    """

    packed: DataFrame
    rare: DataFrame
    shards: int
    restaurants: DataFrame
    roots: DataFrame
    ranks: Ranks
    types: int
    train_tokens: int
    root_customers: list[int]  # of each sample
    discount: float
    root_discount: float
    concentration: float

    @property
    def samples(self) -> int:
        return len(self.root_customers)

    @property
    def cells(self) -> DataFrame:
        return self.ranked_cells(1).union(self.rare)

    def ranked_cells(self, least: int) -> DataFrame:
        """Cells of ranked tokens and `least` customers or more."""
        samples = self.samples

        def unpack(batches):
            for b in batches:
                for row in range(b.num_rows):
                    pair, n, tables = cell_arrays(b.slice(row, 1), samples)
                    some = n >= least
                    columns = (*sides(pair[some]), n[some], tables[some])
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["h", "w", "n", "tables"])

        return self.packed.where(F.lit(least <= 1) | F.col("n").isNotNull()).mapInArrow(unpack, "h long, w long, n long, tables long")


def cell_arrays(packed, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, customers and tables of PitmanYor.packed."""
    single = pc.is_null(packed.column("n"))
    one, packed = opened(packed.column("pair").filter(single)), packed.filter(pc.invert(single))
    first, many = np.ones(len(one), np.int64), [opened(packed.column(c)) for c in ("pair", "n", "tables")]
    return tuple(np.concatenate(x) for x in zip((one, first, samples * first), many))


def train(
    docs: DataFrame, burn_in: int = 1, samples: int = 3, concentration: float = 1.0, ranked_words: int = 1 << 19, seed: int = 11
) -> PitmanYor:
    """Learns from every row of `docs` (text). A null text is empty: one end token.

    Each history, which is the token before (the end token before a text's first), has a
    restaurant, whose dishes are the tokens that follow it. All restaurants share the
    root: a table of theirs is a customer of the root, where each token has one table.
    The root's new tables are new tokens. Both levels' discounts come from how many cells
    (and root dishes) have one and two customers.

    A Gibbs sweep draws, in turn and each given all others,
    1. of each restaurant: x ~ Gamma(concentration / discount + its tables), which makes its cells independent;
    2. of the root: the tokens' probabilities, Dirichlet(customers - discount, ..., what is left for new tokens);
    3. of each cell (history, token) with n customers: its tables t, from their exact law,
       S(n, t) (discount * x * probability)^t (see Tables). Cells of one customer have one table.
    After `burn_in` sweeps the next `samples` are kept. All draws are named by their keys,
    so results do not depend on partitions. Sums go by token and by history through
    Spark; `ranked_words` of the commonest tokens' values at most are broadcast, the
    others are joined. No texts give a model in which every token is new.
    """
    ranks, total = rank_tokens(docs, ranked_words)
    shards, size = total // SHARD + 1, len(ranks.hashes)
    counted = count_pairs(docs, ranks, shards)
    packed = counted.where(F.col("h").isNull())
    rare = counted.where(F.col("h").isNotNull()).select("h", "w", F.col("c").alias("n"))
    own = [F.col("n"), *[F.expr(f"CAST(n {x} AS LONG)") for x in ("= 1", "> 1", "= 2")]]

    def totals(side: int, key: str, count: str) -> DataFrame:
        each = tallied(packed, side, size).union(rare.select(key, *own)).groupBy(F.col("key").alias(key))
        return saved(each.agg(F.sum("n").alias(count), *[F.sum(c).alias(c) for c in ("single", "again", "twice")]))

    restaurants, roots = totals(0, "h", "customers"), totals(1, "w", "count")
    got = restaurants.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(x) for c, x in (("single", "once"), ("twice", "twice"))]).first()
    tables, idle = F.col("single") + F.col("again"), F.col("again") == 0
    at_root = roots.agg(
        F.count("*").alias("types"),
        F.sum("count").alias("tokens"),
        F.count_if(tables == 1).alias("once"),
        F.count_if(tables == 2).alias("twice"),
        F.count_if(idle).alias("idle"),
        F.coalesce(F.sum(F.when(idle, F.col("single"))), F.lit(0)).alias("idle_customers"),
    ).first()
    discount, root_discount, types = discount_of(got.once, got.twice), discount_of(at_root.once, at_root.twice), at_root.types
    # Of histories and tokens whose cells have one customer each, nothing is ever drawn but the sum of their shares of the root.
    idle_shape = concentration + root_discount * types + at_root.idle_customers - root_discount * at_root.idle

    def drawn(table: DataFrame, key: str, sweep: int) -> DataFrame:
        """(key, t, x): what the sweep draws, Gamma(t + shift), for each row (key, t); kept. The shift of histories lifts, that of tokens lowers."""
        shift, stream = (concentration / discount, 1) if key == "h" else (-root_discount, 2)

        def draw(batches):
            for b in batches:
                x = gammas(b.column("t").to_numpy() + shift, _unsigned(b.column(key)), seed, sweep, stream)
                yield pa.RecordBatch.from_arrays([b.column(key), b.column("t"), pa.array(x)], names=[key, "t", "x"])

        return saved(table.select(key, "t").mapInArrow(draw, f"{key} long, t long, x double"))

    def of_ranked(table: DataFrame, key: str) -> np.ndarray:
        top, ranked = table.where(F.col(key) >= 0).select(key, "x").toArrow(), np.zeros(size)
        ranked[top.column(key).to_numpy()] = top.column("x").to_numpy()
        return ranked

    # The class needs no installed package in a task.
    law_of = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(Tables(discount)))

    def seated(law, h, w, n, x, g):
        key = mixed(h, w)
        return law.draw(n, discount * x * g / mass, uniforms(key, seed, sweep, 3), uniforms(key, seed, sweep, 4))

    def seat_ranked(batches):
        law, (x, g) = pickle.loads(law_of.value), shared.value
        for b in batches:
            pair, n, total = (opened(b.column(c)) for c in ("pair", "n", "total"))
            h, w = sides(pair)
            t = seated(law, h, w, n, x[h], g[w])
            edges, total = edges_of(b.column("pair")), (total if len(total) else np.zeros(len(t), np.int64)) + (t if sweep >= burn_in else 0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("shard", "pair", "n")), cut(t, edges), cut(total, edges)], names=["shard", "pair", "n", "t", "total"])

    def seat_joined(batches):
        law = pickle.loads(law_of.value)
        for b in batches:
            h, w, n, total, x, g = (c.to_numpy() for c in b.columns)
            t = seated(law, h, w, n, x, g)
            columns = (h, w, n, t, total + (t if sweep >= burn_in else 0))
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["h", "w", "n", "t", "total"])

    ranked = packed.select("shard", "pair", "n", F.lit(None).cast("binary").alias("total"))
    once, rare = rare.where("n = 1"), rare.where("n > 1").select("h", "w", "n", F.lit(0).cast("long").alias("total"))
    rooms, dishes = (drawn(base.where(~idle).select(key, tables.alias("t")), key, 0) for base, key in ((restaurants, "h"), (roots, "w")))
    last: list[DataFrame] = []
    samples_of: list[tuple[DataFrame, DataFrame]] = []
    root_customers: list[int] = []
    for sweep in range(burn_in + samples):
        others = gammas(np.array([idle_shape]), np.array([seed], np.uint64), seed, sweep, 5)
        mass = (dishes.agg(F.sum("x")).first()[0] or 0.0) + float(others[0])
        shared = docs.sparkSession.sparkContext.broadcast((of_ranked(rooms, "h"), of_ranked(dishes, "w")))
        joined = rare.join(rooms.select("h", "x"), "h").join(dishes.select("w", F.col("x").alias("g")), "w").select("h", "w", "n", "total", "x", "g")
        done = [*last, *([rooms, dishes] if sweep <= burn_in else [])]
        ranked = saved(ranked.select("shard", "pair", "n", "total").mapInArrow(seat_ranked, "shard int, pair binary, n binary, t binary, total binary"))
        rare = saved(joined.mapInArrow(seat_joined, "h long, w long, n long, t long, total long"))
        shared.destroy()
        summed_up = [
            base.where(~idle)
            .select(key, F.col("single").alias("t"))
            .union(seats_of(ranked, side, size))
            .union(rare.select(key, "t"))
            .groupBy(key)
            .agg(F.sum("t").alias("t"))
            for side, (base, key) in enumerate(((restaurants, "h"), (roots, "w")))
        ]
        # The next sweep's draws are made as the tables are added up.
        rooms, dishes = (drawn(t, k, sweep + 1) if sweep + 1 < burn_in + samples else saved(t) for t, k in zip(summed_up, "hw"))
        del summed_up
        last = [ranked, rare]
        if sweep >= burn_in:
            samples_of.append((rooms, dishes))
            root_customers.append(at_root.idle_customers + (dishes.agg(F.sum("t")).first()[0] or 0))
        forget(*done)
    final = []
    for base, key, keep, side in ((restaurants, "h", "customers", 0), (roots, "w", "count", 1)):
        each = None
        for i, tables_of in enumerate(samples_of):
            one = tables_of[side].select(key, F.lit(i).alias("i"), "t")
            each = each.union(one) if each else one
        each = each.groupBy(key).agg(F.array(*[F.sum(F.when(F.col("i") == i, F.col("t"))) for i in range(samples)]).alias("sampled"))
        alone = F.array(*[F.col("single")] * samples)
        final.append(saved(base.where(~idle).join(each, key).select(key, keep, "sampled").union(base.where(idle).select(key, keep, alone))))
    law_of.destroy()
    forget(restaurants, roots, *[t for pair in samples_of for t in pair])
    none = F.lit(None).cast("binary")
    alike = packed.select("shard", F.col("single").alias("pair"), none.alias("n"), none.alias("tables"))
    return PitmanYor(
        alike.union(ranked.select("shard", "pair", "n", "total")),
        once.select("h", "w", "n", F.lit(samples).cast("long").alias("tables")).union(rare.select("h", "w", "n", "total")),
        shards,
        *final,
        ranks,
        types,
        at_root.tokens or 0,
        root_customers,
        discount,
        root_discount,
        concentration,
    )


def predictive(model: PitmanYor) -> tuple[DataFrame, DataFrame, Column]:
    """(restaurants, roots, p): p is the averaged probability of a cell's row that is left-joined with both.

    In each sample a token has (n - discount * tables) / (concentration + customers) of
    its history's restaurant, and the rest of the restaurant, (concentration + discount *
    all tables) / (concentration + customers), times its probability at the root.
    """
    many = range(model.samples)
    in_all = 1 / (F.lit(model.concentration) + F.col("customers"))
    restaurants = model.restaurants.select(
        "h", in_all.alias("in_all"), *[((model.concentration + model.discount * F.col("sampled")[i]) * in_all).alias(f"a{i}") for i in many]
    )
    totals = [model.concentration + c for c in model.root_customers]
    roots = model.roots.select("w", "count", *[((F.col("sampled")[i] - model.root_discount) / totals[i]).alias(f"b{i}") for i in many])
    new = [(model.concentration + model.root_discount * model.types) / t for t in totals]
    back = sum((F.coalesce(F.col(f"a{i}"), F.lit(1.0)) * F.coalesce(F.col(f"b{i}"), F.lit(new[i])) for i in many), F.lit(0.0)) / model.samples
    own = (F.col("n") - model.discount / model.samples * F.col("tables")) * F.col("in_all")
    return restaurants, roots, F.coalesce(own, F.lit(0.0)) + back


@dataclass(frozen=True)
class Chances:
    """The averaged probabilities of pairs of ranked tokens, as predictive() has them, from arrays by rank."""

    in_all: np.ndarray
    rooms: np.ndarray  # a0, a1, ...
    roots: np.ndarray  # b0, b1, ...
    share: float  # of a table of a cell, in a sample's mean

    def of(self, pair: np.ndarray, n: np.ndarray, tables: np.ndarray) -> np.ndarray:
        h, w = sides(pair)
        own = np.where(n > 0, (n - self.share * tables) * self.in_all[h], 0.0)
        return own + sum(a[h] * b[w] for a, b in zip(self.rooms, self.roots)) / len(self.rooms)


def score(docs: DataFrame, model: PitmanYor, keep: dict[str, Column] | None = None, dense_pairs: int = 1 << 20, passes: int = 2) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score and score of each row, with the columns `keep`.

    score is the sum over a text's tokens of log10 of the predictive probability, which is
    averaged over the model's samples; 10 ** (-score / n_tokens) is the perplexity. A
    token that training lacked has what the root leaves for new tokens. base_score is the
    same of add-one unigrams over the training tokens. n_known counts tokens seen in
    training. A null or empty text is one end token; repeated rows are scored each; no
    rows give none.

    The probabilities of at most `dense_pairs` of the commonest pairs of ranked tokens are
    broadcast. Other pairs are folded by tasks into a block of bytes for each shard, by the
    pair or, where one side is a rare token, by that token: the distinct pairs, how many
    places each has and the places' texts. Each shard meets its cells, and its rare tokens'
    restaurants or roots; what it adds to texts goes back to where the block came from.
    Rare tokens that follow a rare one are joined to their cells by (history, token), to
    their restaurant and to their root; what they add to their text is summed up. Each text
    is tokenised once. Pairs of two ranked tokens or of two rare ones are worked off in
    `passes` turns, a power of two, by their shard or by the lowest bits in which their keys
    differ, so that less is shuffled at once; for the same reason the kinds of pairs are
    taken in turn, and what a turn has read and shuffled is deleted.
    """
    spark = docs.sparkSession
    restaurants, roots, p = predictive(model)
    size, many, unit = len(model.ranks.hashes), range(model.samples), float(model.train_tokens + model.types + 1)

    def by_rank(table: DataFrame, key: str, columns: list[str]) -> np.ndarray:
        got, out = table.where(f"{key} >= 0").select(key, *columns).toArrow(), np.zeros((len(columns), size))
        for x, c in zip(out, columns):
            x[got.column(key).to_numpy()] = got.column(c).to_numpy()
        return out

    room, root = by_rank(restaurants, "h", ["in_all", *[f"a{i}" for i in many]]), by_rank(roots, "w", ["count", *[f"b{i}" for i in many]])
    chances = Chances(room[0], room[1:], root[1:], model.discount / model.samples)
    counts = model.packed.where("n IS NOT NULL").mapInArrow(cell_counts, "n long, cells long")
    singles = model.packed.where("n IS NULL").select(F.lit(1).cast("long"), F.expr("length(pair) div 8"))
    pairs = model.ranked_cells(least_count(counts.union(singles).where("cells > 0"), "n", dense_pairs, "cells"))
    top = pairs.select(F.expr("shiftleft(h, 32) | w").alias("pair"), "n", "tables").toArrow()
    pair, n, tables = (top.column(c).to_numpy() for c in top.column_names)
    by = np.argsort(pair)
    dense = pair[by], np.log10(chances.of(pair[by], n[by], tables[by]))
    shared = spark.sparkContext.broadcast((model.ranks.hashes, model.ranks.rank, *dense, np.log10((root[0] + 1) / unit)))
    del top, pair, n, tables, by, dense, room, root
    release()
    keep = keep or {c: F.col(c) for c in docs.columns}
    own = {c: f"_keep{i}" for i, c in enumerate(keep)}
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "text", *[c.alias(own[x]) for x, c in keep.items()])
    kinds = "".join(f", {x} {rows.schema[x].dataType.simpleString()}" for x in own.values())
    schema = f"row long, h long, w long, n_tokens long, n_known long, base_score double, score double{kinds}, shard int, pair binary, other binary, times binary, at binary, kind int"
    names = [*["row", "h", "w", "n_tokens", "n_known", "base_score", "score"], *own.values(), *["shard", "pair", "other", "times", "at", "kind"]]
    texts_kind, seen, shards, samples = -1, F.col("count").isNotNull(), model.shards, model.samples

    def look_up(batches):
        hashes, rank, pair, chance, base = shared.value
        ranks = Ranks(hashes, rank)
        # By kind: ranked pairs, or rare tokens and the ranked one beside each; and their rows.
        held: list[list[tuple[np.ndarray, ...]]] = [[], [], []]
        places = 0

        def batch_of(kind, columns, kept):
            length = len(columns["row"])
            types = {"row": pa.int64(), "h": pa.int64(), "w": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64(), "shard": pa.int32(), "pair": pa.binary(), "other": pa.binary(), "times": pa.binary(), "at": pa.binary()} | kept
            columns = columns | {"kind": pa.array(np.broadcast_to(kind, length).astype(np.int32))}
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(length, types[c]) for c in names], names=names)

        def flush(kind):
            *keys, row = (np.concatenate(x) for x in zip(*held[kind]))
            by = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
            keys, at = [x[by] for x in keys], row[by] - row.min()
            first = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in keys], axis=0)])
            times = np.diff(np.r_[first, len(at)])
            order, edges = dealt(keys[0][first], shards)
            # The places of a pair move with it.
            begin = np.r_[0, np.cumsum(times[order])]
            at = at[np.repeat(first[order] - begin[:-1], times[order]) + np.arange(len(at))]
            full = np.flatnonzero(np.diff(edges))
            columns = {
                "row": pa.array(np.full(shards, row.min())),
                "shard": pa.array(np.arange(shards, dtype=np.int32)),
                "pair": cut(keys[0][first][order], edges),
                "times": cut(times[order].astype(np.uint32), edges),
                "at": cut(at.astype(np.uint32), begin[edges]),
            }
            columns |= {"other": cut(x[first][order].astype(np.uint32), edges) for x in keys[1:]}
            return batch_of(kind if kind else 4 * (full % passes), {k: x.take(pa.array(full)) for k, x in columns.items()}, kept)

        for batch in batches:
            kept = {x: batch.schema.field(x).type for x in own.values()}
            for part in chunks(batch):
                t = tokens(part.column("text"))
                row, texts = part.column("row"), part.num_rows
                keys = ranks.keys(t.known)
                h, w = keys[t.before], keys[t.token]
                common = w >= 0
                both = common & (h >= 0)
                # Rising pairs are found faster, and each but once.
                asked, text = h[both] << 32 | w[both], t.text[both]
                by = np.argsort(asked)
                asked, text = asked[by], text[by]
                first = np.flatnonzero(np.r_[True, asked[1:] != asked[:-1]]) if len(asked) else np.zeros(0, np.int64)
                dense = np.repeat(place_of(pair, asked[first]), np.diff(np.r_[first, len(asked)]))
                hit = dense < len(pair)
                of = np.zeros(len(keys))
                of[keys >= 0] = base[keys[keys >= 0]]
                sums = {
                    "n_tokens": np.bincount(t.text, minlength=texts).astype(np.int64),
                    "n_known": np.bincount(t.text[common], minlength=texts).astype(np.int64),
                    "base_score": np.bincount(t.text, of[t.token], texts).astype(float),
                    "score": np.bincount(text[hit], chance[dense[hit]], texts).astype(float),
                }
                yield batch_of(texts_kind, {"row": row} | {k: pa.array(x) for k, x in sums.items()} | {c: part.column(c) for c in own.values()}, kept)
                # 0 of ranked tokens, 1 of a rare token, 2 of a rare history, 3 of both.
                held[0].append((asked[~hit], row.to_numpy()[text[~hit]]))
                rest = np.flatnonzero(~both)
                kind, of_text = (w[rest] < 0) + 2 * (h[rest] < 0), row.to_numpy()[t.text[rest]]
                for k, (rare, other) in ((1, (w, h)), (2, (h, w))):
                    mine = kind == k
                    held[k].append((rare[rest[mine]], other[rest[mine]], of_text[mine]))
                places += len(hit) - hit.sum() + (kind < 3).sum()
                rest, of_text = rest[kind == 3], of_text[kind == 3]
                yield batch_of(3, {"row": pa.array(of_text), "h": pa.array(h[rest]), "w": pa.array(w[rest])}, kept)
                del t, keys, h, w, common, both, asked, text, by, first, dense, hit, of, sums, rest, kind, of_text, mine
                if places >= PLACES:
                    for k in range(3):
                        if any(len(x[0]) for x in held[k]):
                            yield flush(k)
                        held[k] = []
                    places = 0
        for k in range(3):
            if any(len(x[0]) for x in held[k]):
                yield flush(k)

    def answers(kind, lacking):
        def answer(asked, cells):
            of_rooms, rooms, roots, share = fields.value
            pair, times, at = opened(asked.column("pair")), opened(asked.column("times"), np.uint32), opened(asked.column("at"), np.uint32)
            seen = count = None
            if kind:
                own = pc.is_null(cells.column("n"))
                mine, cells = cells.filter(own), cells.filter(pc.invert(own))
                token, values = opened(mine.column("rare")), [opened(mine.column(f"v{i}"), np.float64) for i in range(samples + 1)]
                by = np.argsort(token)
                token, values = token[by], [np.r_[x[by], y] for x, y in zip(values, lacking)]
                # A rare token's number is its place among the shard's.
                pairs_of = lambda rare, other: (other << 32 | rare) if kind == 1 else (rare << 32 | other)
                rare = place_of(token, pair)
                pair = pairs_of(rare, opened(asked.column("other"), np.uint32).astype(np.int64))
                known, n, tables = pairs_of(place_of(token, opened(cells.column("rare"))), opened(cells.column("other"))), opened(cells.column("n")), opened(cells.column("tables"))
                if kind == 1:
                    seen, count, roots = rare < len(token), values[0][rare], values[1:]
                else:
                    of_rooms, rooms = values[0], values[1:]
            else:
                known, n, tables = cell_arrays(cells, samples)
            by = np.argsort(known)
            known, n, tables = known[by], np.r_[n[by], 0], np.r_[tables[by], 0]
            place = place_of(known, pair)
            chance = np.log10(Chances(of_rooms, rooms, roots, share).of(pair, n[place], tables[place]))
            block = np.repeat(np.arange(asked.num_rows), np.diff(edges_of(asked.column("at"), np.uint32)))
            text, of = np.unique(block << 32 | at, return_inverse=True)
            edges = np.searchsorted(text >> 32, np.arange(asked.num_rows + 1))
            base = None if count is None else np.log10((count + 1) / unit)
            sums = [pa.nulls(asked.num_rows, pa.binary()) if x is None else cut(np.bincount(of, np.repeat(x, times), len(text)).astype(float), edges) for x in (seen, base, chance)]
            return pa.table([asked.column("row"), cut((text & 0xFFFFFFFF).astype(np.uint32), edges), *sums], names=["row", "at", "n_known", "base_score", "score"])

        return answer

    def gathered(key, table):
        found, of = np.unique(opened(table.column("at"), np.uint32), return_inverse=True)
        added = [opened(table.column(c), np.float64) for c in ("n_known", "base_score", "score")]
        known, base, mine = (np.bincount(of, x, len(found)).astype(float) if len(x) else np.zeros(len(found)) for x in added)
        return pa.table([pa.array(key[0].as_py() + found.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(mine)], names=["row", "n_known", "base_score", "score"])

    parts = saved(rows.mapInArrow(look_up, schema), partition_by="kind")
    shared.destroy()
    fields = spark.sparkContext.broadcast((chances.in_all, chances.rooms, chances.roots, chances.share))
    tidy(spark)

    def met(kind: int, asked: DataFrame, cells: DataFrame, lacking: list[float]) -> DataFrame:
        asked = asked.select("row", "shard", "pair", "other", "times", "at").groupBy("shard")
        out = asked.cogroup(cells.groupBy("shard")).applyInArrow(answers(kind, lacking), "row long, at binary, n_known binary, base_score binary, score binary")
        return saved(out.groupBy("row").applyInArrow(gathered, "row long, n_known long, base_score double, score double"))

    added = []
    for turn in range(passes):
        added.append(met(0, parts.where(F.col("kind") == 4 * turn), model.packed.where(F.col("shard") % passes == turn), []))
        forget_part(parts, f"kind={4 * turn}")
    # What a token that training lacked has: of the root what is left for new tokens, of a restaurant all.
    new = [(model.concentration + model.root_discount * model.types) / (model.concentration + c) for c in model.root_customers]
    for kind, table, rare, other, values, lacking in (
        (1, roots, "w", "h", ["count", *[f"b{i}" for i in many]], [0.0, *new]),
        (2, restaurants, "h", "w", ["in_all", *[f"a{i}" for i in many]], [1.0] * (samples + 1)),
    ):
        mine = table.where(f"{rare} < 0").select(F.col(rare).alias("rare"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(values)])
        cells = model.rare.where(f"{rare} < 0 AND {other} >= 0").select(F.col(rare).alias("rare"), F.col(other).alias("other"), "n", "tables")
        facts = blocks_of(mine, "rare", shards).unionByName(blocks_of(cells, "rare", shards), allowMissingColumns=True)
        added.append(met(kind, parts.where(F.col("kind") == kind), facts, lacking))
        forget_part(parts, f"kind={kind}")
    fields.destroy()
    for turn in range(passes):
        some = parts.where((F.col("kind") == 3) & F.expr(f"(h ^ w) & {passes - 1} = {turn}")).select("row", "h", "w")
        some = some.join(model.rare.where(f"h < 0 AND w < 0 AND (h ^ w) & {passes - 1} = {turn}"), ["h", "w"], "left")
        some = some.join(restaurants.where("h < 0"), "h", "left").join(roots.where("w < 0"), "w", "left")
        base_of = F.log10((F.coalesce("count", F.lit(0)) + 1) / unit)
        some = some.select("row", seen.cast("long").alias("n_known"), base_of.alias("base_score"), F.log10(p).alias("score"))
        added.append(saved(some.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_known", "base_score", "score")])))
    forget_part(parts, "kind=3")
    sums = reduce(DataFrame.union, added).groupBy("row").agg(*[F.sum(c).alias(f"_{c}") for c in ("n_known", "base_score", "score")])
    plus = lambda c: (F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c)
    texts = parts.where(F.col("kind") == texts_kind).select("row", *own.values(), "n_tokens", "n_known", "base_score", "score")
    out = saved(texts.join(sums, "row", "left").select(*own.values(), "n_tokens", plus("n_known"), plus("base_score"), plus("score")))
    forget(parts, *added)
    return out.select(*[F.col(x).alias(c) for c, x in own.items()], "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(column: str = "doc_id") -> Column:
    return crc_of_id(column) % 7 == 2


def op1_pitman_yor(spark, sf_dir: str) -> DataFrame:
    """Every document's scores by the model of the documents that are not held out."""
    docs = load(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return score(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": held_out()})
