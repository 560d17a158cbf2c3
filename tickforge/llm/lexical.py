"""Ranked lexical search: MaxScore over the inverted lists of document shards."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast, chunks, forget, load, saved, split_words

#: Distinct (item, term) pairs that are searched for at once; more items go in further passes over the documents.
PASS_TERMS = 1 << 18

#: Postings of a shard, whose lists a task holds at once.
SHARD_POSTINGS = 1 << 21

#: Each byte as a term has it: A-Z as a-z, digits, letters and bytes beyond ASCII as they are, a space for all others.
FOLDED = np.full(256, ord(" "), np.uint8)
for _b in (*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)):
    FOLDED[_b] = _b
for _b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    FOLDED[_b] = _b + 32


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms one after another, and how many each text has; a null has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    own = [None, pa.py_buffer(np.ascontiguousarray(at - at[0])), pa.py_buffer(FOLDED[raw])]
    return split_words(pa.Array.from_buffers(pa.large_string(), len(texts), own), lower=False)


@dataclass(frozen=True)
class Asked:
    """Items of one pass: item i asks for the terms entry[begin[i]:begin[i + 1]], each `times` as often."""

    items: np.ndarray  # row numbers
    ids: pa.Array
    begin: np.ndarray
    term: np.ndarray
    times: np.ndarray
    vocabulary: pa.Array


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, term, times), kept: a row for each distinct term of each item's row, numbered by `item`."""

    def split(batches):
        for batch in batches:
            for part in chunks(batch):
                terms, n = split_terms(part.column("text"))
                coded = terms.dictionary_encode()
                size = max(1, len(coded.dictionary))
                key, times = np.unique(np.repeat(np.arange(len(n)), n) * size + coded.indices.to_numpy(), return_counts=True)
                row = pa.array(key // size)
                yield pa.RecordBatch.from_arrays(
                    [part.column("item").take(row), part.column("item_id").take(row), coded.dictionary.take(pa.array(key % size)).cast(pa.string()), pa.array(times)],
                    names=["item", "item_id", "term", "times"],
                )

    rows = saved(items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")))
    out = saved(rows.mapInArrow(split, "item long, item_id long, term string, times long"))
    forget(rows)
    return out


def asked(rows: pa.Table) -> Asked:
    coded = rows.column("term").combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    item = rows.column("item").to_numpy()
    by = np.argsort(item, kind="stable")
    items, begin = np.unique(item[by], return_index=True)
    ids = rows.column("item_id").combine_chunks().take(pa.array(by[begin]))
    return Asked(items, ids, np.r_[begin, len(by)], coded.indices.to_numpy()[by], rows.column("times").to_numpy()[by], coded.dictionary)


def postings(docs: DataFrame, vocabulary: pa.Array, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, counts), kept: each document's number of terms, and its terms of the vocabulary as unsigned 32-bit places and counts."""
    held = broadcast(docs.sparkSession, vocabulary)

    def find(batches):
        wanted = held()
        for batch in batches:
            for part in chunks(batch):
                terms, n = split_terms(part.column("text"))
                coded = terms.dictionary_encode()
                place = pc.fill_null(pc.index_in(coded.dictionary, value_set=wanted.cast(coded.dictionary.type)), -1).to_numpy(zero_copy_only=False)
                term = place[coded.indices.to_numpy()] if len(place) else np.zeros(0, np.int64)
                hit = np.flatnonzero(term >= 0)
                size = max(1, len(wanted))
                key, count = np.unique(np.repeat(np.arange(len(n)), n)[hit] * size + term[hit], return_counts=True)
                end = 4 * np.searchsorted(key, np.arange(len(n) + 1) * size)
                lists = [
                    pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(end.astype(np.int32)), pa.py_buffer(x.astype("<u4"))])
                    for x in (key % size, count)
                ]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return saved(rows.mapInArrow(find, "doc_id long, n long, terms binary, counts binary"))


def _numbers(lists: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(lists.to_pylist()), "<u4").astype(np.int64)


def document_counts(lists: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each term."""

    def count(batches):
        found = np.zeros(terms, np.int64)
        for batch in batches:
            found += np.bincount(_numbers(batch.column("terms")), minlength=terms)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["term", "df"])

    got = lists.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(terms, np.int64)
    out[got.column("term").to_numpy()] = got.column("df").to_numpy()
    return out


def maxscore(lists: list[tuple[np.ndarray, np.ndarray]], times: np.ndarray, most: np.ndarray, documents: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) among which are the k best of a shard that reach `least`, ties to smaller places included.

    lists: each term's documents, ascending, and what the term adds to them; `most` is the
    largest of that, `times` how often the item has the term. Lists are taken by falling
    bounds. As long as those not yet taken could lift a new document to the k-th best
    score so far, they are essential and add documents; the others are only looked up for
    the documents that can still qualify, which become fewer with each list.
    """
    order = np.argsort(-most * times, kind="stable")
    rest = np.cumsum((most * times)[order][::-1])[::-1]
    rest = np.r_[rest, 0]
    score = np.zeros(documents, np.int64)
    j = 0
    while j < len(order) and rest[j] >= max(least, 1):
        docs, adds = lists[order[j]]
        score[docs] += adds * times[order[j]]
        j += 1
        if documents > k and rest[j] < score.max():
            least = max(least, int(np.partition(score, documents - k)[documents - k]))
    where = np.flatnonzero((score > 0) & (score + rest[j] >= least))
    score = score[where]
    for t, left in zip(order[j:], rest[j + 1 :]):
        if not len(where):
            break
        docs, adds = lists[t]
        at = np.minimum(np.searchsorted(docs, where), len(docs) - 1)
        score = score + np.where(docs[at] == where, adds[at] * times[t], 0)
        if len(where) > k:
            least = max(least, int(np.partition(score, len(where) - k)[len(where) - k]))
        on = score + left >= least
        where, score = where[on], score[on]
    return where, score


class Best:
    """The k best documents of each item so far; a null id comes after all others."""

    def __init__(self, items: int, k: int):
        self.k, self.of = k, [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in range(items)]

    def least(self, item: int) -> int:
        return int(self.of[item][0][-1]) if len(self.of[item][0]) == self.k else 0

    def add(self, item: int, score: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        score, null, doc = (np.concatenate(x) for x in zip(self.of[item], (score, null, doc)))
        by = np.lexsort((doc, null, -score))[: self.k]
        self.of[item] = score[by], null[by], doc[by]


def search_shard(lists: pa.Table, asks: Asked, weight: np.ndarray, total: int, length: int, best: Best) -> None:
    """Adds a shard's documents to the items' best."""
    lists = lists.take(pc.sort_indices(lists, sort_keys=[("doc_id", "ascending")], null_placement="at_end")).combine_chunks()
    ids = lists.column("doc_id").combine_chunks()
    null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    m = 75 + 25 * lists.column("n").to_numpy() * total // length
    sizes = pc.binary_length(lists.column("terms").combine_chunks()).to_numpy() // 4
    doc, term, tf = np.repeat(np.arange(len(sizes)), sizes), _numbers(lists.column("terms")), _numbers(lists.column("counts"))
    by = np.argsort(term, kind="stable")
    doc, term, tf = doc[by], term[by], tf[by]
    adds = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
    there, begin = np.unique(term, return_index=True)
    end, most = np.r_[begin[1:], len(term)], np.maximum.reduceat(adds, begin) if len(begin) else begin
    place = np.full(len(weight), -1)
    place[there] = np.arange(len(there))
    for i in range(len(asks.items)):
        own = slice(asks.begin[i], asks.begin[i + 1])
        at, times = place[asks.term[own]], asks.times[own]
        at, times = at[at >= 0], times[at >= 0]
        if len(at):
            found, score = maxscore([(doc[begin[t] : end[t]], adds[begin[t] : end[t]]) for t in at], times, most[at], len(sizes), best.k, best.least(i))
            best.add(i, score, null[found], ids[found])


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    pass_terms: int = PASS_TERMS,
    shard_postings: int = SHARD_POSTINGS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of highest score above 0, equal scores by ascending doc_id.

    Terms, weights and scores are those of op11_lexical's contract, all but the logarithm in
    64-bit integers. Documents are read once a pass: their counts of the items' terms are
    kept as postings, from which document frequencies are added up. A task then builds
    inverted lists for one shard of documents after another (`shard_postings` postings,
    or one document) and runs MaxScore on each for every item, starting from the scores
    that its earlier shards have reached. It gives out k documents an item, which are
    ranked in two rounds, so that no task gets all of an item's.

    Items go through in passes of about `pass_terms` distinct (item, term) pairs, dealt by
    hash; only a pass's items and their terms are sent to tasks. Texts that are null, empty
    or without terms are found by no item and find none; they do not count as documents.
    Each row of `items` is an item and each row of `docs` a document, also where ids
    repeat; a null doc_id comes after all others. Empty tables give no rows.
    """
    spark = docs.sparkSession
    rows = item_terms(items, item_col, item_text_col)
    passes = max(1, -(-rows.count() // pass_terms))
    out = None
    for p in range(passes):
        asks = asked(rows.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == p).toArrow())
        if not len(asks.items):
            continue
        lists = postings(docs, asks.vocabulary, id_col, text_col)
        total, length = lists.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = document_counts(lists, len(asks.vocabulary))
        weight = np.floor(1000 * np.log((2 * total + 2) / (2 * df + 1))).astype(np.int64)
        one = ranked(best_of_tasks(lists, broadcast(spark, (asks, weight)), total, length, k, shard_postings), k)
        out = out.unionByName(one) if out else one
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out


def best_of_tasks(lists: DataFrame, held, total: int, length: int, k: int, shard_postings: int) -> DataFrame:
    def run(batches):
        asks, weight = held()
        best, shard, size = Best(len(asks.items), k), [], 0
        for batch in batches:
            held_by = pc.binary_length(batch.column("terms")).to_numpy() // 4
            # A batch is cut where a shard is full, so that only one document can make it larger.
            part = (size + np.cumsum(held_by) - 1) // shard_postings
            for at in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(part)) + 1):
                if len(at) and part[at[0]] > 0 and size:
                    search_shard(pa.Table.from_batches(shard), asks, weight, total, length, best)
                    shard, size = [], 0
                shard.append(batch.take(pa.array(at)))
                size += int(held_by[at].sum())
        if shard and length:
            search_shard(pa.Table.from_batches(shard), asks, weight, total, length, best)
        for s in range(0, len(asks.items), 1024):
            some = range(s, min(s + 1024, len(asks.items)))
            own = np.repeat(np.arange(s, some.stop), [len(best.of[i][0]) for i in some])
            score, null, doc = (np.concatenate(x) for x in zip(*(best.of[i] for i in some)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(asks.items[own]), asks.ids.take(pa.array(own)), pa.array(doc, mask=null), pa.array(score)], names=["item", "item_id", "doc_id", "score"]
            )

    return lists.where("octet_length(terms) > 0").mapInArrow(run, "item long, item_id long, doc_id long, score long")


def ranked(found: DataFrame, k: int, parts: int = 16) -> DataFrame:
    """The k best of each item: first among those dealt to one of `parts` by doc_id, then among what is left."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    found = found.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    for by in (["item", "_part"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")


def op11_lexical(spark, sf_dir: str) -> DataFrame:
    """The 20 highest-scoring documents for each item of the benchmark; see search() for nulls, ties, repeats and empty tables."""
    return search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
l AS (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d),
tf AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM l GROUP BY r, term),
s AS (SELECT count(DISTINCT r) AS N, sum(tf)::BIGINT AS L FROM tf),
w AS (SELECT term, floor(1000 * ln((2 * any_value(s.N) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term),
q AS (SELECT i, any_value(item_id) AS item_id, term, count(*) AS times
      FROM (SELECT i, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS t FROM benchmark WHERE text IS NOT NULL)) GROUP BY i, term),
f AS (SELECT q.i, any_value(q.item_id) AS item_id, tf.r, any_value(tf.doc_id) AS doc_id,
             sum(q.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (100 - 25 + (25 * tf.n * s.N) // s.L))))::BIGINT AS score
      FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY q.i, tf.r)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM f WHERE score > 0 QUALIFY rank <= 20
"""
