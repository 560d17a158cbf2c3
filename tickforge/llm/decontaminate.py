"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, forget, hash_words, inside, load, mix, rolling_hash, saved, split_words

#: Everything but ASCII letters and digits and non-ASCII characters separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def content_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased (A-Z) words without punctuation, one after another, and how many each text has."""
    lower = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    return split_words(pc.replace_substring_regex(lower, SEPARATORS, " "), lower=False)


def shingle_hashes(words: pa.Array, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's k-word shingles (of its whole words, if fewer), and how many each text has."""
    each = hash_words(words)
    n = np.where(count == 0, 0, np.maximum(1, count - k + 1))
    out = np.zeros(int(n.sum()), np.uint64)
    text = np.repeat(np.arange(len(count)), n)
    long_ = count >= k
    if long_.any():
        out[long_[text]] = rolling_hash(each, k)[inside(count, k, len(each))]
    first, place = np.cumsum(count) - count, np.cumsum(n) - n
    for size in range(1, k):
        short = np.flatnonzero(count == size)
        if len(short):
            out[place[short]] = mix(rolling_hash(each, size)[first[short]] + np.uint64(size))
    return out, n


def shingles(words: list[str], k: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def permutations(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def keys_of(least: np.ndarray, size_class: np.ndarray | int, permutation: int) -> np.ndarray:
    """A 64-bit key for each MinHash value of a size class under a permutation; no two have the same."""
    rest = np.asarray(size_class).astype(np.uint64) | np.uint64(permutation << 6)
    return mix(least.astype(np.uint64) | rest << np.uint64(32))


def item_keys(texts: pa.Array, k: int, perms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, size class, key) of each item's minima; class c holds the items of 2^(c-1) to 2^c - 1 shingles."""
    hashes, n = shingle_hashes(*content_words(texts), k)
    own = np.flatnonzero(n)
    if not len(own):
        return own, own, np.zeros(0, np.uint64)
    base, start = (hashes >> np.uint64(32)).astype(np.uint32), (np.cumsum(n) - n)[own]
    classes = np.frexp(n[own].astype(np.float64))[1]
    keys = [keys_of(np.minimum.reduceat(base * m + a, start), classes, p) for p, (m, a) in enumerate(zip(*permutations(perms)))]
    return np.tile(own, perms), np.tile(classes, perms), np.concatenate(keys)


@dataclass(frozen=True)
class Index:
    """The items' minima, and what a document's minima are tried against before they are joined to them."""

    items: DataFrame  # item, item_id, text
    minima: DataFrame  # item, key
    classes: list[int]  # those that have items
    bits: np.ndarray  # a Bloom filter of the keys


#: Bits of the filter that a key sets.
PROBES = 4


def probed(keys: np.ndarray, size: int) -> list[np.ndarray]:
    """The bits of a filter of `size` (a power of two) bits that stand for each key."""
    step = keys >> np.uint64(32) | np.uint64(1)
    return [keys + np.uint64(i) * step & np.uint64(size - 1) for i in range(PROBES)]


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the keys that may be in the filter."""
    at = np.arange(len(keys))
    for i in range(PROBES):
        place = probed(keys[at], len(bits) * 64)[i]
        at = at[bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1) > 0]
    return at


def index(benchmark: DataFrame, k: int, perms: int, filter_bits: int) -> Index:
    """Minima of all items, computed and kept by Spark; the driver gets 2^filter_bits bits of their filter at most."""
    text = F.coalesce("text", F.lit("")).alias("text")
    items = saved(benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id", text))

    def sketch(batches):
        for batch in batches:
            for part in chunks(batch):
                own, classes, keys = item_keys(part.column("text"), k, perms)
                yield pa.RecordBatch.from_arrays(
                    [part.column("item").take(pa.array(own)), pa.array(classes.astype(np.int32)), pa.array(keys.view(np.int64))],
                    names=["item", "class", "key"],
                )

    minima = saved(items.select("item", "text").mapInArrow(sketch, "item long, class int, key long"))
    classes = sorted(r[0] for r in minima.select("class").distinct().collect())
    words = max(1, min(1 << filter_bits, 1 << (128 * minima.count()).bit_length()) // 64)

    def set_bits(batches):
        for batch in batches:
            place = np.unique(np.concatenate(probed(batch.column("key").to_numpy().view(np.uint64), words * 64)))
            word, first = np.unique(place >> np.uint64(6), return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), first) if len(place) else place
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(mask.view(np.int64))], names=["word", "mask"])

    masks = minima.select("key").mapInArrow(set_bits, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(words, np.uint64)
    bits[masks.column("word").to_numpy()] = masks.column("mask").to_numpy().view(np.uint64)
    return Index(items, minima.select("item", "key"), classes, bits)


def window_keys(texts: pa.Array, classes: list[int], bits: np.ndarray, k: int, perms: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of the texts' window minima that may be an item's."""
    hashes, n = shingle_hashes(*content_words(texts), k)
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    base, start = (hashes >> np.uint64(32)).astype(np.uint32), np.cumsum(n) - n
    blocks_of = {}
    for c in classes:
        # Blocks have at least an item's shingles, so that it lies in two neighbouring ones.
        blocks = -(-n >> c) if c < 62 else np.minimum(n, 1)
        text = np.repeat(np.arange(len(n)), blocks)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        blocks_of[c] = text, start[text] + (nth << c), np.flatnonzero(text[1:] == text[:-1])
    found_text, found = [], []
    for p, (m, a) in enumerate(zip(*permutations(perms))):
        value = base * m + a
        for c, (text, at, followed) in blocks_of.items():
            least = np.minimum.reduceat(value, at)
            window = least.copy()
            window[followed] = np.minimum(least[followed], least[followed + 1])
            keys = keys_of(window, c, p)
            maybe = in_filter(bits, keys)
            found_text.append(text[maybe])
            found.append(keys[maybe])
    pair = np.stack([np.concatenate(found_text).astype(np.uint64), np.concatenate(found)])
    pair = pair[:, np.lexsort((pair[1], pair[0]))]
    own = np.r_[True, (pair[:, 1:] != pair[:, :-1]).any(axis=0)] if pair.shape[1] else np.zeros(0, bool)
    return pair[0, own].astype(np.int64), pair[1, own]


def looked_up(docs: DataFrame, found: Index, k: int, perms: int) -> DataFrame:
    """The rows some of whose minima may be an item's, with `row` and these `keys`. Kept."""
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    shared, classes = docs.sparkSession.sparkContext.broadcast(found.bits), found.classes

    def scan(batches):
        bits = shared.value
        for batch in batches:
            for part in chunks(batch):
                of, keys = window_keys(part.column("text"), classes, bits, k, perms)
                count = np.bincount(of, minlength=part.num_rows)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "keys"]).filter(pa.array(count > 0))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return saved(rows.mapInArrow(scan, f"{kinds}, keys array<long>"))


def verified(hits: DataFrame, found: Index, k: int, threshold: float) -> DataFrame:
    """(row, item_id, shared, item_shingles) of all pairs of a row and an item whose text it holds. Kept.

    Candidates are joined by key. A candidate's text and then its items' come one after
    another in a sorted partition, so a task holds the shingles of one text and one item.
    """
    pairs = saved(hits.select("row", F.explode("keys").alias("key")).join(found.minima, "key").select("row", "item").distinct())
    kind = found.items.schema["item_id"].dataType
    own = hits.join(pairs.select("row").distinct(), "row", "left_semi").select("row", F.lit(False).alias("asked"), "text", F.lit(None).cast(kind).alias("item_id"))
    both = own.union(pairs.join(found.items, "item").select("row", F.lit(True), "text", "item_id"))

    def check(batches):
        held: set = set()
        for batch in batches:
            for part in chunks(batch):
                words, count = content_words(part.column("text"))
                first, asked = np.cumsum(count) - count, part.column("asked").to_pylist()
                at, shared, size = [], [], []
                for i, (f, c) in enumerate(zip(first, count)):
                    mine = shingles(words[int(f) : int(f + c)].to_pylist(), k)
                    if not asked[i]:
                        held = mine
                    elif len(mine & held) >= threshold * len(mine):
                        at.append(i)
                        shared.append(len(mine & held))
                        size.append(len(mine))
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("row").take(at), part.column("item_id").take(at), pa.array(shared, pa.int64()), pa.array(size, pa.int64())],
                    names=["row", "item_id", "shared", "item_shingles"],
                )

    dealt = both.repartition("row").sortWithinPartitions("row", "asked")
    out = saved(dealt.mapInArrow(check, f"row long, item_id {kind.simpleString()}, shared long, item_shingles long"))
    forget(pairs)
    return out


def contained_items(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, perms: int = 64, filter_bits: int = 28) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) of items that a document holds.

    Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters;
    shingles are `k` consecutive ones, or all of a text that has fewer. Containment is
    the share of the item's distinct shingles that occur in the document.

    Items are partitioned by size. A document is cut into blocks of as many shingles
    as the class's largest item may have; any two neighbouring blocks make a window that
    holds an item that lies in one piece, and has a Jaccard similarity of about 0.2
    or more with it whatever the document's length. A window is a candidate if one of
    `perms` minima agrees with the item's; at a similarity of 0.19, the least for a
    contained share of 0.8, one pair in a million is missed. Every candidate is verified by its
    actual shingles over the whole document.

    Spark computes the items' minima, keeps them and joins them to the documents' by
    equality, which are first tried against a Bloom filter of at most 2 ** `filter_bits`
    bits. That alone is broadcast; a benchmark it is too small for gives more rows to
    join and the same result. Documents are read once, whatever the benchmark's size.

    Null or empty texts of either side hold and are held by nothing. Repeated
    documents or items give a row for each pair. Other columns are not read.
    """
    found = index(benchmark, k, perms, filter_bits)
    doc_kind, item_kind = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id")))
    if not found.classes:
        return docs.sparkSession.createDataFrame([], f"doc_id {doc_kind}, item_id {item_kind}, shared long, item_shingles long, containment double")
    hits = looked_up(docs.select("doc_id", "text"), found, k, perms)
    out = hits.select("row", "doc_id").join(verified(hits, found, k, threshold), "row")
    return out.select("doc_id", "item_id", "shared", "item_shingles", (F.col("shared") / F.col("item_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, perms: int = 64, filter_bits: int = 28) -> DataFrame:
    """The rows of `docs` that hold no item of the benchmark, as contained_items() finds them; all their columns, whatever their names.

    What a row holds depends on its text alone, so rows go whose texts have the SHA-256 of one that holds an item.
    """
    found = index(benchmark, k, perms, filter_bits)
    if not found.classes:
        return docs
    hits = looked_up(docs.select("text"), found, k, perms)
    held = verified(hits, found, k, threshold)
    bad = saved(hits.join(held, "row", "left_semi").select(F.sha2("text", 256).alias("digest")).distinct())
    forget(hits, held, found.items)
    return docs.join(bad, F.sha2(docs["text"], 256) == bad["digest"], "left_anti")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it holds."""
    return contained_items(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, array_to_string(w[n : n + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS n FROM d WHERE len(w) > 0)
), s AS (
  SELECT DISTINCT item_id, array_to_string(w[n : n + 4], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS n FROM i WHERE len(w) > 0)
), z AS (SELECT item_id, count(*) AS item_shingles FROM s GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, any_value(item_shingles) AS item_shingles,
  count(*) / any_value(item_shingles)::DOUBLE AS containment
FROM ds JOIN s USING (s) JOIN z USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8::DOUBLE * any_value(item_shingles)
"""
