"""SimHash near-duplicates through deletion-variant signatures."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, load, saved, split_words
from .graph import components

#: Text bytes whose shingles' bits are held at once.
TEXT = 1 << 20
#: Rows of the variant index that are compared at once.
BLOCK = 1 << 18
#: Groups up to this size are compared by offsets, all groups of a block at once.
SMALL = 32
#: A column that numbers the rows of documents, whose own columns are not called so.
ROW = "_tickforge_row"
#: Groups up to this size are compared as a whole; larger ones are cut by the parts of which two linked fingerprints share one.
LARGE = 2048


def majority(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """(texts, bytes): the bits that over half of a text's hashes have. hashes: (hashes, bytes), text after text; count: how many each text has."""
    value = np.zeros((len(count), hashes.shape[1]), np.uint8)
    full = np.flatnonzero(count)
    if len(full):
        ones = np.add.reduceat(np.unpackbits(hashes, axis=1), (np.cumsum(count) - count)[full], axis=0, dtype=np.uint32)
        value[full] = np.packbits(2 * ones > count[full, None], axis=1)
    return value


def fingerprints(docs: DataFrame, shingle: int = 4, bits: int = 64, row: str | None = None) -> DataFrame:
    """(doc_id, row, f0, f1) of each row: its SimHash over word shingles, repeats included.

    row is the column of that name, or else a number given to each row.

    A-Z is lower-cased; words are runs of anything but ASCII white space. Shingles are
    joined by one space; a text of fewer words is one shingle, one without words gets
    zero. With 64 bits a shingle's hash is XXH64 with seed 42 and f1 is 0; with 128 it
    is the 128-bit XXH3, whose halves give f0 and f1. A bit is set if over half of the
    hashes have it.
    """
    digest = (lambda x: xxhash.xxh64_digest(x, 42)) if bits == 64 else xxhash.xxh3_128_digest
    size = bits // 8

    def hashed(batches):
        for batch in batches:
            for part in chunks(batch, limit=TEXT):
                words, count = split_words(part.column("text"), lower=True)
                length = pc.binary_length(words).to_numpy().astype(np.int64) + 1
                end = np.cumsum(length) - 1
                start = end - length + 1
                joined = pc.binary_join(
                    pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words), pa.scalar(" ", words.type)
                )[0].as_buffer().to_pybytes() if len(words) else b""
                first = np.cumsum(count) - count
                shingles = np.where(count == 0, 0, np.maximum(1, count - shingle + 1))
                before = np.cumsum(shingles) - shingles
                at = np.arange(int(shingles.sum())) - np.repeat(before - first, shingles)
                last = np.minimum(at + shingle, np.repeat(first + count, shingles)) - 1
                hashes = b"".join([digest(joined[a:b]) for a, b in zip(start[at].tolist(), end[last].tolist())])
                value = majority(np.frombuffer(hashes, np.uint8).reshape(-1, size), shingles)
                halves = value.view(">u8").astype(np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row"), pa.array(halves[:, 0]), pa.array(halves[:, 1] if bits == 128 else np.zeros(len(count), np.int64))],
                    names=["doc_id", "row", "f0", "f1"],
                )

    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = docs.select(F.col("doc_id").cast("long"), "text", number.alias("row"))
    return rows.mapInArrow(hashed, "doc_id long, row long, f0 long, f1 long")


def cut(bits: int, segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of segments of nearly equal width."""
    edge = [bits * s // segments for s in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


def field(f: np.ndarray, start: int, width: int) -> np.ndarray:
    """Bits start .. start + width - 1 of (n, halves) fingerprints, bit 0 being the lowest of the first half."""
    half, low = divmod(start, 64)
    value = f[:, half] >> np.uint64(low)
    if low + width > 64:
        value = value | (f[:, half + 1] << np.uint64(64 - low))
    return value & np.uint64((1 << width) - 1)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def bits_at(f: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The bits of (n, halves) fingerprints at the given places, as one number each."""
    value = np.zeros(len(f), np.uint64)
    for p in places:
        value = (value << np.uint64(1)) | ((f[:, p >> 6] >> np.uint64(p & 63)) & np.uint64(1))
    return value


def _spread(f: np.ndarray, most: int, linked: list) -> None:
    """Adds pairs of indices that join all that is linked within `f`.

    Breadth first, which takes a dense group in few steps. Once several fingerprints
    had no link, no more than LARGE that are left are compared as a whole; more are cut:
    the bits in which they differ at all fall into most + 1 parts, and linked ones are
    alike in one part, so groups of one part's values are worked on in turn.
    """
    left, misses = np.arange(len(f)), 0
    while len(left):
        if misses >= 8:
            rest = f[left]
            if len(left) <= LARGE:
                near = np.bitwise_count(rest[:, None, 0] ^ rest[None, :, 0])
                if f.shape[1] > 1 and rest[:, 1].any():
                    near = near + np.bitwise_count(rest[:, None, 1] ^ rest[None, :, 1])
                a, b = np.nonzero(near <= most)
                linked.append((left[a[a < b]], left[b[a < b]]))
                return
            differs = np.bitwise_or.reduce(rest ^ rest[0], axis=0)
            places = np.flatnonzero([int(differs[p >> 6]) >> (p & 63) & 1 for p in range(64 * f.shape[1])])
            for part in np.array_split(places, most + 1):
                value = bits_at(rest, part)
                by = np.argsort(value, kind="stable")
                edge = np.r_[np.flatnonzero(np.r_[True, value[by][1:] != value[by][:-1]]), len(by)]
                for x, y in zip(edge, edge[1:]):
                    if y - x > 1:
                        found: list = []
                        _spread(rest[by[x:y]], most, found)
                        linked += [(left[by[x:y][a]], left[by[x:y][b]]) for a, b in found]
            return
        misses += 1
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = distance(f[left], f[x]) <= most
            if near.any():
                misses = 0
                hit = left[near]
                linked.append((np.full(len(hit), x), hit))
                queue.extend(hit.tolist())
                left = left[~near]


def links(key: np.ndarray, f: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of indices that join all that is linked inside runs of one key, not all pairs."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    out: list[tuple[np.ndarray, np.ndarray]] = []
    small = np.repeat(size <= SMALL, size)
    for d in range(1, SMALL):
        i = np.flatnonzero((key[:-d] == key[d:]) & small[:-d]) if d < len(key) else ()
        if not len(i):
            break
        i = i[distance(f[i], f[i + d]) <= most]
        out.append((i, i + d))
    for s, n in zip(start[size > SMALL], size[size > SMALL]):
        found: list = []
        _spread(f[s : s + n], most, found)
        out += [(a + s, b + s) for a, b in found]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node joined to it) for the edges, smallest nodes left out."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(node))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(node))
    return node[own], node[label[own]]


def linked_fingerprints(nodes: DataFrame, max_bits: int, segments: int, bits: int) -> DataFrame:
    """Edges (a, b) that join all linked nodes (node, f0, f1), of different fingerprints each.

    A fingerprint is cut into `segments`; for each bit of a segment the segment
    with that bit wild is a variant. Segments that differ in one bit at most share a
    variant, so with segments > max_bits / 2 every linked pair meets in one. The
    variants are dealt by their value; inside a task equal ones lie together and are
    verified by their whole fingerprints. What leaves it is a forest for each block
    of rows, not the pairs of a group.
    """
    spans = cut(bits, segments)

    def variants(batches):
        for batch in batches:
            f = np.stack([batch.column(c).to_numpy() for c in ("f0", "f1")], axis=1).view(np.uint64)
            node = batch.column("node")
            for start, width in spans:
                value = field(f, start, width)
                for b in range(width):
                    key = ((value & ~np.uint64(1 << b)) << np.uint64(8)) | np.uint64(start + b)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), node, batch.column("f0"), batch.column("f1")], names=["key", "node", "f0", "f1"]
                    )

    def joined(batches):
        held: list[np.ndarray] = []
        rows = 0

        def verify(x: np.ndarray):
            a, b = links(x[:, 0], x[:, 2:].view(np.uint64), max_bits)
            if len(a):
                a, b = forest(x[a, 1], x[b, 1])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns], axis=1))
            rows += batch.num_rows
            if rows < BLOCK:
                continue
            x = np.concatenate(held)
            whole = int(np.searchsorted(x[:, 0], x[-1, 0]))  # the last key's rows may go on
            if whole:
                yield from verify(x[:whole])
                x = x[whole:]
            held, rows = [x], len(x) if whole else 0
        if held:
            yield from verify(np.concatenate(held))

    index = nodes.select("node", "f0", "f1").mapInArrow(variants, "key long, node long, f0 long, f1 long")
    dealt = index.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(joined, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 64, max_bits: int = 4, segments: int = 3, row: str | None = None) -> DataFrame:
    """(doc_id, row, f0, f1, component, component_id) of every row of documents (doc_id, text).

    Rows whose fingerprints differ in `max_bits` bits at most are linked;
    component is the smallest row number, component_id the smallest doc_id that is
    reachable over links, the row itself included. All links count if segments > max_bits / 2; with fewer segments those of
    over 2 * segments - 1 bits are found only where they fall together in a segment.
    Equal fingerprints are one node from the start, so copies cost one row each; rows
    without words are linked with each other. A null doc_id is never a component's
    smallest while another is there. No rows give no rows.
    """
    prints = saved(fingerprints(docs, shingle, bits, row))
    nodes = saved(prints.groupBy("f0", "f1").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")))
    roots = components(linked_fingerprints(nodes, max_bits, segments, bits))
    found = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = found.groupBy("root").agg(F.min("least").alias("component_id"))
    named = found.join(least, "root").select("f0", "f1", F.col("root").alias("component"), "component_id")
    return prints.join(named, ["f0", "f1"])


def keep_one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` without those that are near copies of a row with a smaller doc_id.

    Of several rows with that doc_id the one that is read first stays. Takes what
    near_duplicates() takes; returns the columns of `docs`, which must be a table that
    is read from files, in the same order each time.
    """
    numbered = docs.withColumn(ROW, F.monotonically_increasing_id())
    groups = near_duplicates(numbered, row=ROW, **how)
    first = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")
    stay = groups.groupBy("component").agg(F.min(first)["row"].alias(ROW))
    return numbered.join(stay.select(ROW), ROW, "left_semi").select(docs.columns)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's 64-bit fingerprint of 4-word shingles and its component over links of 4 bits or fewer."""
    return near_duplicates(load(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id"
    )
