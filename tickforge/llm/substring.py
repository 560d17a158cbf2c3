"""Removal of long repeated passages by compacting the de Bruijn graph of repeated word windows."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, hash_words, inside, joined_words, load, numbered, rolling_hash, saved, split_words

#: Bits of a coordinate that hold the place of a word in its document.
PLACE = 26
#: Spans of one source document that are read together.
SPANS = 10_000
LAST = (1 << 63) - 1


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each `width` consecutive values, in log2(width) vector steps."""
    step = 1
    while 2 * step <= width:
        x = pick(x[:-step], x[step:]) if len(x) > step else x[:0]
        step *= 2
    rest = width - step
    return x if not rest else (pick(x[:-rest], x[rest:]) if len(x) > rest else x[:0])


def anchors(words: np.ndarray, count: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every k-mer, which k-mers are anchors, which windows lie in one text).

    The smallest k-mers of a window are its anchors, so equal windows have equal
    anchors at equal places, and each window has one at least.
    """
    grams = rolling_hash(words, k) if len(words) >= k else np.zeros(0, np.uint64)
    whole = inside(count, window, len(words))
    if not len(whole):
        return grams, np.zeros(len(grams), bool), whole
    span = window - k + 1
    least = np.where(whole, sliding(grams, span, np.minimum), np.uint64(0))
    pad = np.zeros(span - 1, np.uint64)
    return grams, sliding(np.concatenate([pad, least, pad]), span, np.maximum) == grams, whole


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def repeated_spans(docs: DataFrame, window: int = 50, anchor: int = 10, keep: tuple[str, ...] = ()):
    """Documents by key, and the spans of each that repeat windows of a document with a smaller id.

    Returns (texts, spans). texts: u, id_key, doc_id, text and the columns `keep`, dealt by
    u; each use of them takes all columns, so that Spark deals them once. spans: u, id_key and
    spans, an array of (start, words, digest): `words` words from `start` are covered by
    windows that also start in a document with a smaller id, and digest is the hash of
    the passage at the place in that document.

    1. Anchors (minimal `anchor`-word k-mers) that occur in one document alone rule out
       the windows whose smallest k-mer they are.
    2. The other windows of `window` words are the edges of the graph, from their first
       window - 1 words to their last; one row for all places that one has in a document. An edge's coordinates are its document's place in
       the order of ids and its own place there; the smallest is its source.
    3. Joined to their sources, a document's neighbouring edges whose sources are
       neighbours too have no branch between them, and compact to one path.
    4. A path's source span is read at its coordinates, and its hash handed on, so that
       the passage itself can be compared. A source that is asked for many spans is read
       once for each SPANS of them.
    """
    id_key = F.coalesce(F.col("doc_id"), F.lit(LAST))
    keyed = docs.select(
        F.xxhash64(id_key, F.coalesce("text", F.lit(""))).alias("u"),
        id_key.alias("id_key"),
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        *[F.col(c).alias(f"_{c}") for c in keep],
    )

    def mark(batches):
        for batch in batches:
            for part in chunks(batch):
                words, count = split_words(part.column("text"), lower=False)
                grams, chosen, _ = anchors(hash_words(words), count, anchor, window)
                at = np.flatnonzero(chosen)
                text = np.repeat(np.arange(len(count)), count)[at]
                # An anchor that a document repeats is one row.
                by = np.lexsort((at, grams[at], text))
                at, text = at[by], text[by]
                new = np.r_[True, (grams[at][1:] != grams[at][:-1]) | (text[1:] != text[:-1])][: len(at)]
                at, text = at[new], text[new]
                place = at - (np.cumsum(count) - count)[text]
                u = part.column("u").to_numpy()[text]
                yield pa.RecordBatch.from_arrays([_signed(grams[at]), pa.array(u), pa.array(place.astype(np.int32))], names=["h", "u", "place"])

    marks = saved(keyed.select("u", "text").mapInArrow(mark, "h long, u long, place int"))
    shared = marks.groupBy("h").agg(F.min("u").alias("lo"), F.max("u").alias("hi")).where("lo != hi").select("h")
    places = saved(marks.join(shared, "h").groupBy("u").agg(F.collect_set("place").alias("places")))

    order = numbered(keyed.select("id_key", "u").distinct(), ["id_key", "u"], "ord")
    order = order.join(order.groupBy("id_key").agg(F.min("ord").alias("first")), "id_key")
    texts = keyed.repartition("u")

    def edges(batches):
        for batch in batches:
            for part in chunks(batch):
                words, count = split_words(part.column("text"), lower=False)
                each = hash_words(words)
                grams, chosen, whole = anchors(each, count, anchor, window)
                if not whole.any():
                    continue
                if count.max() > 1 << PLACE:
                    raise ValueError(f"a document has {count.max()} words; places hold {1 << PLACE}")
                first = np.cumsum(count) - count
                lists = part.column("places")
                sizes = np.diff(lists.offsets.to_numpy())
                found = grams[lists.flatten().to_numpy() + np.repeat(first, sizes)]
                known = np.zeros(len(grams), bool)
                known[chosen] = np.isin(grams[chosen], found)
                span = window - anchor + 1
                shared_least = sliding(np.where(known, grams, ~np.uint64(0)), span, np.minimum)
                at = np.flatnonzero(whole & (shared_least == sliding(grams, span, np.minimum)))
                text = np.repeat(np.arange(len(count)), count)[at]
                coordinate = (part.column("ord").to_numpy()[text] << PLACE) | (at - first[text])
                # A window that a document repeats is one row, whose further places stand in a list.
                hashes = rolling_hash(each, window)[at]
                by = np.lexsort((coordinate, hashes, text))
                hashes, coordinate, text = hashes[by], coordinate[by], text[by]
                again = np.r_[False, (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])]
                row = np.cumsum(~again) - 1
                alone = np.flatnonzero(~again)
                size = np.bincount(row[again], minlength=len(alone))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(coordinate[again]), mask=pa.array(size == 0))
                yield pa.RecordBatch.from_arrays([_signed(hashes[alone]), pa.array(coordinate[alone]), lists], names=["h", "at", "more"])

    candidates = places.join(order, "u").select("u", "id_key", "ord", "places")
    edge = texts.join(candidates.hint("shuffle_hash"), ["u", "id_key"]).select("ord", "places", *texts.columns).mapInArrow(edges, "h long, at long, more array<long>").repartition("h")
    source = edge.groupBy("h").agg(F.min("at").alias("source"), F.max("at").alias("last"))
    source = source.where(F.shiftright("source", PLACE) != F.shiftright("last", PLACE)).select("h", "source")
    repeats = edge.join(source.hint("shuffle_hash"), "h").where(F.shiftright("source", PLACE) != F.shiftright("at", PLACE))
    places_of = F.when(F.col("more").isNull(), F.array("at")).otherwise(F.concat(F.array("at"), "more"))
    repeats = repeats.select(F.explode(places_of).alias("at"), "source")

    def compact(batches):
        names = ["ord", "start", "words", "source_ord", "source_start"]
        for batch in batches:
            at, src = (batch.column(c).to_numpy() for c in ("at", "source"))
            begin = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (src[1:] != src[:-1] + 1)]) if len(at) else np.zeros(0, int)
            words = np.diff(np.r_[begin, len(at)]) + window - 1
            low = (1 << PLACE) - 1
            columns = [at[begin] >> PLACE, at[begin] & low, words, src[begin] >> PLACE, src[begin] & low]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=names)

    paths = (
        repeats.repartition(F.shiftright("at", PLACE))
        .sortWithinPartitions("at")
        .mapInArrow(compact, "ord long, start long, words long, source_ord long, source_start long")
    )
    paths = paths.join(order, "ord").where(F.col("source_ord") < F.col("first")).select("u", "id_key", "start", "words", "source_ord", "source_start")
    paths = saved(paths)

    source_of = order.select(F.col("u").alias("source_u"), F.col("id_key").alias("source_id"), F.col("ord").alias("source_ord"))
    paths = paths.join(source_of, "source_ord")
    asked = paths.select(F.col("source_u").alias("u"), F.col("source_id").alias("id_key"), F.struct(F.col("source_start").alias("start"), "words").alias("s"))
    asked = asked.distinct()
    slices = F.ceil(F.count("*") / SPANS).alias("slices")
    asked = asked.join(asked.groupBy("u", "id_key").agg(slices), ["u", "id_key"])
    asked = asked.groupBy("u", "id_key", F.pmod(F.xxhash64("s"), F.col("slices")).alias("slice")).agg(F.collect_list("s").alias("spans"))

    def read(batches):
        for batch in batches:
            for part in chunks(batch):
                rows = []
                for text, u, id_, spans in zip(*(part.column(c) for c in ("text", "u", "id_key", "spans"))):
                    words, _ = split_words(pa.array([text.as_py()]), lower=False)
                    joined, start, end = joined_words(words)
                    for s in spans.as_py():
                        rows.append((u.as_py(), id_.as_py(), s["start"], s["words"], digest(joined, start, end, s["start"], s["words"])))
                names = ["source_u", "source_id", "source_start", "words", "digest"]
                kinds = [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    asked_texts = texts.join(asked.hint("shuffle_hash"), ["u", "id_key"]).select("spans", *texts.columns)
    digests = asked_texts.mapInArrow(read, "source_u long, source_id long, source_start long, words long, digest binary").distinct()
    spans = (
        paths.join(digests, ["source_u", "source_id", "source_start", "words"])
        .groupBy("u", "id_key")
        .agg(F.collect_list(F.struct("start", "words", "digest")).alias("spans"))
    )
    return texts, spans


def digest(joined: bytes, start: np.ndarray, end: np.ndarray, at: int, words: int) -> bytes:
    return xxhash.xxh3_128_digest(joined[start[at] : end[at + words - 1]])


def remove_repeats(docs: DataFrame, window: int = 50, anchor: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of each document: kept are its words, joined by one space, without repeats.

    The columns of `docs` that `keep` names follow.

    Words are runs of anything but ASCII white space, unchanged. A word is removed if
    one of the windows of `window` words that cover it also starts in a document with a
    smaller doc_id, in the input as it is. The first occurrence stays, and what is
    repeated within one document alone, too.

    A null or empty text has no words; texts shorter than the window lose none. A null
    doc_id counts as larger than all others. Rows that share a doc_id do not repeat each
    other; equal rows are treated alike. A document of over 2^26 words is an error. Other
    columns are not read. No rows give no rows.
    """
    texts, spans = repeated_spans(docs, window, anchor, keep)

    def strip(batches):
        for batch in batches:
            for part in chunks(batch):
                words, count = split_words(part.column("text"), lower=False)
                first = np.cumsum(count) - count
                stays = np.ones(len(words), bool)
                joined, start, end = joined_words(words)
                for i, own in enumerate(part.column("spans")):
                    for s in own.as_py() or ():
                        a = int(first[i]) + s["start"]
                        if a + s["words"] <= first[i] + count[i] and digest(joined, start, end, a, s["words"]) == s["digest"]:
                            stays[a : a + s["words"]] = False
                upto = np.r_[0, np.cumsum(stays)]
                offsets = np.r_[upto[first], upto[-1]]
                lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), words.filter(pa.array(stays)))
                kept = pc.binary_join(lists, pa.scalar(" ", words.type)).cast(pa.string())
                left = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(count.astype(np.int64)), pa.array((count - left).astype(np.int64)), kept, *(part.column(f"_{c}") for c in keep)],
                    names=["doc_id", "n_words", "n_removed", "kept", *keep],
                )

    joined = texts.join(spans.hint("shuffle_hash"), ["u", "id_key"], "left").select("spans", *texts.columns)
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return joined.mapInArrow(strip, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string{kinds}")


def op5_substring(spark, sf_dir: str) -> DataFrame:
    """Every document's words, how many of them repeat a window of a document with a smaller id, and the rest's SHA-256."""
    kept = remove_repeats(load(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (
  SELECT doc_id, p, array_to_string(w[p : p + 49], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)
), r AS (SELECT doc_id, p FROM x JOIN (SELECT s, min(doc_id) AS first FROM x GROUP BY s) USING (s) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM r, (SELECT unnest(range(50)) AS k)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
