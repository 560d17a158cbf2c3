"""Alignment of two tokenizers' tokens, weighed by how many documents of the corpus link them."""

import hashlib
import json
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast, chunks, forget, load, saved, shared_folder
from .packing import tokenizer_path

#: Segments that are encoded together, and those that a task remembers.
ENCODED, REMEMBERED = 50_000, 400_000

#: Distinct pairs that a task counts before it gives them out.
PARTIAL = 1 << 21

#: Segments whose tokens are written out and hashed at once.
WRITTEN = 1 << 19

#: Pieces of text that are byte-level BPE's words, as public descriptions of this vocabulary give them.
BYTE_LEVEL_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, and the others as the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE of a tokenizers file: ids of texts, and each id's bytes.

    tiktoken does the merges, in the order of ids, which is that of the file's merges; it
    gives the file's own tokenizer's ids at a third of its time. Special tokens are
    never looked for.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        special, letters = {t["content"] for t in held["added_tokens"]}, byte_of_letter()
        ranks = {bytes(letters[c] for c in t): i for t, i in held["model"]["vocab"].items() if t not in special}
        self.model = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(held["model"]["vocab"].values()) + 1)
        for b, i in ranks.items():
            self.bytes[i] = b

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.model.encode_ordinary(t) for t in texts]


class Pieces:
    """A sentencepiece model of which texts already begin with the space that it would add."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        held = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            held.ParseFromString(f.read())
        held.normalizer_spec.add_dummy_prefix = False
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(held.SerializeToString())
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
            self.bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


#: Bytes after which a space begins a new segment: all but ASCII white space and control characters.
CLOSES = np.zeros(256, bool)
CLOSES[0x21:0x7F] = CLOSES[0x80:] = True

#: The last byte of white space beyond ASCII, and the byte before it.
WIDE_LAST, WIDE_FIRST = np.zeros(256, bool), np.zeros(256, bool)
WIDE_LAST[[0x80, *range(0x81, 0x8B), 0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
WIDE_FIRST[[0x80, 0x81, 0x9A, 0xC2]] = True


def segments(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """A space and each text, cut where both tokenizers always end a token, and how many segments each text has; none for empty or null texts.

    That is before a space that follows anything but white space: no byte-level word
    and no piece goes on over it.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    there = np.flatnonzero(pc.binary_length(texts).to_numpy() > 0)
    spaced = pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in ("", texts.take(pa.array(there)), " ")))
    count = np.zeros(len(texts), np.int64)
    if not len(there):
        return pa.array([], pa.large_string()), count
    _, offsets, data = spaced.buffers()
    end = np.frombuffer(offsets, np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
    raw = np.frombuffer(data, np.uint8)[end[0] : end[-1]]
    end = end - end[0]
    cut = np.zeros(len(raw), bool)
    before, two_before = raw[1:-1], raw[:-2]
    cut[2:] = (raw[2:] == 0x20) & CLOSES[before] & ~(WIDE_LAST[before] & WIDE_FIRST[two_before])
    cut[end[:-1]] = True
    begin = np.flatnonzero(cut)
    count[there] = np.diff(np.searchsorted(begin, end))
    own = [None, pa.py_buffer(np.r_[begin, len(raw)].astype(np.int64)), pa.py_buffer(raw)]
    return pa.Array.from_buffers(pa.large_string(), len(begin), own), count


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((x for own in ids for x in own), np.int64, int(size.sum())), size


def _sums(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of consecutive runs of x of the given sizes."""
    upto = np.r_[0, np.cumsum(x)]
    end = np.cumsum(size)
    return upto[end] - upto[end - size]


class Aligned:
    """Two tokenizers, and what they make of the segments a task has met: each distinct one is encoded once.

    By segment: tokens of either, groups, links (packed keys: A's id in the upper half, B's in the
    lower one) and the groups written out. A segment whose joined bytes differ is not `ok`.
    """

    def __init__(self, a: str, b: str, written: bool):
        self.a, self.b, self.written = ByteLevel(a), Pieces(b), written
        self.length = [np.fromiter(map(len, x.bytes), np.int64, len(x.bytes)) for x in (self.a, self.b)]
        self.pieces = [pa.array(x.bytes, pa.large_binary()) for x in (self.a, self.b)]
        self.first_b = len(self.a.bytes)
        if written:
            names = lambda n, end: [f"{i}{end}".encode() for i in range(n)]
            na, nb = len(self.a.bytes), len(self.b.bytes)
            self.names = pa.array(names(na, ",") + names(nb, ",") + names(na, "|") + names(nb, ";"), pa.large_binary())
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ok = np.zeros(0, bool)
        self.n = np.zeros((3, 0), np.int64)  # tokens of A, of B, groups
        self.end, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.text = pa.array([], pa.large_binary())

    def find(self, distinct: pa.Array) -> tuple[np.ndarray, slice]:
        """The places of the segments among those known, and the range of those that are new."""
        if len(self.known) > REMEMBERED:
            self.forget()
        was = len(self.known)
        at = pc.index_in(distinct, value_set=self.known)
        missing = distinct.filter(pc.is_null(at))
        for s in range(0, len(missing), ENCODED):
            self._add(missing.slice(s, ENCODED))
        if len(missing):
            self.known = pa.concat_arrays([self.known, missing])
            at = pc.index_in(distinct, value_set=self.known)
        return at.to_numpy(), slice(was, len(self.known))

    def _add(self, new: pa.Array) -> None:
        texts = new.to_pylist()
        sides = [_flat(x.encode(texts)) for x in (self.a, self.b)]
        joined = [pieces.take(pa.array(ids)) for pieces, (ids, _) in zip(self.pieces, sides)]
        want = pc.binary_length(new).to_numpy().astype(np.int64)
        ok = np.ones(len(texts), bool)
        for pieces, length, (ids, size) in zip(joined, self.length, sides):
            got = _sums(length[ids], size)
            made = pieces.buffers()[2].to_pybytes()[: int(length[ids].sum())] if len(ids) else b""
            if (got == want).all() and made == "".join(texts).encode():
                continue
            end = np.cumsum(got)
            ok &= [made[e - n : e] == t.encode() for e, n, t in zip(end.tolist(), got.tolist(), texts)]
        sides = [(ids[np.repeat(ok, size)], np.where(ok, size, 0)) for ids, size in sides]
        (a, na), (b, nb) = sides
        end_a, end_b = np.cumsum(self.length[0][a]), np.cumsum(self.length[1][b])
        first = np.searchsorted(end_b, end_a - self.length[0][a], side="right")
        last = np.searchsorted(end_b, end_a, side="left")
        both_end = end_b[last] == end_a if len(a) else np.zeros(0, bool)
        many = last - first + 1
        other = np.repeat(first, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        links = np.repeat(a, many) << 32 | b[other]
        self.ok = np.concatenate([self.ok, ok])
        self.n = np.concatenate([self.n, np.stack([na, nb, _sums(both_end, na)])], axis=1)
        self.links = np.concatenate([self.links, links])
        self.end = np.concatenate([self.end, self.end[-1] + np.cumsum(_sums(many, na))])
        if self.written:
            self.text = pa.concat_arrays([self.text, self._written(a, b, na + nb, end_a[both_end], end_a, end_b)])

    def _written(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, shared: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> pa.Array:
        """Each segment's groups as text, each group ended by a semicolon; n: a segment's tokens of both sides."""
        group = np.r_[np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)]
        side = np.repeat([0, 1], [len(a), len(b)])
        by = np.lexsort((np.arange(len(group)), side, group))
        key = (2 * group + side)[by]
        ends = np.r_[key[1:] != key[:-1], True][: len(key)]
        name = np.r_[a, self.first_b + b][by] + np.where(ends, len(self.names) // 2, 0)
        text = self.names.take(pa.array(name))
        # Groups lie within segments, so each segment's names are consecutive.
        offsets = np.r_[0, np.cumsum(_sums(pc.binary_length(text).to_numpy().astype(np.int64), n))]
        data = text.buffers()[2] if len(text) else pa.py_buffer(b"")
        return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), data])

    def links_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `links` of these segments' links one after another, and how many each has."""
        many = self.end[at + 1] - self.end[at]
        return np.repeat(self.end[at], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many), many


def documents_of(aligned: Aligned, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, slice]:
    """(document, segment) of every segment of texts whose bytes both tokenizers give back, and the range of new segments."""
    each, count = segments(texts)
    coded = each.dictionary_encode()
    at, new = aligned.find(coded.dictionary)
    at = at[coded.indices.to_numpy()] if len(at) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(count)), count)
    bad = np.zeros(len(count), bool)
    bad[doc[~aligned.ok[at]]] = True
    return doc[~bad[doc]], at[~bad[doc]], new


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.int64)


def pair_counts(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(key, n): how many of a task's documents link each pair, counted by np.unique; a key once for each PARTIAL of a task."""

    def count(batches):
        aligned = Aligned(a, b, False)
        keys, counts, held = [], [], 0
        give = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["key", "n"])
        for batch in batches:
            for part in chunks(batch):
                doc, at, _ = documents_of(aligned, part.column("text"))
                size = len(aligned.known) + 1
                own = np.unique(doc * size + at)
                doc, at = own // size, own % size
                segment, inverse = np.unique(at, return_inverse=True)
                place, many = aligned.links_of(segment)
                distinct, pair = np.unique(aligned.links[place], return_inverse=True)
                # The pairs of each (document, segment), then each pair of a document once.
                begin = np.cumsum(many) - many
                n = many[inverse]
                index = np.repeat(begin[inverse], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                linked = np.unique(np.repeat(doc, n) * (len(distinct) + 1) + pair[index])
                keys.append(distinct)
                counts.append(np.bincount(linked % (len(distinct) + 1), minlength=len(distinct)))
                held += len(distinct)
                if held > PARTIAL:
                    key, n = summed(keys, counts)
                    keys, counts, held = [key], [n], len(key)
                    if held > PARTIAL // 2:
                        yield give(key, n)
                        keys, counts, held = [], [], 0
        if keys:
            yield give(*summed(keys, counts))

    return rows.select("text").mapInArrow(count, "key long, n long")


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder, and the folder's path in it."""
    if folder.startswith("file:") or "://" not in folder:
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", folder)
    return fs.FileSystem.from_uri(folder)


@dataclass(frozen=True)
class Counts:
    """Sorted shards of keys and counts in the shared folder, and each A id's highest count (as many as the vocabulary has)."""

    folder: str
    files: list[str]
    firsts: np.ndarray
    rows: np.ndarray
    best: np.ndarray

    def numbers(self, name: str) -> np.ndarray:
        store, path = opened(self.folder)
        if isinstance(store, fs.LocalFileSystem):
            return np.memmap(f"{path}/{name}", "<i8", "r")
        with store.open_input_file(f"{path}/{name}") as f:  # a store without memory maps: one shard at a time
            return np.frombuffer(f.read(), "<i8")

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The counts of distinct keys in order, 0 for those that no document has; shards are mapped one after another."""
        out = np.zeros(len(keys), np.int64)
        shard = np.searchsorted(self.firsts, keys, side="right") - 1
        for s in np.unique(shard[shard >= 0]):
            own = np.flatnonzero(shard == s)
            there = self.numbers(f"{self.files[s]}.keys")
            at = np.minimum(np.searchsorted(there, keys[own]), len(there) - 1)
            out[own] = np.where(there[at] == keys[own], self.numbers(f"{self.files[s]}.counts")[at], 0)
        return out


def sorted_shards(partial: DataFrame, vocabulary: int) -> Counts:
    """Range-partitions the partial counts by key, sorts them, adds up runs of one key and writes each partition as a shard.

    A shard's task gives back its name, first key, length and, for the A ids that it holds,
    their highest counts: over all shards one row for each id, and one more a shard.
    Files of attempts that failed are named by nobody.
    """
    folder = f"{shared_folder(partial.sparkSession)}/{uuid.uuid4().hex}"

    def write(batches):
        store, path = opened(folder)
        store.create_dir(path)
        name = uuid.uuid4().hex
        first, rows, last, best = None, 0, (np.zeros(0, np.int64), np.zeros(0, np.int64)), {}
        with store.open_output_stream(f"{path}/{name}.keys") as keys, store.open_output_stream(f"{path}/{name}.counts") as counts:

            def put(key, n):
                nonlocal rows
                keys.write(key.astype("<i8").tobytes())
                counts.write(n.astype("<i8").tobytes())
                rows += len(key)
                ids, begin = np.unique(key >> 32, return_index=True)
                for i, m in zip(ids.tolist(), np.maximum.reduceat(n, begin).tolist() if len(begin) else ()):
                    best[i] = max(m, best.get(i, 0))

            for batch in batches:
                if batch.num_rows:
                    key, n = summed([last[0], batch.column("key").to_numpy()], [last[1], batch.column("n").to_numpy()])
                    first = key[0] if first is None else first
                    put(key[:-1], n[:-1])
                    last = key[-1:], n[-1:]
            put(*last)
        if rows:
            out = [[name], [int(first)], [rows], [list(best)], [list(best.values())]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["name", "first", "rows", "ids", "most"])

    dealt = partial.repartitionByRange("key").sortWithinPartitions("key")
    made = sorted(dealt.mapInArrow(write, "name string, first long, rows long, ids array<long>, most array<long>").collect(), key=lambda r: r.first)
    best = np.zeros(vocabulary, np.int64)
    for r in made:
        np.maximum.at(best, np.array(r.ids, np.int64), np.array(r.most, np.int64))
    return Counts(folder, [r.name for r in made], np.array([r.first for r in made], np.int64), np.array([r.rows for r in made], np.int64), best)


def count_pairs(docs: DataFrame, a: str, b: str, text_col: str = "text") -> Counts:
    """How many documents link each pair of tokens, in sorted shards that tasks look up."""
    partial = saved(pair_counts(docs.select(F.col(text_col).alias("text")), a, b))
    out = sorted_shards(partial, len(ByteLevel(a).bytes))
    forget(partial)
    return out


def align(docs: DataFrame, a: str, b: str, counts: Counts | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): how two tokenizers' tokens of each text lie over each other.

    `a` is a byte-level BPE file of tokenizers, `b` a sentencepiece model that adds a space.
    Texts are cut where both always end a token; a task aligns each distinct segment once,
    and a document's numbers are sums over its segments. Counts of pairs, unless given, are
    made by count_pairs() over these documents: partial counts by np.unique, one global
    sort by ranges, and sorted shards in the shared folder, which tasks map and search.
    Only the shards' names and each A id's highest count are sent to tasks.

    Texts that are null or empty, or that either tokenizer does not give back byte by
    byte, have no tokens: zeros and ''. Each row is a document, repeated ids and texts too;
    no rows give none. A text of any length without a space is one segment.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = counts or count_pairs(rows, a, b)
    held = broadcast(docs.sparkSession, counts)

    def run(batches):
        counts = held()
        aligned = Aligned(a, b, True)
        weight = np.zeros((2, 0), np.int64)  # of each known segment: links of the highest count, sum of counts
        for batch in batches:
            for part in chunks(batch):
                doc, at, new = documents_of(aligned, part.column("text"))
                links = aligned.links[aligned.end[new.start] :]
                distinct, inverse = np.unique(links, return_inverse=True)
                n = counts.look_up(distinct)
                best = n == counts.best[distinct >> 32]
                many = np.diff(aligned.end[new.start :])
                weight = np.concatenate([weight[:, : new.start], np.stack([_sums(best[inverse].astype(np.int64), many), _sums(n[inverse], many)])], axis=1)
                total = lambda x: np.bincount(doc, x[at], part.num_rows).astype(np.int64)
                numbers = [*(total(x) for x in aligned.n), total(np.diff(aligned.end)), *(total(x) for x in weight)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *map(pa.array, numbers), pa.array(digests(aligned.text, doc, at, part.num_rows))],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                )

    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def digests(texts: pa.Array, doc: np.ndarray, at: np.ndarray, documents: int) -> list[str]:
    """SHA-256 of each document's segments' groups, without the last semicolon; '' for documents without any."""
    out: list = [None] * documents
    last = np.r_[doc[1:] != doc[:-1], True][: len(doc)]
    for s in range(0, len(at), WRITTEN):
        own = texts.take(pa.array(at[s : s + WRITTEN]))
        end = np.cumsum(pc.binary_length(own).to_numpy().astype(np.int64))
        data = memoryview(own.buffers()[2])
        of = doc[s : s + WRITTEN]
        ends = np.flatnonzero(np.r_[of[1:] != of[:-1], True])
        begin = 0
        for e in ends:
            upto = int(end[e])
            if out[of[e]] is None:
                out[of[e]] = hashlib.sha256()
            out[of[e]].update(data[begin : upto - 1 if last[s + e] else upto])
            begin = upto
    return ["" if h is None else h.hexdigest() for h in out]


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    """Every document's tokens by a byte-level and a sentencepiece vocabulary, aligned; see align() for nulls, empty and odd texts, repeats and empty tables."""
    return align(load(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
