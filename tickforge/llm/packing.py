"""Packing by power-of-two decomposition: no sequence crosses a document and none is padded."""

import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, load, split_words

#: Text bytes whose distinct words are tokenised together.
CHUNK = 4 << 20

#: Distinct words whose encodings are held at once, and whose ids a task remembers.
ENCODED, REMEMBERED = 20_000, 500_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_lengths(tokens: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, length) of the pieces of texts of so many tokens, in order.

    Lengths are powers of two of `longest` at most and add up to the text's tokens; the
    longest come first.
    """
    whole, rest = np.divmod(tokens, longest)
    bit = 1 << np.arange(longest.bit_length() - 2, -1, -1)
    text, at = np.nonzero(rest[:, None] & bit)
    text = np.concatenate([np.repeat(np.arange(len(tokens)), whole), text])
    by = np.argsort(text, kind="stable")
    return text[by], np.concatenate([np.full(int(whole.sum()), longest, np.int64), bit[at]])[by]


#: Words that this tokenizer neither changes nor splits before it merges bytes: lower-case Latin letters.
PLAIN = re.compile("[a-zß-öø-ÿ]+")


class Words:
    """The tokenizer, and the ids of words that it was asked for: one buffer of ids, and each word's place in it.

    `whole` takes any word; `plain` lacks the steps that leave PLAIN words as they are.
    The special tokens are cut out of a text before its words are looked at.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.whole.encode_special_tokens = self.plain.encode_special_tokens = True
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = {t.content: i for i, t in self.whole.get_added_tokens_decoder().items() if t.special}
        self.forget()

    def forget(self) -> None:
        self.known, self.end, self.ids = pa.array([], pa.large_string()), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def find(self, words: pa.Array) -> np.ndarray:
        """The places of distinct words in `end`, where word i has ids[end[i] : end[i + 1]]."""
        if len(self.known) > REMEMBERED:
            self.forget()
        at = pc.index_in(words, value_set=self.known)
        missing = words.filter(pc.is_null(at))
        new: tuple[list[str], list[str]] = ([], [])
        for x in missing.to_pylist():
            new[PLAIN.fullmatch(x) is not None].append(x)
        for model, mine in zip((self.whole, self.plain), new):
            for s in range(0, len(mine), ENCODED):
                some = mine[s : s + ENCODED]
                ids = [e.ids for e in model.encode_batch_fast(some, add_special_tokens=False)]
                size = np.fromiter(map(len, ids), np.int64, len(ids))
                self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(size.sum()))])
                self.end = np.concatenate([self.end, self.end[-1] + np.cumsum(size)])
                self.known = pa.concat_arrays([self.known, pa.array(some, pa.large_string())])
        return (pc.index_in(words, value_set=self.known) if len(missing) else at).to_numpy()


def segments(texts: pa.Array, special: dict[str, int], end_id: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The texts cut at special tokens, the id that ends each segment, and how many segments each text has."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    has = np.zeros(len(texts), bool)
    for content in special:
        has |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
    if not has.any():
        return texts, np.full(len(texts), end_id, np.uint32), np.ones(len(texts), np.int64)
    cut = re.compile("(" + "|".join(map(re.escape, special)) + ")")
    split = [cut.split(t.as_py()) if h else [t.as_py()] for t, h in zip(texts, has)]
    parts, ends = [], []
    for x in split:
        parts += x[::2]
        ends += [*(special[c] for c in x[1::2]), end_id]
    return pa.array(parts, pa.large_string()), np.array(ends, np.uint32), np.array([len(x) // 2 + 1 for x in split])


def token_ids(words: Words, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each ended by `end_id`, one after another, and how many each text has.

    For tokenizers that fold case, drop white space and end words at it and between a
    letter and a full stop or comma, as word_bpe_49k does: each distinct word is
    tokenised once, and the texts' ids are gathered from the words'.
    """
    texts, ends, per_text = segments(texts, words.special, end_id)
    lower = pc.ascii_lower(texts)
    each, count = split_words(pc.replace_substring_regex(lower, "([a-z])([.,])", r"\1 \2"), lower=False)
    coded = each.dictionary_encode()
    place = words.find(coded.dictionary)
    begin, size = words.end[place], words.end[place + 1] - words.end[place]
    # The id that ends a segment is one more word behind the segment's words.
    kinds, kind = np.unique(ends, return_inverse=True)
    pool = np.concatenate([words.ids, kinds])
    begin = np.concatenate([begin, len(words.ids) + np.arange(len(kinds))])
    size = np.concatenate([size, np.ones(len(kinds), np.int64)]).astype(np.int32)
    last = np.cumsum(count + 1) - 1
    word = np.zeros(len(each) + len(count), np.int32)
    own = np.ones(len(word), bool)
    own[last] = False
    word[own] = coded.indices.to_numpy()
    word[last] = len(place) + kind
    n = size[word]
    upto = np.cumsum(n, dtype=np.int64)
    shift = begin[word] - (upto - n)
    out = pool[np.repeat(shift, n) + np.arange(int(upto[-1]) if len(upto) else 0)]
    done = np.r_[0, upto[last[np.cumsum(per_text) - 1]]] if len(per_text) else np.zeros(1, np.int64)
    return out, np.diff(done)


def pack_power_of_two(
    docs: DataFrame,
    tokenizer: str,
    max_tokens: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    ids_as: str = "array",
) -> DataFrame:
    """Tokenises each text, ends it with `end_id` and cuts it into pieces of binary lengths.

    A document of n ids gives n // max_tokens whole pieces and one piece for each
    bit set in the remainder. Each piece is a sequence of its own, so it never
    crosses a document; sequences of one length make a bucket, and a batch drawn
    from one bucket needs no padding. `max_tokens` must be a power of two.

    Returns doc_id, start, length, doc_tokens, sequence_id, offset (always 0), bucket
    (log2 of the length) and ids: array<int>, or with ids_as="binary" their
    little-endian unsigned 32-bit bytes. A null or empty text has the end id only.
    Repeated rows and ids are packed once for each row. The rows need no shuffle: a
    task streams over its own texts, CHUNK bytes at a time (a longer text by itself).
    Special tokens written in a text give their ids, as the tokenizer itself does.
    """
    if max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")

    def pack(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = Words(tokenizer)
        for batch in batches:
            for part in chunks(batch, limit=CHUNK):
                ids, count = token_ids(words, part.column("text"), end_id)
                document, length = piece_lengths(count, max_tokens)
                end = np.cumsum(length)
                start = end - length - (np.cumsum(count) - count)[document]
                # The pieces lie in the ids one after another, so their bytes are taken as they are.
                if ids_as == "binary":
                    offsets = pa.py_buffer(np.r_[0, 4 * end].astype(np.int32))
                    own = pa.Array.from_buffers(pa.binary(), len(end), [None, offsets, pa.py_buffer(ids.astype("<u4"))])
                else:
                    own = pa.ListArray.from_arrays(pa.array(np.r_[0, end].astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(document)), pa.array(start), pa.array(length), pa.array(count[document]), own],
                    names=["doc_id", "start", "length", "doc_tokens", "ids"],
                )

    kind = "binary" if ids_as == "binary" else "array<int>"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = rows.mapInArrow(
        pack,
        f"doc_id long, start long, length long, doc_tokens long, ids {kind}",
    )
    return pieces.select(
        "doc_id",
        "start",
        "length",
        "doc_tokens",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.round(F.log2("length")).cast("int").alias("bucket"),
        "ids",
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Writes each bucket's sequences to a folder of its own, to be read in batches of one length."""
    pieces.write.partitionBy("bucket").parquet(path)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces of binary lengths up to 2048 tokens, each a sequence of its own; CRC-32 of its ids' bytes."""
    pieces = pack_power_of_two(load(spark, sf_dir, "documents"), tokenizer_path(), ids_as="binary")
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )
