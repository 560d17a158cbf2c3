import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tickforge.llm import alignment
from tickforge.llm.alignment import Aligned, ByteLevel, align, byte_of_letter, op12_alignment, segments, summed
from tickforge.llm.packing import tokenizer_path

from .helpers import documents, small_corpus

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(models, text):
    """(id, bytes) of both sides, of the whole text at once."""
    a, b = models
    letters = byte_of_letter()
    byte = re.compile("<0x([0-9A-F]{2})>")
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes.fromhex(m[1]) if (m := byte.fullmatch(p := b.id_to_piece(i))) else p.replace("▁", " ").encode()) for i in b.encode(text)]
    return left, right


def ends(side):
    return np.cumsum([len(x) for _, x in side]).tolist()


def brute(models, docs):
    each, count = [], Counter()
    for _, text in docs:
        groups, links = [], []
        if text:
            left, right = tokens(models, text)
            want = (" " + text).encode()
            if b"".join(x for _, x in left) == want == b"".join(x for _, x in right):
                both, place = sorted(set(ends(left)) & set(ends(right))), {}
                for side, own in enumerate((left, right)):
                    for (i, x), e in zip(own, ends(own)):
                        place.setdefault(next(b for b in both if e <= b) if len(both) < 50 else min(b for b in both if e <= b), ([], []))[side].append((i, e - len(x), e))
                for b in both:
                    groups.append(place[b])
                    links += [(i, j) for i, s, e in place[b][0] for j, t, f in place[b][1] if s < f and t < e]
        each.append((groups, links))
        count.update(set(links))
    best = {}
    for (i, _), n in count.items():
        best[i] = max(n, best.get(i, 0))
    out = []
    for (doc, _), (groups, links) in zip(docs, each):
        text = ";".join("|".join(",".join(str(i) for i, *_ in side) for side in g) for g in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        n = [sum(len(g[s]) for g in groups) for s in (0, 1)]
        out.append((doc, *n, len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), digest))
    return sorted(out, key=str)


AWKWARD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b   c\n\n d\r\n e\t f", "<s> </s> <unk> <|endoftext|> x", "<0x0A> <0x", "▁literal", "x ▁ y", "é è à café au  lait et  plus",
    "　 wide   spaces  here      x\u0085 y   z", "日本語 テスト 한국어 😀😀 👩‍👩‍👧", "a\x00b \x00 \x1c x\x1d y \x7f z", "don't we'll I'M 123 4567 ... --- ++x", "); \r x{\r\n }", "́ combining é ﻿ bom",
    "word " * 400, "z" * 3000, "same words here", "same words here",
]


def test_equals_whole_texts_by_the_libraries(spark, models):
    docs = list(enumerate(AWKWARD)) + [(None, "null id"), (3, "again"), (3, "again")] + [(100 + i, t[:3000]) for i, t in small_corpus(spark)[:40]]
    got = align(documents(spark, docs).repartition(3), A, B)
    assert sorted(map(tuple, got.collect()), key=str) == brute(models, docs)


def test_small_memories_change_nothing(spark, models, monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé '▁") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(30)))) for i in range(120)]
    table = pa.RecordBatch.from_pydict({"text": [t for _, t in docs]})
    for name, value in (("REMEMBERED", 20), ("ENCODED", 7), ("WRITTEN", 11)):
        monkeypatch.setattr(alignment, name, value)
    aligned, got = Aligned(A, B, True), []
    for s in range(0, 120, 10):
        part = table.column("text").slice(s, 10).cast(pa.large_string())
        doc, at, _ = alignment.documents_of(aligned, pa.array(part.to_pylist(), pa.large_string()))
        got += list(zip(np.bincount(doc, aligned.n[0][at], 10), np.bincount(doc, np.diff(aligned.end)[at], 10), alignment.digests(aligned.text, doc, at, 10)))
    want = {r[0]: r for r in brute(models, docs)}
    assert [(int(n), int(k), h) for n, k, h in got] == [(want[i][1], want[i][4], want[i][7]) for i, _ in docs]


def test_encoder_gives_the_files_own_ids(models):
    rng, own = random.Random(4), ByteLevel(A)
    pool = ["etaoinshr", "aAbB09-_.,;: \n\t'sdt", "éàñüß日本語한국어абв😀 　 ‍ ", "".join(map(chr, range(256)))]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for letters in pool for _ in range(3000)]
    texts += ["".join(own.bytes[rng.randrange(50256)].decode("utf-8", "ignore") for _ in range(3)) for _ in range(10_000)]
    assert own.encode(texts) == [e.ids for e in models[0].encode_batch_fast(texts, add_special_tokens=False)]


def test_segments_are_the_text():
    texts = [t for t in AWKWARD] + ["a  b", "à b é c"]
    each, count = segments(pa.array(texts))
    end = np.cumsum(count)
    for t, e, n in zip(texts, end, count):
        assert "".join(each[e - n : e].to_pylist()) == (" " + t if t else "")
    assert each[int(end[-1]) - 4 :].to_pylist() == [" à", " b", " é", " c"] and count[-2] == 1


def test_sums_of_runs_and_shards(spark):
    assert [x.tolist() for x in summed([np.array([3, 1]), np.array([1])], [np.array([2, 5]), np.array([7])])] == [[1, 3], [12, 2]]
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 50, 4000) << 32 | rng.integers(0, 40, 4000)
    counts = alignment.sorted_shards(spark.createDataFrame([(int(k), 2) for k in keys], "key long, n long").repartition(7), 50)
    distinct, n = np.unique(keys, return_counts=True)
    assert (counts.look_up(distinct) == 2 * n).all() and counts.rows.sum() == len(distinct)
    assert (counts.look_up(np.array([5 << 33 | 1 << 20, 99 << 32])) == 0).all()
    assert all(counts.best[a] == 2 * n[distinct >> 32 == a].max() for a in range(50))
    with pytest.raises(Exception):
        alignment.opened("nosuchstore://x/y")


def test_empty_table_and_texts_without_tokens(spark):
    assert align(documents(spark, []), A, B).collect() == []
    assert [tuple(r) for r in align(documents(spark, [(1, None), (2, "▁")]), A, B).orderBy("doc_id").collect()] == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_query_gives_every_document(spark):
    d = "/root/testdata/sf0.001"
    got = op12_alignment(spark, d)
    assert got.count() == spark.read.parquet(f"{d}/documents.parquet").count() and got.where("n_links < n_a").count() == 0
