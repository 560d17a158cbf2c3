import pyarrow as pa

from tickforge.llm.common import chunks, hash_words, joined_words, numbered, rolling_hash, split_words

from .helpers import words

TEXTS = ["A b\x0bC", None, "", " x  É y ", "d" * 50, "e f " * 20, "g\x1ch"]


def test_chunks_cover_a_batch():
    batch = pa.RecordBatch.from_pydict({"text": TEXTS * 3, "n": list(range(21))})
    for limit in (1, 30, 1000):
        parts = list(chunks(batch, limit=limit))
        assert [x for p in parts for x in p.column("n").to_pylist()] == list(range(21))
        for lower in (True, False):
            got = []
            for p in parts:
                flat, count = split_words(p.column("text"), lower)
                flat = flat.to_pylist()
                for c in count:
                    got.append([x.encode() for x in flat[:c]])
                    flat = flat[c:]
            assert got == [words(t, lower) for t in TEXTS * 3]
    assert list(chunks(batch.slice(0, 0))) == []


def test_hashes_depend_on_words_alone():
    a, _ = split_words(pa.array(["p q r s t q r s"]), True)
    h = rolling_hash(hash_words(a), 3)
    assert len(h) == 6 and h[1] == h[5] and len(set(h.tolist())) == 5
    joined, start, end = joined_words(a)
    assert joined == b"p q r s t q r s" and joined[start[4] : end[6]] == b"t q r"


def test_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)], "k long, v long").repartition(7)
    got = {r.k: r.n for r in numbered(df, ["k"], "n").collect()}
    assert got == {k: k for k in range(101)}
