import math
from collections import defaultdict

from tickforge.llm.language import held_out, identify, op9_language, train

from .helpers import crc, documents


def plain_bits(texts, text, order):
    """PPM code length, byte by byte from dictionaries."""
    counts = defaultdict(lambda: defaultdict(int))
    for t in texts:
        data = b"\n" * order + t.encode()
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts[data[i - k : i]][data[i]] += 1
    data, bits = b"\n" * order + text.encode(), 0.0
    for i in range(order, len(data)):
        for k in range(order, -2, -1):
            if k < 0:
                bits += 8
                break
            seen = counts.get(data[i - k : i])
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if data[i] in seen:
                bits += math.log2(total / seen[data[i]])
                break
            bits += math.log2(total / len(seen))
    return bits


LEARN = [(1, "the cat sat on the mat", "en"), (2, "and the dog ran", "en"), (3, "le chat est là", "fr"), (4, "où est le chien", "fr"), (5, None, "en"), (6, "lost", None)]


def test_code_lengths_are_exact(spark):
    model = train(spark.createDataFrame(LEARN, "doc_id long, text string, lang string"), order=2)
    asked = [(1, "the chat ran là ÿ"), (2, "est"), (3, "a" * 300), (4, "12"), (5, None), (6, ""), (6, "")]
    got = {(r.doc_id, r.text): r for r in identify(documents(spark, asked), model).collect()}
    assert model.languages == ["en", "fr"]
    for i, t in asked:
        row = got[i, t]
        if not t or not any(c.isalpha() for c in t):
            assert (row.lang_pred, row.score, row.bits_per_byte) == ("und", 0.0, None)
            continue
        bits = {x: plain_bits([a for _, a, y in LEARN if y == x and a], t, 2) for x in ("en", "fr")}
        best = min(bits, key=bits.get)
        assert row.lang_pred == best
        assert math.isclose(row.bits_per_byte, bits[best] / len(t.encode()), rel_tol=1e-9)
        assert math.isclose(row.score, 1 / sum(2 ** (bits[best] - b) for b in bits.values()), rel_tol=1e-6)


def test_nothing_learned_and_nothing_asked(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = train(empty)
    assert [r.lang_pred for r in identify(documents(spark, [(1, "abc")]), model).collect()] == ["und"]
    model = train(spark.createDataFrame(LEARN, "doc_id long, text string, lang string"))
    assert identify(documents(spark, []), model).collect() == []


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    got = op9_language(spark, d).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) for r in got)
    ours = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out and truth[r.doc_id]]
    assert sum(ours) / len(ours) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_split_of_null_id(spark):
    assert documents(spark, [(None, "a")]).select(held_out().alias("h")).first().h is False
