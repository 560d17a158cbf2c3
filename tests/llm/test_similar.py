import random

import numpy as np
import pytest

import corpus_pipeline as p
from tickforge.llm import similar

from .helpers import documents, similarity
from .test_simhash import ROWS, classes


def kept(spark, tmp_path, rows):
    documents(spark, rows).repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = p.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    return sorted(r.doc_id for r in got.collect())


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"e{rng.getrandbits(40)}"
    return words


def family(rng, texts, length, edits):
    seed = [f"w{rng.getrandbits(40)}" for _ in range(length)]
    return [" ".join(edited(rng, seed, rng.choice(edits))) for _ in range(texts)]


def least_of_each(rows):
    group = classes([t for _, t in rows], lambda a, b: 5 * similarity(a, b) >= 4)
    return sorted({g: i for (i, _), g in reversed(list(zip(rows, group)))}.values())


def test_only_similar_texts_are_linked(spark, tmp_path):
    """Families at 0.55 to 0.79, whose fingerprints differ in few bits, lose nothing but true near copies."""
    rng = random.Random(5)
    texts = [t for _ in range(12) for t in family(rng, 12, 200, (2, 3, 4, 5, 6))]
    rows = list(enumerate(texts))
    want = least_of_each(rows)
    assert len(rows) > len(want) > 12
    assert kept(spark, tmp_path, rows) == want


@pytest.mark.parametrize("size", [similar.SLICE, 1500])
def test_large_groups_in_slices(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(similar, "SLICE", size)
    rng = random.Random(6)
    texts = family(rng, 60, 150, (0, 1, 2, 3)) + family(rng, 40, 100, (2, 3)) + [f"alone {i} " * 9 for i in range(20)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert kept(spark, tmp_path, rows) == least_of_each(rows)


def test_awkward_texts(spark, tmp_path):
    assert kept(spark, tmp_path, [r for r in ROWS if r[0] is not None]) == [90, 93, 95, 97]


def test_pairs_join_what_is_linked():
    rng = np.random.default_rng(2)
    base = np.sort(rng.integers(0, 2**62, 100, dtype=np.uint64))
    sets = [np.sort(rng.permutation(base)[: rng.integers(60, 101)]) for _ in range(50)] + [np.arange(7, dtype=np.uint64)]
    a, b = similar.similar_pairs(np.concatenate(sets), np.array([len(x) for x in sets]), (4, 5))
    linked = lambda x, y: 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y))
    assert all(linked(sets[x], sets[y]) for x, y in zip(a, b))
    group = classes(sets, linked)
    from tickforge.llm.simhash import forest

    got = dict(zip(*(x.tolist() for x in forest(a, b))))
    assert [got.get(i, i) for i in range(51)] == group


def pairs_just_over(n):
    """n pairs of texts whose similarity is 41 / 51, and an equal number of pairs at 39 / 49, just under 0.8."""
    rng = random.Random(8)
    rows = []
    for length in (50, 48):
        for _ in range(n):
            words = [f"w{rng.getrandbits(40)}" for _ in range(length)]
            other = list(words)
            other[rng.randrange(4, length - 4)] = f"e{rng.getrandbits(40)}"
            rows += [" ".join(words), " ".join(other)]
    return list(enumerate(rows))


def test_every_pair_just_over_the_threshold_is_linked(spark, tmp_path):
    rows = pairs_just_over(400)
    assert 0.8 <= similarity(rows[0][1], rows[1][1]) < 0.81 and 0.79 < similarity(rows[800][1], rows[801][1]) < 0.8
    assert kept(spark, tmp_path, rows) == [i for i, _ in rows if i % 2 == 0 or i > 800]


def test_simhash_finds_near_copies_by_itself(spark, tmp_path):
    """Without MinHash keys, pairs lose a member if their fingerprints are linked and their similarity is 0.8 or more."""
    rng = random.Random(9)
    texts = [t for _ in range(40) for seed in [[f"w{rng.getrandbits(40)}" for _ in range(300)]] for t in (" ".join(seed), " ".join(edited(rng, seed, 1)))]
    texts += [t for _ in range(300) for seed in [[f"w{rng.getrandbits(40)}" for _ in range(34)]] for t in (" ".join(seed), " ".join([*seed[:17], f"e{rng.getrandbits(40)}", *seed[18:]]))]
    rows = [*enumerate(texts), (len(texts), ""), (len(texts) + 1, None)]
    documents(spark, rows).repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    print_of = {r.doc_id: r.f0 & (1 << 64) - 1 for r in similar.sketches(docs.withColumn(similar.ROW, docs.doc_id), 5, 1, 4).collect()}
    bits = [(print_of[i] ^ print_of[i + 1]).bit_count() for i in range(0, len(texts), 2)]
    gone = {2 * i + 1 for i, n in enumerate(bits) if n <= 5 and 5 * similarity(texts[2 * i], texts[2 * i + 1]) >= 4}
    assert len(gone) >= 20 and any(n <= 5 for n in bits[40:]) and all(5 * similarity(texts[i], texts[i + 1]) < 4 for i in range(80, len(texts), 2))
    got = {r.doc_id for r in similar.keep_one_of_similar(docs, bands=0).collect()}
    assert got == set(range(len(texts) + 1)) - gone
