import random

import numpy as np
import pytest
import xxhash

from tickforge.llm.graph import components
from tickforge.llm.simhash import forest, keep_one_of_each, links, near_duplicates, op4_simhash

from .helpers import documents, small_corpus, words


def fingerprint(text, k=4):
    w = words(text)
    parts = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(items, linked):
    parent = list(range(len(items)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(items))]


ROWS = [(90, None), (91, ""), (92, " \n"), (93, "one"), (94, "ONE"), (95, "a b c"), (96, "a b c"), (96, "a b c"), (None, "a b c"), (97, "Ä b c d e")]


def test_against_all_pairs(spark):
    rows = ROWS + [(1000 + i, t) for i, t in small_corpus(spark)]
    got = sorted(((r.doc_id or -1, r.f0 % 2**64, r.component_id) for r in near_duplicates(documents(spark, rows).repartition(3)).collect()))
    prints = [fingerprint(t) for _, t in rows]
    group = classes(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for g, (i, _) in zip(group, rows):
        least[g] = min([x for x in (least.get(g), i) if x is not None], default=None)
    assert got == sorted((i or -1, p, least[g]) for (i, _), p, g in zip(rows, prints, group))


@pytest.mark.parametrize("bits,most,segments,n", [(64, 4, 3, 400), (64, 7, 4, 300), (128, 15, 8, 300), (64, 4, 3, 3000)])
def test_no_link_is_lost(spark, bits, most, segments, n):
    rng = random.Random(n + bits)
    seeds = [rng.getrandbits(bits) for _ in range(n // 6)]
    prints = {0}
    while len(prints) < n:
        x = rng.choice(seeds)
        for b in rng.sample(range(bits), rng.randint(0, most)):
            x ^= 1 << b
        seeds.append(x)
        prints.add(x)
    prints = sorted(prints)
    group = classes(prints, lambda a, b: (a ^ b).bit_count() <= most)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    nodes = spark.createDataFrame([(i, signed(p % 2**64), signed(p >> 64)) for i, p in enumerate(prints)], "node long, f0 long, f1 long")
    from tickforge.llm.simhash import linked_fingerprints

    got = {r.node: r.root for r in components(linked_fingerprints(nodes, most, segments, bits)).collect()}
    assert [got.get(i, i) for i in range(n)] == group


def test_large_groups_of_one_key():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 2**63, (5000, 2), dtype=np.uint64)
    f[:, 1] = 0
    f[1::5, 0] = f[0::5, 0] ^ np.uint64(0b1011)
    a, b = links(np.zeros(5000, np.int64), f, 4)
    node, root = forest(a, b)
    assert dict(zip(node.tolist(), root.tolist())) == {i + 1: i for i in range(0, 5000, 5)}


def test_a_large_group_without_links_is_cut():
    rng = np.random.default_rng(0)
    f = np.zeros((100_000, 2), np.uint64)
    f[:, 0] = rng.integers(0, 1 << 43, len(f)).astype(np.uint64)
    f[1::1000, 0] = f[::1000, 0] ^ np.uint64(0b1011 << 20)
    a, b = links(np.zeros(len(f), np.int64), f, 4)
    assert (np.bitwise_count(f[a, 0] ^ f[b, 0]) <= 4).all() and {(x, x + 1) for x in range(0, len(f), 1000)} <= set(zip(a.tolist(), b.tolist()))
    some = f[:6000] & np.uint64((1 << 20) - 1)
    near = np.argwhere(np.bitwise_count(some[:, None, 0] ^ some[None, :, 0]) <= 2)
    near = near[near[:, 0] < near[:, 1]]
    for x, y in zip(forest(*links(np.zeros(len(some), np.int64), some, 2)), forest(near[:, 0], near[:, 1])):
        assert (x == y).all()


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 300)] + [(7, 7), (500, 499)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {x: 100 for x in range(100, 300)} | {500: 499, 499: 499}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_of_each_group_stays(spark, tmp_path):
    documents(spark, ROWS).coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = keep_one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [90, 93, 95, 97]
    assert keep_one_of_each(docs.limit(0)).collect() == []


def test_query_covers_all(spark):
    d = "/root/testdata/sf0.001"
    got = op4_simhash(spark, d).collect()
    assert len(got) == 200 and all(len(r.fingerprint) == 16 and r.component_id <= r.doc_id for r in got)
