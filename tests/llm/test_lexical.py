import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tickforge.llm.lexical import OP11_SQL, maxscore, op11_lexical, search

from .helpers import documents, lower_az

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, k=20):
    """docs and items: (id, text). Scores by the definition, term by term."""
    terms = [Counter(TERM.findall(lower_az(t))) for _, t in docs]
    there = [c for c in terms if c]
    total, length = len(there), sum(sum(c.values()) for c in there)
    df = Counter(t for c in there for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, _), c in zip(docs, terms):
            n = sum(c.values())
            if not n:
                continue
            m = 100 - 25 + 25 * n * total // length
            score = 0
            for t in TERM.findall(lower_az(text)):
                if t in c:
                    score += math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def texts(rng, n, size=30):
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(n * size)]
    return [" ".join(words[i * size : i * size + rng.randrange(size + 1)]) for i in range(n)]


AWKWARD = ["", " ", ".,!", "É école_École É", "A-B a.b C3po\x00c3PO", "naïve ２３ x" * 3, "w1 " * 5000, "w1", "w1", "w2 w1 w2"]


@pytest.mark.parametrize("shard", [1, 7, 1 << 21])
def test_search_equals_brute_force(spark, shard):
    rng = random.Random(shard)
    docs = list(enumerate(texts(rng, 120) + AWKWARD)) + [(None, "w1 w3"), (7, "w1 w3"), (7, "w1 w3"), (200, None)]
    items = list(enumerate(texts(rng, 12, 12) + AWKWARD)) + [(3, "w1 w1 w2"), (3, "w1 w1 w2"), (None, "w3"), (9, None), (10, "absent")]
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, term string, times int").repartition(2)
    got = search(documents(spark, docs).repartition(3), asked, shard_postings=shard)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_passes_of_items_give_the_same(spark):
    rng = random.Random(5)
    docs, items = list(enumerate(texts(rng, 60))), list(enumerate(texts(rng, 20, 10)))
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = search(documents(spark, docs), asked, k=4, pass_terms=30)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 4)


def test_ties_beyond_the_last_rank_go_to_smaller_ids(spark):
    docs = [(i, "same words here") for i in random.Random(1).sample(range(1000), 300)]
    got = search(documents(spark, docs).repartition(5), spark.createDataFrame([(1, "words")], "item_id long, text string"), shard_postings=40)
    assert [r.doc_id for r in got.orderBy("rank").collect()] == sorted(i for i, _ in docs)[:20]


def test_lists_that_cannot_matter_are_only_probed():
    rng = np.random.default_rng(0)
    lists = []
    for t in range(12):
        docs = np.sort(rng.choice(5000, 2000 if t else 40, replace=False))
        lists.append((docs, rng.integers(1, 10, len(docs)) if t else rng.integers(900, 1000, len(docs))))
    times, most = np.ones(12, np.int64), np.array([x[1].max() for x in lists])
    where, score = maxscore(lists, times, most, 5000, 5, 0)
    whole = np.zeros(5000, np.int64)
    for docs, adds in lists:
        whole[docs] += adds
    assert len(where) < 40 and (score == whole[where]).all()
    assert set(np.argsort(-whole, kind="stable")[:5]) <= set(where.tolist())
    assert not len(maxscore(lists, times, most, 5000, 5, int(whole.max()) + 1)[0])


def test_empty_tables(spark):
    no_docs, no_items = documents(spark, []), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search(no_docs, some).collect() == [] == search(documents(spark, [(1, "a")]), no_items).collect()
    assert search(documents(spark, [(1, None), (2, "--")]), some).collect() == []


def test_query_equals_its_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = con.sql(f"select item_id, rank, doc_id, score from ({OP11_SQL})").fetchall()
    got = op11_lexical(spark, d).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 500
