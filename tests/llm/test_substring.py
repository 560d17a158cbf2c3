import hashlib
import random

import duckdb
import pytest

from tickforge.llm.substring import OP5_SQL, op5_substring, remove_repeats

from .helpers import documents, words


def expected(rows, window=50):
    first, out = {}, []
    key = lambda d: float("inf") if d is None else d
    split = [(d, words(t, lower=False)) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            first[x] = min(first.get(x, key(d)), key(d))
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < key(d):
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key(d), len(w), len(gone), kept.decode()))
    return sorted(out)


def case(seed, window):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("éklmnop") + rng.choice(["", "q", "Q."])
    text = lambda n: [word() for _ in range(n)]
    passages = [text(n) for n in (window, window + 1, window - 1, 3 * window, 7 * window)]
    rows = []
    for i in rng.sample(range(1000), 60):
        w = text(rng.randint(0, 3 * window))
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "changed"
            a = rng.randint(0, len(w))
            w[a:a] = p
        rows.append((i, " ".join(w) if rng.random() < 0.8 else "\n ".join(w) + " "))
    rows += [(2000, rows[3][1]), (2001, rows[3][1]), (rows[5][0], rows[5][1]), (rows[6][0], rows[7][1]), (None, rows[8][1]), (2002, None), (2003, ""), (2004, "a " * 200), (2005, "a " * 300)]
    return rows


@pytest.mark.parametrize("window,anchor", [(50, 10), (8, 3)])
def test_against_brute_force(spark, window, anchor):
    rows = case(window, window)
    got = remove_repeats(documents(spark, rows).repartition(4), window, anchor).collect()
    assert sorted((float("inf") if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == expected(rows, window)


def test_no_documents(spark):
    assert remove_repeats(documents(spark, [])).collect() == []


def test_query_on_a_real_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = [(i, n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k in expected(rows)]
    assert sorted(map(tuple, op5_substring(spark, d).collect())) == want
    assert any(m for _, _, m, _ in want)


def test_query_equals_its_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet'")
    want = con.sql(f"select doc_id, n_words, n_removed, kept_sha256 from ({OP5_SQL})").fetchall()
    assert sorted(map(tuple, op5_substring(spark, d).collect())) == sorted(want) and sum(w[2] for w in want) > 1000
