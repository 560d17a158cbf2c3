import math

import duckdb
import numpy as np

from pyspark.sql import functions as F

from tickforge.llm.pivots import OP13_SQL, annuli, choose, op13_pivots, top_k


def brute(rows, k, asks):
    ok = [(n, i, [math.floor(1024 * x) if abs(x) < 2.0**900 else int(x) * 1024 for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, v in ok:
        if asks(i):
            score = [(max(min(sum(a * b for a, b in zip(v, w)), 2**63 - 1), -(2**63)), j) for m, j, w in ok if m != n]
            best = sorted(score, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
            out += [(i, r, j, s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out, key=str)


def table(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, row int, v string, annulus int").repartition(3)


def found(spark, rows, k, mod=3, **parameters):
    got = top_k(table(spark, rows), F.col("vec_id") % mod == 0, k, **parameters)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()), key=str)


def clusters(rng, n, width=8, number=6):
    middle = rng.normal(size=(number, width))
    return [(i, (middle[i % number] + 0.02 * rng.normal(size=width)).tolist()) for i in range(n)]


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = clusters(rng, 500) + [(600 + i, rng.normal(size=8).tolist()) for i in range(100)]
    rows += [(1000, None), (1002, [float("nan")] * 8), (1005, [float("inf")] + [1.0] * 7), (1008, [None] + [1.0] * 7)]
    rows += [(1011, [0.0] * 8), (1014, []), (1017, [1.0, 2.0]), (1020, [1.0] * 12), (1021, [-0.5] * 40), (6, rows[6][1]), (None, rows[6][1]), (1023, rows[9][1])]
    for parameters in ({"block": 20}, {"block": 50, "pivots": 5, "rounds": (2, 3)}, {}):
        assert found(spark, rows, 7, **parameters) == brute(rows, 7, lambda i: i is not None and i % 3 == 0)


def test_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.choice([0, 3, 6, 9, 40, 300])).tolist()) for i in range(150)]
    assert found(spark, rows, 5, block=16) == brute(rows, 5, lambda i: i % 3 == 0)


def test_many_copies_of_one_vector(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [0.5, 0.25, -0.5]) for i in range(0, 600, 2)] + [(i, rng.normal(size=3).tolist()) for i in range(1, 600, 2)]
    assert found(spark, rows, 10, mod=20, block=32) == brute(rows, 10, lambda i: i % 20 == 0)
    same = [(i, [1.0, 1.0]) for i in range(200)]
    assert found(spark, same, 4, mod=20, block=16) == brute(same, 4, lambda i: i % 20 == 0)


def test_few_and_no_rows(spark):
    assert found(spark, [], 5) == [] == found(spark, [(3, [1.0])], 5) == found(spark, [(3, None)], 5)
    assert found(spark, [(3, [1.0]), (4, [-1.0])], 5) == [(3, 1, 4, -1024 * 1024)]


def test_bounds_hold_and_spare_annuli():
    rng = np.random.default_rng(6)
    x = np.floor(1024 * np.array([v for _, v in clusters(rng, 3000)]))
    radius = np.sqrt((x**2).sum(axis=1).max())
    p = choose(x[:500], radius, 6)
    d = p.distances(x, True)
    near, step = d.argmin(axis=1), (d.min(axis=1) / p.step).astype(int)
    counts = np.zeros((len(p.place), 512), np.int64)
    np.add.at(counts, (near, step), 1)
    made = annuli(counts, p.step, 100)
    of = made.of[near, step]
    assert (of >= 0).all() and made.parts.sum() >= 30 and (np.bincount(of) <= 100 * made.parts).all()
    q = x[::100]
    bound = made.bounds(p.distances(q, False))
    true = np.sqrt((q**2).sum(axis=1)[:, None] + radius**2 - 2 * q @ x.T)
    assert (bound[:, of] <= true + 1e-6 * radius).all()
    kth = np.sort(true, axis=1)[:, 10]
    assert (bound > kth[:, None]).mean() > 0.5


def test_query_equals_its_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    want = con.sql(f"select query_id, rank, vec_id, score from ({OP13_SQL}) order by 1, 2").fetchall()
    got = op13_pivots(spark, d).select("query_id", "rank", "vec_id", "score").orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == want and len(want) == 50
