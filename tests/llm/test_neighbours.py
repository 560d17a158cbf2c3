import duckdb
import numpy as np

from pyspark.sql import functions as F

from tickforge.llm.neighbours import OP6_SQL, nearest, op6_neighbours


def brute(rows, k):
    out = []
    ok = [(n, i, np.array(v, float)) for n, (i, v) in enumerate(rows) if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    for n, i, v in ok:
        if i % 3 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, j, w in ok if m != n and len(w) == len(v))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (405, [float("inf")] * 16), (408, [None] + [1.0] * 15)]
    rows += [(411, [1.0, 2.0]), (412, [2.0, 1.0]), (414, rows[6][1]), (6, rows[6][1]), (417, [1e30] * 16), (420, [1e-30] * 16)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, row int, v string").repartition(3)
    got = nearest(df, F.col("vec_id") % 3 == 0, 7, query_block=50, candidate_block=60).collect()
    as32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, got)) == brute(as32, 7)


def test_products_that_overflow(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.choice([0, 100, 160, -200])).tolist()) for i in range(200)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 3 == 0, 5, query_block=30, candidate_block=40).collect()
    with np.errstate(all="ignore"):
        best = {i: sorted(((float(np.cumsum(np.array(v) * np.array(w))[-1]), j) for j, w in rows if j != i), key=lambda x: (np.isnan(x[0]), -x[0], x[1]))[:5] for i, v in rows if i % 3 == 0}
    for i, want in best.items():
        mine = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == i)
        assert [m[2] for m in mine] == [j for _, j in want] and np.allclose([m[1] for m in mine], [s for s, _ in want], equal_nan=True)


def test_no_vectors(spark):
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 2 == 0).collect() == []


def test_query_equals_its_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    want = con.sql(f"select query_id, rank, vec_id, score from ({OP6_SQL}) order by 1, 2").fetchall()
    got = op6_neighbours(spark, d).select("query_id", "rank", "vec_id", "score").orderBy("query_id", "rank").collect()
    assert [tuple(r)[:3] for r in got] == [w[:3] for w in want]
    print("exactly equal scores:", np.mean([r.score == w[3] for r, w in zip(got, want)]))
    assert np.allclose([r.score for r in got], [w[3] for w in want], rtol=1e-12)
