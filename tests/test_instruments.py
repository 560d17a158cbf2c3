import random

from tickforge.operators import tables
from tickforge.sources import instruments as I


def test_many_keywords_equal_scans(spark):
    rng = random.Random(1)
    rows = [(str(i), "".join(rng.choice("abcé ") for _ in range(rng.randrange(9))), "m") for i in range(300)] + [("x1", None, "m"), ("", "abcabc", "m")]
    words = {"".join(rng.choice("abcé 12") for _ in range(n)) for n in (1, 2, 3, 4, 5) for _ in range(25)} | {"abc", "zzz", "abcabca"}
    keywords = [(w,) for w in words] + [("abc",), ("",), (None,)]
    table = spark.createDataFrame(rows, "symbol string, name string, market string").repartition(3)
    got = sorted(map(tuple, I.search_many(table, spark.createDataFrame(keywords, "keyword string")).collect()), key=str)
    assert got == sorted({(w, s, n) for w in words for s, n, _ in rows if w in s or w in (n or "")}, key=str) and len(got) > 500
    tried = I.candidates(I.trigram_index(table), spark.createDataFrame([("abcé",), ("éab",)], "keyword string")).count()
    assert tried < 40


def test_postings_are_never_broadcast(spark, tmp_path, monkeypatch):
    """Spark takes them for as small as their file; at 60 times sf0.1 their broadcast took all of the driver's memory."""
    rows = [(str(i), f"Customer#{i:09d}") for i in range(3000)]
    spark.createDataFrame(rows, "symbol string, name string").write.parquet(str(tmp_path / "i"))
    words = [f"{i:03d}" for i in range(0, 1000, 7)] + ["1", "42"]
    spark.createDataFrame([(w,) for w in words], "keyword string").write.parquet(str(tmp_path / "k"))
    want = sorted((w, s, n) for w in words for s, n in rows if w in s or w in n)
    for most in (1 << 20, 0):
        monkeypatch.setattr(I, "SENT", most, raising=False)
        got = I.search_many(spark.read.parquet(str(tmp_path / "i")), spark.read.parquet(str(tmp_path / "k")))
        assert sorted(map(tuple, got.collect())) == want
        lines = [(len(x) - len(x.lstrip(" :+-")), x) for x in got._jdf.queryExecution().executedPlan().toString().splitlines()]
        for at, (deep, line) in enumerate(lines):
            if "BroadcastExchange" in line:
                below = [x for d, x in lines[at + 1 :][: next((i for i, (d, _) in enumerate(lines[at + 1 :]) if d <= deep), None)]]
                assert below and not any("symbol" in x for x in below)


def test_search_of_one_keyword(spark):
    table = spark.createDataFrame([("2", "ab", "m"), ("1", "xab", "m"), ("3", "b", "m")], "symbol string, name string, market string")
    assert [r.symbol for r in I.search(table, "ab").collect()] == ["1", "2"] and I.search(table, "ab", 1).count() == 1


def test_nearest_bars_over_many_spans(spark):
    rng = random.Random(2)
    times = {s: sorted(rng.sample(range(-3000, 3000), n)) for s, n in (("A", 200), ("B", 3), ("C", 1))}
    asks = [(s, rng.randrange(-4000, 4000)) for s in "ABCD" for _ in range(150)] + [("A", t) for t in times["A"][:20]] + [("A", None)]
    bars = spark.createDataFrame([(s, t) for s, own in times.items() for t in own], "symbol string, time long").repartition(3)
    for width in (50, 700, 1 << 22):
        got = sorted(map(tuple, tables.nearest_bar(spark.createDataFrame(asks, "symbol string, at long"), bars, width).collect()), key=str)
        want = [(s, t, None if t is None or s == "D" else min(times[s], key=lambda x: (abs(x - t), x))) for s, t in asks]
        assert got == sorted(want, key=str)
