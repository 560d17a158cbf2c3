import random
import re

import duckdb

from tickforge.llm.common import CHUNK_BYTES
from tickforge.llm.decontaminate import OP10_SQL, contained_items, decontaminate, op10_decontamination

from .helpers import documents, lower_az

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sh(text):
    w = WORD.findall(lower_az(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def case():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([14, 20, 37, 59, 120, 300, 5, 6, 3, 1])] + [(20, None), (21, ""), (22, "!!!")]
    docs = [(100 + i, text(n)) for i, n in enumerate([3, 10, 200, 3000, 9000])]
    for i, t in items[:8]:
        docs.append((200 + i, text(5000) + ". " + t.upper() + "! " + text(3000)))
        docs.append((300 + i, t))
        w = t.split()
        w[len(w) // 2] = "zzz"
        docs.append((400 + i, text(700) + " " + " ".join(w) + " " + text(900)))
        docs.append((500 + i, text(400) + " " + " ".join(w[: len(w) // 3]) + " " + text(10)))
    docs += [(600, None), (601, ""), (602, items[8][1]), (603, "?"), (100, docs[0][1]), (None, items[0][1])]
    return docs, items


def expected(docs, items):
    out = []
    for d, t in docs:
        have = sh(t)
        for i, u in items:
            want = sh(u)
            shared = len(want & have)
            if want and shared >= 0.8 * len(want):
                out.append((d if d is not None else -1, i, shared, len(want), shared / len(want)))
    return sorted(out)


def test_against_brute_force(spark):
    docs, items = case()
    bench = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id int")
    for filter_bits in (28, 8):  # with 256 bits nearly all minima pass the filter
        got = contained_items(documents(spark, docs), bench, filter_bits=filter_bits).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, *tuple(r)[1:]) for r in got) == expected(docs, items)
    bad = {d for d, *_ in expected(docs, items)}
    clean = decontaminate(documents(spark, docs), bench)
    assert clean.columns == documents(spark, docs).columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in docs if d is not None and d not in bad)


def test_very_long_text_and_many_copies_of_an_item(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    items = [(1, text(40)), (2, text(70)), (2, text(70)), (3, text(900))]
    whole = " ".join([text(300_000), items[3][1], text(400_000), items[0][1], text(1000)])
    assert len(whole) > CHUNK_BYTES
    docs = [(1, whole), (2, text(50)), *[(i, text(30) + " " + items[1][1]) for i in range(3, 40)]]
    bench = spark.createDataFrame(items + items[1:2], "item_id long, text string")
    got = contained_items(documents(spark, docs), bench).collect()
    assert sorted(map(tuple, got)) == expected(docs, items + items[1:2])
    assert [r.doc_id for r in decontaminate(documents(spark, docs), bench).collect()] == [2]


def test_empty_sides(spark):
    docs, items = case()
    none = spark.createDataFrame([], "item_id long, text string")
    assert contained_items(documents(spark, docs[:3]), none).collect() == []
    assert decontaminate(documents(spark, docs[:3]), none).count() == 3
    assert contained_items(documents(spark, []), spark.createDataFrame(items, "item_id long, text string")).collect() == []


def test_query_equals_its_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = con.sql(f"select doc_id, item_id, shared, item_shingles, containment from ({OP10_SQL})").fetchall()
    assert sorted(map(tuple, op10_decontamination(spark, d).collect())) == sorted(want) and len(want) > 3
