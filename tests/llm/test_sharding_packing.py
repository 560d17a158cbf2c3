import zlib

import duckdb
import numpy as np

from tickforge.llm.packing import pack_power_of_two, piece_lengths, tokenizer_path
from tickforge.llm.sharding import OP7_SQL, op7_sharding, shard_by_bytes

from .helpers import documents, small_corpus

ROWS = [(5, "bb"), (3, None), (3, ""), (1, "é" * 4000), (9, "x y z"), (9, "x y z"), (None, "lost"), (7, "Don't <|endoftext|> it's 12 34\x0bz q")]


def test_shards_are_contiguous_and_even(spark):
    rows = ROWS + small_corpus(spark)
    got = shard_by_bytes(documents(spark, rows).repartition(5), 8).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted(
        (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows
    )
    total, longest = sum(r.size for r in got), max(r.size for r in got)
    got.sort(key=lambda r: (r.shard, r.slot))
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    for s in range(8):
        mine = [r for r in got if r.shard == s]
        assert [r.slot for r in mine] == list(range(len(mine)))
        assert abs(sum(r.size for r in mine) - total / 8) <= longest


def test_shards_of_nothing(spark):
    assert shard_by_bytes(documents(spark, []), 3).collect() == []


def test_shards_equal_their_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet'")
    columns = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    want = con.sql(f"select {', '.join(columns)} from ({OP7_SQL}) order by doc_id").fetchall()
    assert list(map(tuple, op7_sharding(spark, d).select(*columns).orderBy("doc_id").collect())) == want


def test_piece_lengths():
    text, length = piece_lengths(np.array([2048 * 2 + 5, 0, 2048, 7]), 2048)
    assert text.tolist() == [0, 0, 0, 0, 2, 3, 3, 3] and length.tolist() == [2048, 2048, 4, 1, 2048, 4, 2, 1]


def test_pieces_join_to_the_whole_ids(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path())
    rows = ROWS + small_corpus(spark)[:80] + [(900, "a <|endoftext|> b<|startoftext|>"), (901, "<|ENDOFTEXT|>x"), (902, "<|endoftext|>"), (903, "some words " * 500_000)]
    got = pack_power_of_two(documents(spark, rows), tokenizer_path(), 64).collect()
    assert len({r.sequence_id for r in got}) == len(got) and {r.offset for r in got} == {0}
    assert all(len(r.ids) == r.length == 1 << r.bucket <= 64 for r in got)
    whole = {}
    for r in sorted(got, key=lambda r: r.sequence_id):
        if r.start == 0:
            whole.setdefault(r.doc_id, []).append([])
        assert len(whole[r.doc_id][-1]) == r.start
        whole[r.doc_id][-1] += r.ids
        assert r.doc_tokens >= r.start + r.length
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(model.encode(t or "", add_special_tokens=False).ids + [1])
    assert {k: sorted(v) for k, v in whole.items()} == {k: sorted(v) for k, v in want.items()}


def test_words_alone_give_the_ids_of_whole_texts(spark):
    from tokenizers import Tokenizer

    import pyarrow as pa

    from tickforge.llm.packing import Words, token_ids

    model = Tokenizer.from_file(tokenizer_path())
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += ["naïve. ÀÉ e\u0301 ﬁ ĳ ŒUVRE Σας ǅ ß ẞ ÿ, x.y,z.. 'll can't.you'RE 3,5 a\u0301.b", "日本語。 ١٢ \u2028x \u00a0y", "<|startoftext|>a<|endoftext|>", "", "A<|StartOfText|>. <|endoftext|><|endoftext|> <|endoftext|"]
    known = Words(tokenizer_path())
    for some in (texts[:300], texts[300:], texts):
        ids, count = token_ids(known, pa.array(some), 1)
        want = [e.ids + [1] for e in model.encode_batch(some, add_special_tokens=False)]
        assert count.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_binary_ids(spark):
    docs = documents(spark, [(1, "some words here")])
    a = pack_power_of_two(docs, tokenizer_path(), 4).collect()
    b = pack_power_of_two(docs, tokenizer_path(), 4, ids_as="binary").collect()
    assert [r.ids for r in a] == [np.frombuffer(bytes(r.ids), "<u4").tolist() for r in b]


def test_nothing_to_pack(spark):
    assert pack_power_of_two(documents(spark, []), tokenizer_path()).collect() == []
