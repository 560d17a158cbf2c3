import json

from tickforge.sources import candles as S
from tickforge.sources.vendor import dropped, vendor_replies

ROWS = {
    "600000": ("qfqday", [["2024-01-02", "1", "2", "3", "0.5", "10"], ["2024-01-03", "1", "x", "3", "0.5", "10"], ["2024-01-04", 1, 2.5, 3, 0.5, 7, {"note": "split"}]]),
    "000001": ("day", [["2024-02-30", "1", "2", "3", "0.5", "10"], ["2024-01-05", "1", "2", "3", None, "10"], ["2024-01-08", "4", "5", "6", "3", "1e3"]]),
    "300001": ("day", []),
}


def test_recorded_replies_equal_decoded_rows(spark, tmp_path):
    for symbol, (key, rows) in ROWS.items():
        (tmp_path / f"{symbol}.json").write_text(json.dumps({"code": 0, "data": {f"sh{symbol}": {key: rows}}}))
    (tmp_path / "900000.json").write_text(json.dumps({"data": {}}))
    replies = vendor_replies(spark, str(tmp_path))
    cells = lambda rows: [[None if c is None else str(c) for c in r if not isinstance(c, dict)] for r in rows]
    given = [(s, cells(rows) if k == "qfqday" else None, cells(rows) if k == "day" else None) for s, (k, rows) in ROWS.items()]
    want = S.decoded_vendor_rows(spark.createDataFrame(given, replies.schema))
    got = S.decoded_vendor_rows(replies)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 3
    assert {tuple(r) for r in dropped(replies, got).collect()} == {("600000", 3, 1), ("000001", 3, 2), ("300001", 0, 0)}


def test_only_the_named_symbols_are_opened(spark, tmp_path):
    (tmp_path / "A.json").write_text(json.dumps({"data": {"A": {"day": [["2024-01-02", "1", "2", "3", "0.5", "10"]]}}}))
    (tmp_path / "B.json").write_text("not a reply")
    one = vendor_replies(spark, f"file://{tmp_path}", ["A"])
    assert one.rdd.getNumPartitions() == 1 and [r.symbol for r in one.collect()] == ["A"]
    assert vendor_replies(spark, str(tmp_path), ["C"]).collect() == []
