import re

import duckdb

from tickforge.llm.licenses import OP8_SQL, PHRASES, TEMPLATES, op8_licenses, scan_licenses

from .helpers import documents, lower_az, small_corpus

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

ROWS = [
    (1, "Released under the MIT License."),
    (2, "mit  license, and the MIT-license; then Apache License v2"),
    (3, None),
    (4, ""),
    (5, "mitlicense mit xlicense"),
    (6, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    (7, "Redistribution and use in source and binary form, with or without modification, are permitted provided that the following conditions are met:"),
    (8, "x " * 5000 + "This work is licensed under the GNU General Public License, version 3. " + "the of " * 3000 + "All rights reserved."),
    (8, "Licensed under CC BY-NC 4.0."),
    (8, "Licensed under CC BY-NC 4.0."),
    (None, "worK is licensed under the apache license"),
    (10, "mit license mit license"),
    (11, "émit license"),
    (12, "Redistribution und use im source and binary forms, mit or without modification, are permitted provided that xx following conditions are met:"),
    (13, "permission is hereby given free of charge to all person obtaining a copy of that software and associated documentation files"),
]


def expected(text):
    words = [w.decode() for w in WORD.findall(lower_az(text))]
    base = [(i, label) for label, p in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    labels, best = {x for _, x in base}, []
    for label, notice, key in TEMPLATES:
        want, k = notice.split(), key.split()
        at = next(i for i in range(len(want)) if want[i : i + len(k)] == k)
        for s in range(-len(want), len(words)):
            same = sum(0 <= s + i < len(words) and words[s + i] == w for i, w in enumerate(want))
            if s + at >= 0 and words[s + at : s + at + len(k)] == k and same >= 0.8 * len(want):
                labels.add(label)
                best.append(same / len(want))
    score = max(best, default=1.0 if base else 0.0)
    starts = [i for i, _ in base]
    join = lambda x: ",".join(sorted(set(x)))
    return len(words), len(base), min(starts, default=None), max(starts, default=None), join(x for _, x in base), join(labels), round(score, 9)


def test_against_brute_force(spark):
    rows = ROWS + small_corpus(spark)
    got = sorted(((r.doc_id or -1, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in scan_licenses(documents(spark, rows).repartition(3)).collect()), key=str)
    assert got == sorted(((i or -1, *expected(t)) for i, t in rows), key=str)


def test_no_documents(spark):
    assert scan_licenses(documents(spark, [])).collect() == []


def test_query_equals_its_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet'")
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = con.sql(f"select {', '.join(columns)} from ({OP8_SQL})").fetchall()
    assert sorted(map(tuple, op8_licenses(spark, d).select(*columns).collect()), key=str) == sorted(want, key=str)
