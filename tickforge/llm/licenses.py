"""License detection with a positional rare-token index, in DataFrame operations alone."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import load, saved

#: (label, notice, mandatory key phrase). Texts are those of public notices; words as the operator takes them.
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "licensed under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "any purpose with or without fee"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "public domain"),
    ("proprietary", "all rights reserved", "rights reserved"),
]

#: Phrases whose every place counts, and their labels.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

#: Words are separated by these (ASCII but digits and letters).
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

VOCABULARY = sorted({w for _, notice, key in [*TEMPLATES, *((a, b, b) for a, b in PHRASES)] for w in notice.split() + key.split()})


def split_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def licence_words(words: Column) -> Column:
    """(pos, word) of the words that occur in any notice; A-Z counts as a-z."""
    placed = F.transform(words, lambda w, i: F.struct(i.alias("pos"), F.lower(w).alias("word"), w.alias("raw")))
    known = F.filter(placed, lambda x: x["word"].isin(VOCABULARY))
    # lower() folds more than A-Z; what it made ASCII from something else is no word of a notice.
    known = F.filter(known, lambda x: F.octet_length(x["raw"]) == F.length(x["raw"]))
    return F.transform(known, lambda x: F.struct(x["pos"].alias("pos"), x["word"].alias("word")))


def scan_licenses(
    docs: DataFrame,
    templates: list[tuple[str, str, str]] = TEMPLATES,
    phrases: list[tuple[str, str]] = PHRASES,
    matching: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Labels of the notices and phrases that each document holds.

    One scan keeps each document's word count and the places of words that any notice
    uses. Their document frequencies over all documents rank a notice's words; its
    postings are its places of highest inverse frequency, two more than the share
    `matching` lets be missing, so that a notice in the text has two of them in place.
    A document's places of such words, less the place in the notice, vote for where a
    notice starts; where two or more agree, the notice is compared word by word. It is
    found if its key phrase stands complete and the share `matching` of its words stand
    in place.
    `phrases` are found by the same index, every word being a posting and required.

    Returns doc_id, n_words, n_base (places of phrases), first_word, last_word (their
    smallest and largest start; null if none), base_labels and labels (with the
    notices' too; distinct, sorted, comma-joined) and score (the largest share of a
    found notice's words in place; 1 where only a phrase was found; 0 if nothing was).
    A null or empty text has no words and no labels. Each row is a document of its
    own, repeated ids included; other columns are not read. No rows give no rows.
    """
    slim = saved(
        docs.select(F.col(id_col).alias("doc_id"), split_words(F.col(text_col)).alias("words")).select(
            "doc_id",
            F.monotonically_increasing_id().alias("row"),
            F.size("words").cast("long").alias("n_words"),
            licence_words(F.col("words")).alias("known"),
        )
    )
    # At most one row for each word of the vocabulary.
    used = F.explode(F.array_distinct(F.transform("known", lambda x: x["word"])))
    frequency = dict(map(tuple, slim.select(used.alias("word")).groupBy("word").count().collect()))

    postings, bodies = [], []
    for t, (label, notice, key) in enumerate([*templates, *((a, b, b) for a, b in phrases)]):
        words, base = notice.split(), t >= len(templates)
        at = [i for i in range(len(words)) if words[i : i + len(key.split())] == key.split()][0]
        need = len(words) if base else min(2, len(words))
        missing = 0 if base else int(len(words) * (1 - matching) + 1e-9)
        rare = sorted(range(len(words)), key=lambda i: (frequency.get(words[i], 0), words[i], i))[: missing + need]
        postings += [(words[i], t, i, need) for i in rare]
        bodies += [(t, label, base, i, w, at <= i < at + len(key.split()), len(words)) for i, w in enumerate(words)]
    spark = docs.sparkSession
    index = spark.createDataFrame(postings, "word string, t int, i int, need int")
    body = spark.createDataFrame(bodies, "t int, label string, base boolean, i int, word string, is_key boolean, size int")

    rare_all = sorted({p[0] for p in postings})
    places = slim.where(F.exists("known", lambda x: x["word"].isin(rare_all))).select("row", F.explode("known").alias("x")).select("row", "x.pos", "x.word")
    starts = (
        places.where(F.col("word").isin(rare_all))
        .join(F.broadcast(index), "word")
        .groupBy("row", "t", (F.col("pos") - F.col("i")).alias("start"))
        .agg(F.count("*").alias("votes"), F.first("need").alias("need"))
        .where("votes >= need")
    )
    found = (
        starts.join(F.broadcast(body), "t")
        .withColumn("pos", F.col("start") + F.col("i"))
        .join(places, ["row", "pos", "word"])
        .groupBy("row", "t", "start", "label", "base", "size")
        .agg(F.count("*").alias("in_place"), F.sum(F.col("is_key").cast("int")).alias("key_in_place"))
    )
    keys = body.where("is_key").groupBy("t").agg(F.count("*").alias("key_size"))
    by_row = (
        found.join(F.broadcast(keys), "t")
        .where((F.col("key_in_place") == F.col("key_size")) & (F.col("in_place") >= F.col("size") * F.when(F.col("base"), 1.0).otherwise(matching)))
        .groupBy("row")
        .agg(
            F.count_if("base").alias("n_base"),
            F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
            F.max(F.when(~F.col("base"), F.col("in_place") / F.col("size"))).alias("share"),
            F.lit(1.0).alias("phrase"),
        )
    )
    return slim.select("doc_id", "row", "n_words").join(by_row, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("share", "phrase", F.lit(0.0)).alias("score"),
    )


def _sql_rows(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() for x in r) + ")" for r in rows)


def _sql_notices() -> str:
    rows = []
    for t, (label, notice, key) in enumerate([*TEMPLATES, *((a, b, b) for a, b in PHRASES)]):
        words, k = notice.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
        rows += [(t, label, t >= len(TEMPLATES), i, w, at <= i < at + len(k), len(words), len(k)) for i, w in enumerate(words)]
    return _sql_rows(rows)


OP8_SQL = rf"""
WITH notices(t, label, base, i, word, is_key, size, keys) AS (VALUES {_sql_notices()}),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), w AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
f AS (
  SELECT doc_id, t, label, base, pos - i AS start, count(*) / any_value(size)::DOUBLE AS share
  FROM w JOIN notices USING (word) GROUP BY doc_id, t, label, base, pos - i
  HAVING count(*) FILTER (is_key) = any_value(keys) AND count(*) >= any_value(size) * CASE WHEN base THEN 1.0 ELSE 0.8 END
), a AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    coalesce(max(share) FILTER (NOT base), 1) AS score
  FROM f GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN a USING (doc_id)
"""


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    """Every document's licence words, places of phrases and labels; see scan_licenses() for nulls, empty texts and repeats."""
    return scan_licenses(load(spark, sf_dir, "documents"))
