"""Op 7: license phrases and license notices. DataFrame functions only.

Words are runs of ASCII digits, letters (A-Z lower-cased) and all characters beyond ASCII.
The base part finds the places where a phrase's words stand consecutively. The method's part
is an exact set-similarity join between notices (``NOTICES``) and text blocks. A block is any run
of as many consecutive words as the notice has (or the whole text, if it is shorter), wherever
lines break; every block that holds at least ``threshold`` of a notice's distinct words is found.

Tokens are ordered by their document frequency over the whole corpus (rarest first, ties by
token; only the notices' words are counted). A block that reaches the threshold must have one
of the first n - ceil(threshold * n) + 1 of a notice's n tokens. So a text is cut into cells of
the notice's length, and the cells that hold such a word are joined with their notice; the
stretch that has all blocks through a cell stands for them (three cells at most). The length
filter drops stretches with fewer than ceil(threshold * n) distinct words, the positional filter
those that cannot get enough words after their rarest common one; in what is left every block
is verified. A text gives at most three times its words for each notice, however often a word
repeats. Notices are a parameter of fixed size, so their table is broadcast; texts never are.

``score`` is the largest containment found for a document, 0 if there is none. Defined cases:
null counts as empty; repeated rows give repeated results; ties between notices give all their
labels; an empty table gives no rows; further columns are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, table

# fixed values: the phrases of the base part, and published notices of licenses
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
NOTICES = (
    ("agpl-3.0", "licensed under the gnu affero general public license version 3"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
THRESHOLD = 0.8
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text) -> F.Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), GAP), "")


def _literal(items) -> F.Column:
    return F.array(*[F.lit(x) for x in items])


def scan(docs: DataFrame, phrases: tuple = PHRASES, notices: tuple = NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    if not 0 < threshold <= 1:
        raise ValueError("0 < threshold <= 1")
    sets = [(label, sorted(set(text.split())), len(text.split())) for label, text in notices]
    vocabulary = sorted({t for _, s, _ in sets for t in s})
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))

    # global order: document frequencies of the notices' words, over all documents
    seen = texts.select(F.explode(F.array_intersect(words(F.col("text")), _literal(vocabulary))).alias("token"))
    counted = {r[0]: r[1] for r in seen.groupBy("token").count().collect()}  # no more rows than the notices have words
    order = {t: k for k, t in enumerate(sorted(vocabulary, key=lambda t: (counted.get(t, 0), t)))}
    rows, cells = [], []
    for k, (label, s, length) in enumerate(sets):
        s = sorted(s, key=order.__getitem__)
        need = max(1, math.ceil(threshold * len(s) - 1e-9))
        rows.append((k, label, s, length, need))
        cells.append((k, length, s[: len(s) - need + 1]))
    prefix = sorted({t for _, _, p in cells for t in p})
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame(rows, "notice int, label string, tokens array<string>, length int, need int"))

    starts = sorted({p.split()[0] for p, _ in phrases} | set(prefix))
    places = [_places(phrase.split(), label) for phrase, label in phrases]
    base = texts.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), words(F.col("text")).alias("w"))
    base = base.withColumn("near", F.arrays_overlap("w", _literal(starts)))
    base = base.withColumn("spots", F.when(F.col("near"), F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i).isin(prefix))))
    none = F.array().cast("array<struct<at:int,label:string>>")
    stretches = F.concat(*[_stretches(*c) for c in cells])
    base = base.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), F.when(F.col("near"), F.concat(*places)).otherwise(none).alias("places"), F.when(F.col("near"), stretches).alias("stretches"))
    base = cut(base)

    pairs = base.select("doc_id", "key", F.explode("stretches").alias("x")).select("doc_id", "key", "x.notice", "x.b").join(known, "notice")
    own = F.array_intersect("tokens", "b")
    pairs = pairs.where((F.size(F.array_distinct("b")) >= F.col("need")) & (F.size(own) >= F.col("need")))
    pairs = pairs.withColumn("first", F.array_min(F.transform(own, lambda t: F.array_position("tokens", t))).cast("int"))  # tokens stand in the global order
    pairs = pairs.where(F.size("tokens") - F.col("first") + 1 >= F.col("need"))
    at = F.filter(F.transform("b", lambda x, i: F.struct(i.alias("i"), F.array_position("tokens", x).alias("t"))), lambda s: s["t"] > 0)
    pairs = pairs.select("doc_id", "key", "label", "need", "length", F.size("tokens").alias("n"), at.alias("at"))
    in_block = lambda h: F.size(F.array_distinct(F.transform(F.filter("at", lambda o: (o["i"] >= h["i"]) & (o["i"] < h["i"] + F.col("length"))), lambda o: o["t"])))
    pairs = pairs.withColumn("common", F.array_max(F.transform("at", in_block)))  # a best block starts at one of the notice's words
    pairs = pairs.where("common >= need").select("doc_id", "key", "label", (F.col("common") / F.col("n")).alias("c"))
    hits = pairs.groupBy("doc_id", "key").agg(F.collect_set("label").alias("found"), F.max("c").alias("c"))

    b, h = base.drop("stretches").alias("b"), hits.alias("h")
    out = b.join(h, F.expr("b.key = h.key AND b.doc_id <=> h.doc_id"), "left")
    own = F.array_distinct(F.transform("places", lambda x: x["label"]))
    both = F.array_union(own, F.coalesce("found", F.array().cast("array<string>")))
    at = F.transform("places", lambda x: x["at"].cast("long"))
    return out.select("b.doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), F.array_join(F.sort_array(own), ",").alias("base_labels"), F.array_join(F.sort_array(both), ",").alias("labels"), F.coalesce("c", F.lit(0.0)).alias("score"))


def _stretches(notice: int, length: int, prefix: list[str]) -> F.Column:
    """For each cell of `length` words that holds one of the prefix: the words of all blocks that meet it."""
    at = F.array_distinct(F.transform(F.filter("spots", lambda i: F.get("w", i).isin(prefix)), lambda i: F.floor(i / length).cast("int")))

    def around(c):
        first = F.greatest(F.lit(0), c * length - (length - 1))
        return F.struct(F.lit(notice).alias("notice"), F.slice("w", first + 1, c * length + 2 * length - 1 - first).alias("b"))

    return F.transform(at, around)


def _places(phrase: list[str], label: str) -> F.Column:
    """Starts of a phrase in the words of column w, as structs (at, label)."""

    def here(i):
        out = F.lit(True)
        for k, t in enumerate(phrase):
            out = out & F.coalesce(F.get("w", i + k) == t, F.lit(False))
        return out

    return F.transform(F.filter(F.sequence(F.lit(0), F.size("w") - 1), here), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def query(spark, sf_dir: str) -> DataFrame:
    """op7_license_scan: every whole text of documents."""
    return scan(table(spark, sf_dir, "documents"))


def sql() -> str:
    q = lambda s: "'" + s + "'"
    phrases = " UNION ALL ".join(f"SELECT doc_id, i - 1 AS pos, {q(label)} AS label FROM p WHERE " + " AND ".join(f"w[i + {k}] = {q(t)}" for k, t in enumerate(phrase.split())) for phrase, label in PHRASES)
    notices = ", ".join(f"({k}, {q(label)}, {len(text.split())}, [{', '.join(q(t) for t in sorted(set(text.split())))}])" for k, (label, text) in enumerate(NOTICES))
    split = lambda x: f"list_filter(string_split_regex(translate({x}, '{UPPER}', '{LOWER}'), '{GAP}'), lambda y: y <> '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
ws AS (SELECT doc_id, {split('text')} AS w FROM d),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM ws),
places AS ({phrases}),
n(k, label, m, tokens) AS (VALUES {notices}),
nt AS (SELECT k, label, m, len(tokens) AS size, unnest(tokens) AS t FROM n),
occ AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM ws),
inside AS (SELECT doc_id, label, size, count(DISTINCT t) OVER (PARTITION BY doc_id, k ORDER BY i RANGE BETWEEN CURRENT ROW AND m - 1 FOLLOWING) AS c FROM occ JOIN nt USING (t)),
pairs AS (SELECT doc_id, label, max(c / size) AS c FROM inside WHERE c >= ceil({THRESHOLD} * size - 1e-9) GROUP BY 1, 2),
base AS (SELECT doc_id, count(*) AS n, min(pos) AS a, max(pos) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM places GROUP BY 1),
best AS (SELECT doc_id, max(c) AS c FROM pairs GROUP BY 1),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM pairs) GROUP BY 1)
SELECT ws.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, CAST(base.a AS BIGINT) AS first_word, CAST(base.z AS BIGINT) AS last_word,
  coalesce(base.l, '') AS base_labels, coalesce(every.l, '') AS labels, CAST(coalesce(best.c, 0) AS DOUBLE) AS score
FROM ws LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN every USING (doc_id)
"""


SQL = sql()
