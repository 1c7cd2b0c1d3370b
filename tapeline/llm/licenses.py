"""License scan by diagonal voting."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, lower_ascii

# Phrases whose places are counted, with their labels.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

# Notices and texts of common licenses, with SPDX-like labels.
TEMPLATES = [
    ("mit-notice", "Released under the MIT License"),
    ("mit-notice", "Licensed under the MIT License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("lgpl-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1"),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-sa-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0"),
    ("cc-by-nc-nd-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

# Words besides numbers that tell licenses apart, and words whose pairs are too common to vote.
TELLING = ("nc", "sa", "nd", "noncommercial", "sharealike", "noderivatives", "lesser", "affero")
PLAIN = ("this", "work", "is", "under", "the", "a", "of", "to")

#: Words of a gram; how far neighbouring diagonals may lie apart, and the words between their votes; least agreement of a span.
K, DRIFT, GAP, COVERAGE = 3, 3, 8, 0.8
#: Words of a gram of phrases and of templates with fewer than SHORT words.
PAIR, SHORT = 2, 16
_SIGNS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-case A-Z, then runs of characters other than ASCII signs."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _SIGNS), "")


def template_table(templates=TEMPLATES, phrases=PHRASES) -> tuple[list[tuple], list[tuple]]:
    """What is known of each template (number, label, phrase, k, length, needed), and its grams (number, k, place, gram).

    Pairs of plain words don't vote; length counts the words that lie in a gram. needed: places of numbers and telling words.
    """
    known, grams = [], []
    for i, (label, text, phrase) in enumerate([(*x, True) for x in phrases] + [(*x, False) for x in templates]):
        w = [x for x in re.split(_SIGNS, text.lower()) if x]
        k = PAIR if phrase or len(w) < SHORT else K
        at = [p for p in range(len(w) - k + 1) if phrase or not set(w[p : p + k]) <= set(PLAIN)]
        grams += [(i, k, p, " ".join(w[p : p + k])) for p in at]
        needed = [] if phrase else [p for p, x in enumerate(w) if x.isdigit() or x in TELLING]
        known.append((i, label, phrase, k, len({p + j for p in at for j in range(k)}), needed))
    return known, grams


def license_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES, drift: int = DRIFT, gap: int = GAP) -> DataFrame:
    """row, id, n_words, template, label, phrase, first, last (words from 0), differing, coverage, ok, kept: a row per span found.

    Each input row also gives one row with a null template, so that texts without a span are seen; ``row`` tells input rows apart, also
    those that repeat an id and its text. Every k-gram of words is joined by hash to the positions of equal grams in the templates
    (k is 3, 2 for phrases and short templates) and compared with the template's words. A vote's diagonal is its word minus its
    template position; votes are counted by diagonal, and diagonals of a template that lie within ``drift`` words of each other and
    whose votes lie within ``gap`` words are merged into a span, so that words put in or left out don't break it. A phrase's
    diagonals stay apart.

    A span is verified (ok) by its words: votes cover ``COVERAGE`` or more of the template's words and every number and telling word of
    it, and the words put in between are at most half as many as the template's; a phrase must stand as it is. Of verified
    spans that overlap, those with the fewest differing words (left out or put in) are kept.

    Null is an empty text. Other columns are ignored.

    Scale: the text isn't shuffled, only votes are. The template table is a constant of some hundred rows, whatever the input,
    and is broadcast.
    """
    spark = df.sparkSession
    known, grams = template_table(templates, phrases)
    table = spark.createDataFrame(grams, "template int, k int, at int, gram string")
    hits = table.groupBy("k", F.xxhash64("gram").alias("h")).agg(F.collect_list(F.struct("template", "at", "gram")).alias("hits"))
    long, short = (hits.filter(F.col("k") == k).select(F.col("h").alias(f"h{k}"), F.col("hits").alias(f"hits{k}")) for k in (K, PAIR))

    docs = df.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w")).withColumn("row", F.monotonically_increasing_id())
    gram = F.transform("w", lambda x, i: F.concat_ws(" ", x, F.get("w", i + 1), F.get("w", i + 2)))
    rows = docs.select("row", "id", F.size("w").alias("n_words"), F.posexplode_outer(gram).alias("pos", "gram"))
    pair = F.substring_index("gram", " ", PAIR)
    rows = rows.withColumns({f"h{K}": F.xxhash64("gram"), f"h{PAIR}": F.xxhash64(pair)})
    rows = rows.join(F.broadcast(long), f"h{K}", "left").join(F.broadcast(short), f"h{PAIR}", "left")
    rows = rows.filter(f"hits{K} is not null or hits{PAIR} is not null or coalesce(pos, 0) = 0")
    none = F.array().cast("array<struct<template:int,at:int,gram:string>>")
    same = lambda col, text: F.coalesce(F.filter(col, lambda x: x["gram"] == text), none)
    votes = rows.select("row", "id", "n_words", "pos", F.explode_outer(F.concat(same(f"hits{K}", F.col("gram")), same(f"hits{PAIR}", pair))).alias("v"))
    # one more row a text, without a template
    seen = votes.select("row", "id", "n_words", F.col("v.template").alias("template"), (F.col("pos") - F.col("v.at")).alias("diagonal"), "pos", F.col("v.at").alias("at"))
    seen = seen.select("*", F.explode(F.when(F.coalesce("pos", F.lit(0)) == 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("extra"))
    seen = seen.filter("extra or template is not null")
    for c in ("template", "diagonal", "at", "pos"):
        seen = seen.withColumn(c, F.when(~F.col("extra"), F.col(c)))
    diagonals = seen.groupBy("row", "id", "n_words", "template", "diagonal").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("at").alias("at"))

    info = spark.createDataFrame(known, "template int, label string, phrase boolean, k int, length int, needed array<int>")
    diagonals = diagonals.join(F.broadcast(info), "template", "left")
    w = W.partitionBy("row", "template").orderBy("first", "diagonal")
    far = (F.abs(F.col("diagonal") - F.lag("diagonal").over(w)) > drift) | (F.col("first") - F.lag("last").over(w) > gap)
    starts = F.when(F.col("phrase") | F.coalesce(far, F.lit(True)), 1).otherwise(0)
    spans = diagonals.withColumn("start", starts).withColumn("span", F.sum("start").over(w.rowsBetween(W.unboundedPreceding, 0)))
    spread = lambda a: F.flatten(F.transform(a, lambda x: F.sequence(x, x + F.col("k") - 1)))
    spans = spans.withColumn("place", F.transform("at", lambda x: x + F.col("diagonal")))
    spans = spans.groupBy("row", "id", "n_words", "template", "label", "phrase", "k", "length", "needed", "span").agg(
        F.min("first").alias("first"), (F.max("last") + F.col("k") - 1).alias("last"), F.flatten(F.collect_list("at")).alias("at"), F.flatten(F.collect_list("place")).alias("place"),
    )
    spans = spans.withColumns({"at": F.array_distinct(spread("at")), "place": F.size(F.array_distinct(spread("place")))})
    extra = F.col("last") - F.col("first") + 1 - F.col("place")
    spans = spans.withColumns({"differing": F.col("length") - F.size("at") + extra, "coverage": F.size("at") / F.col("length")})
    enough = (F.col("coverage") >= F.when(F.col("phrase"), 1.0).otherwise(COVERAGE)) & (extra * 2 <= F.col("length"))
    spans = spans.withColumn("ok", F.coalesce(enough & (F.size(F.array_except("needed", "at")) == 0), F.lit(False)))

    rival = F.col("ok") & ~F.col("phrase")
    in_text = W.partitionBy("row").orderBy("first", "last", "template", "span")
    reached = F.max(F.when(rival, F.col("last"))).over(in_text.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("fresh", F.when(rival & F.coalesce(F.col("first") > reached, F.lit(True)), 1).otherwise(0))
    spans = spans.withColumn("cluster", F.sum("fresh").over(in_text.rowsBetween(W.unboundedPreceding, 0)))
    least = F.min(F.when(rival, F.col("differing"))).over(W.partitionBy("row", "cluster"))
    spans = spans.withColumn("kept", F.col("ok") & (F.col("phrase") | (F.col("differing") == least)))
    return spans.select("row", "id", "n_words", "template", "label", "phrase", "first", "last", "differing", "coverage", "ok", "kept")


def license_report(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per input row: counts of phrase places, labels of kept spans, and the best coverage as score (0 without votes)."""
    base = F.col("kept") & F.col("phrase")
    names = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    out = spans.groupBy("row", "id").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        names(base).alias("base_labels"), names(F.col("kept")).alias("labels"), F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"),
        F.count(F.when(F.col("kept") & ~F.col("phrase"), 1)).alias("n_spans"),
    )
    return out.withColumnRenamed("id", id_col).drop("row")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(license_spans(documents(spark, sf_dir)))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_KNOWN, _GRAMS = template_table()
_TEMPLATES = ", ".join(f"({i}, {_quoted(label)}, {str(phrase).lower()}, {k}, {n}, {needed}::INTEGER[])" for i, label, phrase, k, n, needed in _KNOWN)
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH t(template, label, phrase, k, size, needed) AS (VALUES {_TEMPLATES}),
tg(template, k, p0, gram) AS (VALUES {", ".join(f"({i}, {k}, {p}, {_quoted(gram)})" for i, k, p, gram in _GRAMS)}),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT rid, k, pos, array_to_string(w[pos + 1 : pos + k], ' ') AS gram FROM (SELECT rid, w, unnest(range(0, len(w))) AS pos FROM d), (SELECT unnest([{PAIR}, {K}]) AS k)),
v AS MATERIALIZED (SELECT rid, tg.template, g.k, pos, p0, pos - p0 AS diagonal FROM g JOIN tg ON tg.k = g.k AND tg.gram = g.gram),
dg AS (SELECT rid, template, phrase, v.k, diagonal, min(pos) AS f, max(pos) AS l FROM v JOIN t USING (template) GROUP BY ALL),
st AS (SELECT *, CASE WHEN phrase OR lag(l) OVER w IS NULL OR abs(diagonal - lag(diagonal) OVER w) > {DRIFT} OR f - lag(l) OVER w > {GAP} THEN 1 ELSE 0 END AS s
  FROM dg WINDOW w AS (PARTITION BY rid, template ORDER BY f, diagonal)),
sp AS (SELECT *, sum(s) OVER (PARTITION BY rid, template ORDER BY f, diagonal ROWS UNBOUNDED PRECEDING) AS span FROM st),
co AS (SELECT v.rid, v.template, span, min(pos) AS f, max(pos) AS l, list_distinct(flatten(list(list_transform(range(0, v.k), lambda j: CAST(p0 + j AS INTEGER))))) AS cov, len(list_distinct(flatten(list(list_transform(range(0, v.k), lambda j: pos + j))))) AS places
  FROM v JOIN sp ON sp.rid = v.rid AND sp.template = v.template AND sp.diagonal = v.diagonal GROUP BY 1, 2, 3),
sc AS (SELECT co.*, label, phrase, needed, l + k - 1 AS last, l + k - f - places AS extra, size, size - len(cov) + l + k - f - places AS differing, len(cov) / size AS coverage FROM co JOIN t USING (template)),
ok AS (SELECT *, coverage >= CASE WHEN phrase THEN 1.0 ELSE {COVERAGE} END AND extra * 2 <= size AND list_has_all(cov, needed) AS ok FROM sc),
re AS (SELECT *, max(CASE WHEN ok AND NOT phrase THEN last END) OVER (PARTITION BY rid ORDER BY f, last, template, span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM ok),
cl AS (SELECT *, sum(CASE WHEN ok AND NOT phrase AND (reached IS NULL OR f > reached) THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY f, last, template, span ROWS UNBOUNDED PRECEDING) AS cluster FROM re),
ke AS (SELECT *, ok AND (phrase OR differing = min(CASE WHEN ok AND NOT phrase THEN differing END) OVER (PARTITION BY rid, cluster)) AS kept FROM cl)
SELECT any_value(doc_id) AS doc_id, CAST(len(any_value(w)) AS BIGINT) AS n_words, count(*) FILTER (kept AND phrase) AS n_base, min(f) FILTER (kept AND phrase) AS first_word, max(f) FILTER (kept AND phrase) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kept AND phrase), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kept), '') AS labels,
  coalesce(max(coverage), 0) AS score, count(*) FILTER (kept AND NOT phrase) AS n_spans
FROM d LEFT JOIN ke USING (rid) GROUP BY rid
"""
