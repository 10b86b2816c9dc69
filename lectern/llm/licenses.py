"""License scans by diagonal voting.

One scan takes each whole text apart into words, finds the places of the base's
phrases, and hashes every rolling k-gram of words.  What can't be a template's
gram by its hash is left in the scan (the templates are a fixed table of a few
hundred grams); the rest is joined, by hash and by the gram itself, with the
template positions.  A hit votes for its offset diagonal, text position less
template position; neighbouring diagonals are merged, so a few inserted or
missing words don't split a match; a merged span is verified by the exact
k-grams of the template that it holds.  Only hits are shuffled.

Every row has a number of its own, so labels never pass from one row to another.

Cases: a null text counts as empty: no words, no labels, score 0; a null doc_id
stays null, and rows that lack or repeat one are judged each by its own text;
an empty table gives no rows; equal places of several phrases all count; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.storage import materialize, table

#: Characters that end a word: ASCII but letters and digits.  Listed one by one, as a regex engine looks such a class
#: up in a table of bits, where it tests a class of ranges range by range.
BREAKS = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
GRAM = 3
#: Diagonals this far apart still belong to one span.
SLACK = 2
#: Share of a template's k-grams that a verified span holds at least.
LEAST_COVERAGE = 0.6

#: Phrases of the base and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Characteristic sentences of public licenses, by label.
TEMPLATES = {
    "agpl-3": ("under the terms of the gnu affero general public license as published by the free software foundation",),
    "apache-2.0": (
        "licensed under the apache license version 2 0",
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
    ),
    "bsl-1.0": ("distributed under the boost software license version 1 0",),
    "cc0": (
        "the person who associated a work with this deed has dedicated the work to the public domain",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights",
    ),
    "cc-by-nc": ("licensed under cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"),
    "gpl-3": (
        "this work is licensed under the gnu general public license version 3",
        "under the terms of the gnu general public license as published by the free software foundation",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    ),
    "lgpl": ("under the terms of the gnu lesser general public license as published by the free software foundation",),
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files",
    ),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "zlib": ("this software is provided as is without any express or implied warranty in no event will the authors be held liable",),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0",),
}


def license_words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; null counts as empty.

    A word that isn't ASCII keeps its capitals: it is equal to no word of a phrase or template in either form.
    """
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^{BREAKS}]+"), F.lit(0))
    return F.transform(found, lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(w))


def template_grams(spark: SparkSession) -> DataFrame:
    """``label, template, at, n_grams, gram, h``: a few hundred rows at most."""
    rows = []
    for label, texts in TEMPLATES.items():
        for k, text in enumerate(texts):
            words = text.split()
            n = len(words) - GRAM + 1
            rows += [(label, k, i, n, " ".join(words[i : i + GRAM])) for i in range(n)]
    schema = "label string, template int, at int, n_grams int, gram string"
    return spark.createDataFrame(rows, schema).withColumn("h", F.xxhash64("gram"))


def _gram(words: Column, i: Column) -> list[Column]:
    return [F.get(words, i + k) for k in range(GRAM)]


def _starts(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand one after the other."""
    parts = phrase.split()
    last = F.size(words) - len(parts)

    def here(i: Column) -> Column:
        found = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            found = found & (F.get(words, i + k) == part)
        return found

    maybe = last >= 0
    for part in parts:
        maybe = maybe & F.array_contains(words, part)
    places = F.when(maybe, F.filter(F.sequence(F.lit(0), last), here))
    return F.coalesce(places, F.array().cast("array<int>"))


def marked(docs: DataFrame) -> DataFrame:
    """``row, doc_id, n_words``, the base's ``places`` and ``base`` labels, and ``hits``, for each row of ``docs``.

    A hit is a position whose gram has the hash of a template's gram, with its words.
    """
    spark = docs.sparkSession
    known = [r["h"] for r in template_grams(spark).select(F.xxhash64(F.split("gram", " ")).alias("h")).distinct().collect()]
    worded = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", license_words(F.col("text")).alias("words")
    )
    last = F.size("words") - GRAM
    at = F.filter(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.array(*_gram(F.col("words"), i))).isin(known))
    hits = F.transform(at, lambda i: F.struct(i.alias("pos"), F.slice("words", i + 1, GRAM).alias("words")))
    found = worded.select(
        "row",
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        *[_starts(F.col("words"), phrase).alias(f"p{k}") for k, phrase in enumerate(PHRASES)],
        F.when(last >= 0, hits).alias("hits"),
    )
    labels = [F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())]
    return found.select(
        "row",
        "doc_id",
        "n_words",
        F.concat(*[F.col(f"p{k}") for k in range(len(PHRASES))]).alias("places"),
        F.array_compact(F.array(*labels)).alias("base"),
        "hits",
    )


def license_spans(marks: DataFrame) -> DataFrame:
    """``row, label, first_word, last_word, coverage`` for each verified span of :func:`marked` rows."""
    rolled = marks.select("row", F.explode("hits").alias("hit")).select(
        "row", "hit.pos", F.array_join("hit.words", " ").alias("marked")
    )
    rolled = rolled.withColumn("h", F.xxhash64("marked"))
    votes = (
        rolled.join(F.broadcast(template_grams(marks.sparkSession)), "h")
        .where("gram = marked")
        .groupBy("row", "label", "template", "n_grams", (F.col("pos") - F.col("at")).alias("diagonal"))
        .agg(F.collect_set("at").alias("ats"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    )
    along = Window.partitionBy("row", "label", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > SLACK, F.lit(True))
    merged = votes.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(along))
    return (
        merged.groupBy("row", "label", "template", "n_grams", "span")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("held"),
            F.min("low").alias("first_word"),
            (F.max("high") + GRAM - 1).alias("last_word"),
        )
        .withColumn("coverage", F.col("held") / F.col("n_grams"))
        .where(F.col("coverage") >= LEAST_COVERAGE)
        .select("row", "label", "first_word", "last_word", "coverage")
    )


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: the base, all labels, and the best coverage as score."""
    marks = materialize(marked(docs), "license-marks")
    found = license_spans(marks).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("best"))
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return (
        marks.drop("hits")
        .join(found, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.size("places").cast("long").alias("n_base"),
            F.array_min("places").cast("long").alias("first_word"),
            F.array_max("places").cast("long").alias("last_word"),
            F.array_join(F.array_sort("base"), ",").alias("base_labels"),
            F.array_join(labels, ",").alias("labels"),
            F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        )
    )


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    grams = []
    for label, texts in TEMPLATES.items():
        for k, text in enumerate(texts):
            w = text.split()
            n = len(w) - GRAM + 1
            grams += [f"('{label}', {k}, {i}, {n}, '{' '.join(w[i : i + GRAM])}')" for i in range(n)]

    def places(phrase: str) -> str:
        parts = phrase.split()
        here = " AND ".join(f"ws[i + {k}] = '{x}'" for k, x in enumerate(parts))
        return f"list_transform(list_filter(range(1, len(ws) - {len(parts) - 2}), lambda i: {here}), lambda i: i - 1)"

    found = [places(x) for x in PHRASES]
    names = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(PHRASES.values()))
    return f"""
WITH m(label, tpl, place, n, gram) AS (VALUES {', '.join(grams)}),
w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{word}') AS ws FROM documents),
g AS (SELECT doc_id, s - 1 AS pos, array_to_string(ws[s:s + {GRAM - 1}], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {GRAM - 2})) AS s FROM w WHERE len(ws) >= {GRAM})),
d AS (SELECT doc_id, label, tpl, n, pos - place AS dg, list(DISTINCT place) AS ats FROM g JOIN m USING (gram) GROUP BY ALL),
e AS (SELECT *, CASE WHEN dg - lag(dg) OVER o <= {SLACK} THEN 0 ELSE 1 END AS apart FROM d WINDOW o AS (PARTITION BY doc_id, label, tpl ORDER BY dg)),
f AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, label, tpl ORDER BY dg) AS span FROM e),
h AS (SELECT doc_id, label, len(list_distinct(flatten(list(ats)))) / n AS coverage FROM f GROUP BY doc_id, label, tpl, n, span),
l AS (SELECT doc_id, list(DISTINCT label) AS more, max(coverage) AS best FROM h WHERE coverage >= {LEAST_COVERAGE} GROUP BY doc_id),
b AS (SELECT doc_id, len(ws) AS n_words, {', '.join(f'{x} AS p{k}' for k, x in enumerate(found))} FROM w),
c AS (SELECT *, flatten([{', '.join(f'p{k}' for k in range(len(found)))}]) AS ps, list_filter([{names}], lambda x: x IS NOT NULL) AS base FROM b)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_base, list_min(ps) AS first_word, list_max(ps) AS last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ','), '') AS labels,
  CASE WHEN len(ps) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score
FROM c LEFT JOIN l USING (doc_id)"""


QUERIES = {"op4_license_diagonals": _query}
ORACLES = {"op4_license_diagonals": _sql()}
