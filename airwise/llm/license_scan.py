"""Operator 2, license scans: an exact set-similarity join of text blocks with license templates.

Base: a document's words are searched for license phrases whose words stand consecutively.

Method: a block is a run of consecutive words of the whole text, as long as the template's wording
divided by the threshold, so line breaks and comment marks inside a notice don't matter, and words
that stand scattered are no notice.  A template is a set of words; a block matches when it contains
at least ``threshold`` of them.  The join finds every match and verifies few blocks:

* texts are cut into pieces of ``PIECE`` words that overlap by the longest block, so every block lies
  whole in a piece and a very long text is many rows.  Template words are put in one global order,
  rarest in the corpus first (pieces that hold a word are counted over all documents; only the
  templates' vocabulary comes to the driver); a piece's template words stand in that order;
* prefix: a match misses at most ``n - need`` of a template's n words, so it holds one of the first
  ``n - need + 1``.  Pieces are joined with this index of prefix words only, by the first they hold;
* length: a piece of fewer than ``need`` template words can't match;
* position: when the first prefix word found is the template's i-th and the piece's j-th, at most the
  words from there on in both can be shared;
* candidates are verified: the sets are intersected, then the blocks that start at a template word
  (each best block can be moved to one).

All of it is DataFrame functions; the prefix index has a row per template and prefix word and is
broadcast, its size being that of the templates.  Only matches and word counts are shuffled, so a hot
source or a license line that a third of all documents hold is as cheap as any.

Rows: null text has no words; very long texts are read whole, a piece a row; repeated rows get a row
each; a null doc_id stays null; extra columns are ignored; an empty table gives an empty result.  A
document without any match has empty labels and score 0; a base label's score is 1, another's the
best containment found.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airwise.llm.common import text_keys, text_of, word_array

#: Phrases of the base labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Wording of license notices by label.
TEMPLATES = {
    "apache": ["licensed under the apache license version 2 0",
               "you may not use this file except in compliance with the license you may obtain a copy of the license at"],
    "arr": ["all rights reserved"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by-nc": ["licensed under cc by nc 4 0",
                 "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license"],
    "gpl": ["this work is licensed under the gnu general public license version 3",
            "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"],
    "mit": ["released under the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
}
THRESHOLD = 0.8
#: Words of a piece beyond which the next one starts.
PIECE = 256


def _templates(templates: dict[str, list[str]], threshold: float) -> list[tuple[str, tuple[str, ...], int, int]]:
    """label, distinct words, how many of them a match needs, words of a block."""
    up = lambda x: ceil(round(x, 9))
    return [(label, tuple(sorted(set(t.split()))), up(threshold * len(set(t.split()))), up(len(t.split()) / threshold))
            for label, texts in sorted(templates.items()) for t in texts]


def _words_of(xs) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def pieces(docs: DataFrame, overlap: int) -> DataFrame:
    """doc_id, th, tm, piece: the words of every text, cut into overlapping pieces."""
    rows = docs.select("doc_id", text_of().alias("t")).select("doc_id", *text_keys(F.col("t")), word_array(F.col("t")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.size("w"), F.lit(PIECE))
    return rows.select("doc_id", "th", "tm", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(PIECE + overlap)))).alias("piece"))


def word_frequencies(docs: DataFrame, vocabulary: list[str], overlap: int) -> dict[str, int]:
    """In how many pieces each word of the (small) vocabulary stands."""
    found = pieces(docs, overlap).select(F.explode(F.array_intersect(_words_of(vocabulary), "piece")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return {r["w"]: r["n"] for r in found.collect()}  # a row per word of the vocabulary at most


def similar_blocks(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, th, tm, label, containment: the best block of every text that contains ``threshold`` of a template's words."""
    spark = docs.sparkSession
    known = _templates(templates or TEMPLATES, threshold)
    overlap = max(span for *_, span in known) - 1
    vocabulary = sorted({w for _, t, _, _ in known for w in t})
    count = word_frequencies(docs, vocabulary, overlap)
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (count.get(w, 0), w)))}
    index = []
    for k, (label, words, need, span) in enumerate(known):
        ordered = sorted(words, key=rank.get)
        index += [(w, k, label, i, len(words), need, span, ordered, ordered[:i]) for i, w in enumerate(ordered[:len(words) - need + 1])]
    prefix = spark.createDataFrame(index, "w string, template int, label string, i int, n int, need int, span int, words array<string>, rarer array<string>")
    rare = sorted({x[0] for x in index}, key=rank.get)
    # the template words of a piece in the global order; its prefix words become rows, and the piece goes along for the check
    tokens = pieces(docs, overlap).withColumn("held", F.array_intersect(_words_of(sorted(rank, key=rank.get)), "piece"))
    probes = tokens.withColumn("w", F.explode(F.array_intersect(_words_of(rare), "held")))
    left = F.size("held") - F.array_position("held", F.col("w")) + 1
    hits = probes.join(F.broadcast(prefix), "w") \
        .where((F.size("held") >= F.col("need")) & (left >= F.col("need")) & (F.col("n") - F.col("i") >= F.col("need"))) \
        .where(~F.arrays_overlap("held", "rarer") & (F.size(F.array_intersect("held", "words")) >= F.col("need")))
    starts = F.filter(F.sequence(F.lit(1), F.size("piece")), lambda p: F.array_contains(F.col("words"), F.get("piece", p - 1)))
    best = F.array_max(F.transform(starts, lambda p: F.size(F.array_intersect(F.slice("piece", p, F.col("span")), "words"))))
    return hits.select("doc_id", "th", "tm", "label", "n", "need", best.alias("shared")).where("shared >= need") \
        .groupBy("doc_id", "th", "tm", "label").agg(F.max(F.col("shared") / F.col("n")).alias("containment"))


def phrase_starts(words: Column, phrase: str) -> Column:
    """Sorted starts of the places where the phrase's words stand consecutively."""
    parts = phrase.split()
    at = lambda i: [F.get(words, i + k) == p for k, p in enumerate(parts)]

    def here(i: Column) -> Column:
        test = at(i)[-1]  # the last word is tried first: "license" is rarer than what stands before it
        for x in at(i)[:-1]:
            test = test & x
        return test

    return F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)


def license_labels(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None,
                   threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: a row per row of ``docs``."""
    phrases = phrases or PHRASES
    rows = docs.select("doc_id", text_of().alias("t")).select("doc_id", "t", *text_keys(F.col("t")), word_array(F.col("t")).alias("w"))
    none = F.array().cast("array<int>")
    spots = F.struct(*[F.when((F.size("w") >= len(p.split())) & F.array_contains("w", p.split()[-1]), phrase_starts(F.col("w"), p)).otherwise(none).alias(f"p{k}")
                       for k, p in enumerate(phrases)])
    base = rows.select("doc_id", "th", "tm", F.size("w").cast("long").alias("n_words"), spots.alias("at")).select("doc_id", "th", "tm", "n_words", "at.*")
    every = F.concat(*[F.col(f"p{k}") for k in range(len(phrases))])
    mine = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(f"p{k}") > 0, label) for k, label in enumerate(phrases.values())]), lambda x: x.isNotNull())))
    base = base.select("doc_id", "th", "tm", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
                       F.array_max(every).cast("long").alias("last_word"), mine.alias("mine"))
    found = similar_blocks(docs, templates, threshold).groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_th"), F.col("tm").alias("_tm")) \
        .agg(F.collect_set("label").alias("theirs"), F.max("containment").alias("containment"))
    both = base.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_th")) & (F.col("tm") == F.col("_tm")), "left")
    labels = F.array_sort(F.array_union("mine", F.coalesce("theirs", F.array().cast("array<string>"))))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("mine", ",").alias("base_labels"),
                       F.array_join(labels, ",").alias("labels"),
                       F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"))


def oracle_sql() -> str:
    """The whole result in DuckDB SQL: every block that starts at a template's word against the template, without the join's filters."""
    words = lambda c: (f"list_filter(string_split_regex(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "  # noqa: E731
                       r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')")
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    known = ", ".join(f"('{label}', {list(t)}, {need}, {span})" for label, t, need, span in _templates(TEMPLATES, THRESHOLD))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, {words('t')} AS w FROM d),
ph(p, label, n) AS (VALUES {phrases}), tp(label, words, need, span) AS (VALUES {known}),
spot AS (SELECT doc_id, label, i FROM (SELECT doc_id, w, p, label, n, unnest(range(0, len(w) - n + 1)) AS i FROM w, ph WHERE len(w) >= n)
       WHERE array_to_string(w[i + 1:i + n], ' ') = p),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM spot GROUP BY doc_id),
bl AS (SELECT doc_id, label, words, need, unnest([list_intersect(w[i:i + span - 1], words) FOR i IN range(1, len(w) + 1) IF list_contains(words, w[i])]) AS shared FROM w, tp),
m AS (SELECT doc_id, label, len(shared) / CAST(len(words) AS DOUBLE) AS c FROM bl WHERE len(shared) >= need),
ls AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM m UNION SELECT doc_id, label FROM spot) GROUP BY doc_id),
mx AS (SELECT doc_id, max(c) AS c FROM m GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN b ON w.doc_id = b.doc_id LEFT JOIN ls ON w.doc_id = ls.doc_id LEFT JOIN mx ON w.doc_id = mx.doc_id
"""
