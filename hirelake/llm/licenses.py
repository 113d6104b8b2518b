"""License scans: phrases, and an exact set-similarity join with templates.

A text block is a window of ``WINDOW`` words; windows start every half window,
so that a passage of up to half a window lies whole in one.  A template is the
set of its words without function words.  A block meets a template if it holds
at least ``CONTAINMENT`` of that set.

The join orders words by how many documents hold them, rarest first.  A block
and a template that share enough words share one within the prefixes of both,
so only prefixes are joined; a pair goes on if the block holds enough template
words at all (length) and enough can still follow the shared one (position);
then the overlap is counted.  Only words of templates matter to an overlap, so
blocks are reduced to them first, and blocks without any vanish.

Everything is DataFrame expressions.  Defined results: a null text is the empty
text and has no words, label or score; repeated rows are each reported; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hirelake.llm.common import settle
from hirelake.llm.registry import query, table

# Words are all that is not an ASCII sign, blank or upper-case letter.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

WINDOW = 64
CONTAINMENT = 0.8
# All templates together may have so many words; they are broadcast.
MAX_WORDS = 10_000

# Opening words of public license notices, by label.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
    " documentation files",
    "apache": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
    " public license as published by the free software foundation",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that"
    " the following conditions are met",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
# Function words, which are no part of a template's set.
FUNCTION_WORDS = ("a", "and", "any", "as", "by", "for", "in", "into", "is", "it", "of", "or", "that", "the", "this", "to", "with", "you")


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    enough: int  # words of the set that a block must hold

    @staticmethod
    def of(label: str, text: str, containment: float = CONTAINMENT) -> Template:
        words = tuple(sorted(set(text.split()) - set(FUNCTION_WORDS)))
        if len(text.split()) > WINDOW // 2:
            raise ValueError(f"template {label} is longer than half a window")
        return Template(label, words, max(1, math.ceil(containment * len(words))))


def _words_column(text: Column) -> Column:
    """All words, each between two blanks: ' w1 w2 '; a single blank if none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, OTHER, " ")), F.lit(" "))


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _phrase_columns(words: str) -> dict[str, Column]:
    """Places and the first and last start of each phrase, from ' w1 w2 '."""
    out, line = {}, F.col(words)
    for i, phrase in enumerate(PHRASES):
        size = len(phrase.split())
        found = F.locate(f" {phrase} ", line) > 0
        # No phrase begins with the words it ends with: its places stand apart.
        out[f"p{i}"] = F.when(found, F.regexp_count(line, F.lit(f" {phrase}(?= )"))).otherwise(F.lit(0)).cast("long")
        out[f"f{i}"] = F.when(found, _blanks(F.substring_index(line, f" {phrase} ", 1)).cast("long"))
        after = _blanks(F.substring_index(line, f" {phrase} ", -1))
        out[f"l{i}"] = F.when(found, (F.col("n_words") - size - after).cast("long"))
    return out


def _base(docs: DataFrame, keep: list[str], vocabulary: list[str]) -> DataFrame:
    """Per document: phrases, and where words of templates stand."""
    n = range(len(PHRASES))
    line = docs.select(*keep, _words_column(F.col("text")).alias("line"))
    # ' w1 w2 ' has one blank more than words; a single blank means none.
    counted = line.withColumn("n_words", F.when(F.col("line") == "  ", 0).otherwise(_blanks(F.col("line")) - 1).cast("long"))
    placed = counted.withColumns(_phrase_columns("line"))
    labels = F.filter(
        F.array(*[F.when(F.col(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())]), F.isnotnull
    )
    wanted = F.array(*map(F.lit, vocabulary))
    hits = F.filter(
        F.transform(F.split(F.trim("line"), " "), lambda w, i: F.struct(i.alias("at"), w.alias("word"))),
        lambda h: h["word"].isin(vocabulary),
    )
    # A block needs several template words, so most texts need no list of places.
    some = F.size(F.array_intersect(F.split(F.trim("line"), " "), wanted)) >= 2
    return placed.select(
        *keep,
        "n_words",
        sum((F.col(f"p{i}") for i in n), F.lit(0)).cast("long").alias("n_base"),
        F.least(*[F.col(f"f{i}") for i in n]).alias("first_word"),
        F.greatest(*[F.col(f"l{i}") for i in n]).alias("last_word"),
        F.array_sort(F.array_distinct(labels)).alias("base"),
        F.when(some, hits).alias("hits"),
    )


def _blocks(base: DataFrame) -> DataFrame:
    """Distinct (row, block, word) of template words; a place lies in two windows."""
    half = WINDOW // 2
    hit = base.select("row", F.explode("hits").alias("h")).select(
        "row", "h.word", F.floor(F.col("h.at") / half).cast("long").alias("half")
    )
    return hit.select("row", "word", F.explode(F.array(F.col("half") - 1, F.col("half"))).alias("block")).distinct()


def _ranks(base: DataFrame, vocabulary: list[str]) -> DataFrame:
    """The global order of template words: rarest first, ties by the word."""
    spark = base.sparkSession
    counted = base.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word")).groupBy("word").count()
    known = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    ordered = (
        known.join(counted, "word", "left")
        .select(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word").alias("w"))
        .agg(F.array_sort(F.collect_list("w")).alias("all"))  # at most MAX_WORDS words
    )
    return ordered.select(F.posexplode("all").alias("rank", "w")).select("rank", "w.word")


def matches(base: DataFrame, templates: list[Template]) -> DataFrame:
    """(row, label, share): every block and template that meet the threshold."""
    spark = base.sparkSession
    vocabulary = sorted({w for t in templates for w in t.words})
    if len(vocabulary) > MAX_WORDS:
        raise ValueError(f"{len(vocabulary)} template words; at most {MAX_WORDS} are broadcast")
    ranks = F.broadcast(_ranks(base, vocabulary))
    fewest = min(t.enough for t in templates)
    blocks = (
        _blocks(base)
        .join(ranks, "word")
        .groupBy("row", "block")
        .agg(F.array_sort(F.collect_list("rank")).alias("own"))
        .where(F.size("own") >= fewest)
    )
    listed = spark.createDataFrame(
        [(i, t.label, t.enough, w) for i, t in enumerate(templates) for w in t.words],
        "template int, label string, enough int, word string",
    )
    sets = (
        listed.join(ranks, "word")
        .groupBy("template", "label", "enough")
        .agg(F.array_sort(F.collect_list("rank")).alias("words"))
    )
    prefixes = sets.select(
        "*", F.posexplode(F.slice("words", F.lit(1), F.size("words") - F.col("enough") + 1)).alias("t_at", "rank")
    )
    probes = blocks.select(
        "*", F.posexplode(F.slice("own", F.lit(1), F.size("own") - fewest + 1)).alias("b_at", "rank")
    )
    following = F.least(F.size("own") - F.col("b_at"), F.size("words") - F.col("t_at"))
    paired = (
        probes.join(F.broadcast(prefixes), "rank")
        .where((F.size("own") >= F.col("enough")) & (following + F.least("b_at", "t_at") >= F.col("enough")))
        .select("row", "block", "template", "label", "enough", "own", "words")
        .dropDuplicates(["row", "block", "template"])
    )
    shared = F.size(F.array_intersect("own", "words"))
    return paired.where(shared >= F.col("enough")).select("row", "label", (shared / F.size("words")).alias("share"))


def scan(docs: DataFrame, keep: list[str], templates: list[Template] | None = None) -> DataFrame:
    """Columns ``keep``, n_words, n_base, first_word, last_word, base_labels,
    labels and score: 1 where a phrase stands, else the largest share of a
    template's words in a block that meets the threshold, else 0."""
    templates = templates or [Template.of(label, text) for label, text in TEMPLATES.items()]
    vocabulary = sorted({w for t in templates for w in t.words})
    base = settle(_base(docs, keep, vocabulary).withColumn("row", F.monotonically_increasing_id()))
    found = matches(base, templates).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    everything = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return base.join(found, "row", "left").select(
        *keep,
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(everything, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def _sql() -> str:
    """The same rows by brute force: every block against every template."""
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    templates = [Template.of(label, text) for label, text in TEMPLATES.items()]
    listed = ", ".join(f"({i}, '{t.label}', {t.enough}, {len(t.words)}, '{w}')" for i, t in enumerate(templates) for w in t.words)
    half = WINDOW // 2
    return f"""
WITH phrases(phrase, label, size) AS (VALUES {phrases}),
templates(template, label, enough, size, word) AS (VALUES {listed}),
split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words
          FROM documents),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM split),
starts AS (SELECT s.doc_id, p.label, i.pos AS pos
           FROM split s, phrases p, LATERAL (SELECT unnest(range(len(s.words) - p.size + 1)) AS pos) i
           WHERE list_contains(s.words, split_part(p.phrase, ' ', 1))
             AND array_to_string(s.words[i.pos + 1 : i.pos + p.size], ' ') = p.phrase),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
                list_sort(list_distinct(list(label))) AS labels FROM starts GROUP BY doc_id),
blocks AS (SELECT DISTINCT doc_id, pos // {half} - d AS block, word
           FROM placed, (VALUES (0), (1)) v(d) WHERE word IN (SELECT word FROM templates)),
met AS (SELECT b.doc_id, t.label, count(*) / max(t.size) AS share
        FROM blocks b JOIN templates t ON t.word = b.word
        GROUP BY b.doc_id, b.block, t.template, t.label HAVING count(*) >= max(t.enough)),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM met GROUP BY doc_id)
SELECT s.doc_id, len(s.words) AS n_words, coalesce(b.n_base, 0) AS n_base, b.first_word, b.last_word,
       coalesce(array_to_string(b.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '')
           AS labels,
       CASE WHEN b.n_base > 0 THEN 1.0 ELSE coalesce(m.share, 0.0) END AS score
FROM split s LEFT JOIN base b ON b.doc_id = s.doc_id LEFT JOIN more m ON m.doc_id = s.doc_id
"""


@query("op3_license_scan", _sql())
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    return scan(table(spark, sf_dir, "documents"), ["doc_id"])
