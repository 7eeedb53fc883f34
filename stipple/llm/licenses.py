"""License scans by an exact set-similarity join, with DataFrame functions only.

A document is cut into blocks, overlapping runs of words, and a template is
contained in a block that holds at least its share of the template's words.
Words are ordered by the number of documents that hold them, rarest first.  A
block that contains a template holds one of the template's first words
(prefix filter), enough template words at all (length filter) and, from the
first common word on, enough words after it on both sides (positional
filter); what remains is verified by intersecting the sets.  The filters lose
nothing, so every block that meets a threshold is found.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipple.session import Scratch


@dataclass(frozen=True)
class Template:
    """A label holds where a block has this share of the distinct words of the text; short texts need all of theirs."""

    label: str
    text: str
    share: float = 0.8

    @property
    def words(self) -> list[str]:
        return sorted(set(self.text.split()))

    @property
    def needed(self) -> int:
        return math.ceil(self.share * len(self.words) - 1e-9)


#: fixed values: phrases of the base labels
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: fixed values: wording of well-known licenses
TEMPLATES = [
    Template("mit", "released under the mit license", 1.0),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                    "documentation files the software to deal in the software without restriction"),
    Template("apache-2", "licensed under the apache license version 2 0", 1.0),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Template("gpl-3", "licensed under the gnu general public license version 3", 1.0),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
                    "public license as published by the free software foundation"),
    Template("lgpl", "licensed under the gnu lesser general public license", 1.0),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
                    "following conditions are met"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", 1.0),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("reserved", "all rights reserved", 1.0),
]
#: words of a block and words between the starts of two: runs of up to BLOCK - STRIDE + 1 words lie in one block
BLOCK, STRIDE = 64, 32


def normal(text: Column) -> Column:
    """Words of the text in lower case, each between single spaces; "" without words."""
    whole = F.coalesce(text, F.lit(""))
    # the two letters outside ASCII whose lower case has an ASCII letter stay outside
    odd = whole.contains("\u212a") | whole.contains("\u0130")
    whole = F.when(odd, F.translate(whole, "\u212a\u0130", "\u00e5\u00e5")).otherwise(whole)
    flat = F.trim(F.regexp_replace(F.lower(whole), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(flat == "", "").otherwise(F.concat(F.lit(" "), flat, F.lit(" ")))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _phrase(words: Column, phrase: str) -> dict[str, Column]:
    """Number of places, and the first and the last start in words."""
    padded = f" {phrase} "
    first = F.instr(words, padded)
    last = F.length(words) - F.instr(F.reverse(words), padded[::-1]) - len(padded) + 2
    return {
        "n": F.when(first > 0, F.regexp_count(words, F.lit(f"(?<= ){re.escape(phrase)}(?= )"))).otherwise(0),
        "first": F.when(first > 0, _spaces(F.substring(words, 1, first)) - 1),
        "last": F.when(first > 0, _spaces(F.substring(words, 1, last)) - 1),
    }


def _any(found: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, found, F.lit(False))


def blocks(words: Column) -> Column:
    """Structs start, held (distinct words) of the blocks."""

    def cut(every: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(every) - 1, F.lit(STRIDE)),
                           lambda s: F.struct(s.alias("start"), F.array_distinct(F.slice(every, s + 1, BLOCK)).alias("held")))

    return F.flatten(F.transform(F.array(F.split(F.trim(words), " ")), cut))  # a lambda's argument is split once


def contained(docs: DataFrame, frequency: dict[str, int], templates: list[Template] = TEMPLATES) -> DataFrame:
    """row, start, template (its number), share of every block of the column ``words`` that contains a template."""
    order = {w: n for n, w in enumerate(sorted(frequency, key=lambda w: (frequency[w], w)))}
    ranked = [sorted(order[w] for w in t.words) for t in templates]
    prefix = [(rank, n, at, len(r), t.needed) for n, (t, r) in enumerate(zip(templates, ranked, strict=True))
              for at, rank in enumerate(r[:len(r) - t.needed + 1])]
    names = sorted(order, key=order.get)
    first_words = sorted({names[rank] for rank, *_ in prefix})
    spark = docs.sparkSession
    index = F.broadcast(spark.createDataFrame(prefix, "rank int, template int, at int, size int, needed int"))  # as long as the templates
    whole = F.broadcast(spark.createDataFrame(list(enumerate(ranked)), "template int, ranks array<int>"))
    number = F.create_map(*[x for w, n in order.items() for x in (F.lit(w), F.lit(n))])
    vocabulary = F.array(*map(F.lit, names))
    # inside the lambda the words are at hand; in a plain filter they would be made anew for every comparison
    some = docs.where(F.exists(F.array("words"), lambda t: _any([F.contains(t, F.lit(f" {w} ")) for w in first_words])))
    cut = some.select("row", F.explode(blocks(F.col("words"))).alias("b")).select(
        "row", "b.start", F.array_intersect("b.held", vocabulary).alias("held"))
    cut = cut.where(F.size("held") >= min(t.needed for t in templates))
    held = cut.select("row", "start", F.array_sort(F.transform("held", lambda w: F.element_at(number, w))).alias("own"))
    met = held.select("row", "start", "own", F.posexplode("own").alias("place", "rank")).join(index, "rank")
    after = F.least(F.col("size") - F.col("at"), F.size("own") - F.col("place"))  # common words from this one on, at most
    met = met.where((F.size("own") >= F.col("needed")) & (after >= F.col("needed") - F.col("at")))
    pairs = met.select("row", "start", "own", "template", "needed").distinct().join(whole, "template")
    common = F.size(F.array_intersect("own", "ranks"))
    return pairs.where(common >= F.col("needed")).select("row", "start", "template", (common / F.size("ranks")).alias("share"))


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    A null text is an empty one; repeated rows are kept and scanned each; other
    columns are left out; an empty table gives an empty one.  ``score`` is 1
    where a base phrase stands, else the largest share of a template that a
    block contains, 0 without one.
    """
    scratch = Scratch(docs.sparkSession, "licenses")
    whole = docs.select(F.col(key), normal(F.col(text)).alias("words")).select(
        key, "words", F.struct(F.xxhash64(key, "words").alias("a"), F.hash("words", key).alias("b")).alias("row"))
    vocabulary = sorted({w for t in templates for w in t.words})
    places = [(label, _phrase(F.col("words"), phrase)) for label, phrase in PHRASES]
    told = scratch.save(whole.select(
        key, "row", _spaces(F.col("words")).alias("spaces"),
        reduce(lambda a, b: a + b, [p["n"] for _, p in places]).cast("bigint").alias("n_base"),
        F.least(*[p["first"] for _, p in places]).cast("bigint").alias("first_word"),
        F.greatest(*[p["last"] for _, p in places]).cast("bigint").alias("last_word"),
        F.array_compact(F.array(*[F.when(p["n"] > 0, F.lit(label)) for label, p in places])).alias("base"),
        F.array(*[F.contains("words", F.lit(f" {w} ")) for w in vocabulary]).alias("has"),
    ), "told")
    counts = told.agg(*[F.sum(F.col("has")[n].cast("bigint")).alias(f"w{n}") for n in range(len(vocabulary))]).first()
    frequency = {w: counts[n] or 0 for n, w in enumerate(vocabulary)}
    labels = F.array(*[F.lit(t.label) for t in templates])
    found = contained(whole.select("row", "words"), frequency, templates).groupBy("row").agg(
        F.collect_set(labels[F.col("template")]).alias("more"), F.max("share").alias("share"))  # as many as there are templates
    rows = told.join(found, "row", "left")
    none = F.array().cast("array<string>")
    return rows.select(
        F.col(key), F.greatest(F.col("spaces") - 1, F.lit(0)).cast("bigint").alias("n_words"), "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))


def scan_sql(templates: list[Template] = TEMPLATES) -> str:
    """The same rows in SQL: every block against every template, every place against every phrase."""
    listed = ", ".join(f"('{t.label}', {t.words}, {t.needed})" for t in templates)
    phrases = ", ".join(f"('{label}', {phrase.split()})" for label, phrase in PHRASES)
    return f"""WITH docs AS (
  SELECT doc_id, row_number() OVER () r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM documents),
templates(label, words, needed) AS (VALUES {listed}),
phrases(label, words) AS (VALUES {phrases}),
starts AS (SELECT r, w, unnest(range(0, len(w), {STRIDE})) s FROM docs),
cut AS (SELECT r, list_distinct(w[s + 1:s + {BLOCK}]) b FROM starts),
met AS (SELECT r, label, len(list_intersect(b, words)) / len(words) share FROM cut, templates
        WHERE len(list_intersect(b, words)) >= needed),
places AS (SELECT r, unnest(range(0, len(w))) p, w FROM docs),
base AS (SELECT r, label, p FROM places, phrases WHERE w[p + 1:p + len(words)] = words),
b AS (SELECT r, count(*) n, min(p) lo, max(p) hi, string_agg(DISTINCT label, ',' ORDER BY label) l FROM base GROUP BY r),
m AS (SELECT r, max(share) share FROM met GROUP BY r),
u AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) l FROM (SELECT r, label FROM met UNION SELECT r, label FROM base) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n, 0) n_base, lo first_word, hi last_word,
       coalesce(b.l, '') base_labels, coalesce(u.l, '') labels, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0) END score
FROM docs LEFT JOIN b USING (r) LEFT JOIN m USING (r) LEFT JOIN u USING (r)"""
