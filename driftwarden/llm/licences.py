"""Licence scans with a positional index of rare words.

A template is a run of words; the index lists, for every word of a template that tells something, its place there.  One
pass over the texts keeps the places of such words only.  A word's weight is its inverse document frequency in
the corpus.  Per template the heaviest word of the mandatory key phrase, which every place must have, proposes where
the template may start; the postings of the template's other words are intersected with that by relative position, as
bits of a mask; the bits of the key phrase must all be there.  A key phrase that names the licence is enough; after any other
one a weighted share of `SHARE` of the template must be there too.

A base phrase is a template that is all key phrase.  DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from driftwarden.session import stage_table

# words with upper-case letters as well: they are lowered one by one
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str
    base: bool = False
    named: bool = False     # the key phrase names the licence

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_places(self) -> range:
        words, key = self.words, self.key.split()
        at = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
        return range(at, at + len(key))


# fixed values: base phrases, and opening words of public licence texts with the phrase each must have
BASE = (Template("cc-by", "cc by", "cc by", True),
        Template("gpl", "general public license", "general public license", True),
        Template("reserved", "all rights reserved", "all rights reserved", True))
TEMPLATES = (
    Template("mit", "released under the mit license", "mit license", named=True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted"),
    Template("apache", "licensed under the apache license version 2 0", "apache license", named=True),
    Template("bsd", "redistribution and use in source and binary forms with or without modification", "binary forms"),
    Template("mpl", "subject to the terms of the mozilla public license", "mozilla public license", named=True),
    Template("lgpl", "gnu lesser general public license", "lesser general public license", named=True),
    Template("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license",
             "gnu general public license", named=True),
    Template("cc-by", "licensed under a creative commons attribution", "creative commons attribution", named=True),
    Template("public-domain", "free and unencumbered software released into the public domain", "unencumbered software"),
)
COMMON = frozenset("a an and any are can in into is it of or the this to under with without you".split())
SHARE = 0.6


def postings(templates: tuple[Template, ...]) -> list[tuple[str, int, int]]:
    """(word, template, place) of the words that are looked up: those of the key phrase and those that are not common."""
    return [(w, t, i) for t, template in enumerate(templates) for i, w in enumerate(template.words)
            if i in template.key_places or w not in COMMON]


def key_bits(template: Template) -> int:
    return sum(1 << i for i in template.key_places)


def _file_hits(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    placed = F.transform("words", lambda w, i: F.struct(
        i.alias("pos"), F.when(F.octet_length(w) == F.length(w), F.lower(w)).alias("word")))
    return (docs.select("doc_id", words.alias("words"))
            .select("doc_id", F.size("words").cast("long").alias("n_words"),
                    F.filter(placed, lambda h: h["word"].isin(vocabulary)).alias("hits"))
            .withColumn("row", F.monotonically_increasing_id()))


def _by_template(values: list, template: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), template + 1)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row of `docs` (doc_id, text).

    n_base counts the places of base phrases, first_word and last_word are the smallest and largest of their
    starts (null without any), labels are sorted and joined by commas (empty without any), score is the best weighted
    share of a template found at one place (below `SHARE` only if the key phrase names the licence), 1 for a base phrase, 0 without any.  A null or empty text has no
    words; null ids stay, repeated rows are each scanned; an empty table gives no rows.
    """
    known = (*BASE, *templates)
    index = postings(known)
    vocabulary = sorted({w for w, _, _ in index})
    files = stage_table(_file_hits(docs, vocabulary), "hits")
    total = files.count()
    seen = {r.word: r.n for r in files.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word"))
            .groupBy("word").agg(F.count("*").alias("n")).collect()}           # as many rows as the vocabulary has words
    weight = {w: math.log((total + 1) / (seen.get(w, 0) + 0.5)) for w in vocabulary}

    # the place of the heaviest word of each key phrase (ties: the first)
    leads = [max(t.key_places, key=lambda i: weight[t.words[i]]) for t in known]
    entries = {}
    for w, t, i in index:
        entries.setdefault(w, []).append(F.struct(F.lit(t).alias("template"), F.lit(i).alias("place"), F.lit(i == leads[t]).alias("lead")))
    word_entries = F.create_map(*[x for w, e in sorted(entries.items()) for x in (F.lit(w), F.array(*e))])

    hits = (files.filter(F.size("hits") > 0).select("row", F.explode("hits").alias("hit"))
            .select("row", "hit", F.explode(F.element_at(word_entries, F.col("hit.word"))).alias("entry")))
    starts = (hits.select("row", F.col("entry.template").alias("template"), (F.col("hit.pos") - F.col("entry.place")).alias("start"),
                          F.expr("shiftleft(1L, entry.place)").alias("bit"), F.col("entry.lead").alias("lead"))
              .groupBy("row", "template", "start")      # before the text's first word if only the end of a template is there
              .agg(F.bit_or("bit").alias("mask"), F.max("lead").alias("lead")).filter("lead"))
    template = F.col("template")
    keys = _by_template([key_bits(t) for t in known], template).cast("long")
    places = starts.filter(F.col("mask").bitwiseAND(keys) == keys)
    gained = F.lit(0.0)
    for t, words in enumerate(known):
        own = {i: weight[w] for w, u, i in index if u == t}
        whole = sum(own.values()) or 1.0
        held = sum(F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(v / whole)).otherwise(0.0) for i, v in sorted(own.items()))
        gained = F.when(template == t, F.lit(1.0) if words.base else F.least(held, F.lit(1.0))).otherwise(gained)
    named = _by_template([t.named for t in known], template)
    places = places.withColumn("share", gained).filter(named | (F.col("share") >= SHARE))
    based, label = template < len(BASE), _by_template([t.label for t in known], template)
    found = places.groupBy("row").agg(
        F.count_if(based).alias("n_base"), F.min(F.when(based, F.col("start"))).alias("first_word"),
        F.max(F.when(based, F.col("start"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(based, label))).alias("base_labels"),
        F.array_sort(F.collect_set(label)).alias("labels"), F.max("share").alias("score"))
    return files.select("row", "doc_id", "n_words").join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce(F.array_join("base_labels", ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join("labels", ","), F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
