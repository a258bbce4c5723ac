"""License scans (operator 10) by a positional rare-token index, in DataFrame functions only.

The index holds, for each licence template, its rarest words by document frequency over the whole corpus, with their
places. A file's occurrences of indexed words vote for (template, place in the file less place in the template); votes
for one start are the postings' intersection by relative position. A start with enough votes is a licence when the
template's mandatory phrase stands in the file. Everything about one file stays in its row: nothing is shuffled but the
word frequencies.

Defined cases: a null text counts as empty; texts are scanned whole; repeated rows give equal results; an empty table
gives an empty result; other columns are ignored. ``score`` is the best share of a template's indexed weight found at one
start, 1 for a base phrase, 0 without any indexed word.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riftline.llm.native import let

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ENDS = r"^[\x00-\x2F\x3A-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x60\x7B-\x7F]+$"

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, a line or passage by which the licence is named or granted, and the phrase that must be there.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by "
     "the free software foundation", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation",
     "lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation",
     "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "licensed under the bsd 3 clause license", "bsd"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted", "permission to use copy modify"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license",
     "creative commons attribution 4"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "unencumbered software released into the public domain"),
    ("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    ("boost", "distributed under the boost software license version 1 0", "boost software license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held "
     "liable for any damages", "without any express or implied warranty"),
)
RARE = 5  # indexed words per template
SHARE = 0.8  # of a template's indexed weight that a start must gather
STRIDE = 1 << 33  # a vote is template * STRIDE + file place - template place + STRIDE / 2


def vocabulary() -> list[str]:
    return sorted({word for _, passage, _ in TEMPLATES for word in passage.split()})


def _normal(text: Column) -> Column:
    """Lower case, words joined by one space. (Letters past ASCII are word characters in either case, and no phrase or
    template holds one, so lowering them too changes nothing.)"""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), ENDS, ""), SPLIT, " ")


def _words(normal: Column) -> Column:
    return F.when(normal == "", F.array().cast("array<string>")).otherwise(F.split(normal, " "))


def document_frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """Documents, and how many hold each template word: at most one entry per word of the templates."""
    known = F.array(*[F.lit(word) for word in vocabulary()])
    seen = docs.select(F.explode_outer(F.array_intersect(_words(_normal(F.col("text"))), known)).alias("word"))
    counted = {row.word: row.n for row in seen.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    counted.pop(None, None)
    return docs.count(), counted


class RareIndex:
    """Postings of the rarest words of each template: word -> [(template, place)], and each posting's weight."""

    def __init__(self, n_docs: int, frequency: dict[str, int], rare: int = RARE):
        self.postings: dict[str, list[tuple[int, int]]] = {}
        self.weight: dict[tuple[int, str], float] = {}
        for number, (_, passage, _) in enumerate(TEMPLATES):
            words = passage.split()
            idf = {word: log((n_docs + 1) / (frequency.get(word, 0) + 0.5)) + 1e-3 * len(word) for word in words}
            chosen = sorted(set(words), key=lambda word: (-idf[word], word))[:rare]
            low = min(idf[word] for word in chosen)
            for word in chosen:
                place = words.index(word)
                self.postings.setdefault(word, []).append((number, place))
                self.weight[number, word] = idf[word] - min(low, 0) + 0.1
        totals: dict[int, float] = {}
        for (number, _), value in self.weight.items():
            totals[number] = totals.get(number, 0.0) + value
        self.weight = {key: value / totals[key[0]] for key, value in self.weight.items()}


def _votes(words: Column, index: RareIndex) -> Column:
    """Sorted (start key, weight) of all indexed words in a file."""
    known = F.array(*[F.lit(word) for word in sorted(index.postings)])
    lists = F.create_map(*[
        part for word in sorted(index.postings) for part in (
            F.lit(word), F.array(*[
                F.struct(F.lit(t * STRIDE - place + STRIDE // 2).cast("long").alias("key"), F.lit(index.weight[t, word]).alias("weight"))
                for t, place in index.postings[word]
            ]),
        )
    ])
    found = F.filter(
        F.transform(words, lambda w, i: F.when(F.array_contains(known, w), F.struct(w.alias("word"), i.alias("at")))),
        lambda x: x.isNotNull(),
    )
    return F.sort_array(F.flatten(F.transform(found, lambda x: F.transform(
        F.element_at(lists, x["word"]), lambda p: F.struct((p["key"] + x["at"].cast("long")).alias("key"), p["weight"].alias("weight"))
    ))))


def _starts(votes: Column) -> Column:
    """(template, weight) per start: the sorted votes are folded run by run."""
    none = F.array().cast("array<struct<template:int,weight:double>>")
    start = F.struct(F.lit(-1).cast("long").alias("key"), F.lit(0.0).alias("weight"), none.alias("done"))

    def closed(s: Column) -> Column:
        ready = (s["key"] >= 0) & (s["weight"] >= SHARE / 4)
        one = F.array(F.struct(F.call_function("div", s["key"], F.lit(STRIDE)).cast("int").alias("template"), s["weight"].alias("weight")))
        return F.when(ready, F.array_union(s["done"], one)).otherwise(s["done"])

    def fold(s: Column, v: Column) -> Column:
        again = s["key"] == v["key"]
        return F.struct(
            v["key"].alias("key"), F.when(again, s["weight"] + v["weight"]).otherwise(v["weight"]).alias("weight"),
            F.when(again, s["done"]).otherwise(closed(s)).alias("done"),
        )

    return F.aggregate(votes, start, fold, closed)


def _places(words: Column, phrase: str) -> Column:
    """Word places at which the phrase stands."""
    parts = phrase.split()
    at = F.transform(words, lambda w, i: F.when(w == parts[0], i))
    hits = F.filter(at, lambda i: i.isNotNull())

    def whole(i: Column) -> Column:
        same = F.lit(True)
        for step, part in enumerate(parts[1:], 1):
            same = same & (F.get(words, i + step) == part)
        return F.coalesce(same, F.lit(False))

    return F.filter(hits, whole)


def _found(number: int):
    return lambda s: (s["template"] == number) & (s["weight"] >= SHARE - 1e-9)


def license_scan(docs: DataFrame) -> DataFrame:
    """n_words, places and labels of base phrases, all labels, score: one row per document."""
    index = RareIndex(*document_frequencies(docs))
    normal = _normal(F.col("text"))
    held = docs.select("doc_id", F.concat(F.lit(" "), normal, F.lit(" ")).alias("_padded"))
    padded, words = F.col("_padded"), F.array_remove(F.split("_padded", " "), "")
    has = {phrase: F.contains(padded, F.lit(f" {phrase} ")) for phrase in BASE}
    any_base = has["mit license"] | has["apache license"] | has["general public license"]
    rare = F.lit(False)
    for word in sorted(index.postings):
        rare = rare | F.contains(padded, F.lit(f" {word} "))
    # one space before each word and one at the end; two spaces alone hold no word
    spaces = F.length("_padded") - F.length(F.replace("_padded", F.lit(" "), F.lit("")))
    n_words = F.when(F.col("_padded") == "  ", 0).otherwise(spaces - 1).cast("long")
    empty = F.array().cast("array<int>")
    named = held.select(
        "doc_id", "_padded", n_words.alias("n_words"),
        # Only a file with a base phrase, or with an indexed word, is cut into words.
        F.when(any_base, let(words, lambda w: F.array_sort(F.concat(*[_places(w, p) for p in BASE])))).otherwise(empty).alias("_at"),
        F.filter(F.array(*[F.when(has[p], F.lit(label)) for p, label in BASE.items()]), lambda x: x.isNotNull()).alias("_base"),
        F.when(rare, _starts(_votes(words, index)))
        .otherwise(F.array().cast("array<struct<template:int,weight:double>>")).alias("_starts"),
    )
    verified = F.filter(
        F.array(*[
            F.when(
                F.exists("_starts", _found(t))
                & F.contains("_padded", F.lit(f" {phrase} ")),
                F.lit(label),
            ) for t, (label, _, phrase) in enumerate(TEMPLATES)
        ]),
        lambda x: x.isNotNull(),
    )
    best = F.coalesce(F.array_max(F.transform("_starts", lambda s: s["weight"])), F.lit(0.0))
    score = F.when(F.size("_at") > 0, F.lit(1.0)).otherwise(F.least(best, F.lit(1.0)))
    return named.select(
        "doc_id", "n_words", F.size("_at").cast("long").alias("n_base"),
        F.array_min("_at").cast("long").alias("first_word"), F.array_max("_at").cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct("_base")), ",").alias("base_labels"),
        F.when(F.size("_starts") > 0, F.array_join(F.sort_array(F.array_distinct(F.concat("_base", verified))), ","))
        .otherwise(F.array_join(F.sort_array(F.array_distinct("_base")), ",")).alias("labels"),
        score.alias("score"),
    )
