"""Licence scans with a positional index of rare words, with DataFrame functions only.

Words are runs of ASCII letters, digits and longer characters, with A-Z lowered. Templates are
short notices; a template's index entries are its words of highest IDF over all files. A file is
looked up by its words that the index holds, all or those of highest IDF: each of their places,
less the word's place in a template, gives a start. Starts on which `least_agreeing` looked-up words agree are
candidates. A candidate counts if the template's mandatory key phrase stands in full at its
place, and if the words that stand at theirs hold `least_share` of the template's IDF.

The index is a few hundred entries whatever the corpus, so it is part of the expressions, and
files are neither joined nor shuffled. IDF is counted over all files.

Base phrases are found besides, as consecutive words, and label a file by themselves. The score
is the highest share of a template found, 1 if a base phrase was.

Null and empty texts have no words and no labels. Repeated rows are scanned each by itself. All
columns of the input are kept; those named like an output are replaced. Empty tables give empty
tables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditweave.llm.textkit import unused


@dataclass(frozen=True)
class Template:
    label: str
    notice: str
    phrase: str

    @property
    def words(self) -> list[str]:
        return self.notice.split()

    @property
    def phrase_at(self) -> int:
        wanted = self.phrase.split()
        return next(i for i in range(len(self.words)) if self.words[i : i + len(wanted)] == wanted)


# Notices of well-known licences, as words. Fixed values.
TEMPLATES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "granted free of charge to any person"),
    Template("mit", "released under the mit license", "the mit license"),
    Template("mit", "spdx license identifier mit", "license identifier mit"),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    Template("apache-2", "spdx license identifier apache 2 0", "license identifier apache 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", "for any purpose with or without fee"),
    Template("gpl-2", "the terms of the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl-3", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
)
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def file_words(text: str) -> Column:
    """The words. `lower` is the same as A-Z for pure ASCII, and faster."""
    whole = F.coalesce(text, F.lit(""))
    ascii_only = F.length(whole) == F.octet_length(whole)
    lowered = F.when(ascii_only, F.lower(whole)).otherwise(F.translate(whole, _UPPER, _LOWER))
    return F.regexp_extract_all(lowered, F.lit(_WORD), F.lit(0))


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _phrase_starts(found: Column, phrase: str) -> Column:
    wanted = phrase.split()

    def here(place: Column) -> Column:
        stands = F.get(found, place) == wanted[0]
        for step, word in enumerate(wanted[1:], 1):
            stands = stands & F.coalesce(F.get(found, place + step) == word, F.lit(False))
        return stands

    places = F.sequence(F.lit(0), F.size(found) - 1)
    return F.when(F.array_contains(found, wanted[-1]), F.filter(places, here)).otherwise(F.array().cast("array<int>"))


def word_idf(documents: DataFrame, text: str, vocabulary: list[str]) -> dict[str, float]:
    """IDF of licence words over all files; the result is bounded by the vocabulary."""
    held = documents.select(F.array_intersect(file_words(text), _strings(vocabulary)).alias("held"))
    # A file with none of the words still counts: it leaves the empty word.
    every = held.select(F.explode(F.array_append("held", F.lit(""))).alias("word"))
    counts = {row.word: row["count"] for row in every.groupBy("word").count().collect()}
    files = counts.get("", 0)
    return {word: math.log((1 + files) / (1 + counts.get(word, 0))) + 1.0 for word in vocabulary}


def scan(
    documents: DataFrame,
    text: str = "text",
    templates: tuple[Template, ...] = TEMPLATES,
    entries: int = 4,
    looked_up: int | None = 12,
    least_agreeing: int = 2,
    least_share: float = 0.75,
) -> DataFrame:
    """Add `n_words`, `n_base`, `first_word`, `last_word`, `base_labels`, `labels`, `score`, `places`.

    `entries` is the number of a template's words in the index, `looked_up` the number of a
    file's distinct licence words that are searched, None for all of them: with fewer, a file of
    many notices loses labels. `places` are the template finds.
    """
    vocabulary = sorted({word for t in templates for word in t.words})
    idf = word_idf(documents, text, vocabulary)
    postings: dict[str, list[tuple[int, int]]] = {}
    for number, template in enumerate(templates):
        rarest = sorted(set(template.words), key=lambda w: (-idf[w], w))[:entries]
        for place, word in enumerate(template.words):
            if word in rarest:
                postings.setdefault(word, []).append((number, place))
    by_idf = sorted(postings, key=lambda w: (-idf[w], w))

    def posting(template: int, place: int) -> Column:
        return F.struct(F.lit(template).alias("template"), F.lit(place).alias("place"))

    index = F.create_map(
        *[c for w in by_idf for c in (F.lit(w), F.array(*[posting(*x) for x in postings[w]]))]
    )
    notices = F.array(*[_strings(t.words) for t in templates])
    phrases = F.array(*[F.struct(F.lit(t.phrase_at).alias("at"), F.lit(len(t.phrase.split())).alias("n")) for t in templates])
    weights = F.array(*[F.array(*[F.lit(idf[w]) for w in t.words]) for t in templates])
    labels = _strings([t.label for t in templates])

    w, rare, starts, base = (unused(documents.columns, x) for x in ("words", "rare", "starts", "base"))
    found = F.col(w)

    def stands(template: Column, at: Column, place: Column) -> Column:
        return F.coalesce(F.get(found, at + place) == F.get(F.get(notices, template), place), F.lit(False))

    def verified(start: Column) -> Column:
        template, at = start["template"], start["at"]
        size = F.size(F.get(notices, template))
        phrase = F.get(phrases, template)
        held = F.aggregate(
            F.sequence(F.lit(0), size - 1),
            F.lit(0.0),
            lambda total, j: total + F.when(stands(template, at, j), F.get(F.get(weights, template), j)).otherwise(0.0),
        )
        whole = F.aggregate(F.get(weights, template), F.lit(0.0), lambda total, x: total + x)
        key = F.forall(F.sequence(phrase["at"], phrase["at"] + phrase["n"] - 1), lambda j: stands(template, at, j))
        return F.struct(
            F.get(labels, template).alias("label"), at.alias("at"), F.when(key, F.least(held / whole, F.lit(1.0))).otherwise(0.0).alias("share")
        )

    none = F.array().cast("array<struct<template:int,at:int>>")
    tagged = documents.withColumn(w, file_words(text))
    # In order of IDF, so that the first are the file's rarest.
    held = F.array_intersect(_strings(by_idf), found)
    tagged = tagged.withColumn(rare, held if looked_up is None else F.slice(held, 1, looked_up))
    hits = F.filter(
        F.transform(found, lambda word, i: F.struct(word.alias("word"), i.alias("i"))),
        lambda hit: F.array_contains(F.col(rare), hit["word"]),
    )
    all_starts = F.flatten(
        F.transform(
            hits,
            lambda hit: F.transform(
                F.element_at(index, hit["word"]),
                lambda p: F.struct(p["template"].alias("template"), (hit["i"] - p["place"]).alias("at")),
            ),
        )
    )
    tagged = tagged.withColumn(
        starts, F.when(F.size(rare) >= least_agreeing, F.array_sort(all_starts)).otherwise(none)
    )
    # Equal starts stand together; the one that has enough before it is a candidate.
    agreeing = F.array_distinct(
        F.filter(F.col(starts), lambda s, i: F.get(F.col(starts), i - (least_agreeing - 1)) == s)
    )
    finds = F.filter(F.transform(agreeing, verified), lambda f: f["share"] >= least_share)
    phrase_places = {label: _phrase_starts(found, phrase) for phrase, label in BASE_PHRASES.items()}
    tagged = tagged.withColumns(
        {
            "places": finds,
            base: F.array(
                *[F.struct(F.lit(label).alias("label"), at.alias("at")) for label, at in phrase_places.items()]
            ),
        }
    )
    base_places = F.flatten(F.transform(base, lambda b: b["at"]))
    base_found = F.transform(F.filter(base, lambda b: F.size(b["at"]) > 0), lambda b: b["label"])
    every_label = F.concat(base_found, F.transform("places", lambda f: f["label"]))
    best = F.coalesce(F.array_max(F.transform("places", lambda f: f["share"])), F.lit(0.0))
    return tagged.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "n_base": F.size(base_places).cast("long"),
            "first_word": F.array_min(base_places).cast("long"),
            "last_word": F.array_max(base_places).cast("long"),
            "base_labels": F.concat_ws(",", F.array_sort(F.array_distinct(base_found))),
            "labels": F.concat_ws(",", F.array_sort(F.array_distinct(every_label))),
            "score": F.when(F.size(base_places) > 0, 1.0).otherwise(best),
        }
    ).drop(w, rare, starts, base)
