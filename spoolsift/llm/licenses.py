"""Licence texts in documents, by a positional index of rare words. DataFrame functions only.

Every template has a mandatory key phrase. Of its words the one that fewest documents hold, the highest in inverse document frequency,
is its posting in the index. The words of a document are looked up there; a hit says where the template would begin. The
rarest words of the phrase besides it must stand at the same distance, then the whole phrase must be there, and the share
of the template's words that stand in their places is the score.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A licence's text, in part, and the phrase of it that must be there."""

    label: str
    text: str
    phrase: str
    base: bool = False


# Public licence texts.
TEMPLATES = (
    Template("mit", "mit license", "mit license", base=True),
    Template("apache", "apache license", "apache license", base=True),
    Template("gpl", "general public license", "general public license", base=True),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "permission is hereby granted free of charge",
    ),
    Template(
        "apache",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "you may not use this file except in compliance with the license",
    ),
    Template(
        "gpl",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "under the terms of the gnu general public license",
    ),
    Template("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license", "gnu affero general public license"),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistribution and use in source and binary forms",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "with or without fee is hereby granted",
    ),
    Template("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    Template("epl", "eclipse public license", "eclipse public license"),
    Template("cc", "this work is licensed under a creative commons attribution", "licensed under a creative commons"),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        "free and unencumbered software released into the public domain",
    ),
)

# A template counts if this share of its words is in place.
LEAST_SHARE = 0.6
# The phrase's rarest words that are compared before the whole phrase.
COMPARED = 3

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of letters, digits and all beyond ASCII, A-Z lower-cased; of null none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), 0)


def _strings(values: Sequence[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _phrase_words(docs: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """A row for every word of every phrase: template (number), word, place (in the phrase)."""
    rows = [
        F.struct(F.lit(i).alias("template"), F.lit(word).alias("word"), F.lit(place).alias("place"))
        for i, t in enumerate(templates)
        for place, word in enumerate(t.phrase.split())
    ]
    return docs.sparkSession.range(1).select(F.inline(F.array(*rows)))


def _postings(docs: DataFrame, text: str, templates: Sequence[Template]) -> DataFrame:
    """The index: for every template the word of its phrase in fewest documents, and the next rarest with their places.

    Documents are counted for the templates' words only, so the counts are as few as those; the index has a row a template.
    """
    known = docs.select(F.explode(F.array_intersect(words_of(F.col(text)), _strings(_vocabulary(templates)))).alias("word"))
    counts = known.groupBy("word").agg(F.count("*").alias("n"))
    ranked = _phrase_words(docs, templates).join(F.broadcast(counts), "word", "left")
    by_rarity = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place")))
    rarest = ranked.groupBy("template").agg(F.slice(by_rarity, 1, COMPARED).alias("rarest"))
    details = [
        F.struct(
            F.lit(i).alias("template"),
            F.lit(t.label).alias("label"),
            F.lit(t.base).alias("base"),
            _strings(t.text.split()).alias("words"),
            _strings(t.phrase.split()).alias("phrase"),
            F.lit(_place(t)).alias("at"),
        )
        for i, t in enumerate(templates)
    ]
    described = docs.sparkSession.range(1).select(F.inline(F.array(*details)))
    index = described.join(rarest, "template")
    return index.withColumns({"word": F.col("rarest")[0]["word"], "place": F.col("rarest")[0]["place"]})


def _vocabulary(templates: Sequence[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.phrase.split()})


def _place(template: Template) -> int:
    """Where the phrase begins in the text of its template."""
    words, phrase = template.text.split(), template.phrase.split()
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def licenses(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, text: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_words, places, an array of (start, label, base, n_words, share) in order.

    A place is where the key phrase of a template stands as consecutive words; ``start`` is its first word, from 0, ``n_words`` its
    length, ``share`` the share of the template's words that stand in their places around it. Templates that are not ``base``
    need LEAST_SHARE. A null or empty text has no words and no places. Each row is looked at by itself and whole: repeated rows
    and rows without doc_id come out as they come in, an empty table gives an empty one, other columns are ignored.
    """
    end = F.struct(F.lit(-1).alias("template"), F.lit("").alias("word"))
    # The empty word, which no text has, is added to each row's licence words, so that every row comes through the look-up.
    index = _postings(docs, text, templates).unionByName(
        docs.sparkSession.range(1).select(F.inline(F.array(end))), allowMissingColumns=True
    )
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", words_of(F.col(text)).alias("_words"))
    present = F.array_intersect("_words", _strings(_vocabulary(templates)))
    tokens = rows.withColumn("word", F.explode(F.concat(present, F.array(F.lit("")))))
    hits = tokens.join(F.broadcast(index), "word")

    def there(at: Column) -> Column:
        """Does the phrase stand around its rarest word, which is at this place?"""
        begin = at - F.col("place")
        compared = F.forall("rarest", lambda r: F.get("_words", begin + r["place"]) == r["word"])
        whole = F.slice("_words", begin + 1, F.size("phrase")) == F.col("phrase")
        return (F.get("_words", at) == F.col("word")) & F.when(begin >= 0, F.when(compared, whole)).otherwise(False)

    def place(at: Column) -> Column:
        begin = at - F.col("place")
        in_place = F.transform("words", lambda w, i: (F.get("_words", begin - F.col("at") + i) == w).cast("int"))
        share = F.aggregate(in_place, F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0))) / F.size("words")
        return F.struct(
            begin.cast("long").alias("start"),
            F.col("label").alias("label"),
            F.col("base").alias("base"),
            F.size("phrase").cast("long").alias("n_words"),
            F.when(F.col("base"), F.lit(1.0)).otherwise(share).alias("share"),
        )

    found = F.transform(F.filter(F.sequence(F.lit(0), F.size("_words") - 1), there), place)
    found = F.when(F.col("template") >= 0, F.filter(found, lambda p: p["base"] | (p["share"] >= LEAST_SHARE)))
    one = hits.select("_row", "doc_id", F.size("_words").cast("long").alias("n"), found.alias("found"))
    by_row = one.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n").alias("n_words"), F.flatten(F.collect_list("found")).alias("places")
    )
    return by_row.select("doc_id", "n_words", F.array_sort("places").alias("places"))
