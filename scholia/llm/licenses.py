"""License scans by diagonal voting.

Every word k-gram of a text whose rolling hash starts a k-gram of a template gives a vote for the diagonal
(place in the text minus place in the template). Votes are the set of template places hit, so they add up
without regard to order or repetition. A phrase stands in the text where a diagonal has all of its places.
For the longer templates neighbouring diagonals are merged, as an inserted or missing word moves the rest by
one: each diagonal together with the next few, never a chain of them, so that no run of votes can make a span
too long. A merged span is verified by the share of the template's places that it covers, and of spans whose
starts lie that close the best covered one counts.

Templates are a fixed list, so the table of their k-grams is small by construction and may be broadcast;
texts are never shuffled, only votes are, and a text's votes are summed before they leave its task.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.plans.lineage import durable

#: Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Well-known wordings of licences and notices, by label.
TEMPLATES = {
    "apache-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit-notice": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license",
}
#: Words: runs of ASCII letters and digits and of all characters beyond ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 2
#: Diagonals at most so far apart are merged (less for templates of fewer places); a span must cover this share of them.
MERGE = 12
COVER = 0.6
#: A multiple of every number up to MERGE: in these units all templates have the same distance of merging.
_UNITS = 27720


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    exact: bool

    @property
    def places(self) -> int:
        return len(self.words) - GRAM + 1


def templates(phrases: dict[str, str] | None = None, texts: dict[str, str] | None = None) -> list[Template]:
    out = [Template(label, tuple(p.split()), True) for p, label in (PHRASES if phrases is None else phrases).items()]
    out += [Template(label, tuple(t.split()), False) for label, t in (TEMPLATES if texts is None else texts).items()]
    for t in out:
        if not GRAM <= len(t.words) <= 63:
            raise ValueError(f"{t.label}: {len(t.words)} words")
    return out


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: F.Column) -> F.Column:
    """Words of a text, A-Z in lower case; a separator at either end leaves an empty part, which is none."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), SEPARATORS), "")


def _grams(spark: SparkSession, all_templates: list[Template]) -> DataFrame:
    rows = [
        {"template": i, "place": p, "first": a, "second": b, "size": t.places, "exact": t.exact, "label": t.label}
        for i, t in enumerate(all_templates) for p, (a, b) in enumerate(zip(t.words, t.words[1:], strict=False))
    ]
    schema = "array<struct<template:int, place:int, first:string, second:string, size:int, exact:boolean, label:string>>"
    grams = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))
    return grams.withColumn("gram", F.xxhash64("first", "second"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, texts: dict[str, str] | None = None) -> DataFrame:
    """``(id, text_hash, label, exact, first_word, last_word, cover)``: every place of a phrase and every span of a template.

    ``first_word`` is where the phrase or span starts and ``last_word`` its last word, counted from 0.
    Rows that repeat id and text give their spans once. Null and empty texts have none.
    """
    spark = docs.sparkSession
    grams = _grams(spark, templates(phrases, texts))
    text = F.col(text_col).cast("string")
    rows = docs.where(text.isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), _words(text).alias("words"))
    # A place per k-gram; shorter texts have none.
    places = rows.where(F.size("words") >= GRAM).select("id", "text_hash", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("at"))
    first, second = F.element_at("words", F.col("at")), F.element_at("words", F.col("at") + 1)
    places = places.select("id", "text_hash", F.col("at") - 1, first.alias("w1"), second.alias("w2")).toDF("id", "text_hash", "at", "w1", "w2")
    places = places.withColumn("gram", F.xxhash64("w1", "w2"))
    votes = places.join(F.broadcast(grams), "gram").where((F.col("w1") == F.col("first")) & (F.col("w2") == F.col("second")))
    diagonal = (F.col("at") - F.col("place")).alias("diagonal")
    keys = ["id", "text_hash", "template", "label", "exact", "size"]
    summed = votes.groupBy(*keys, diagonal).agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("hit"))
    # Kept, as it is small and both kinds of templates read it: texts are split once.
    summed = durable(summed)

    whole = summed.where(F.col("exact") & (F.bit_count("hit") == F.col("size")))
    whole = whole.select("id", "text_hash", "label", "exact", F.col("diagonal").alias("first_word"), (F.col("diagonal") + F.col("size")).alias("last_word"), F.lit(1.0).alias("cover"))

    lowest = F.col("diagonal") + F.log2(F.col("hit").bitwiseAND(-F.col("hit")).cast("double")).cast("int")
    highest = F.col("diagonal") + F.floor(F.log2(F.col("hit").cast("double"))).cast("int") + GRAM - 1
    step = F.col("diagonal").cast("long") * F.floor(F.lit(_UNITS) / F.least("size", F.lit(MERGE))).cast("long")
    fuzzy = summed.where(~F.col("exact")).select("*", step.alias("step"), lowest.alias("low"), highest.alias("high"))
    by = Window.partitionBy("id", "text_hash", "template").orderBy("step")
    ahead, around = by.rangeBetween(0, _UNITS), by.rangeBetween(-_UNITS, _UNITS)
    merged = fuzzy.select("*", (F.bit_count(F.bit_or("hit").over(ahead)) / F.col("size")).alias("cover"), F.min("low").over(ahead).alias("first_word"), F.max("high").over(ahead).alias("last_word"))
    merged = merged.where(F.col("cover") >= COVER)
    # Of spans that start close together the best covered one stays, of equal ones the first.
    worth = F.struct("cover", -F.col("step"))
    best = merged.withColumn("best", F.max(worth).over(around)).where(worth == F.col("best"))
    return whole.unionByName(best.select("id", "text_hash", "label", "exact", "first_word", "last_word", "cover"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)``.

    ``n_base`` counts all places of the fixed phrases; ``first_word`` and ``last_word`` are the smallest and
    largest start among them, null without any. Labels are distinct, sorted and comma-joined, empty without
    any. ``score`` is the best cover of a label, 0 without any. A null text counts as empty.
    """
    found = spans(docs, id_col, text_col)
    base = F.when(F.col("exact"), F.col("first_word"))
    per_text = found.groupBy("id", "text_hash").agg(
        F.count_if(F.col("exact")).alias("n_base"), F.min(base).cast("long").alias("first_word"), F.max(base).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("cover").alias("score"),
    ).alias("f")
    text = F.col(text_col).cast("string")
    n_words = F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), n_words.alias("n_words")).alias("d")
    met = rows.join(per_text, F.col("d.id").eqNullSafe(F.col("f.id")) & (F.col("d.text_hash") == F.col("f.text_hash")), "left")
    zero, none = F.lit(0), F.lit("")
    return met.select(
        "d.id", "d.n_words", F.coalesce("f.n_base", zero).alias("n_base"), "f.first_word", "f.last_word",
        F.coalesce("f.base_labels", none).alias("base_labels"), F.coalesce("f.labels", none).alias("labels"), F.coalesce("f.score", F.lit(0.0)).alias("score"),
    )
