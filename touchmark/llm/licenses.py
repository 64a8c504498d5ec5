"""License scans: k-gram hashes joined to template positions, votes counted by diagonal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchmark.llm.common import digest, fits, ngrams, read, register, stored, text_or_empty

# Phrases that count as base places, and notices as their licenses word them.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
     "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
     "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
     "following conditions"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
     "except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
     "your option) any later version."),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation; either version 2 of the License, or (at "
     "your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mit", "Released under the MIT License."),
)


@dataclass(frozen=True)
class Scan:
    gram: int = 3
    #: Neighbouring diagonals up to this far apart are one span: words added or left out.
    max_shift: int = 4
    #: A span counts when its grams cover this share of the notice's words.
    min_coverage: float = 0.75
    #: Template grams that are broadcast; a larger set is joined by shuffling.
    broadcast_grams: int = 1_000_000


def license_words(text: Column) -> Column:
    """Runs of ASCII letters, lowered, ASCII digits and all characters beyond ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate(text, upper, upper.lower())
    return F.array_remove(F.split(lowered, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def _templates(spark: SparkSession, phrases, notices, gram: int) -> DataFrame:
    """(template, label, base, n_words, n_grams, h, place): each gram of each template with its place."""
    rows = [(i, label, True, text) for i, (label, text) in enumerate(phrases)]
    rows += [(i + len(phrases), label, False, text) for i, (label, text) in enumerate(notices)]
    table = spark.createDataFrame(rows, "template int, label string, base boolean, text string")
    table = table.withColumn("w", license_words(F.col("text"))).withColumn("n_words", F.size("w"))
    grams = F.posexplode(ngrams(F.col("w"), gram)).alias("place", "h")
    return table.select("template", "label", "base", "n_words", (F.size("w") - gram + 1).alias("n_grams"), grams)


def _hits(docs: DataFrame, templates: DataFrame, text: str, scan: Scan) -> DataFrame:
    """Distinct (text digest, template, position, place) where a gram of a text is one of a template.

    Equal texts give equal hits, so copies fold together before the shuffle.
    """
    body = text_or_empty(text)
    grams = docs.select(digest(body).alias("digest"), license_words(body).alias("w")).select(
        "digest", F.posexplode(ngrams(F.col("w"), scan.gram)).alias("at", "h")
    )
    small = fits(templates, scan.broadcast_grams)
    return grams.join(F.broadcast(templates) if small else templates, "h").drop("h").distinct()


def _spans(hits: DataFrame, scan: Scan) -> DataFrame:
    """One row per text and span: template, label, first and end word, share of the notice covered."""
    hits = hits.withColumn("diagonal", F.col("at") - F.col("place"))
    one = Window.partitionBy("digest", "template")
    step = F.col("diagonal") - F.lag("diagonal").over(one.orderBy("diagonal", "at"))
    group = F.sum(F.when(F.coalesce(step, F.lit(0)) > scan.max_shift, 1).otherwise(0)).over(
        one.orderBy("diagonal", "at").rowsBetween(Window.unboundedPreceding, 0)
    )
    hits = hits.withColumn("span", group)
    # Words of the notice under its matched grams: each gram adds what the next does not cover.
    places = F.array_sort(F.collect_set("place"))
    spans = hits.groupBy("digest", "template", "label", "n_words", "span").agg(
        F.min("at").alias("start"), (F.max("at") + scan.gram).alias("end"), places.alias("places")
    )
    start = F.struct(F.lit(-scan.gram).alias("last"), F.lit(0).alias("total"))
    covered = F.aggregate(
        "places",
        start,
        lambda acc, p: F.struct(
            p.alias("last"), (acc["total"] + F.least(F.lit(scan.gram), p - acc["last"])).alias("total")
        ),
        lambda acc: acc["total"],
    )
    return spans.select("digest", "template", "label", "start", "end", (covered / F.col("n_words")).alias("coverage"))


def _phrases(hits: DataFrame) -> DataFrame:
    """Places of whole phrases: diagonals on which every gram of the phrase votes."""
    votes = hits.groupBy("digest", "template", "label", "n_grams", (F.col("at") - F.col("place")).alias("start"))
    return votes.agg(F.count("*").alias("votes")).filter(F.col("votes") == F.col("n_grams"))


def scan_licenses(
    docs: DataFrame, key: str = "doc_id", text: str = "text", phrases=PHRASES, notices=NOTICES, scan: Scan = Scan()
) -> DataFrame:
    """Per document: words, base places, labels, and the best coverage of any notice (phrases count 1).

    Null texts are empty, with no labels and score 0. Every row comes back, repeated or not; an empty
    table gives none. A span is held to its words by 64-bit gram hashes on neighbouring diagonals, whose
    places must cover the notice; a longer text only adds grams, as no group spans more than a text.
    """
    spark = docs.sparkSession
    found = stored(_hits(docs, _templates(spark, phrases, notices, scan.gram), text, scan), "license-hits")
    places = _phrases(found.filter("base")).groupBy("digest").agg(
        F.count("*").alias("n_base"), F.min("start").cast("long").alias("first_word"),
        F.max("start").cast("long").alias("last_word"), F.collect_set("label").alias("base_set"),
    )
    spans = _spans(found.filter("NOT base"), scan).groupBy("digest").agg(
        F.collect_set(F.when(F.col("coverage") >= scan.min_coverage, F.col("label"))).alias("span_set"),
        F.max("coverage").alias("coverage"),
    )
    none = F.array().cast("array<string>")
    marks = places.join(spans, "digest", "full").select(
        F.col("digest").alias("__d"), "n_base", "first_word", "last_word", "coverage",
        F.coalesce("base_set", none).alias("base_set"), F.coalesce("span_set", none).alias("span_set"),
    )
    body = text_or_empty(text)
    rows = docs.select(F.col(key), digest(body).alias("__digest"), F.size(license_words(body)).cast("long").alias("n_words"))
    rows = rows.join(marks, F.col("__digest") == F.col("__d"), "left")
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return rows.select(
        key, "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        joined(F.col("base_set")).alias("base_labels"),
        joined(F.array_union("base_set", "span_set")).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("coverage", F.lit(0.0))).alias("score"),
    )


@register("op9_license_diagonals")
def op9_license_diagonals(spark: SparkSession, d: str) -> DataFrame:
    return scan_licenses(read(spark, d, "documents"))
