"""License scan by MinHash bands over overlapping text windows, in built-in functions only.

Texts and templates become lower-cased words of letters and digits, and shingles of
``SHINGLE`` words. A template of t shingles belongs to the size class c, the power of two
with c/2 < t <= c; texts are read through windows of 2c shingles that start every c
shingles, so some window holds any passage of up to c shingles whole. Each band is the
minimum of one hash function over the shingles (one row per band). A window with the
fraction s of the template's shingles has similarity of at least J = s*t / (2c + (1-s)*t)
to it, and ``BANDS`` bands miss it with probability (1-J)^BANDS: for a full template of
t = c shingles below 1e-7, at s = 0.8 below 1e-4, in the worst case (t just over c/2,
s = 0.8) about 1e-2 per window. Windows that share a band minimum with a template of
their class are candidates; exact shingle containment of at least ``CONTAINMENT`` decides.

Texts without any anchor word (found from the templates so that a text without one lacks
more than 1 - ``CONTAINMENT`` of every template's shingles) are passed over.

A template of fewer than ``SHINGLE`` words is one shingle of all its words, and is looked
for exactly, with the windows of size class 1.

Results: one row per document and template found: the best containment, and the first
word (from 0) of the first window that has it. Null and
empty texts give none, and texts shorter than a shingle only templates that are shorter
too. Repeated rows give one row.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evlens.functions.literals import literal_frame

SHINGLE = 5
BANDS = 24
CONTAINMENT = 0.8

# Template name, license, text of the notice.
TEMPLATES = (
    ("apache-2-short", "Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2-notice", "Apache-2.0", "you may not use this file except in compliance with the License. "
     "You may obtain a copy of the License at"),
    ("bsd", "BSD", "Redistribution and use in source and binary forms, with or without modification, "
     "are permitted provided that the following conditions are met"),
    ("cc-by-nc-4-short", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("gpl-3-short", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "GPL", "you can redistribute it and/or modify it under the terms of the GNU General Public License "
     "as published by the Free Software Foundation"),
    ("mit-grant", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
     "and associated documentation files"),
    ("mit-short", "MIT", "Released under the MIT License"),
    ("mpl-2-notice", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("agpl-notice", "AGPL", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
     "as published by the Free Software Foundation"),
    ("agpl-short", "AGPL", "licensed under the GNU Affero General Public License"),
    ("apache-2-title", "Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("cc0-short", "CC0-1.0", "CC0 1.0 Universal Public Domain Dedication"),
    ("cc0-waiver", "CC0-1.0", "has waived all copyright and related or neighboring rights to"),
    ("cc-by-4-notice", "CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-4-short", "CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4-notice", "CC-BY-NC-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa-4-notice", "CC-BY-SA-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa-4-short", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("gnu-text", "GNU", "Everyone is permitted to copy and distribute verbatim copies of this license document, "
     "but changing it is not allowed"),
    ("gpl-short", "GPL", "licensed under the GNU General Public License"),
    ("isc-grant", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
     "is hereby granted"),
    ("lgpl-notice", "LGPL", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
     "as published by the Free Software Foundation"),
    ("lgpl-short", "LGPL", "licensed under the GNU Lesser General Public License"),
    ("unlicense", "Unlicense", "This is free and unencumbered software released into the public domain"),
)
# Single lines, some shorter than a shingle.
LINES = (("rights-reserved", "All-rights-reserved", "All rights reserved"),) + tuple(
    (f"spdx-{name.lower()}", name, f"SPDX-License-Identifier: {name}")
    for name in ("AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0",
                 "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense"))
# Words too common to tell texts apart; an anchor only where nothing else is left.
COMMON = frozenset("""a all an and any are as at be by for from in is it may not of on or that the this to under use was
were with you""".split())
_BETWEEN = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _BETWEEN, " "), " ", -1),
                    lambda w: w != "")


def _places(words: Column, k: int) -> Column:
    """First word (from 1) of every shingle."""
    return F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1))).otherwise(
        F.array().cast("array<int>"))


def shingle_hashes(words: Column, k: int = SHINGLE) -> Column:
    return F.transform(_places(words, k), lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(k)]))


def shingle_texts(words: Column, k: int = SHINGLE) -> Column:
    return F.transform(_places(words, k), lambda i: F.array_join(F.slice(words, i, k), " "))


def band(hashes: Column, first: Column, last: Column, j: Column) -> Column:
    """Minimum of the j-th hash function over the shingles at places first..last (from 1).

    By place, as slicing a long array copies all of it.
    """
    return F.array_min(F.transform(F.sequence(first, last), lambda i: F.xxhash64(F.element_at(hashes, i), j)))


def template_table(spark: SparkSession, templates=TEMPLATES, shingle: int = SHINGLE, bands: int = BANDS) -> DataFrame:
    """Templates with their distinct shingles, size class and band minima; those shorter than a shingle are not in it."""
    rows = literal_frame(spark, [("template", "string"), ("license", "string"), ("text", "string")], list(templates))
    words = rows.select("template", "license", words_of(F.col("text")).alias("words"))
    parts = words.select("template", "license", F.array_distinct(shingle_texts(F.col("words"), shingle)).alias("shingles"),
                         F.array_distinct(shingle_hashes(F.col("words"), shingle)).alias("hashes")).where(F.size("hashes") > 0)
    return parts.withColumn("class", F.pow(F.lit(2.0), F.ceil(F.log2(F.size("shingles")))).cast("int")).withColumn(
        "minima", F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: band(F.col("hashes"), F.lit(1), F.size("hashes"), j)))


def anchor_words(templates: list[list[str]], least: float = CONTAINMENT) -> list[str]:
    """Words that a text with the fraction ``least`` of some template's shingles cannot lack.

    For each template (a list of shingles) words are taken until less than the fraction
    ``least`` of its shingles hold none: whoever has those only has too few.
    Long words come first, as they are rare, and common ones last.
    """
    out: set[str] = set()
    for shingles in templates:
        sets = [set(s.split(" ")) for s in shingles]
        while sets and sum(not s & out for s in sets) / len(sets) >= least:
            left = [s for s in sets if not s & out]
            out.add(max({w for s in left for w in s}, key=lambda w: (w not in COMMON, sum(w in s for s in left) * len(w) ** 2, w)))
    return sorted(out)


def _short_notices(docs: DataFrame, templates, shingle: int, id_col: str, text_col: str) -> DataFrame | None:
    """Matches of the templates shorter than a shingle; nothing if there are none."""
    rows = literal_frame(docs.sparkSession, [("template", "string"), ("license", "string"), ("text", "string")], list(templates))
    words = rows.select("template", "license", words_of(F.col("text")).alias("words"))
    known = words.where(F.size("words").between(1, shingle - 1)).collect()      # one row per template
    if not known:
        return None
    text = F.col(f"`{text_col}`").cast("string")
    lines = "|".join(sorted({_BETWEEN.join(map(re.escape, r["words"])) for r in known}))
    may = F.lower(text).rlike(rf"(?<![\p{{L}}\p{{N}}])({lines})(?![\p{{L}}\p{{N}}])")
    found = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text")).where(may).select(
        "doc_id", words_of(F.col("text")).alias("words"))

    def place(r) -> Column:
        """First word (from 1) of the first place of the template, null without one."""
        k = len(r["words"])
        same = lambda i: F.slice("words", i, k) == F.array(*map(F.lit, r["words"]))
        at = F.array_min(F.filter(_places(F.col("words"), k), same))
        return F.struct(F.lit(r["template"]).alias("template"), F.lit(r["license"]).alias("license"), at.alias("at"))

    hits = found.select("doc_id", F.explode(F.array(*map(place, known))).alias("hit")).where("hit.at is not null")
    # The first window of two shingles that holds a place starts one word before it.
    return (hits.groupBy("doc_id", F.col("hit.template").alias("template"), F.col("hit.license").alias("license"))
            .agg(F.greatest(F.min("hit.at") - 2, F.lit(0)).cast("long").alias("first_word"))
            .select("doc_id", "template", "license", F.lit(1.0).alias("containment"), "first_word"))


def scan(docs: DataFrame, templates=TEMPLATES + LINES, shingle: int = SHINGLE, bands: int = BANDS, least: float = CONTAINMENT,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, template, license, containment, first_word)``; see the module text."""
    short = _short_notices(docs, templates, shingle, id_col, text_col)
    table = template_table(docs.sparkSession, templates, shingle, bands)
    known = table.select("class", "minima", "shingles").collect()        # one row per template
    classes = sorted({r["class"] for r in known})
    if not classes:
        return short if short is not None else literal_frame(docs.sparkSession, [("doc_id", "long"), ("template", "string"), ("license", "string"),
                                                 ("containment", "double"), ("first_word", "long")], [])
    anchors = anchor_words([r["shingles"] for r in known], least)
    text = F.col(f"`{text_col}`").cast("string")
    may = F.lower(text).rlike(rf"(?<![\p{{L}}\p{{N}}])({'|'.join(map(re.escape, anchors))})(?![\p{{L}}\p{{N}}])")
    rows = (docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text")).where(may)
            .select("doc_id", words_of(F.col("text")).alias("words"))
            .select("doc_id", "words", shingle_hashes(F.col("words"), shingle).alias("hashes")))
    # No filter on these arrays: it would move below them, and bring their expressions along, once for each use.

    def candidates(c: int) -> Column:
        """Windows of class c that share a band minimum with a template of the class."""
        minima = sorted({v for r in known if r["class"] == c for v in r["minima"]})
        last = F.greatest(F.ceil(F.size("hashes") / c).cast("int") - 2, F.lit(0))

        def shares(w: Column) -> Column:
            stop = F.least(w * c + 2 * c, F.size("hashes"))
            return F.exists(F.sequence(F.lit(0), F.lit(bands - 1)),
                            lambda j: band(F.col("hashes"), w * c + 1, stop, j).isin(minima))

        hits = F.transform(F.filter(F.sequence(F.lit(0), last), shares),
                           lambda w: F.struct(F.lit(c).alias("class"), (w * c).alias("at")))
        return F.when(F.size("hashes") > 0, hits).otherwise(F.array().cast("array<struct<class:int,at:int>>"))

    # explode_outer: a plain explode would have Spark work the array out a second time, to filter by its size.
    found = (rows.select("doc_id", "words", F.explode_outer(F.concat(*[candidates(c) for c in classes])).alias("hit"))
             .where("hit is not null").select("doc_id", F.col("hit.class").alias("class"), F.col("hit.at").alias("at"),
                     F.slice("words", F.col("hit.at") + 1, 2 * F.col("hit.class") + (shingle - 1)).alias("part")))
    # One row per template: a proven bound for the broadcast.
    both = found.join(F.broadcast(table.select("class", "template", "license", "shingles")), "class")
    share = F.size(F.array_intersect(shingle_texts(F.col("part"), shingle), F.col("shingles"))) / F.size("shingles")
    long = (both.select("doc_id", "template", "license", "at", share.alias("share")).where(F.col("share") >= least)
            .groupBy("doc_id", "template", "license")
            .agg(F.max(F.struct("share", (-F.col("at")).alias("at"))).alias("best"))
            .select("doc_id", "template", "license", F.col("best.share").alias("containment"),
                    (-F.col("best.at")).cast("long").alias("first_word")))
    return long if short is None else long.unionByName(short)
