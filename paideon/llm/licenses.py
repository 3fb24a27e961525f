"""License notices in documents, with DataFrame functions only.

Texts become shingles of five normalised words. A template of s shingles is looked for in
windows of twice its size class (the power of two from s on) that begin at every multiple of
the class, so a notice lies whole in one of the overlapping windows. Window and template
signatures are minima of 32 hash functions and every function is a band: a notice that keeps
four fifths of a template's shingles has a Jaccard similarity of at least 0.19 with its window
and shares no band with a probability below 0.0012, an unchanged one below 0.0001. Retrieved
templates are verified by exact containment of shingles.

Only windows that hold a shingle of some template are signed; any other shares nothing with
one, so this leaves nothing out.

Defined cases: a null text has no words; texts and templates under five words have no
shingles and match nothing; repeated rows are judged one by one; an empty table gives an empty
result; texts of any length are scanned whole; of windows with equal containment any stands for the template; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paideon.llm.common import whole_text
from paideon.llm.decontaminate import key_at, screen_hash, words
from paideon.session import stage

SHINGLE_WORDS = 5
BANDS = 32
CONTAINMENT = 0.8
SCREEN_SLOTS = 1 << 20
# Public notices by name.
TEMPLATES = (
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met"),
    ("cc-by-4.0-line", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
     "version."),
    ("isc-permission", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit-line", "Released under the MIT License."),
    ("mit-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def _shingle_starts(array: str) -> Column:
    enough = F.size(array) >= SHINGLE_WORDS
    return F.when(enough, F.sequence(F.lit(0), F.size(array) - SHINGLE_WORDS)).otherwise(F.array().cast("array<int>"))


def _signature(at) -> Column:
    """Minima of all hash functions over the hashes that `at(index)` gives for an index array."""
    hashes = at
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda j: F.struct(
        j.alias("band"), F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, j))).alias("low")))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """name, size class, shingles as texts and their hashes; one row per template that has shingles."""
    rows = spark.createDataFrame([(n, t) for n, t in templates], "name string, text string")
    split = rows.select("name", words(F.col("text")).alias("w"))
    listed = split.select(
        "name", F.array_distinct(F.transform(_shingle_starts("w"), lambda i: key_at("w", i, SHINGLE_WORDS))).alias("shingles"),
        F.array_distinct(F.transform(_shingle_starts("w"), lambda i: screen_hash("w", i, SHINGLE_WORDS))).alias("hashes"))
    size = F.size("shingles")
    return listed.filter(size > 0).withColumn("class", F.pow(F.lit(2), F.ceil(F.log2(size.cast("double")))).cast("int"))


def scan(docs: DataFrame, hashes: list[int], classes: list[int]) -> DataFrame:
    """row_no, doc_id, n_words and the signed windows (class, at, shingles, signature) of every row."""
    table = bytearray(SCREEN_SLOTS)
    for h in hashes:
        table[h % SCREEN_SLOTS] = 1
    slots, known = F.lit(bytes(table)), F.array(*[F.lit(h) for h in sorted(hashes)])

    listed = docs.select("doc_id", words(whole_text()).alias("w"))
    hashed = listed.select("doc_id", "w", F.transform(_shingle_starts("w"), lambda i: screen_hash("w", i, SHINGLE_WORDS)).alias("h"))
    places = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: (
        (F.substr(slots, F.pmod(F.get("h", i), F.lit(SCREEN_SLOTS)).cast("int") + 1, F.lit(1)) == F.lit(b"\x01"))
        & F.array_contains(known, F.get("h", i))))
    found = hashed.select("doc_id", "w", "h", F.when(F.size("h") > 0, places).otherwise(F.array().cast("array<int>")).alias("places"))

    def windows(size: int) -> Column:
        step = F.lit(size)
        numbers = F.array_distinct(F.flatten(F.transform("places", lambda p: F.array(
            F.floor(p / step).cast("int"), F.greatest(F.floor(p / step).cast("int") - 1, F.lit(0))))))
        return F.transform(numbers, lambda n: F.struct(
            F.lit(size).alias("class"), (n * size).alias("at"),
            F.array_distinct(F.transform(F.filter("places", lambda p: (p >= n * size) & (p < (n + 2) * size)),
                                         lambda p: key_at("w", p, SHINGLE_WORDS))).alias("shingles"),
            _signature(F.transform(F.sequence(n * size, F.least((n + 2) * size, F.size("h")) - 1),
                                   lambda q: F.get("h", q))).alias("signature")))

    return found.select(
        F.monotonically_increasing_id().alias("row_no"), "doc_id", F.size("w").cast("long").alias("n_words"),
        F.when(F.size("places") > 0, F.concat(*[windows(c) for c in classes])).alias("windows"))


def matches(docs: DataFrame, templates=TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """Scanned rows, and row_no, name, at, containment of every verified window."""
    spark = docs.sparkSession
    table = template_table(spark, templates)
    listed = table.collect()  # templates are a parameter of the caller
    hashes = sorted({h for r in listed for h in r["hashes"]})
    classes = sorted({r["class"] for r in listed})
    scanned = stage(scan(docs, hashes, classes or [1]), "scanned")
    bands = table.select("name", "class", "shingles", F.inline(_signature(F.col("hashes"))))
    signed = scanned.filter("windows is not null").select("row_no", F.inline("windows"))
    probes = signed.select("row_no", "class", "at", F.inline("signature"))
    retrieved = probes.join(F.broadcast(bands.select("name", "class", "band", "low")), ["class", "band", "low"]).select(
        "row_no", "class", "at", "name").distinct()
    both = (retrieved.join(signed.select("row_no", "class", "at", F.col("shingles").alias("found")), ["row_no", "class", "at"])
            .join(F.broadcast(table.select("name", "shingles")), "name"))
    shared = F.size(F.array_intersect("shingles", "found")) / F.size("shingles")
    return scanned, both.select("row_no", "name", "at", shared.alias("containment")).filter(F.col("containment") >= CONTAINMENT)


def report(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row per document: n_words, n_licenses, licenses (names, sorted, comma-joined), containment (the best)."""
    scanned, found = matches(docs, templates)
    each = found.groupBy("row_no", "name").agg(F.max("containment").alias("containment"))
    of_row = each.groupBy("row_no").agg(
        F.count(F.lit(1)).alias("n_licenses"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("licenses"),
        F.max("containment").alias("containment"))
    return scanned.select("row_no", "doc_id", "n_words").join(of_row, "row_no", "left").select(
        "doc_id", "n_words", F.coalesce("n_licenses", F.lit(0)).alias("n_licenses"),
        F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("containment", F.lit(0.0)).alias("containment"))
