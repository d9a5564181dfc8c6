"""License scan: MinHash bands over overlapping text windows, then exact shingle containment; DataFrame functions only.

Words are lower-cased runs of letters and digits, shingles are five of them in
sequence.  The shingles of a text are cut into blocks of ``BLOCK``; two adjacent
blocks are a window, so windows overlap by half and any stretch of ``BLOCK``
shingles lies inside some window whole.  Every window has ``BANDS`` minima of its
shingle hashes, each under an order of its own (the hash XOR a constant), and each
minimum is a band.  Templates have the same minima over parts of ``BLOCK`` shingles.
A part of p shingles that lies in a window has Jaccard similarity of at least
p / (2 BLOCK) with it and shares a band with probability 1 - (1 - s)^BANDS: over
0.9995 for the shortest part, ``DIRECT + 1`` shingles.  Shorter templates are too
small for any sketch of a window, so each of their shingles is a band by itself.
A retrieved template counts if at least ``CONTAINED`` of its distinct shingles occur
in the text, which is checked exactly.  Templates of one family differ in few words, so
of these only the best contained count.

The template list is a parameter of bounded size, so its keys are broadcast; texts
never leave their row, and only verified matches are shuffled.

Defined cases: a null or empty text matches nothing; a text under five words is one
shingle; rows that share a doc_id share their licenses; a null doc_id counts as an
id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pin

SHINGLE = 5
BLOCK = 32
BANDS = 16
DIRECT = 24
CONTAINED = 0.8

# Notices by which licenses are declared, as (license, family, text).
TEMPLATES = (
    ("Apache-2.0", "apache", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", "mit", "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("ISC", "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "gpl-line", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "gpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "cc-line", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "cc", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "cc", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "cc0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("BSD", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MPL-2.0", "mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)


def scan_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(words: Column) -> Column:
    """XXH64 of each shingle, in order; fewer words than a shingle are one."""
    n = F.size(words)
    whole = F.when(n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))
    each = F.transform(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(words, i + k) for k in range(SHINGLE)])))
    return F.when(n < SHINGLE, whole).otherwise(each)


def _orders(bands: int = BANDS) -> list[int]:
    """Constants, spread evenly over the hash range, that order the hashes anew by XOR."""
    return [((2 * b + 1) * ((1 << 63) // bands) + 0x5DEECE66D * (b + 1)) % (1 << 64) - (1 << 63) for b in range(bands)]


def minima(hashes: Column) -> Column:
    """The smallest value under each order, null for no hashes."""

    def ordered(constant: int) -> Column:
        return F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(constant))))

    return F.array(*[ordered(c) for c in _orders()])


def template_keys(docs: DataFrame, templates=TEMPLATES) -> tuple[DataFrame, list[int]]:
    """(band, low, template, license, family, shingles) of every template key, and all template shingles."""
    # Literals instead of a local table, which Python workers would read.
    told = F.array(*[F.struct(F.lit(n).alias("template"), *[F.lit(x).alias(c) for c, x in zip(("license", "family", "text"), t, strict=True)]) for n, t in enumerate(templates)])
    rows = docs.sparkSession.range(1).select(F.explode(told).alias("t")).select("t.*")
    rows = rows.select("template", "license", "family", F.array_distinct(shingle_hashes(scan_words(F.col("text")))).alias("shingles")).where(F.size("shingles") > 0)
    short = rows.where(F.size("shingles") <= DIRECT).select("template", "license", "family", "shingles", F.lit(-1).alias("band"), F.explode("shingles").alias("low"))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size("shingles") - BLOCK, F.lit(0)), F.lit(BLOCK)), lambda s: F.slice("shingles", s + 1, BLOCK))
    long = rows.where(F.size("shingles") > DIRECT).select("template", "license", "family", "shingles", F.explode(parts).alias("part"))
    long = long.select("template", "license", "family", "shingles", F.posexplode(minima(F.col("part"))).alias("band", "low"))
    keys = short.unionByName(long).distinct()
    wanted = sorted({h for r in rows.select("shingles").collect() for h in r["shingles"]})  # bounded by the template list
    return keys, wanted


def license_matches(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, template, license, containment of every verified match."""
    keys, wanted = template_keys(docs, templates)
    rows = pin(docs.select("doc_id", F.col("text").cast("string").alias("text")), words=scan_words(F.col("text")))
    rows = pin(rows.select("doc_id", "words"), hashes=shingle_hashes(F.col("words"))).where(F.size("hashes") > 0)
    # Which template shingles a text has is noted here, so that verification needs no second pass over the text.
    known = F.array(*[F.lit(h) for h in wanted]).cast("array<bigint>")
    starts = F.sequence(F.lit(0), F.size("hashes") - 1, F.lit(BLOCK))
    blocks = F.transform(starts, lambda s: minima(F.slice("hashes", s + 1, BLOCK)))
    rows = pin(rows, present=F.array_intersect("hashes", known), blocks=blocks)
    windows = F.transform("blocks", lambda m, i: F.zip_with(m, F.coalesce(F.get("blocks", i + 1), m), lambda a, b: F.least(a, b)))
    lows = F.flatten(F.transform(windows, lambda w: F.transform(w, lambda low, band: F.struct(band.alias("band"), low.alias("low")))))
    direct = F.transform("present", lambda h: F.struct(F.lit(-1).alias("band"), h.alias("low")))
    probes = rows.select("doc_id", "present", F.explode(F.concat(lows, direct)).alias("p")).select("doc_id", "present", "p.band", "p.low")
    hits = probes.join(F.broadcast(keys), ["band", "low"])
    share = F.size(F.array_intersect("present", "shingles")) / F.size("shingles")
    hits = hits.select("doc_id", "family", F.struct(share.alias("containment"), "template", "license").alias("m")).where(F.col("m.containment") >= CONTAINED)
    grouped = hits.groupBy("doc_id", "family").agg(F.max("m.containment").alias("best"), F.collect_set("m").alias("found"))  # bounded by the template list
    found = grouped.select("doc_id", F.explode(F.filter("found", lambda m: m["containment"] == F.col("best"))).alias("m"))
    return found.select("doc_id", "m.template", "m.license", "m.containment").distinct()


def scan_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, licenses (sorted, joined by commas, empty if none), n_templates, containment (the best, 0 if none) for every document."""
    found = license_matches(docs, templates).groupBy(F.col("doc_id").alias("found_id")).agg(
        F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"),  # bounded by the template list
        F.count(F.lit(1)).alias("n_templates"),
        F.round(F.max("containment"), 6).alias("containment"),
    )
    return docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left").select(
        "doc_id",
        F.coalesce("licenses", F.lit("")).alias("licenses"),
        F.coalesce("n_templates", F.lit(0)).cast("long").alias("n_templates"),
        F.coalesce("containment", F.lit(0.0)).alias("containment"),
    )
