"""License scan in DataFrame operations only (operator 6).

A notice counts as found where a window of the text holds at least ``percent`` of
the distinct two-word shingles of a template. A template of n words is looked for
in windows of W words, W the smallest power of two from 2 * n (8 at least), that
begin every W / 2 words: whatever stands in W / 2 words lies whole in one of them.

1. A text can only hold a template if it holds one of a few of its shingles (at
   most 1 - percent of them can be missing), so texts without any of those
   shingles' longer words are set aside by plain substring search.
2. The rest is cut into windows. MinHash values of a window are bands of one row;
   a band can only meet a template's where the smallest shingle is the
   template's, so windows without a shingle of any template of their size are
   set aside first, without loss.
3. Bands are joined with the templates' bands. A window that holds the template
   has a Jaccard similarity of 0.19 at least with it, so one of 64 bands meets
   with a probability above 0.999998.
4. Shared shingles of each pair that meets are counted exactly.

Scale. No shuffle but the last sum over matches; templates are a list of fixed
size (MOST_TEMPLATES at most), so the broadcast of their bands is bounded. No
step groups documents.

Words are maximal runs of a-z and 0-9 after lower-casing. Edge cases: null and
empty texts give no rows; templates without two words are refused; repeated rows
count as one document with the matches of all; rows with null ids give rows with
a null id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_TEMPLATES = 2000
BANDS = 64

# Wording of common license notices.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-disclaimer": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT-line": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-line": "Released under the BSD License.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
}


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def template_shingles(text: str) -> list[tuple[str, str]]:
    w = template_words(text)
    return sorted(set(zip(w, w[1:], strict=False)))


def window_of(text: str) -> int:
    """Words of the windows in which a template is looked for."""
    w = 8
    while w < 2 * len(template_words(text)):
        w *= 2
    return w


def required(text: str, percent: int) -> int:
    """Shingles of a template that a window must hold."""
    return -(-percent * len(template_shingles(text)) // 100)


def anchors(templates: dict[str, str], percent: int) -> list[str]:
    """Words of which every text that holds a template has one at least."""
    out: set[str] = set()
    for text in templates.values():
        shingles = template_shingles(text)
        longest = sorted((-max(map(len, s)), max(s, key=len)) for s in shingles)
        out |= {word for _, word in longest[: len(shingles) - required(text, percent) + 1]}
    return sorted(x for x in out if not any(y != x and y in x for y in out))


def shingle_hash(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def band_values(shingles: Column) -> Column:
    """One struct (band, value) for each of BANDS hash orders of the shingles."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.struct(k.alias("band"), F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, k))).alias("value")))


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = 80) -> DataFrame:
    """(doc_id, license_id, shared, total, first_word) for every template found in docs(doc_id, text).

    shared: most shingles in one window, of ``total``; first_word: the first word of the first window that has enough.
    """
    templates = TEMPLATES if templates is None else templates
    if len(templates) > MOST_TEMPLATES or any(not template_shingles(x) for x in templates.values()):
        raise ValueError(f"templates must be {MOST_TEMPLATES} at most, of two words at least")
    spark = docs.sparkSession
    listed = [(k, window_of(x), required(x, percent), [list(s) for s in template_shingles(x)]) for k, x in templates.items()]
    literal = [F.struct(F.lit(k).alias("license_id"), F.lit(w).alias("width"), F.lit(n).alias("need"), F.array(*(shingle_hash(F.lit(a), F.lit(b)) for a, b in p)).alias("wanted")) for k, w, n, p in listed]
    sets = spark.range(1).select(F.inline(F.array(*literal)))
    hashes = {r["license_id"]: r["wanted"] for r in sets.collect()}  # MOST_TEMPLATES rows at most
    bands = sets.select("license_id", "width", "need", "wanted", F.inline(band_values(F.col("wanted"))))

    lower = F.lower(F.col("text"))
    # as an element of an array the lower-cased text is made once, not once for each word
    possible = F.exists(F.array(lower), lambda x: reduce(or_, (F.contains(x, F.lit(a)) for a in anchors(templates, percent)), F.lit(False)))
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(possible)
    words = F.filter(F.split(F.regexp_replace(lower, "[^a-z0-9]+", " "), " "), lambda w: w != "")
    held = held.select("doc_id", words.alias("words")).where(F.size("words") > 1)
    pairs = F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: shingle_hash(F.col("words")[i], F.col("words")[i + 1]))
    held = held.select("doc_id", pairs.alias("shingles"))

    def windows(width: int) -> Column:
        """The windows of a width that hold a shingle of its templates."""
        wanted = sorted({h for k, w, _, _ in listed if w == width for h in hashes[k]})
        step = width // 2
        starts = F.sequence(F.lit(0), F.floor((F.size("shingles") - 1) / step).cast("int"))
        cut = F.transform(starts, lambda k: F.struct(F.lit(width).alias("width"), (k * step).alias("start"), F.slice("shingles", k * step + 1, width - 1).alias("part")))
        return F.filter(cut, lambda w: F.exists(w["part"], lambda h: h.isin(wanted)))

    found = held.select("doc_id", F.inline(F.concat(*(windows(w) for w in sorted({w for _, w, _, _ in listed})))))
    found = found.select("doc_id", "width", "start", F.array_distinct("part").alias("part"))
    signed = found.select("doc_id", "width", "start", "part", F.inline(band_values(F.col("part"))))
    met = signed.join(F.broadcast(bands), ["width", "band", "value"])  # BANDS rows a template
    met = met.withColumn("shared", F.size(F.array_intersect("part", "wanted"))).where("shared >= need")
    out = met.groupBy("doc_id", "license_id").agg(F.max("shared").cast("long").alias("shared"), F.first(F.size("wanted")).cast("long").alias("total"), F.min("start").cast("long").alias("first_word"))
    return out


def sql(templates: dict[str, str] | None = None, percent: int = 80) -> str:
    """The same by brute force over all windows, in DuckDB's SQL."""
    templates = TEMPLATES if templates is None else templates
    rows = ", ".join(f"('{k}', {window_of(x)}, {required(x, percent)}, {len(template_shingles(x))}, '{' '.join(s)}')" for k, x in templates.items() for s in template_shingles(x))
    return f"""
WITH t(license_id, width, need, total, pair) AS (VALUES {rows}),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(0, len(ws) - 1)) AS i FROM w WHERE len(ws) > 1),
h AS (SELECT doc_id, i, ws[i + 1] || ' ' || ws[i + 2] AS pair FROM p),
hit AS (SELECT h.doc_id, h.i, t.* FROM h JOIN t USING (pair)),
win AS (SELECT hit.*, i // (width // 2) - b AS k FROM hit, (VALUES (0), (1)) v(b)),
n AS (SELECT doc_id, license_id, width, k, any_value(need) AS need, any_value(total) AS total, count(DISTINCT pair) AS shared FROM win WHERE k >= 0 AND i < k * (width // 2) + width - 1 GROUP BY ALL)
SELECT doc_id, license_id, CAST(max(shared) AS BIGINT) AS shared, CAST(any_value(total) AS BIGINT) AS total, CAST(min(k * (width // 2)) AS BIGINT) AS first_word
FROM n WHERE shared >= need GROUP BY doc_id, license_id"""
