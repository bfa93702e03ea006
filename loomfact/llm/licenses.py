"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

Texts and templates are words (runs of ASCII letters and digits, in lower case), read as
shingles of five.  A window of one shingle starts at every shingle, one of ``WIDE``
shingles at every fourth and at
the last one; templates are cut to tiles of the widest of both that fits.
A window's MinHash signature has one value for each band: of its shingles' 64-bit hashes,
the one nearest to the band's constant (by exclusive or; the constants differ in their
first three bits, so each band orders the hashes its own way).  One equal value retrieves
a template.

A template that stands whole in a text has a window at most two shingles off one of its
wide tiles, thus with a similarity of 0.6 at least, and six bands of one value retrieve
that window with probability 1 - 0.4**6 = 0.996, each further tile and window on top;
single shingles are retrieved for sure.  Retrieved places are verified on the words
themselves: places of one template less than its length apart are one, so that words
which have come in between don't matter, and it is reported if ``CONTAINED`` of the
template's distinct shingles stand within it.  Templates of fewer than ``WIDE`` shingles
have windows of one shingle only, whose MinHash is the shingle's hash in every band.

All of it is DataFrame functions, in the row of a text until something is retrieved.

Defined results: null text counts as empty; texts of fewer than five words match nothing;
each place of a template in a text is a row of its own; rows that share an id, and equal
rows, each report; templates of fewer than five words are never found; one text's words
are held in memory as a whole, however long; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread, whole

SHINGLE, WIDE, STRIDE, CONTAINED = 5, 8, 4, 0.8
#: Characters of all templates at most: they are broadcast.
MOST = 4_000_000
FOUND = "id bigint, template string, containment double, start_word int, n_words int"
#: One for each band; they differ in their first three bits.
BANDS = [(k << 61 | 0x0B4C_52D1_E5A6_9F37) - (1 << 64 if k > 3 else 0) for k in (0, 2, 3, 4, 5, 7)]
#: Public notices of licenses.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "mit-licensed-line": "Licensed under the MIT License.",
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _shingle_hashes(words: Column) -> Column:
    """The hash of each shingle, by place."""
    places = F.sequence(F.lit(0), F.size(words) - SHINGLE)
    made = F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))
    return F.when(F.size(words) >= SHINGLE, made).otherwise(F.array().cast("array<bigint>"))


def _band(hashes: Column, place: Column, width: int, constant: int) -> Column:
    """The hash nearest to the constant, in a window."""
    return F.array_min(F.transform(F.slice(hashes, place + 1, width), lambda h: h.bitwiseXOR(F.lit(constant)))).bitwiseXOR(F.lit(constant))


def _tiles(templates: DataFrame) -> DataFrame:
    """A row for each tile of a template and band: template, width, band, value, tile's place, shingles (as texts)."""
    words = templates.select("template", _words(F.col("text")).alias("w"))
    hashed = words.select("template", "w", _shingle_hashes(F.col("w")).alias("h")).where(F.size("h") > 0)
    shingles = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.array_join(F.slice("w", i + 1, SHINGLE), " ")))
    width = F.when(F.size("h") >= WIDE, WIDE).otherwise(1)
    last = F.size("h") - F.col("width")
    cut = hashed.select("template", "h", shingles.alias("shingles"), F.size("h").alias("n"), width.alias("width"))
    cut = cut.select("*", F.explode(F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.col("width")), F.array(last)))).alias("tile"))
    values = [F.struct(F.lit(b).alias("band"), F.when(F.col("width") == 1, F.get("h", F.col("tile"))).otherwise(_band(F.col("h"), F.col("tile"), WIDE, c)).alias("value")) for b, c in enumerate(BANDS)]
    return cut.select("template", "shingles", "n", "width", "tile", F.inline(F.array(*values)))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", contained: float = CONTAINED) -> DataFrame:
    """One row per text and place of a template in it: id, template, containment, start_word, n_words (of the place)."""
    spark = docs.sparkSession
    given = list((templates if templates is not None else TEMPLATES).items())
    if sum(len(text) for _, text in given) > MOST:
        raise ValueError(f"templates of more than {MOST} characters in all don't fit a broadcast")
    tiles = _tiles(spark.createDataFrame(given, "template string, text string"))
    # the values of a list of templates of bounded size
    known = tiles.select("width", "value", "n").distinct().collect()
    one, wide = (sorted({r["value"] for r in known if (r["width"] == 1) is narrow}) for narrow in (True, False))
    longest = max((r["n"] for r in known), default=1)
    rows = spread(docs).select(F.col(id_col).cast("bigint").alias("id"), F.monotonically_increasing_id().alias("row"), _words(whole(F.col(text_col))).alias("words"))
    rows = rows.select("id", "row", "words", _shingle_hashes(F.col("words")).alias("hashes"))
    none = F.array().cast("array<int>")
    # InSet looks a value up in a hash table; a short list would be compared one by one
    places = F.filter(F.sequence(F.lit(0), F.size("hashes") - 1), lambda i: F.get("hashes", i).isin(one)) if one else none
    end = F.greatest(F.size("hashes") - WIDE, F.lit(0))
    broad = F.filter(F.concat(F.sequence(F.lit(0), end, F.lit(STRIDE)), F.when(end % STRIDE > 0, F.array(end)).otherwise(none)), lambda i: F.exists(F.array(*[_band(F.col("hashes"), i, WIDE, c) for c in BANDS]), lambda v: v.isin(wide))) if wide else none

    def hit(width):
        """A hit takes along the words around it, as many as the longest template may need, and the values that retrieve something."""

        def made(i):
            begin = F.greatest(i - longest - STRIDE, F.lit(0))
            values = [F.struct(F.lit(b).alias("band"), (F.get("hashes", i) if width == 1 else _band(F.col("hashes"), i, WIDE, c)).alias("value")) for b, c in enumerate(BANDS)]
            part = F.slice("words", begin + 1, 2 * longest + longest // 5 + 4 * STRIDE + 2 * SHINGLE)
            return F.struct(i.alias("at"), F.lit(width).alias("width"), begin.alias("from"), part.alias("part"), F.filter(F.array(*values), lambda v: v["value"].isin(one if width == 1 else wide)).alias("asked"))

        return made

    hits = [F.transform(found, hit(width)) for found, width, some in ((places, 1, one), (broad, WIDE, wide)) if some]
    if not hits:
        return spark.createDataFrame([], FOUND)
    found = rows.where(F.size("hashes") > 0).select("id", "row", F.explode(F.concat(*hits)).alias("hit")).select("id", "row", "hit.*")
    asked = found.select("id", "row", "at", "width", "from", "part", F.inline("asked"))
    pairs = asked.join(F.broadcast(tiles), ["width", "band", "value"])
    # the place: where the template would start, with room for a fifth more words and for a window off its tile
    begin = F.greatest(F.col("at") - F.col("tile") - STRIDE, F.lit(0))
    size = F.col("n") + SHINGLE - 1 + 2 * STRIDE + F.ceil(F.col("n") / 5).cast("int")
    place = pairs.select("id", "row", "template", "shingles", "n", begin.alias("begin"), F.slice("part", begin - F.col("from") + 1, size).alias("part")).dropDuplicates(["row", "template", "begin"])
    inside = F.transform(F.sequence(F.lit(0), F.size("part") - SHINGLE), lambda i: F.array_join(F.slice("part", i + 1, SHINGLE), " "))
    have = F.when(F.size("part") >= SHINGLE, F.array_intersect("shingles", inside))
    checked = place.select("id", "row", "template", "n", "begin", (F.col("begin") + F.size("part")).alias("end"), F.size("shingles").alias("all"), have.alias("have")).where(F.size("have") > 0)
    # places less than a template apart are one: words may have come in between
    before = Window.partitionBy("row", "template").orderBy("begin")
    parted = checked.withColumn("new", F.coalesce(F.col("begin") > F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)) + F.col("n"), F.lit(True)))
    spans = parted.withColumn("span", F.sum(F.col("new").cast("int")).over(before))
    key = ["id", "row", "template", "span"]
    each = spans.groupBy(*key).agg(F.min("begin").alias("start_word"), (F.max("end") - F.min("begin")).alias("n_words"), F.max("all").alias("all"))
    counted = spans.select(*key, F.explode("have").alias("shingle")).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("have"))
    share = F.col("have") / F.col("all")
    joined = each.join(counted.withColumnRenamed("id", "same"), key[1:])
    return joined.where(share >= contained).select("id", "template", share.alias("containment"), "start_word", "n_words")
