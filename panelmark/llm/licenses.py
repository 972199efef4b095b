"""License scans: MinHash bands over overlapping windows of words retrieve templates, exact containment verifies.

Texts are cut into lower-case words of letters and digits, and into shingles of SHINGLE words. Windows of a template's size
class overlap so that one of them holds any whole occurrence. MinHash values of a window, one a band, are joined to
the templates' bands; the number of bands is so large that a window that contains LEAST of a template shares a
band with it with a chance of 1 - MISS at least. A match is a window that holds at least LEAST of the template's distinct
shingles, compared as text. Documents that share no shingle with any template cannot match and are left out first,
which loses nothing.

Built-in functions only. Null and empty texts match nothing; a text or template of fewer than SHINGLE words is one shingle.
Each row and license gives at most one row, its best window (the first of equal ones). Licenses' texts resemble each other:
of matches of two licenses in overlapping windows that rest on the same shingles only the one with more of them is given.
Repeated rows give rows of their own. Empty tables of documents or templates give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.llm.common import saved, text_of
from panelmark.llm.minhash import let

SHINGLE, LEAST, MISS = 5, 0.8, 1e-4

_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'
_MIT_REST = """, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_REST = """ THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = """ 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_REST = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _gnu(name: str, version: str, what: str = "program", mark: str = ":") -> str:
    return f"This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{',' if mark == ':' else mark} {version}"


# Notices and whole short texts of public licenses, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", _BSD),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", _ISC),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", _BSD + _BSD_TWO + _BSD_REST),
    ("BSD-3-Clause", _BSD + _BSD_TWO + _BSD_THIRD + _BSD_REST),
    ("ISC", _ISC + _ISC_REST),
    ("MIT", _MIT + _MIT_REST),
    ("AGPL-3.0-or-later", _gnu("Affero General Public License", "either version 3 of the License, or (at your option) any later version.")),
    ("GPL-2.0-only", _gnu("General Public License", "version 2 of the License.", mark=";")),
    ("GPL-2.0-or-later", _gnu("General Public License", "either version 2 of the License, or (at your option) any later version.", mark=";")),
    ("LGPL-2.1-or-later", _gnu("Lesser General Public License", "either version 2.1 of the License, or (at your option) any later version.", "library", ";")),
    ("LGPL-3.0-or-later", _gnu("Lesser General Public License", "either version 3 of the License, or (at your option) any later version.")),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _shingles(words: Column, one) -> Column:
    """one(words, i) for each shingle's first word i; a single one for few words, none without words."""
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE, F.lit(0)))
    return F.when(F.size(words) > 0, F.transform(at, lambda i: one(words, i)))


def shingle_hashes(words: Column) -> Column:
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashed, lambda h: _shingles(h, lambda a, i: F.xxhash64(*[F.get(a, i + j) for j in range(SHINGLE)])))


def shingle_texts(words: Column) -> Column:
    return _shingles(words, lambda a, i: F.array_join(F.slice(a, i + 1, SHINGLE), " "))


def bands_for(similarity: float, miss: float = MISS) -> int:
    """Bands of one MinHash value so that sets of that Jaccard similarity share none with a chance of miss at most."""
    return 1 if similarity >= 1 else ceil(log(miss) / log(1 - similarity))


def window_of(size: int) -> tuple[int, int, int]:
    """The class of templates of `size` shingles: shingles in a window, the step between windows, bands.

    The class is the power of two from size up; a window holds any run of class shingles, as width >= class + step - 1.
    """
    top = 1 << (size - 1).bit_length()
    step = max(1, top // 4)
    width = top + step - 1
    least = top // 2 + 1 if top > 1 else 1
    held = ceil(LEAST * least - 1e-9)
    return width, step, bands_for(held / (width + least - held))


def templates(spark: SparkSession, pairs: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    rows = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(pairs)], "template int, license string, body string")
    rows = rows.withColumn("w", words_of(F.col("body")))
    return rows.select("template", "license", F.array_distinct(shingle_hashes(F.col("w"))).alias("hashes"), F.array_distinct(shingle_texts(F.col("w"))).alias("texts")).where("hashes IS NOT NULL")


def scanned(docs: DataFrame, pairs: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Matches of docs' texts: doc_id, license, containment, first_word and last_word of the window. pairs: few (license, text)."""
    spark = docs.sparkSession
    known = templates(spark, pairs).collect()  # a row a template
    out = "doc_id long, license string, containment double, first_word int, last_word int"
    if not known:
        return spark.createDataFrame([], out)
    every = F.array(*[F.lit(h) for h in sorted({h for t in known for h in t.hashes})])
    own = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).withColumn("row", F.monotonically_increasing_id())
    own = own.where(F.arrays_overlap(shingle_hashes(words_of(F.col("text"))), every))
    own = own.withColumn("words", words_of(F.col("text"))).withColumn("hashes", shingle_hashes(F.col("words"))).drop("text")
    own = saved(own)  # texts are read once for all classes, and a row's number is the same wherever it is used
    classes: dict[tuple[int, int, int], list] = {}
    for t in known:
        classes.setdefault(window_of(len(t.hashes)), []).append(t)

    def values(width: int, step: int):
        """A band's value of each window; one band's hashes are held at a time."""
        starts = F.sequence(F.lit(0), F.greatest(F.size("hashes") - 1, F.lit(0)), F.lit(step))
        return lambda k: let(F.transform("hashes", lambda h: F.xxhash64(h, k)), lambda m: F.transform(starts, lambda at: F.array_min(F.slice(m, at + 1, width))))

    sides = []
    for width, step, n in sorted(classes):
        banded = own.select("row", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(n)), values(width, step))).alias("k", "values"))
        placed = banded.select("row", (F.col("k") + 1).alias("band"), F.posexplode("values").alias("place", "value"))
        sides.append(placed.select("row", F.lit(width).alias("width"), (F.col("place") * step).alias("start"), "band", "value"))
    windows = reduce(DataFrame.union, sides)
    rows = [(t.template, width, k, h) for (width, _, n), own_ in classes.items() for t in own_ for k in range(1, n + 1) for h in t.hashes]
    index = spark.createDataFrame(rows, "template int, width int, band int, hash long")
    index = index.groupBy("template", "width", "band").agg(F.min(F.xxhash64("hash", "band")).alias("value"))
    found = windows.join(F.broadcast(index), ["width", "band", "value"]).select("row", "template", "start", "width").distinct()  # index: a row a template and band
    texts = spark.createDataFrame([(t.template, t.license, t.texts) for t in known], "template int, license string, texts array<string>")
    both = found.join(own.select("row", "doc_id", "words"), "row").join(F.broadcast(texts), "template")
    held = F.array_intersect("texts", shingle_texts(F.slice("words", F.col("start") + 1, F.col("width") + (SHINGLE - 1))))
    both = both.withColumn("containment", F.size(held) / F.size("texts")).where(F.col("containment") >= LEAST)
    last = F.least(F.col("start") + F.col("width") + (SHINGLE - 2), F.size("words") - 1).alias("last")
    best = F.max(F.struct("containment", (-F.col("start")).alias("minus"), last, held.alias("held"), "texts"))
    matches = both.groupBy("row", "doc_id", "template", "license").agg(best.alias("b")).groupBy("row", "doc_id")
    matches = matches.agg(F.collect_list(F.struct("license", "b.*")).alias("all"))  # at most a match a template

    def weaker(x: Column, y: Column) -> Column:
        """Whether y, of another license, has most of x's shingles in the same place and more than x, and x little that y's template lacks."""
        apart = (-y.minus > x.last) | (-x.minus > y.last)
        more = (F.size(y.held) > F.size(x.held)) | ((F.size(y.held) == F.size(x.held)) & (y.containment > x.containment))
        lacked = F.array_except(x.texts, y.texts)
        little = (F.size(lacked) == 0) | (2 * F.size(F.array_intersect(lacked, x.held)) < F.size(lacked))
        return (x.license != y.license) & ~apart & more & little & (F.size(F.array_intersect(x.held, y.held)) >= LEAST * F.size(x.held))

    kept = matches.select("row", "doc_id", F.explode(F.filter("all", lambda x: ~F.exists("all", lambda y: weaker(x, y)))).alias("m"))
    found = kept.groupBy("row", "doc_id", F.col("m.license").alias("license")).agg(F.max(F.struct("m.containment", "m.minus", "m.last")).alias("b"))
    return found.select("doc_id", "license", F.col("b.containment").alias("containment"), (-F.col("b.minus")).alias("first_word"), F.col("b.last").alias("last_word"))
