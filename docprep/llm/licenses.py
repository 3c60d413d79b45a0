"""License scans: MinHash bands over overlapping text windows, verified by exact shingle containment.

A window is 16 shingles of five words; document windows start every 8 shingles,
template windows at every place, so each document window inside a copied template meets a
template window with the same shingles. Four permutations give a window eight bands, a minimum and a maximum each. A window
pair at similarity 0.52 (one word changed in the middle) shares a band with probability
1 - (1 - 0.52)^8 = 0.997, an unchanged one always, and a template of 32 shingles or more has at
least three windows. Templates with fewer are retrieved by windows of one shingle, whose
MinHash is the shingle itself: a document with any shingle of them is a candidate for sure.
Retrieval and verification stay on the row of the document: no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprep.llm.common import lower_ascii, odd_numbers, shingles_of, signed

WINDOW, STRIDE, BANDS = 16, 8, 8
SHORT = 32
_MASKS = [0, *(int(x) for x in signed(odd_numbers(BANDS // 2 - 1, 23)))]

# License notices as their stewards publish them (name, license, text).
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("mit-notice", "MIT", "Released under the MIT License."),
    ("mit-notice-2", "MIT", "Licensed under the MIT License."),
    ("apache-2.0-notice", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0-notice", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-notice", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0-notice", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0-notice", "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "mit-grant",
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ),
    (
        "mit-warranty",
        "MIT",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    (
        "apache-2.0-header",
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    (
        "gpl-3.0-header",
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "bsd-grant",
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "isc-grant",
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
)


def license_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def permuted(shingles: str) -> list[Column]:
    """Arrays ``p0`` ... of the hashes under each permutation, an exclusive-or with its mask."""

    def one(mask: int) -> Column:
        return F.transform(shingles, lambda x: x.bitwiseXOR(F.lit(mask)))

    return [one(m).alias(f"p{k}") for k, m in enumerate(_MASKS)]


def starts(shingles: Column, stride: int) -> Column:
    """Where windows of 16 shingles begin: every ``stride``, until one reaches the end."""
    last = F.ceil((F.size(shingles) - WINDOW) / stride).cast("int")
    return F.when(F.size(shingles) > 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda j: j * stride + 1))


def bands() -> list[Column]:
    """Minimum and maximum of the window at ``i`` under each permutation: ``m0`` ... ``m7``."""
    windows = [F.slice(f"p{k}", F.col("i"), F.lit(WINDOW)) for k in range(len(_MASKS))]
    return [f(w).alias(f"m{2 * k + side}") for k, w in enumerate(windows) for side, f in enumerate((F.array_min, F.array_max))]


def _within(value: str, numbers: Sequence[int]) -> str:
    return f"{value} IN ({', '.join(map('{}L'.format, numbers)) or 'NULL'})"


def _numbers(values: Sequence[int]) -> Column:
    """A constant array: folded once when the query is planned."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str, str]] = TEMPLATES, percent: int = 75) -> DataFrame:
    """Rows ``doc_id``, ``template``, ``license``, ``n_template``, ``n_common``, ``containment``.

    One row per document and template of which at least ``percent`` of the distinct shingles are in the
    document. Words are runs of letters and digits, so punctuation and line breaks do not matter. Null or
    empty texts give no rows; null ids keep theirs; rows that repeat id and text give one. Extra columns
    are ignored. The templates are a parameter held in the plan: some hundreds at most.
    """
    spark = docs.sparkSession
    given = spark.createDataFrame([(i, t[2]) for i, t in enumerate(templates)], "i int, text string")
    given = given.select("i", shingles_of(license_words(F.col("text"))).alias("s")).select("i", F.array_distinct("s").alias("set"), "s", *permuted("s"))
    given = given.select(F.col("i").alias("t"), "set", *[f"p{k}" for k in range(len(_MASKS))], F.explode(starts(F.col("s"), 1)).alias("i"))
    made = given.select("t", "set", *bands()).groupBy("t", "set").agg(*[F.collect_set(f"m{b}").alias(f"m{b}") for b in range(BANDS)])
    made = sorted(made.collect())
    short = [r for r in made if len(r["set"]) < SHORT]
    long = [r for r in made if len(r["set"]) >= SHORT]

    shingles = shingles_of(license_words(F.col("text").cast("string")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shingles.alias("s"))
    rows = rows.select("doc_id", "s", *permuted("s"))
    windows = rows.select("*", F.explode(starts(F.col("s"), STRIDE)).alias("i"))
    windows = windows.select("doc_id", "s", F.slice("s", F.col("i"), F.lit(WINDOW)).alias("w"), *bands())
    tests = [F.arrays_overlap("w", _numbers(sorted({k for r in short for k in r["set"]})))] if short else []
    tests += [F.expr(_within(f"m{b}", sorted({k for r in long for k in r[f"m{b}"]}))) for b in range(BANDS)]
    retrieved = windows.filter(reduce(or_, tests))

    found = []
    for r in made:
        name, license_id, _ = templates[r["t"]]
        n = len(r["set"])
        common = F.size(F.array_intersect(_numbers(r["set"]), F.col("s"))).cast("long")
        hit = F.arrays_overlap(F.col("w"), _numbers(r["set"]))
        if r in long:
            hit = reduce(or_, [F.array_contains(_numbers(sorted(r[f"m{b}"])), F.col(f"m{b}")) for b in range(BANDS)])
        row = F.struct(F.lit(name).alias("template"), F.lit(license_id).alias("license"), F.lit(n).cast("long").alias("n_template"), common.alias("n_common"))
        found.append(F.when(hit & (100 * common >= percent * n), row))
    hits = retrieved.select("doc_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("m")).select("doc_id", "m.*").distinct()
    return hits.withColumn("containment", F.col("n_common") / F.col("n_template"))
