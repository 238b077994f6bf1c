"""License scans by Dice coefficient over word bigrams, in DataFrame functions only.

Texts and templates are normalised alike: A-Z as a-z, every other character but a-z and 0-9 as a space. A text's segments
are its lines, its paragraphs, itself, and windows: wherever a seed word of a template stands next to its neighbour in the
template, as many words of the text as the template has are cut out with that word in the template's place, whatever line
breaks, comment marks or prose are around. A segment's bigram set is compared with a template's by
``2 * shared / (size + size)``. As the coefficient can't exceed ``2 * min / (min + max)`` of the sizes, only templates
whose size lies in [d / (2 - d), (2 - d) / d] times the segment's are candidates. A template's seeds are its longest words,
so many that less than the share d / (2 - d) of its bigrams goes without: no segment reaches d without one of them.

Edge cases: null and empty texts give no rows; a segment of one word has no bigram and matches nothing; equal segments of
a text are one, and so are equal windows; repeated rows give repeated matches; of equal scores the first template in order
of its id counts; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Words too common to be seeds unless a template has no others; a fixed list.
COMMON = ("a", "and", "by", "in", "is", "may", "of", "or", "that", "the", "this", "to", "under", "with", "work", "you")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Notices and short licences as they stand in files, a fixed list; long licences can be given as further templates.
TEMPLATES: Mapping[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except "
    "in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except "
    "in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    "AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
    "language governing permissions and limitations under the License.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
    "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
    "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
    "License for more details. You should have received a copy of the GNU General Public License along with this program. "
    "If not, see https://www.gnu.org/licenses/.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the Software), to deal in the Software without restriction",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the Software), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the Software), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
    "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
    "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def words_of(text: str) -> list[str]:
    """A template's words."""
    ascii_lower = text.translate(str.maketrans(UPPER, LOWER))
    return "".join(c if c in LOWER + "0123456789" else " " for c in ascii_lower).split()


def bigrams_of(text: str) -> list[str]:
    """The sorted bigram set of a template."""
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def seeds_of(text: str, threshold: float) -> list[tuple[str, int, str, str, int]]:
    """(word, place, word before, word behind, words of the template) of a template's seeds; places from 0."""
    w = words_of(text)
    pairs = set(zip(w, w[1:], strict=False))
    chosen: set[str] = set()
    for word in sorted(set(w), key=lambda x: (x in COMMON, -len(x), x)):
        if sum(not chosen & set(p) for p in pairs) < threshold / (2 - threshold) * len(pairs) - 1e-9:
            break
        chosen.add(word)
    return [(x, i, w[i - 1] if i else "", w[i + 1] if i + 1 < len(w) else "", len(w)) for i, x in enumerate(w) if x in chosen]


def _words(text: Column) -> Column:
    cleaned = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " "))
    return F.split(cleaned, " ")


def _bigrams(words: Column) -> Column:
    pairs = F.transform(
        F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat(F.get(words, i - 1), F.lit(" "), F.get(words, i))
    )
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def _windows(words: Column, seeds: list[tuple[str, int, str, str, int]]) -> Column:
    """The texts of the windows around the seeds among words."""
    names = ("word", "place", "before", "behind", "length")
    table = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(names, seed, strict=True))) for seed in seeds))
    known = F.array(*map(F.lit, sorted({seed[0] for seed in seeds})))
    at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(known, F.get(words, i)))

    def around(i: Column) -> Column:
        fits = F.filter(
            table,
            lambda s: (s["word"] == F.get(words, i)) & ((s["before"] == F.get(words, i - 1)) | (s["behind"] == F.get(words, i + 1))),
        )
        return F.transform(fits, lambda s: F.struct(F.greatest(i - s["place"], F.lit(0)).alias("at"), s["length"].alias("n")))

    begins = F.array_distinct(F.flatten(F.transform(at, around)))
    return F.array_distinct(F.transform(begins, lambda x: F.array_join(F.slice(words, x["at"] + 1, x["n"]), " ")))


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license_id, dice, segments, windows: for every row of docs, each template that is the best of a segment, with
    its highest coefficient and the numbers of such segments (lines, paragraphs, the text) and windows."""
    sized = {k: bigrams_of(v) for k, v in sorted(templates.items())}
    sized = {k: v for k, v in sized.items() if v}
    seeds = sorted({s for k in sized for s in seeds_of(templates[k], threshold)})
    known = F.array(*map(F.lit, sorted({s[0] for s in seeds})))
    # A little wider than the bounds, for sizes that lie on them.
    low, high = threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9
    least, most = low * min(map(len, sized.values())), high * max(map(len, sized.values()))
    text = F.col("text")
    parts = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, "\n\n"), F.array(text)))
    # Each step hands its array on through explode(array(...)): a filter over it then isn't pushed into the projection
    # below, which would work the array out again at every use. Texts without a seed end at the first filter.
    segments = (
        docs.filter("text is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
        .select("doc_id", "row", "text", F.explode(F.array(_words(text))).alias("all"))
        .filter((F.size("all") > 1) & F.arrays_overlap("all", known))
        .select(
            "doc_id",
            "row",
            F.explode(
                F.concat(
                    F.transform(parts, lambda x: F.struct(F.lit(False).alias("cut"), x.alias("text"))),
                    F.transform(_windows(F.col("all"), seeds), lambda x: F.struct(F.lit(True).alias("cut"), x.alias("text"))),
                )
            ).alias("segment"),
        )
        .select("doc_id", "row", "segment.cut", F.explode(F.array(_words(F.col("segment.text")))).alias("words"))
        .filter((F.size("words") > F.lit(least)) & F.arrays_overlap("words", known))
        .select("doc_id", "row", "cut", F.explode(F.array(_bigrams(F.col("words")))).alias("set"))
        .withColumn("size", F.size("set"))
        .filter((F.col("size") >= F.lit(least)) & (F.col("size") <= F.lit(most)))
    )

    def dice(name: str, grams: list[str]) -> Column:
        n = len(grams)
        fits = (F.lit(n) >= low * F.col("size")) & (F.lit(n) <= high * F.col("size"))
        shared = F.size(F.array_intersect("set", F.array(*map(F.lit, grams))))
        return F.when(fits, F.struct((2.0 * shared / (F.col("size") + n)).alias("dice"), F.lit(name).alias("license_id")))

    best = F.array_max(
        F.transform(
            F.array(*(dice(k, v) for k, v in sized.items())),
            lambda x, i: F.when(x.isNotNull(), F.struct(x["dice"].alias("dice"), (-i).alias("rank"), x["license_id"].alias("license_id"))),
        )
    )
    found = segments.select("doc_id", "row", "cut", F.explode(F.array(best)).alias("best")).filter(F.col("best.dice") >= threshold)
    # A row's matches stay together: distinct segments of one row, counted by template.
    return (
        found.groupBy("doc_id", "row", F.col("best.license_id").alias("license_id"))
        .agg(F.max("best.dice").alias("dice"), F.count_if(~F.col("cut")).alias("segments"), F.count_if("cut").alias("windows"))
        .drop("row")
    )


def scan_sql(templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same over a table documents in DuckDB SQL, for tables without repeated ids."""
    sized = {k: v for k, v in sorted(templates.items()) if bigrams_of(v)}
    rows = ", ".join(f"({i}, '{k}', [{', '.join(repr(g) for g in bigrams_of(v))}])" for i, (k, v) in enumerate(sized.items()))
    seeds = ", ".join(
        f"('{w}', {at}, '{a}', '{b}', {n})" for w, at, a, b, n in sorted({s for v in sized.values() for s in seeds_of(v, threshold)})
    )

    def words(text: str) -> str:
        return f"string_split(trim(regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ')"

    return f"""
WITH template(rank, license_id, grams) AS (VALUES {rows}),
seed(word, place, before, behind, length) AS (VALUES {seeds}),
whole AS (SELECT doc_id, {words("text")} AS w FROM documents WHERE text IS NOT NULL),
spot AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM whole),
begin AS (SELECT DISTINCT doc_id, w, greatest(i - place, 1) AS first, length
          FROM spot, seed WHERE w[i] = word AND (w[i + 1] = behind OR i > 1 AND w[i - 1] = before)),
segment AS (SELECT DISTINCT doc_id, false AS cut,
                   unnest(list_concat(string_split(text, chr(10)), string_split(text, chr(10) || chr(10)), [text])) AS s
            FROM documents WHERE text IS NOT NULL
            UNION ALL SELECT DISTINCT doc_id, true, array_to_string(w[first : first + length - 1], ' ') FROM begin),
word AS (SELECT doc_id, cut, s, {words("s")} AS w FROM segment),
gram AS (SELECT doc_id, cut, s, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS g FROM word WHERE len(w) > 1),
score AS (SELECT doc_id, cut, s, license_id, rank, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice
          FROM gram, template),
best AS (SELECT doc_id, cut, s, arg_min(license_id, rank) AS license_id, any_value(dice) AS dice
         FROM score WHERE (doc_id, cut, s, dice) IN (SELECT (doc_id, cut, s, max(dice)) FROM score WHERE dice >= {threshold} GROUP BY doc_id, cut, s)
         GROUP BY doc_id, cut, s)
SELECT doc_id, license_id, max(dice) AS dice, count(*) FILTER (NOT cut) AS segments, count(*) FILTER (cut) AS windows
FROM best GROUP BY doc_id, license_id"""
