"""License scans: Dice coefficient over word bigrams against licence templates, with DataFrame functions only.

A unit is a line of a text, and the whole text where it has several lines. Units are normalised: A-Z lower-cased, everything
but letters and digits a space. The Dice coefficient of two sets of bigrams A, B is 2|A n B| / (|A| + |B|); with |B| fixed
it can reach the threshold t only for t/(2-t) |B| <= |A| <= (2-t)/t |B|. These bounds choose the templates that each unit is
compared with. A notice may also stand somewhere inside a text, wrapped over lines or in the midst of one: where a text holds
t/(2-t) of a template's bigrams, windows of the template's size are compared too, from each place where one of its bigrams
stands. The best window is unit -2; it counts where no other unit has a hit. The templates are literals of the plan: nothing
is shuffled but the units' results, which are summed up per document on the map side.

Null, empty or one-word units: no bigrams, no hit. Ties of a document's best hit: the larger template, then its name, then
the first unit (the whole text is unit -1), a window last. Repeated rows of one doc_id are summed up as one document.
Documents without a hit have a null licence. Very long texts are scanned whole. Extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

THRESHOLD = Fraction(4, 5)
LEAST = 4  # bigrams of a template that is looked for inside texts
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# fixed values: public licence notices, in their published wording
TEMPLATES = {
    "Apache-2.0/header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause/notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0/deed": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0/notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0/notice": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT/grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT/full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT/notice": "Released under the MIT License.",
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-3-Clause/full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC/full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Proprietary/rights": "All rights reserved.",
}


def sequence(text: str) -> list[str]:
    """The word bigrams of a template, normalised as units are."""
    words = "".join(ch if ch.isalnum() else " " for ch in text.translate(str.maketrans(UPPER, LOWER))).split()
    return list(map(" ".join, zip(words, words[1:], strict=False)))


def bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a template, in order."""
    return list(dict.fromkeys(sequence(text)))


def bounds(n: int, t: Fraction = THRESHOLD) -> tuple[int, int]:
    """The least and the greatest number of bigrams of a set that can reach the threshold with a set of n."""
    return ceil(t / (2 - t) * n), floor((2 - t) / t * n)


def _words(unit: Column) -> Column:
    plain = F.regexp_replace(F.translate(unit, UPPER, LOWER), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(plain, " "), lambda x: x != "")


def _once(value: Column) -> Column:
    """A value that the optimiser can't copy into the expressions that use it."""
    return F.explode(F.array(value))


def scan(df: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: Fraction = THRESHOLD) -> DataFrame:
    """doc_id, unit, license, dice of every unit that reaches the threshold with a template (its best one)."""
    sets = {name: bigrams(text) for name, text in templates.items()}
    limits = {name: bounds(len(own), threshold) for name, own in sets.items()}
    low = min(a for a, _ in limits.values())
    docs = c.documents(df)
    by_line = docs.select("doc_id", _once(F.transform(F.split("text", "\n"), _words)).alias("lines"))
    unit = lambda i, words: F.struct(i.cast("int").alias("unit"), words.alias("words"))
    whole = F.when(F.size("lines") > 1, F.array(unit(F.lit(-1), F.flatten("lines")))).otherwise(F.array(unit(F.lit(-2), F.get("lines", F.lit(0)))))
    # a text of one line is its own window, by the side
    units = by_line.select("doc_id", F.explode(F.concat(F.transform("lines", lambda words, i: unit(i, words)), whole)).alias("u")).where(F.size("u.words") - 1 >= low)
    every = F.transform(F.sequence(F.lit(0), F.size("u.words") - 2), lambda i: F.concat_ws(" ", F.get("u.words", i), F.get("u.words", i + 1)))
    units = units.select("doc_id", "u.unit", _once(every).alias("every"))
    units = units.select("doc_id", "unit", "every", _once(F.array_distinct("every")).alias("pairs"))
    n = F.size("pairs")
    ordered = sorted(sets.items(), key=lambda x: (-len(x[1]), x[0]))
    dice, windows = [], []
    enough = lambda common, size, own: 2 * threshold.denominator * common >= threshold.numerator * (size + len(own))
    for name, own in ordered:
        a, b = limits[name]
        literal = F.array(*map(F.lit, own))
        common = F.size(F.array_intersect("pairs", literal))
        value = F.when((F.col("unit") > -2) & n.between(a, b) & enough(common, n, own), 2.0 * common / (n + len(own)))
        dice.append(F.struct(value.alias("dice"), F.lit(len(own)).alias("size"), F.lit(name).alias("license")))
        if len(own) >= LEAST:
            found = F.when((F.col("unit") < 0) & (common >= a), _inside(own, len(sequence(templates[name])), literal, enough))
            windows.append(F.struct(found.alias("dice"), F.lit(len(own)).alias("size"), F.lit(name).alias("license")))
    # most units hold no bigram of any template
    all_ = F.array(*map(F.lit, sorted({x for own in sets.values() for x in own})))
    units = units.where(F.arrays_overlap("pairs", all_))
    first = lambda options: F.get(F.array_sort(F.filter(F.array(*options), lambda x: x["dice"].isNotNull()), _better), F.lit(0))
    both = F.array(F.struct("unit", first(dice).alias("best")), F.struct(F.lit(-2).alias("unit"), first(windows).alias("best")))
    out = units.select("doc_id", F.explode(both).alias("x")).where("x.best is not null")
    return out.select("doc_id", "x.unit", "x.best.license", "x.best.dice", "x.best.size")


def _inside(own: list[str], span: int, literal: Column, enough: Callable[[Column, Column, list[str]], Column]) -> Column:
    """The best coefficient of the windows of `span` bigrams of `every` that begin with a bigram of the template, or null."""
    starts = F.filter(F.sequence(F.lit(1), F.size("every")), lambda i: F.array_contains(literal, F.element_at("every", i)))

    def dice(i: Column) -> Column:
        window = F.array_distinct(F.slice("every", i, span))
        both, size = F.size(F.array_intersect(window, literal)), F.size(window)
        return F.when(enough(both, size, own), 2.0 * both / (size + len(own)))

    return F.array_max(F.transform(starts, dice))


def _better(x: Column, y: Column) -> Column:
    """Before: the higher coefficient, then the larger template, then the first name."""
    less = (x["dice"] > y["dice"]) | ((x["dice"] == y["dice"]) & ((x["size"] > y["size"]) | ((x["size"] == y["size"]) & (x["license"] < y["license"]))))
    more = (y["dice"] > x["dice"]) | ((x["dice"] == y["dice"]) & ((y["size"] > x["size"]) | ((x["size"] == y["size"]) & (y["license"] < x["license"]))))
    return F.when(less, -1).when(more, 1).otherwise(0)


def query(df: DataFrame) -> DataFrame:
    """Per document: the number of units with a hit, and its best hit."""
    # the least struct is the best hit: every field is turned so that less is better
    order = F.struct((-F.col("dice")).alias("d"), (-F.col("size")).alias("s"), "license", (F.col("unit") == -2).alias("inside"), "unit")
    hits = scan(df).groupBy("doc_id").agg(F.count(F.when(F.col("unit") > -2, 1)).alias("n"), F.min(order).alias("best")).withColumn("n_hits", F.greatest("n", F.lit(1)))
    out = c.documents(df).select("doc_id").distinct().join(hits, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"), F.col("best.license").alias("license"), (-F.col("best.d")).alias("dice"), F.col("best.unit").cast("long").alias("unit"))


def sql() -> str:
    """The same as DuckDB SQL."""
    rows = ", ".join(f"('{name}', [{', '.join(repr(x) for x in bigrams(text))}], {bounds(len(bigrams(text)))[0]}, {bounds(len(bigrams(text)))[1]}, {len(sequence(text))})" for name, text in TEMPLATES.items())
    return rf"""
WITH templates(license, own, low, high, span) AS (VALUES {rows}),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
units AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS unit, unnest(string_split(text, chr(10))) AS line FROM docs
  UNION ALL SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN -1 ELSE -2 END, text FROM docs),
cut AS (SELECT doc_id, unit, list_filter(string_split(regexp_replace(translate(line, '{UPPER}', '{LOWER}'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM units),
allpairs AS (SELECT doc_id, unit, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] AS every FROM cut WHERE len(w) > 1),
pairs AS (SELECT doc_id, unit, every, list_distinct(every) AS pairs FROM allpairs),
hits AS (
  SELECT doc_id, unit, license, len(own) AS size, 2.0::DOUBLE * len(list_intersect(pairs, own)) / (len(pairs) + len(own)) AS dice
  FROM pairs JOIN templates ON len(pairs) BETWEEN low AND high
  WHERE unit > -2 AND 10 * len(list_intersect(pairs, own)) >= 4 * (len(pairs) + len(own))),
near AS (SELECT doc_id, license, own, span, every, unnest(list_filter(range(1, len(every) + 1), lambda i: list_contains(own, every[i]))) AS i FROM pairs JOIN templates ON unit < 0 AND len(own) >= {LEAST} AND len(list_intersect(pairs, own)) >= low),
windows AS (SELECT doc_id, license, own, list_distinct(every[i:i + span - 1]) AS part FROM near),
inside AS (SELECT doc_id, -2 AS unit, license, len(own) AS size, max(2.0::DOUBLE * len(list_intersect(part, own)) / (len(part) + len(own))) AS dice
  FROM windows WHERE 10 * len(list_intersect(part, own)) >= 4 * (len(part) + len(own)) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, size DESC, license) AS k FROM (SELECT * FROM hits UNION ALL SELECT * FROM inside)),
docs_best AS (SELECT *, greatest(count(*) FILTER (unit > -2) OVER (PARTITION BY doc_id), 1) AS n_hits, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, size DESC, license, unit = -2, unit) AS j FROM best WHERE k = 1)
SELECT d.doc_id, coalesce(b.n_hits, 0)::BIGINT AS n_hits, b.license, b.dice, b.unit::BIGINT AS unit
FROM (SELECT DISTINCT doc_id FROM docs) d LEFT JOIN docs_best b ON b.doc_id = d.doc_id AND b.j = 1
"""
