"""License scans: Dice coefficient over word bigrams, with DataFrame operations only.

A text is cut into words (letters and digits of any script, lower-cased), so line breaks, comment marks and
punctuation don't count.  A unit is a window of consecutive words as long as a template, wherever it stands: a
whole file, wrapped lines of it, or a sentence inside a line.  It is compared with its template by

    dice = 2 * |A & B| / (|A| + |B|)

over their bags of word bigrams.  As a window is as long as its template, ``dice >= t`` needs ``t`` of the
template's bigrams, so of any ``(1 - t) * n + 1`` of its n bigrams at least one: these are its anchors, the longest
ones.  Only windows in which an anchor stands at its own place are looked at (each anchor of a document gives one),
and nearly all texts have none; at the start or end of a text a window is cut off, down to the size bound
``t / (2 - t)`` of the template, below which no bag can reach the threshold.  All of a document stays in its row: there
is no shuffle.

Templates are a parameter: a bounded list that goes into the plan as literals.

Defined cases: a null text, or one of fewer than two words, has no units; templates need two words; windows of one
template at different places are matches of their own; of equal scores the license of the lesser name is named;
repeated rows are repeated; a null doc_id is kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts of public licenses, and notices as projects write them, by identifier.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved."],
}

TEXTS = {
    "Apache-2.0": [
        (
            'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
            'obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, '
            'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
            'implied. See the License for the specific language governing permissions and limitations under the License.'
        ),
    ],
    "BSD-2-Clause": [
        (
            'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are '
            'met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. '
            'Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the '
            'documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS '
            'IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
            'PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, '
            'SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, '
            'OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT '
            '(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
        ),
    ],
    "BSD-3-Clause": [
        (
            'Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this '
            'software without specific prior written permission.'
        ),
    ],
    "GPL-3.0": [
        (
            'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by '
            'the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the '
            'hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR '
            'PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with '
            'this program. If not, see <https://www.gnu.org/licenses/>.'
        ),
    ],
    "ISC": [
        (
            'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the '
            'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
            'WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE '
            'LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, '
            'WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS '
            'SOFTWARE.'
        ),
    ],
    "MIT": [
        (
            'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the '
            '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
            'distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the '
            'following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the '
            'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
            'MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY '
            'CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE '
            'SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
        ),
        (
            'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the '
            '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
            'distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the '
            'following conditions:'
        ),
    ],
    "MPL-2.0": [
        (
            'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this '
            'file, You can obtain one at https://mozilla.org/MPL/2.0/.'
        ),
    ],
    "Unlicense": [
        (
            'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or '
            'distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any '
            'means.'
        ),
    ],
}

TEMPLATES = {name: NOTICES.get(name, []) + TEXTS.get(name, []) for name in sorted(NOTICES.keys() | TEXTS.keys())}
THRESHOLD = 0.8
_BETWEEN = r"[^\p{L}\p{N}]+"


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bigrams(w: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(w, w[1:])]


def tagged(pairs: list[str]) -> list[str]:
    """The bag of bigrams as a set: each with the number of its occurrence."""
    seen: Counter = Counter()
    out = []
    for pair in pairs:
        seen[pair] += 1
        out.append(f"{pair} {seen[pair]}")
    return out


def anchors(pairs: list[str], threshold: float) -> list[int]:
    """Places of so many bigrams, the longest, that a window without any of them can't reach the threshold."""
    n = math.floor(len(pairs) * (1 - threshold) + 1e-9) + 1
    return sorted(sorted(range(len(pairs)), key=lambda i: (-len(pairs[i]), i))[:n])


def prepared(templates: dict[str, list[str]], threshold: float) -> tuple[list[tuple[str, list[str]]], dict[str, list[tuple[int, int]]]]:
    """(license, bigrams) of each template, and for each anchor the templates and places where it stands."""
    out = [(name, bigrams(words(t))) for name, texts in sorted(templates.items()) for t in texts]
    if not all(pairs for _, pairs in out):
        raise ValueError("a template needs two words")
    places: dict[str, list[tuple[int, int]]] = {}
    for i, (_, pairs) in enumerate(out):
        for q in anchors(pairs, threshold):
            places.setdefault(pairs[q], []).append((i, q))
    return out, places


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and ``matches``: license, dice, and first word and number of words of every window that reaches the threshold."""
    known, places = prepared(templates or TEMPLATES, threshold)
    strings = lambda x: F.array(*map(F.lit, x))
    bags, sizes = F.array(*[strings(tagged(pairs)) for _, pairs in known]), F.array(*[F.lit(len(pairs)) for _, pairs in known])
    names = strings([name for name, _ in known])
    where = F.create_map(*[x for pair, at in places.items() for x in (F.lit(pair), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(q).alias("q")) for t, q in at]))])

    found = docs.select("doc_id", F.filter(F.split(F.lower(F.col("text").cast("string")), _BETWEEN), lambda w: w != "").alias("w"))
    pair_at = lambda i: F.concat(F.get("w", i), F.lit(" "), F.get("w", i + 1))
    hits = F.when(F.size("w") > 1, F.filter(F.sequence(F.lit(0), F.size("w") - 2), lambda i: pair_at(i).isin(list(places))))
    found = found.withColumn("hits", hits)
    starts = F.flatten(F.transform("hits", lambda i: F.transform(where[pair_at(i)], lambda x: F.struct(x["t"].alias("t"), F.greatest(i - x["q"], F.lit(0)).alias("start")))))
    windows = F.when(F.size("hits") > 0, F.array_distinct(starts))

    def rated(x: Column) -> Column:
        size = F.get(sizes, x["t"])
        last = F.least(x["start"] + size - 1, F.size("w") - 2)
        # the number of an occurrence makes the bag a set; arrays of one element stand for local names
        def dice(pairs: Column) -> Column:
            bag = F.transform(pairs, lambda p, i: F.concat(p, F.lit(" "), F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda q: q == p)).cast("string")))
            return 2.0 * F.size(F.array_intersect(bag, F.get(bags, x["t"]))) / (F.size(pairs) + size)

        score = F.get(F.transform(F.array(F.transform(F.sequence(x["start"], last), pair_at)), dice), F.lit(0))
        score = F.when(last - x["start"] + 1 >= threshold / (2 - threshold) * size - 1e-9, score).otherwise(0.0)
        return F.struct((-score).alias("order"), F.get(names, x["t"]).alias("license"), score.alias("dice"), x["start"].alias("start"), (last - x["start"] + 2).alias("n_words"))

    matches = F.filter(F.transform(windows, rated), lambda s: s["dice"] >= threshold)
    return found.select("doc_id", F.coalesce(F.array_sort(matches), F.array().cast("array<struct<order:double,license:string,dice:double,start:int,n_words:int>>")).alias("matches"))


def digest(docs: DataFrame) -> DataFrame:
    """op5: doc_id, the best match (license, dice), n_matches and all licenses found, sorted, joined by commas."""
    first = F.get("matches", F.lit(0))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",")
    return scan(docs).select("doc_id", first["license"].alias("license"), F.coalesce(first["dice"], F.lit(0.0)).alias("dice"), F.size("matches").cast("long").alias("n_matches"), names.alias("licenses"))


def oracle() -> str:
    """The same rows in DuckDB's SQL."""
    known, places = prepared(TEMPLATES, THRESHOLD)
    bags = ", ".join(f"({i}, '{p}')" for i, (_, pairs) in enumerate(known) for p in tagged(pairs))
    sizes = ", ".join(f"({i}, '{name}', {len(pairs)})" for i, (name, pairs) in enumerate(known))
    at = ", ".join(f"('{pair}', {t}, {q})" for pair, places_ in places.items() for t, q in places_)
    return rf"""
WITH bag(template, tagged) AS (VALUES {bags}), t(template, license, size) AS (VALUES {sizes}), anchor(pair, template, q) AS (VALUES {at}),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
p AS (SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] AS pair, len(w) - 1 AS pairs FROM (SELECT doc_id, w, unnest(range(len(w) - 1)) AS i FROM d WHERE len(w) > 1)),
c AS (SELECT DISTINCT doc_id, template, greatest(i - q, 0) AS start FROM p JOIN anchor USING (pair)),
b AS (SELECT doc_id, template, license, size, start, pair || ' ' || row_number() OVER (PARTITION BY doc_id, template, start, pair ORDER BY i) AS tagged
      FROM c JOIN t USING (template) JOIN p USING (doc_id) WHERE i BETWEEN start AND start + size - 1),
s AS (SELECT doc_id, template, license, start, 2.0::DOUBLE * count(bag.tagged) / (count(*) + size) AS dice, count(*) >= {THRESHOLD} / (2 - {THRESHOLD}) * size - 1e-9 AS enough
      FROM b LEFT JOIN bag USING (template, tagged) GROUP BY doc_id, template, license, size, start),
m AS (SELECT * FROM s WHERE enough AND dice >= {THRESHOLD}),
g AS (SELECT doc_id, arg_min(license, (-dice, license)) AS license, max(dice) AS dice, count(*) AS n_matches, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM m GROUP BY doc_id)
SELECT documents.doc_id, license, coalesce(dice, 0.0::DOUBLE) AS dice, coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses FROM documents LEFT JOIN g USING (doc_id)
"""


ORACLE = oracle()
