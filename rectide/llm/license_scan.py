"""License scans: Dice coefficient over word bigrams against license templates."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (license id, notice).  Fixed values: the short notices that the licenses ask for.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]

_WARRANTY = (
    "{0} \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {1} BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY "
    "OF SUCH DAMAGE."
).format("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "HOLDER OR CONTRIBUTORS")
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
    "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
    "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. "
)
_GNU = (
    "{0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by "
    "the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."
)
#: Standard headers and full texts, besides TEMPLATES; they span lines, so only word windows find them.
#: The long Apache, GNU, MPL and Creative Commons licenses are known by their headers, not by their whole texts.
LONG_TEMPLATES: list[tuple[str, str]] = [
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    ("GPL-3.0", _GNU.format("This program", ":", "General Public License", ",", "3")),
    ("GPL-2.0", _GNU.format("This program", ";", "General Public License", ";", "2")),
    ("LGPL-3.0", _GNU.format("This library", ":", "Lesser General Public License", ",", "3")),
    ("AGPL-3.0", _GNU.format("This program", ":", "Affero General Public License", ",", "3")),
    ("BSD-2-Clause", _BSD + _WARRANTY),
    (
        "BSD-3-Clause",
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
        "or promote products derived from this software without specific prior written permission. " + _WARRANTY,
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_words(text: str) -> list[str]:
    return [w for w in re.sub(_OTHER, " ", text.translate(str.maketrans(_UPPER, _LOWER))).split(" ") if w]


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """Sizes that a set can have at a Dice coefficient of ``threshold`` or more with one of ``size``."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _OTHER, " ")), " ")


def unit_bigrams(units: Column) -> Column:
    """Distinct word bigrams of each unit of an array of texts."""
    words = F.transform(units, _words)
    return F.transform(
        words,
        lambda w: F.array_distinct(
            F.zip_with(
                F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b)
            )
        ),
    )


def license_scan(
    docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.8
) -> DataFrame:
    """Scan every line, and the whole text, of every document for license notices.

    Texts are normalised (A-Z lowered, words of letters, digits and non-ASCII
    characters); a unit matches the template with the largest Dice coefficient
    of their sets of word bigrams, if that reaches ``threshold`` (ties: the
    larger license id).  Only templates whose size lies within the bounds that
    the threshold allows for the unit's size are compared; units no template
    allows for are dropped before any comparison.

    Gives doc_id, n_units (lines and the text itself), n_candidates (units within
    the bounds of some template), n_matches, licenses (sorted, comma-joined),
    best_license and best_dice (of the best unit; null if none).  Null or empty
    text: one empty line and one empty text, no match.  One row for each input
    row, repeated ones too; an empty table gives no rows; other columns are not
    read.  No shuffle; the templates are literals of the plan (a parameter).
    """
    rows = []
    for name, text in templates if templates is not None else TEMPLATES:
        grams = template_bigrams(text)
        if grams:
            rows.append((name, grams, *size_bounds(len(grams), threshold)))
    kind = "array<struct<name: string, grams: array<string>, low: int, high: int>>"
    known = (
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("name"),
                    F.array(*[F.lit(g) for g in grams]).alias("grams"),
                    F.lit(low).alias("low"),
                    F.lit(high).alias("high"),
                )
                for n, grams, low, high in rows
            ]
        )
        if rows
        else F.array()
    ).cast(kind)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    low, high = min((r[2] for r in rows), default=1), max((r[3] for r in rows), default=0)

    def candidates(grams: Column) -> Column:
        return F.filter(known, lambda t: (F.size(grams) >= t["low"]) & (F.size(grams) <= t["high"]))

    def best(grams: Column) -> Column:
        return F.array_max(
            F.transform(
                candidates(grams),
                lambda t: F.struct(
                    (
                        2.0
                        * F.size(F.array_intersect(grams, t["grams"]))
                        / (F.size(grams) + F.size(t["grams"]))
                    ).alias("dice"),
                    t["name"].alias("name"),
                ),
            )
        )

    units = F.concat(F.split(text, "\n"), F.array(text))
    sized = F.filter(unit_bigrams(units), lambda g: (F.size(g) >= low) & (F.size(g) <= high))
    allowed = F.filter(sized, lambda g: F.exists(known, lambda t: (F.size(g) >= t["low"]) & (F.size(g) <= t["high"])))
    scanned = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.size(F.split(text, "\n")) + 1).cast("long").alias("n_units"),
        F.transform(allowed, best).alias("scores"),
    )
    matches = F.filter("scores", lambda s: s["dice"] >= threshold)
    top = F.array_max(matches)
    return scanned.select(
        "doc_id",
        "n_units",
        F.size("scores").cast("long").alias("n_candidates"),
        F.size(matches).cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda s: s["name"]))), ",").alias("licenses"),
        top["name"].alias("best_license"),
        top["dice"].alias("best_dice"),
    )


def license_windows(
    docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.8
) -> DataFrame:
    """Find license notices anywhere in a text, across line breaks and inside longer lines.

    The words of the whole text are normalised as in ``license_scan``.  A window
    has as many words as the template it is compared with and begins at a bigram
    that both hold; the template matches if the Dice coefficient of the sets of
    word bigrams of one of its windows reaches ``threshold``.  A Dice coefficient
    of ``threshold`` needs ``size_bounds`` shared bigrams: only templates sharing
    so many with the text are looked at, and of their windows only those with so
    many shared positions are compared.

    Gives doc_id, n_candidates (templates that share enough bigrams), n_windows
    (windows compared), n_matches (templates with a matching window), licenses
    (sorted, comma-joined), best_license and best_dice (ties: the larger id; null
    if none).  Null or empty text: no match.  One row for each input row; an empty
    table gives no rows.  No shuffle; the templates are literals of the plan.
    """
    rows = []
    for name, text in templates if templates is not None else TEMPLATES + LONG_TEMPLATES:
        grams = template_bigrams(text)
        if grams:
            rows.append((name, grams, size_bounds(len(grams), threshold)[0], len(template_words(text)) - 1))
    kind = "array<struct<name: string, grams: array<string>, low: int, span: int>>"
    known = F.array(
        *[
            F.struct(
                F.lit(n).alias("name"),
                F.array(*[F.lit(g) for g in grams]).alias("grams"),
                F.lit(low).alias("low"),
                F.lit(span).alias("span"),
            )
            for n, grams, low, span in rows
        ]
    ).cast(kind)
    vocabulary = sorted({g for r in rows for g in r[1]})
    letters = F.array(*[F.lit(g) for g in vocabulary]).cast("array<string>")
    least = min((r[2] for r in rows), default=1)
    none = F.array().cast("array<int>")

    def starts(t: Column) -> Column:
        """Shared positions after which enough others follow within the window."""
        held = F.filter("at", lambda i: F.array_contains(t["grams"], F.get("grams", i)))
        return F.flatten(
            F.transform(
                F.array(held),  # binds the positions
                lambda p: F.filter(p, lambda i, j: F.get(p, j + t["low"] - 1) < i + t["span"]),
            )
        )

    def dice(t: Column, i: Column) -> Column:
        window = F.slice("grams", i + 1, t["span"])
        return (
            2.0
            * F.size(F.array_intersect(window, t["grams"]))
            / (F.size(F.array_distinct(window)) + F.size(t["grams"]))
        )

    # each column is read more than once by the next step, so that Spark does not inline it into a lambda
    words = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words"),
    )
    n = F.size("words") - 1
    bigrams = words.select(
        "doc_id",
        F.zip_with(
            F.slice("words", 1, n), F.slice("words", 2, n), lambda a, b: F.concat(a, F.lit(" "), b)
        ).alias("grams"),
    )
    shared = bigrams.select("doc_id", "grams", F.array_intersect("grams", letters).alias("shared"))
    close = shared.select(
        "doc_id",
        "grams",
        F.when(
            F.size("shared") >= least,
            F.filter(known, lambda t: F.size(F.array_intersect(t["grams"], F.col("shared"))) >= t["low"]),
        )
        .otherwise(F.array().cast(kind))
        .alias("close"),
    )
    placed = close.select(
        "doc_id",
        "grams",
        "close",
        F.when(
            F.size("close") > 0,
            F.filter(F.sequence(F.lit(0), F.size("grams") - 1), lambda i: F.get("grams", i).isin(vocabulary)),
        )
        .otherwise(none)
        .alias("at"),
    )
    scored = placed.select(
        "doc_id",
        F.size("close").cast("long").alias("n_candidates"),
        F.when(
            F.size("at") > 0,
            F.transform(
                "close",
                lambda t: F.struct(
                    t["name"].alias("name"), F.transform(starts(t), lambda i: dice(t, i)).alias("dice")
                ),
            ),
        ).alias("scores"),
    )
    counted = scored.select(
        "doc_id",
        "n_candidates",
        F.coalesce(F.aggregate("scores", F.lit(0), lambda n, s: n + F.size(s["dice"])), F.lit(0)).alias("n_windows"),
        F.coalesce(
            F.filter(
                F.transform("scores", lambda s: F.struct(F.array_max(s["dice"]).alias("dice"), s["name"].alias("name"))),
                lambda s: s["dice"] >= threshold,
            ),
            F.array().cast("array<struct<dice: double, name: string>>"),
        ).alias("matches"),
    )
    top = F.array_max("matches")
    return counted.select(
        "doc_id",
        "n_candidates",
        F.col("n_windows").cast("long").alias("n_windows"),
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda s: s["name"]))), ",").alias("licenses"),
        top["name"].alias("best_license"),
        top["dice"].alias("best_dice"),
    )
