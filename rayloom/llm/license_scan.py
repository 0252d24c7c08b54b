"""Licence scan by the Dice coefficient over word bigrams, in DataFrame operations only.

Texts and templates are normalised alike (A-Z lower-cased, everything but letters
and digits to single spaces), whole texts at once: a notice is found however its
lines are wrapped, and in the middle of a line too. A passage of a text for a
template is a run of words whose bigrams the template has: either an unbroken one,
or one with gaps of up to a quarter of the template's bigrams, eight at most. With
``common`` distinct known bigrams and every other position counted once,
dice = 2 * common / (passage + template).

Sets of sizes a and b cannot reach a threshold t unless
t / (2 - t) <= a / b <= (2 - t) / t. That bound prunes twice. A passage needs
t / (2 - t) of a template's bigrams, so it has at least one of any others plus one:
the rarest of each template, its seeds, and a text without a seed is left out
before anything is exploded. Then the bigrams of the rest meet the templates that
have them by a join with the bigram index, and runs outside the bounds go before
any set is counted.

Defined results for odd input: null and empty texts have no licence; a text of one
word has no bigram and never matches; of equally similar templates the
larger wins, then the smaller name; rows with the same id and text are scanned alike; an empty table or no
templates give no licences; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rayloom.llm.common import materialise

#: A bigram index of up to so many entries is broadcast; beyond, the join shuffles.
BROADCAST_GRAMS = 1_000_000
#: Words of a gap inside a passage, at the most.
GAP = 8

#: Licence notices and licence texts as they stand in files.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
        "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND "
        "ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."
    ),
    "ISC text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        "notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
        "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in "
        "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
        "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one "
        "at https://mozilla.org/MPL/2.0/."
    ),
}


def normalise(text: Column) -> Column:
    """The words of a text, one space between."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, r"[^0-9a-z\u0080-\x{10FFFF}]+", " "))


def bigrams_of(text: str) -> list[tuple[str, str]]:
    """The distinct bigrams of a template, by the rule of ``normalise``."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.sub("[^0-9a-z\u0080-\U0010ffff]+", " ", lower).strip(" ").split(" ")
    return sorted(set(zip(words, words[1:])))


def fewest(size: int, threshold: float) -> int:
    """The known bigrams that a passage needs for ``threshold`` against a template of ``size``."""
    return max(1, math.ceil(threshold / (2 - threshold) * size - 1e-9))


def gap_of(size: int) -> int:
    """How far two known positions of one passage may lie apart."""
    return 1 + min(GAP, size // 4)


def seeds_of(sets: Mapping[str, list[tuple[str, str]]], threshold: float) -> set[tuple[str, str]]:
    """Of each template so many of its rarest bigrams that every passage above the threshold has one.

    Rare is what few templates have, and of those the longer words.
    """
    held = Counter(g for grams in sets.values() for g in grams)
    out: set[tuple[str, str]] = set()
    for grams in sets.values():
        ordered = sorted(grams, key=lambda g: (held[g], -len(g[0]) - len(g[1]), g))
        out.update(ordered[: len(grams) - fewest(len(grams), threshold) + 1])
    return out


def _grams(text: Column) -> Column:
    """The hash of every bigram of a text, by position."""
    words = F.split(normalise(text), " ")
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def scan_licenses(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_matches, license, dice) for every document.

    ``n_matches`` counts the templates with a passage at or above ``threshold``,
    ``license`` is the most similar of them, else null.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    hits = materialise(_hits(keyed, _index(spark, templates, threshold), _seeds(templates, threshold), threshold), "licences")
    found = hits.withColumnRenamed("key", "hit_key")
    return keyed.select("doc_id", "key").join(found, F.col("key") == F.col("hit_key"), "left").select(
        "doc_id", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.col("best.license").alias("license"), F.col("best.dice").alias("dice")
    )


def _seeds(templates: Mapping[str, str], threshold: float) -> Column:
    """All seeds as one literal, whatever their number."""
    sets = {n: g for n, t in templates.items() if (g := bigrams_of(t))}
    pairs = F.from_json(F.lit(json.dumps(sorted(seeds_of(sets, threshold)))), "array<array<string>>")
    return F.transform(pairs, lambda p: F.xxhash64(F.get(p, 0), F.get(p, 1)))


def _index(spark, templates: Mapping[str, str], threshold: float) -> DataFrame:
    """(gram, name, size, least, gap): each bigram with the templates that have it."""
    rows = [
        (a, b, name, len(grams), fewest(len(grams), threshold), gap_of(len(grams)))
        for name, text in sorted(templates.items())
        for grams in [bigrams_of(text)]
        for a, b in grams
    ]
    listed = spark.createDataFrame(rows, "a string, b string, name string, size int, least int, gap int")
    index = listed.select(F.xxhash64("a", "b").alias("gram"), "name", "size", "least", "gap")
    return F.broadcast(index) if len(rows) <= BROADCAST_GRAMS else index


def _hits(keyed: DataFrame, index: DataFrame, seeds: Column, threshold: float) -> DataFrame:
    """(key, n_matches, best) of the texts with a passage above the threshold."""
    texts = keyed.select("key", _grams(F.col("text")).alias("grams")).filter(F.arrays_overlap("grams", seeds))
    known = texts.select("key", F.posexplode("grams").alias("pos", "gram")).join(index, "gram")
    # equal rows give equal positions: they are counted once, before the shuffle
    known = known.groupBy("key", "name", "pos").agg(F.first("gram").alias("gram"), *[F.first(c).alias(c) for c in ("size", "least", "gap")])
    order = Window.partitionBy("key", "name").orderBy("pos")
    apart = F.col("pos") - F.lag("pos").over(order)
    stepped = known.withColumn("apart", apart)
    # each position stands in one unbroken run and in one run with gaps
    both = stepped.select("*", F.explode(F.array(F.lit(1), F.col("gap"))).alias("reach"))
    runs = both.withColumn("run", F.sum(F.when(F.col("apart") <= F.col("reach"), 0).otherwise(1)).over(Window.partitionBy("key", "name", "reach").orderBy("pos")))
    passages = runs.groupBy("key", "name", "reach", "run").agg(
        F.countDistinct("gram").alias("common"), F.count("*").alias("held"), (F.max("pos") - F.min("pos") + 1).alias("length"), F.first("size").alias("size"), F.first("least").alias("least")
    )
    passage = F.col("common") + F.col("length") - F.col("held")
    scored = passages.filter(F.col("common") >= F.col("least")).select("key", "name", "size", (F.col("common") * 2.0 / (passage + F.col("size"))).alias("dice"))
    best = scored.filter(F.col("dice") >= threshold).groupBy("key", "name").agg(F.max("dice").alias("dice"), F.first("size").alias("size"))
    return best.groupBy("key").agg(
        F.count("*").cast("int").alias("n_matches"), F.min_by(F.struct(F.col("name").alias("license"), "dice"), F.struct(-F.col("dice"), -F.col("size"), F.col("name"))).alias("best")
    )
