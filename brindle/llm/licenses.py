"""License scans by an exact set-similarity join (DataFrame functions only).

Phrases are found where their words stand consecutively; so are notices of fewer than SHORT words, too few to be told as a
set. Full license bodies are joined with text blocks by containment: a block matches if it holds at least THRESHOLD of a
template's distinct words. Blocks are half-overlapping windows whose step is a power of two of at least 1.25 times the
template's words, so a passage of that length lies whole in some block, wherever it starts. The join is exact. Words of all
templates are ordered by their frequency in the whole corpus, rarest first; a match must share one of the first ``size - need
+ 1`` words of the template (prefix filter), the block must hold enough template words (length filter), and from the first
shared word on both sides must have enough words left (position filter). Each text is split once; what the scan writes per
row, its counts and the places of the words of phrases and templates, serves the frequencies, the phrases and the blocks.
Only rows that hold a prefix word are expanded into blocks, and the side that is broadcast is the templates' words, whose
number is fixed.

The score is the larger of the best containment among matches and 1 - 0.5 ** (number of phrases and notices).

Defined cases: null and empty texts have no words, no labels, score 0 and null positions. Repeated rows are labelled
alike, each for itself. Texts of any length are read whole. An empty table gives no rows. Columns other than id and text are
ignored.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import ascii_lower, written

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices and bodies of licenses in common use, by label, without version numbers and names.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version"),
    ("apache", """you may not use this file except in compliance with the License. You may obtain a copy of the License at. Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under
        the License."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS
        AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY
        AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
        INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
        STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
        POSSIBILITY OF SUCH DAMAGE."""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution License"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
        FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public
        License along with this program."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS
        ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR
        BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
        PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE."""),
    ("mit", "released under the MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
        portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
        IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
    ("public-domain", """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as
        a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the
        author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication
        for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
        relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be
        misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
        product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. This notice may not be removed or altered from any source distribution."""),
]
#: Share of a template's distinct words that a block must hold, and words below which a notice is found as a phrase.
THRESHOLD, SHORT = 0.8, 16
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The one character beyond ASCII whose lower case is an ASCII letter alone.
_KELVIN = "\u212a"


def word_list(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def step_of(words: int) -> int:
    """The power of two of at least 1.25 times a template's words: half a block."""
    return 1 << max(4, ceil(1.25 * words - 1).bit_length())


def scan(docs: DataFrame, phrases: list[tuple[str, list[str], bool]], vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """Per row: row (its number), doc_id, n_words, places (pos, word) of the vocabulary, and starts of each phrase (p0, p1, ...)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = F.split(F.when(F.contains(text, F.lit(_KELVIN)), ascii_lower(text)).otherwise(F.lower(text)), _GAP)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", F.monotonically_increasing_id().alias("row"), parts.alias("parts"))
    first = F.when(F.col("parts")[0] == "", 1).otherwise(0)  # an empty part stands before a gap at the start and after one at the end
    last = F.when((F.size("parts") > 1) & (F.element_at("parts", -1) == ""), 1).otherwise(0)
    rows = rows.withColumn("first", first).withColumn("n_words", (F.size("parts") - F.col("first") - last).cast("long"))
    place = F.transform("parts", lambda w, i: F.when(w.isin(vocabulary), F.struct((i - F.col("first")).alias("pos"), w.alias("word"))))
    placed = rows.select("doc_id", "row", "n_words", F.filter(place, lambda p: p.isNotNull()).alias("places"))

    def starts(words: list[str]) -> Column:
        """Words of a phrase all are in the vocabulary, so they are neighbours among the places where they stand consecutively."""

        def here(p: Column, i: Column) -> Column:
            same = p["word"] == words[0]
            for k, word in enumerate(words[1:], 1):
                same = same & (F.get("places", i + k)["word"] == word)
            return same & (F.get("places", i + len(words) - 1)["pos"] == p["pos"] + len(words) - 1)

        return F.transform(F.filter("places", here), lambda p: p["pos"])

    return placed.select("*", *[starts(words).alias(f"p{n}") for n, (_, words, _) in enumerate(phrases)])


def template_table(counts: dict[str, int], templates: list[tuple[str, list[str]]], threshold: float) -> list[dict]:
    """The templates with their word ranks (rarest word of the corpus first), sizes, needed words, prefixes and steps."""
    rank = {w: i for i, w in enumerate(sorted({w for _, words in templates for w in words}, key=lambda w: (counts.get(w, 0), w)))}
    table = []
    for number, (label, words) in enumerate(templates):
        own = sorted({rank[w] for w in words})
        need = ceil(threshold * len(own) - 1e-9)
        names = {rank[w]: w for w in words}
        table.append({"template": number, "label": label, "ranks": own, "names": names, "need": need, "prefix": own[: len(own) - need + 1], "step": step_of(len(words))})
    return table


def matches(scanned: DataFrame, table: list[dict]) -> DataFrame:
    """(row, hits, containment) from (row, places): the matching templates' labels, and the best containment, per row."""
    spark = scanned.sparkSession
    rare = sorted({t["names"][i] for t in table for i in t["prefix"]})
    vocabulary = spark.createDataFrame(sorted({(w, i, t["step"]) for t in table for i, w in t["names"].items()}), "word string, rank int, step int")
    prefixes = spark.createDataFrame([(i, t["step"], t["template"], at, len(t["ranks"]), t["need"]) for t in table for at, i in enumerate(t["prefix"])], "rank int, step int, template int, i int, size int, need int")
    full = spark.createDataFrame([(t["template"], t["label"], t["ranks"]) for t in table], "template int, label string, all_ranks array<int>")
    holders = scanned.where(F.exists("places", lambda p: p["word"].isin(rare))).select("row", F.inline("places"))
    placed = holders.join(F.broadcast(vocabulary), "word")
    half = F.floor(F.col("pos") / F.col("step")).cast("int")
    in_blocks = placed.select("row", "step", "rank", F.explode(F.array(half, half - 1)).alias("block")).where("block >= 0")
    blocks = in_blocks.groupBy("row", "step", "block").agg(F.sort_array(F.collect_set("rank")).alias("ranks"))
    shared = blocks.select("row", "step", "ranks", F.posexplode("ranks").alias("j", "rank")).join(F.broadcast(prefixes), ["rank", "step"]).where(F.size("ranks") >= F.col("need"))
    first = shared.groupBy("row", "ranks", "template").agg(F.min(F.struct("i", "j", "size", "need")).alias("f")).select("row", "ranks", "template", "f.*")
    enough = 1 + F.least(F.col("size") - F.col("i") - 1, F.size("ranks") - F.col("j") - 1) >= F.col("need")
    common = F.size(F.array_intersect("ranks", "all_ranks"))
    found = first.where(enough).join(F.broadcast(full), "template").withColumn("common", common).where("common >= need")
    return found.groupBy("row").agg(F.collect_set("label").alias("hits"), F.max(F.col("common") / F.col("size")).alias("containment"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score."""
    worded = [(label, word_list(text)) for label, text in templates or TEMPLATES]
    phrases = [(label, p.split(), True) for p, label in PHRASES.items()] + [(label, words, False) for label, words in worded if 0 < len(words) < SHORT]
    bodies = [(label, words) for label, words in worded if len(words) >= SHORT]
    vocabulary = sorted({w for _, words, _ in phrases for w in words} | {w for _, words in bodies for w in words})
    scanned = written(scan(docs, phrases, vocabulary, id_col, text_col), "license-places")
    base = [f"p{n}" for n, (_, _, of_base) in enumerate(phrases) if of_base]
    named = lambda chosen: F.array_compact(F.array(*[F.when(F.size(f"p{n}") > 0, F.lit(label)) for n, (label, _, of_base) in enumerate(phrases) if of_base in chosen]))
    n_found = sum((F.size(f"p{n}") for n in range(len(phrases))), F.lit(0))
    starts = F.concat(*base)
    rows = scanned.select(
        "row", "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(named((True,)))), ",").alias("base_labels"), named((True, False)).alias("found"), n_found.alias("n_found"),
    )
    no_hits = F.array().cast("array<string>")
    if bodies:
        words = scanned.select(F.explode("places.word").alias("word")).where(F.col("word").isin(sorted({w for _, words in bodies for w in words})))
        counts = {r.word: r["count"] for r in words.groupBy("word").count().collect()}  # one row per template word
        rows = rows.join(matches(scanned, template_table(counts, bodies, threshold)), "row", "left")
    else:
        rows = rows.withColumn("hits", no_hits).withColumn("containment", F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_join(F.array_sort(F.array_union("found", F.coalesce("hits", no_hits))), ",").alias("labels"),
        F.greatest(1 - F.pow(F.lit(0.5), F.col("n_found")), F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
