"""License scan: exact set-similarity join of text blocks with license templates, in SQL functions only.

Base: places where the words of a phrase stand one after another. The method
compares blocks of a text with templates, the words of license notices. A block is any
stretch of `STRETCH` times as many words in a row as the template has, wherever lines break. Found is
every template of which some block holds at least `CONTAINMENT` of the distinct words, in any
order and with anything between. All words are ranked by their document frequency in the corpus,
the rarest first, and the join goes from words to templates:

- prefix: a block that holds the overlap asked for holds one of a template's rarest words, all but
  (overlap - 1). An inverted index has the templates of each such word. Where one stands in a text,
  its templates are candidates there; a text without any is not looked at again, and
  words that no document has are not in the index.
- length: around that place there must be as many words of the template as the overlap asks for.
- position: a block whose rarest word has rank r in the template can hold the words from r on only,
  so r must leave as many as the overlap asks for.

All three drop only what can't reach the threshold; then the words of each block around
the place are counted. Frequencies come from a count over all documents, aggregated before it is
shuffled, with a row for each template word. The templates are a small fixed table, so it stands in the
plan with its index; some hundred notices would do as well.

A null or empty text has no words, no places (nulls) and empty labels. Repeated
rows are scanned one by one, extra columns are not read, texts are read whole.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, documents, fresh
from .native_spans import let

CONTAINMENT = 0.8
#: Words of a block for each word of the template.
STRETCH = 1.25
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[0-9a-zA-Z\x{80}-\x{10FFFF}]"
_GAP = r"[^0-9a-zA-Z\x{80}-\x{10FFFF}]+"

# Phrases that are looked for word by word, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# The method's templates, well-known license notices and short forms of them.
TEMPLATES = (
    ("mit", "under the mit license"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software.",
    ),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    (
        "warranty-disclaimer",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("apache-2", "apache license version 2"),
    ("apache-2", "licensed under the apache license version 2 0"),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
        "to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("gpl", "gnu general public license"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("mpl-2", "mozilla public license version 2 0"),
    (
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means.",
    ),
)


def plain_words(template: str) -> list[str]:
    return [w for w in re.split(SEPARATOR, template.lower()) if w]


def base_places(text: Column) -> Column:
    """struct(n, first, last, labels) of the phrases in a text."""
    padded = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), SEPARATOR, " ")), F.lit(" "))

    def counted(s: Column) -> Column:
        n, first, last, labels = [], [], [], []
        spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
        for phrase, label in PHRASES.items():
            # a phrase does not overlap itself, but two may share the blank between them
            n.append(F.regexp_count(s, F.lit(f" {phrase}(?= )")))
            at = F.instr(s, f" {phrase} ")
            first.append(F.when(at > 0, spaces(F.substring(s, F.lit(1), at)) - 1))
            back = F.instr(F.reverse(s), f" {phrase} "[::-1])
            head = F.substring(s, F.lit(1), F.length(s) - (back - 1) - len(phrase) - 1)
            last.append(F.when(back > 0, spaces(head) - 1))
            labels.append(F.when(at > 0, F.lit(label)))
        total = n[0]
        for x in n[1:]:
            total = total + x
        return F.struct(
            total.cast("long").alias("n"),
            F.least(*first).cast("long").alias("first"),
            F.greatest(*last).cast("long").alias("last"),
            F.array_compact(F.array(*labels)).alias("labels"),
        )

    none = "struct<n:bigint,first:bigint,last:bigint,labels:array<string>>"
    any_ = "|".join(_GAP.join(p.split()) for p in PHRASES)
    return F.when(text.rlike(f"(?i)(?:{any_})(?!{_WORD})"), let(padded, counted)).otherwise(
        F.struct(F.lit(0).alias("n"), F.lit(None).alias("first"), F.lit(None).alias("last"), F.array().alias("labels")).cast(none)
    )


def vocabulary() -> list[str]:
    return sorted({w for _, t in TEMPLATES for w in plain_words(t)})


def words(text: Column) -> Column:
    return F.split(F.lower(text), SEPARATOR)


def frequencies(df: DataFrame, text_col: str) -> dict[str, int]:
    """Of each template word, the number of documents that have it; words that none has are left out."""
    known = F.array(*map(F.lit, vocabulary()))
    each = df.select(F.explode(F.array_intersect(words(col(text_col).cast("string")), known)).alias("word"))
    return {r.word: r.n for r in each.groupBy("word").agg(F.count("*").alias("n")).collect()}


def matches(text: Column, often: dict[str, int], containment: float = CONTAINMENT) -> Column:
    """array<struct<label, share>> of the templates that some block of a text reaches, with the best block's share."""
    none = F.array().cast("array<struct<label:string,share:double>>")
    rank = {w: i for i, w in enumerate(sorted(vocabulary(), key=lambda w: (often.get(w, 0), w)))}
    table, index = [], {}
    for i, (label, template) in enumerate(TEMPLATES):
        every = plain_words(template)
        own = sorted(set(every), key=rank.__getitem__)
        overlap = math.ceil(containment * len(own) - 1e-9)
        for w in own[: len(own) - overlap + 1]:
            if w in often:
                index.setdefault(w, []).append(i)
        table.append(
            F.struct(
                F.lit(label).alias("label"),
                F.array(*map(F.lit, own)).alias("words"),
                F.lit(len(own)).alias("m"),
                F.lit(overlap).alias("o"),
                F.lit(math.ceil(STRETCH * len(every))).alias("span"),
            )
        )
    if not index:
        return none
    heads = sorted(index)
    templates, known = F.array(*table), F.array(*map(F.lit, heads))
    lists = F.array(*[F.array(*map(F.lit, index[w])) for w in heads])

    def of_text(all_words: Column) -> Column:
        marked = F.transform(all_words, lambda w, p: F.struct(F.array_position(known, w).cast("int").alias("h"), p.alias("p")))
        hits = F.filter(marked, lambda x: x["h"] > 0)
        places = F.flatten(F.transform(hits, lambda x: F.transform(F.get(lists, x["h"] - 1), lambda t: F.struct(t.alias("t"), x["p"].alias("p")))))

        def judged(place: Column) -> Column:
            def against(t: Column) -> Column:
                start = F.greatest(place["p"] - t["span"] + 1, F.lit(0))
                around = F.slice(all_words, start + 1, place["p"] - start + t["span"])
                ranked = F.transform(around, lambda w, j: F.struct(F.array_position(t["words"], w).cast("int").alias("r"), j.alias("j")))

                def counted(mine: Column) -> Column:
                    def block(q: Column) -> Column:
                        inside = F.filter(mine, lambda y: (y["j"] >= q["j"]) & (y["j"] < q["j"] + t["span"]))
                        own = F.array_distinct(F.transform(inside, lambda y: y["r"]))
                        return let(own, lambda r: F.when(F.array_min(r) <= t["m"] - t["o"] + 1, F.size(r)).otherwise(0))

                    first = F.filter(mine, lambda q: q["j"] <= place["p"] - start)
                    enough = F.size(F.array_distinct(F.transform(mine, lambda y: y["r"]))) >= t["o"]
                    return F.when(enough, F.array_max(F.transform(first, block))).otherwise(0)

                best = let(F.filter(ranked, lambda y: y["r"] > 0), counted)
                return let(best, lambda n: F.struct(t["label"].alias("label"), F.when(n >= t["o"], n / t["m"]).alias("share")))

            return let(F.get(templates, place["t"]), against)

        return F.filter(F.transform(places, judged), lambda x: x["share"].isNotNull())

    any_ = "|".join(map(re.escape, heads))
    return F.when(text.rlike(f"(?i)(?<!{_WORD})(?:{any_})(?!{_WORD})"), let(words(text), of_text)).otherwise(none)


def scan(
    df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), containment: float = CONTAINMENT
) -> DataFrame:
    """`keep` columns, and `license` (renamed on a clash): n_words, places of base phrases, base_labels, labels, score."""
    source, base, more, out = (fresh(n, keep) for n in ("scanned", "base", "more", "license"))
    often = frequencies(df, text_col)
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    now = df.select(*[col(k) for k in keep], text.alias(source))
    now = now.withColumns({base: base_places(col(source)), more: matches(col(source), often, containment)})
    b, m = col(base), col(more)
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    best = F.coalesce(F.array_max(F.transform(m, lambda x: x["share"])), F.lit(0.0))
    made = F.struct(
        F.regexp_count(col(source), F.lit(f"{_WORD}+")).cast("long").alias("n_words"),
        b["n"].alias("n_base"),
        b["first"].alias("first_word"),
        b["last"].alias("last_word"),
        joined(b["labels"]).alias("base_labels"),
        joined(F.concat(b["labels"], F.transform(m, lambda x: x["label"]))).alias("labels"),
        F.when(b["n"] > 0, 1.0).otherwise(best).alias("score"),
    )
    return now.select(*[col(k) for k in keep], made.alias(out))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).select("doc_id", "license.*")
