"""Licence scans by the Dice coefficient of word bigrams.

A text, each of its lines and passages of it are brought to a normal form (letters and digits in lower case, one blank between words) and
compared to the templates: twice the shared different word bigrams, over the bigrams of both. A template is compared only if its
size allows for the threshold t: with a bigrams in the text and b in the template the coefficient is 2 min(a, b) / (a + b) at
most, so b must lie between a t / (2 - t) and a (2 - t) / t. Lines and texts outside the bounds of all templates are gone before any bigram is made.
The best template of a line or a whole text counts, equal ones by name.

A passage is as many words of the text as the template has, lines not minded, from a word that begins one of the template's bigrams; at the text's end it may be shorter.
To reach t, it must have t / (2 - t) of the template's bigrams, so only texts that have as many of them somewhere are searched for passages. At each
word the best template counts. A template that is only found in passages is not reported beside another one that has all its bigrams, such as the whole licence text.

All of it is DataFrame code in one pass over the documents; the templates are a literal in the plan, and only the few findings are
shuffled.

Defined cases: a NULL text, and a text or line of fewer than two words, has no bigrams and matches nothing. A text of one line is
compared once. Rows with one id are pooled; a NULL id is a group of its own. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import table

THRESHOLD = 0.8

# The notices that the licences ask for or that are usual, by SPDX name.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR "
    "ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
    "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_TWO_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
# Whole licence texts, without the line that names the holder.
TEMPLATES |= {
    "BSD-2-Clause-text": _TWO_CLAUSES + _AS_IS,
    "BSD-3-Clause-text": (
        _TWO_CLAUSES + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. " + _AS_IS
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT-text": (
        TEMPLATES["MIT-grant"] + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
}


def normal_form(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def template_words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def larger(templates: Mapping[str, str]) -> dict[str, list[str]]:
    """Per template the others that have all its bigrams and more."""
    known = {name: set(template_bigrams(text)) for name, text in templates.items()}
    return {name: sorted(other for other, b in known.items() if known[name] < b) for name in known}


def bigrams(words: str) -> Column:
    """The different bigrams of a column of words, two at least."""
    starts = F.sequence(F.lit(0), F.size(words) - 2)
    return F.array_distinct(F.transform(starts, lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))))


def passages(docs: DataFrame, templates: Mapping[str, str], threshold: float) -> DataFrame:
    """``id``, ``name`` and ``dice`` of passages that reach the threshold, the best template at each word."""
    known = {name: (template_bigrams(text), len(template_words(text))) for name, text in sorted(templates.items())}
    known = {name: found for name, found in known.items() if found[0]}
    hashed = lambda b: F.array(*[F.xxhash64(*map(F.lit, x.split(" "))) for x in b])
    literal = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, b)).alias("bigrams"), hashed(b).alias("hashes"), F.lit(n).alias("length"), F.lit(len(b) * threshold / (2 - threshold)).alias("least"))
            for name, (b, n) in known.items()
        ]
    )
    every = hashed(dict.fromkeys(x for b, _ in known.values() for x in b))
    fewest = min(len(b) for b, _ in known.values()) * threshold / (2 - threshold)
    once = lambda column, name: F.explode(F.array(column)).alias(name)
    starts = F.sequence(F.lit(0), F.size("words") - 2)
    texts = docs.select("id", "row", once(F.split(normal_form(F.col("text")), " "), "words")).where(F.size("words") >= 2)
    met = F.array_intersect(F.transform(starts, lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1))), every)
    texts = texts.select("id", "row", "words", once(met, "met")).where(F.size("met") >= fewest)
    likely = F.filter(literal, lambda t: F.size(F.array_intersect(t["hashes"], F.col("met"))) >= t["least"])
    asked = texts.select("id", "row", "words", F.explode(likely).alias("t"))
    own = F.filter(starts, lambda i: F.array_contains(F.col("t.bigrams"), F.concat_ws(" ", F.get("words", i), F.get("words", i + 1))))
    cut = F.transform(own, lambda i: F.struct(i.alias("at"), F.slice("words", i + 1, F.col("t.length")).alias("words")))
    windows = asked.select("id", "row", F.col("t.name").alias("name"), F.col("t.bigrams").alias("wanted"), F.explode(cut).alias("x")).select("id", "row", "name", "wanted", "x.at", "x.words")
    grams = windows.select("id", "row", "name", "wanted", "at", once(bigrams("words"), "b"))
    dice = (F.lit(2.0) * F.size(F.array_intersect("b", "wanted"))) / (F.size("b") + F.size("wanted"))
    scored = grams.select("id", "row", "at", "name", dice.alias("dice")).where(F.col("dice") >= threshold)
    best = scored.groupBy("row", "at").agg(F.min(F.struct((-F.col("dice")).alias("less"), "name", "id")).alias("best"))
    return best.select("best.id", "best.name", (-F.col("best.less")).alias("dice"))


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``id_col``, ``licence``, the best ``dice`` and ``n_found``, the lines (or whole texts) with that licence, 1 if it is only found in passages."""
    known = {name: template_bigrams(text) for name, text in sorted(templates.items())}
    ratio = (2 - threshold) / threshold
    most = max(map(len, known.values())) * ratio
    # In the literal: the bigrams, and the bounds that they set.
    literal = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, b)).alias("bigrams"), F.lit(len(b) / ratio).alias("lo"), F.lit(len(b) * ratio).alias("hi"))
            for name, b in known.items()
            if b
        ]
    )
    lines = F.split(F.col(text_col).cast("string"), "\n")
    both = F.when(F.size(lines) > 1, F.concat(lines, F.array(F.col(text_col).cast("string")))).otherwise(lines)
    parts = docs.select(F.col(id_col).alias("id"), F.explode(both).alias("part"))
    # What a filter or a lambda reads many times must be made once: an exploded array of one struct keeps the optimizer from copying it there.
    once = lambda column, name: F.explode(F.array(column)).alias(name)
    words = parts.select("id", once(F.split(normal_form(F.col("part")), " "), "words"))
    # Repeated bigrams make a text seem larger than it is, so a text is too large only if its different words are too many.
    words = words.where((F.size("words") >= 2) & ((F.size("words") - 1 <= most) | (F.size(F.array_distinct("words")) - 1 <= most)))
    grams = words.select("id", once(bigrams("words"), "b"))
    fitting = grams.select("id", "b", once(F.size("b"), "n")).select("id", "b", "n", once(F.filter(literal, lambda t: F.col("n").between(t["lo"], t["hi"])), "fitting"))
    dice = lambda t: (F.lit(2.0) * F.size(F.array_intersect(F.col("b"), t["bigrams"]))) / (F.col("n") + F.size(t["bigrams"]))
    scores = F.transform("fitting", lambda t: F.struct(dice(t).alias("dice"), t["name"].alias("name")))
    scored = fitting.where(F.size("fitting") > 0).select("id", once(scores, "scores"))
    best = F.reduce(
        "scores",
        F.struct(F.lit(-1.0).alias("dice"), F.lit("").alias("name")),
        lambda acc, x: F.when(x["dice"] > acc["dice"], x).otherwise(acc),
    )
    found = scored.select("id", once(best, "best")).where(F.col("best.dice") >= threshold)
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    lines = found.select("id", "best.name", "best.dice", F.lit(1).alias("part"))
    every = lines.unionByName(passages(rows, templates, threshold).withColumn("part", F.lit(0)))
    counted = every.groupBy("id", F.col("name").alias("licence")).agg(F.max("dice").alias("dice"), F.sum("part").alias("parts"))
    beside = F.collect_set("licence").over(Window.partitionBy("id"))
    hides = [(F.col("licence") == name) & F.arrays_overlap("beside", F.array(*map(F.lit, others))) for name, others in larger(templates).items() if others]
    hidden = (F.col("parts") == 0) & reduce(lambda a, b: a | b, hides, F.lit(False))
    kept = counted.withColumn("beside", beside).where(~hidden)
    return kept.select(F.col("id").alias(id_col), "licence", "dice", F.greatest("parts", F.lit(1)).alias("n_found"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(table(spark, sf_dir, "documents"))


def _quoted(texts: Iterable[str]) -> str:
    return ", ".join("'" + s.replace("'", "''") + "'" for s in texts)


def _sql_templates() -> str:
    return ", ".join(f"({_quoted([name])}, [{_quoted(template_bigrams(text))}], {len(template_words(text))})" for name, text in sorted(TEMPLATES.items()))


_PLAIN = r"string_split(trim(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
_GRAMS = "list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"

OP6_SQL = rf"""
WITH template(name, tb, words) AS (VALUES {_sql_templates()}),
part AS (SELECT doc_id, unnest(CASE WHEN contains(text, chr(10)) THEN list_append(string_split(text, chr(10)), text) ELSE [text] END) AS p
         FROM documents WHERE text IS NOT NULL),
word AS (SELECT row_number() OVER () AS part, doc_id, {_PLAIN.format(text='p')} AS w FROM part),
gram AS (SELECT part, doc_id, {_GRAMS.format(w='w')} AS b FROM word WHERE len(w) >= 2),
score AS (SELECT part, doc_id, name, 2.0::DOUBLE * len(list_intersect(b, tb)) / (len(b) + len(tb)) AS dice
          FROM gram JOIN template ON len(b) BETWEEN len(tb) / 1.5 AND len(tb) * 1.5),
best AS (SELECT * FROM score QUALIFY row_number() OVER (PARTITION BY part ORDER BY dice DESC, name) = 1),
whole AS (SELECT row_number() OVER () AS doc, doc_id, {_PLAIN.format(text='text')} AS w FROM documents WHERE text IS NOT NULL),
own AS (SELECT doc, unnest({_GRAMS.format(w='w')}) AS g FROM whole WHERE len(w) >= 2),
tgram AS (SELECT name, len(tb) AS n, unnest(tb) AS g FROM template),
likely AS (SELECT doc, name FROM own JOIN tgram USING (g) GROUP BY doc, name, n HAVING count(*) * 3 >= n * 2),
start AS (SELECT doc, doc_id, name, tb, words, w, unnest(range(1, len(w))) AS pos FROM likely JOIN whole USING (doc) JOIN template USING (name)),
cut AS (SELECT doc, doc_id, name, tb, pos, w[pos : pos + words - 1] AS v FROM start WHERE list_contains(tb, w[pos] || ' ' || w[pos + 1])),
cutgram AS (SELECT doc, doc_id, name, tb, pos, {_GRAMS.format(w='v')} AS b FROM cut),
passage AS (SELECT doc, doc_id, name, pos, 2.0::DOUBLE * len(list_intersect(b, tb)) / (len(b) + len(tb)) AS dice FROM cutgram),
place AS (SELECT * FROM passage WHERE dice >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc, pos ORDER BY dice DESC, name) = 1),
every AS (SELECT doc_id, name, dice, 1 AS part FROM best WHERE dice >= 0.8 UNION ALL SELECT doc_id, name, dice, 0 FROM place),
found AS (SELECT doc_id, name, max(dice) AS dice, sum(part)::BIGINT AS parts FROM every GROUP BY doc_id, name),
larger(name, other) AS (VALUES {", ".join(f"({_quoted([name])}, {_quoted([other])})" for name, others in larger(TEMPLATES).items() for other in others)})
SELECT doc_id, name AS licence, dice, greatest(parts, 1) AS n_found FROM found f WHERE parts > 0 OR NOT EXISTS (
    SELECT 1 FROM larger l JOIN found o ON o.name = l.other WHERE l.name = f.name AND o.doc_id IS NOT DISTINCT FROM f.doc_id)
"""
