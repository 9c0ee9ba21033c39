"""License scan with built-in functions only: Dice coefficient over word bigrams.

A text is compared as a whole, by paragraphs, by lines and by sentences. Each such unit
is normalised to lower-case words. A unit is compared only with the templates whose
number of bigrams lets the coefficient reach the threshold; a unit or a text without any
word that a match must hold is passed over before that. Both steps lose no match.

A licence text may also span several lines and paragraphs of a larger text: for the long
templates all spans of consecutive lines are compared, in texts that hold enough of a
template's bigrams for any span to match.
"""

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.common import table

THRESHOLD = 0.75
# Templates of so many bigrams are looked for in spans of lines; shorter ones are notices of one line.
LONG = 30

# Public license texts and the notices that name them.
NOTICES = {
    "MIT": "MIT License",
    "Apache-2.0": "Apache License, Version 2.0",
    "GPL-2.0": "GNU General Public License, version 2",
    "GPL-3.0": "GNU General Public License, version 3",
    "LGPL-3.0": "GNU Lesser General Public License, version 3",
    "AGPL-3.0": "GNU Affero General Public License, version 3",
    "MPL-2.0": "Mozilla Public License, Version 2.0",
    "BSD-3-Clause": "BSD 3-Clause License",
    "CC-BY-4.0": "CC BY 4.0",
    "CC-BY-SA-4.0": "CC BY-SA 4.0",
    "CC-BY-NC-4.0": "CC BY-NC 4.0",
}
PHRASES = ("Licensed under {the}{name}", "Released under {the}{name}", "This work is licensed under {the}{name}")
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details. You should have received a copy of the GNU General Public License along with this program. If
not, see https://www.gnu.org/licenses/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
any purpose, commercial or non-commercial, and by any means.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}


def templates() -> list:
    """(license, text) of all templates."""
    out = list(TEXTS.items())
    for license, name in NOTICES.items():
        the = "" if name.startswith("CC") else "the "
        out += [(license, phrase.format(the=the, name=name)) for phrase in PHRASES]
    return out


def normal(text: str) -> list:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigrams(words: list) -> list:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def least_shared(count: int, threshold: float) -> int:
    """Fewest bigrams any match shares with a template of ``count`` bigrams: it has at least t / (2 - t) as many."""
    return max(1, math.ceil(threshold / (2 - threshold) * count - 1e-9))


def needed_words(grams: list, threshold: float) -> list:
    """Words of which every match holds one: they cover more bigrams than a match may lack."""
    open_grams, free = set(grams), len(grams) - least_shared(len(grams), threshold)
    chosen: list = []
    while len(grams) - len(open_grams) <= free:
        words = {w for g in open_grams for w in g.split()}
        covered = lambda w: sum(w in g.split() for g in open_grams)
        best = min(words, key=lambda w: (-covered(w) * len(w) ** 2, w))
        chosen.append(best)
        open_grams = {g for g in open_grams if best not in g.split()}
    return chosen


def units(text: Column) -> Column:
    """The whole text, its paragraphs, lines and sentences."""
    sentences = F.regexp_replace(text, r"([.!?;:])[\x20\x09]+", "$1\n")
    return F.array_distinct(F.concat(
        F.array(text), F.split(text, r"\n[\x20\x09\r]*\n+"), F.split(text, "\n+"), F.split(sentences, "\n+")))


def _pairs(w: Column) -> Column:
    return F.array_distinct(F.array_compact(F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))))


def _best_span(lines: Column, t: Column) -> Column:
    """Highest coefficient of template ``t`` with any span of consecutive lines, given as arrays of words.

    A span of the highest coefficient begins at a line that holds, with the next one, a bigram of
    the template. From each such line on, the span grows until it is too large for a match.
    """
    strings = F.expr("CAST(array() AS array<string>)")
    begins = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda k: F.size(F.array_intersect(
        _pairs(F.flatten(F.slice(lines, k, F.lit(2)))), t["grams"])) > 0)
    state = lambda grams, last, best, over: F.struct(grams.alias("grams"), last.alias("last"), best.alias("best"), over.alias("over"))
    dice = lambda g: F.when(F.size(g) <= t["hi"], F.round(2 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + t["n"]), 6)).otherwise(F.lit(0.0))

    def grown(acc, line):
        more = F.array(F.array_union(acc["grams"], _pairs(F.concat(acc["last"], line))))
        return F.when(acc["over"], acc).otherwise(F.get(F.transform(more, lambda g: state(
            g, F.slice(line, -1, 1), F.greatest(acc["best"], dice(g)), F.size(g) > t["hi"])), F.lit(0)))

    start = state(strings, strings, F.lit(0.0), F.lit(False))
    spans = F.transform(begins, lambda k: F.aggregate(F.slice(lines, k, F.size(lines)), start, grown, lambda acc: acc["best"]))
    return F.coalesce(F.array_max(spans), F.lit(0.0))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", given: list | None = None,
         threshold: float = THRESHOLD) -> DataFrame:
    """Licenses of every whole text.

    Returns one row per row of ``docs``: the id, ``license`` (of the best match, ties to
    the first in code point order; null without a match), ``dice`` (its coefficient, six
    digits, else null), ``n_matches`` (units and templates that reach the threshold; of the
spans of lines the best of a long template, if it exceeds the license's units) and
    ``licenses`` (all found, sorted, comma-joined). Templates with fewer than two words are
    refused. A null or empty text has no match; ids pass through, null and repeated ones
    too; other columns are left out.
    """
    given = templates() if given is None else given
    made = [(name, bigrams(normal(text))) for name, text in given]
    if not made or not all(g for _, g in made):
        raise ValueError("each template needs two words at least")
    ratio = threshold / (2 - threshold)
    rows = [{"license": name, "n": len(g), "grams": g, "lo": len(g) * ratio - 1e-9, "hi": len(g) / ratio + 1e-9} for name, g in made]
    shape = "array<struct<license:string,n:int,grams:array<string>,lo:double,hi:double>>"
    known = F.from_json(F.lit(json.dumps(rows)), shape)
    some = sorted({w for _, g in made for w in needed_words(g, threshold)})
    holds = rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(map(re.escape, some))})(?![\p{{L}}\p{{N}}])"
    text = F.coalesce(text_col, F.lit(""))
    out = docs.select(F.col(id_col).alias("id"), F.when(text.rlike(holds), text).alias("text"))
    least, most = min(r["lo"] for r in rows), max(r["hi"] for r in rows)
    clean = lambda u: F.trim(F.regexp_replace(F.lower(u), r"[^\p{L}\p{N}]+", " "))
    none = F.expr("CAST(array() AS array<string>)")
    out = out.withColumn("units", F.when(F.col("text").isNotNull(), F.array_distinct(
        F.transform(F.filter(units(F.col("text")), lambda u: u.rlike(holds)), clean))).otherwise(none))
    out = out.withColumn("words", F.transform("units", lambda u: F.split(u, " "))).drop("units")
    out = out.withColumn("grams", F.transform("words", _pairs)).drop("words")
    fits = F.filter("grams", lambda g: F.size(g).between(least, most))
    compared = lambda g: F.transform(
        F.filter(known, lambda t: F.size(g).between(t["lo"], t["hi"])),
        lambda t: F.struct(F.round(2 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + t["n"]), 6).alias("dice"),
                           t["license"].alias("license")))
    out = out.withColumn("hits", F.filter(F.flatten(F.transform(fits, compared)), lambda h: h["dice"] >= threshold))
    long = [r for r in rows if r["n"] >= LONG]
    if long:
        # The first unit is the whole text; a span's bigrams are among its bigrams.
        every = F.from_json(F.lit(json.dumps(sorted({g for r in long for g in r["grams"]}))), "array<string>")
        out = out.withColumn("some", F.array_intersect(F.get("grams", F.lit(0)), every))
        out = out.withColumn("likely", F.when(F.size("some") >= min(r["lo"] for r in long), F.filter(
            F.from_json(F.lit(json.dumps(long)), shape), lambda t: F.size(F.array_intersect("some", t["grams"])) >= t["lo"])))
        lines = F.transform(F.filter(F.transform(F.split("text", "\n+"), clean), lambda l: l != ""), lambda l: F.split(l, " "))
        out = out.withColumn("lines", F.when(F.size("likely") > 0, lines))
        spans = F.transform("likely", lambda t: F.struct(_best_span(F.col("lines"), t).alias("dice"), t["license"].alias("license")))
        better = F.filter(spans, lambda s: (s["dice"] >= threshold) & ~F.exists(
            "hits", lambda h: (h["license"] == s["license"]) & (h["dice"] >= s["dice"])))
        out = out.withColumn("hits", F.when(F.size("likely") > 0, F.concat("hits", better)).otherwise(F.col("hits")))
    out = out.select("id", "hits")
    best = F.array_min(F.transform("hits", lambda h: F.struct((-h["dice"]).alias("d"), h["license"].alias("license"))))
    return out.select(
        "id", best["license"].alias("license"), (-best["d"]).alias("dice"), F.size("hits").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["license"]))), ",").alias("licenses"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _oracle() -> str:
    """All units against all templates, without pruning."""
    values = ", ".join("({}, {})".format(*["'" + x.replace("'", "''") + "'" for x in t]) for t in templates())
    clean = lambda c: f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    grams = lambda w: f"list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    return f"""WITH t AS (SELECT license, {grams('w')} AS g FROM (SELECT license, string_split({clean('x')}, ' ') AS w
  FROM (VALUES {values}) v(license, x))),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
u AS (SELECT doc_id, t AS x FROM d UNION SELECT doc_id, unnest(string_split_regex(t, '\\n[ \\t\\r]*\\n+')) FROM d
  UNION SELECT doc_id, unnest(string_split_regex(t, '\\n+')) FROM d
  UNION SELECT doc_id, unnest(string_split_regex(regexp_replace(t, '([.!?;:])[ \\t]+', '\\1\n', 'g'), '\\n+')) FROM d),
n AS (SELECT DISTINCT doc_id, {clean('x')} AS x FROM u),
b AS (SELECT doc_id, {grams('w')} AS g FROM (SELECT doc_id, string_split(x, ' ') AS w FROM n)),
h AS (SELECT doc_id, license, round(2.0 * len(list_intersect(b.g, t.g)) / (len(b.g) + len(t.g)), 6) AS dice FROM b, t),
s AS (SELECT doc_id, count(*) AS n, max(dice) AS dice, arg_min(license, (-dice, license)) AS license,
  string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM h WHERE dice >= {THRESHOLD} GROUP BY doc_id)
SELECT doc_id, license, dice::DOUBLE AS dice, coalesce(n, 0) AS n_matches, coalesce(licenses, '') AS licenses FROM d LEFT JOIN s USING (doc_id)"""


ORACLE = _oracle()
