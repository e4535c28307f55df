"""Operator 1: licence notices by the Dice coefficient over word bigrams.

Units of a text (its lines, its paragraphs of several lines, the whole text if it has several
paragraphs, its sentences, and windows over as many consecutive sentences as a template has) and
licence templates are normalised to lower-case words of a-z and 0-9. Windows find notices inside a
paragraph and comments that code follows. A unit matches
the template with which ``2 * common / (bigrams of one + bigrams of the other)`` is largest, if that
is at least ``DICE``. Two sets of very different size can't reach it, so each unit is compared only
with templates whose size lies within the bounds that follow from ``DICE``.

Native: DataFrame functions only, one map over the documents without a shuffle. Texts, and then
units, without any of the templates' marking words are left out; the words are chosen so that no
match can be without one.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least Dice coefficient of a match.
DICE = 0.8

#: Licence notices and texts as published, by SPDX identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        'portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
        "implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with "
        "this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
        "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
        "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software "
        "to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend "
        "this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
]

#: Fixed value: short words that mark nothing.
COMMON = set("a an and any as at be by for if in is it no not of on or so that the this to was will with you".split())

#: What ends a sentence.
SENTENCE = "[.!?][ \\t\\r\\n]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))


def bigrams_of(text: str) -> set[str]:
    words = words_of(text)
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def window_sizes(templates: list[tuple[str, str]]) -> list[int]:
    """Numbers of sentences that templates have, with and without the numbers of their clauses, which end like sentences."""
    forms = [form for _, text in templates for form in (text, re.sub(r"(?<![a-z0-9.])[0-9]+\. ", "", text))]
    return sorted({1} | {len(re.split(SENTENCE, form)) for form in forms})


def marking_words(templates: list[tuple[str, str]], dice: float = DICE) -> list[str]:
    """Words of which every match with any template has at least one.

    A match shares at least ``dice / (2 - dice)`` of the template's bigrams. Words are taken, those
    that the most templates' bigrams need first, until fewer bigrams than that are left without one.
    """
    left = [[b for b in sorted(bigrams_of(t)) if len(bigrams_of(t))] for _, t in templates]
    need = [ceil(len(b) * dice / (2 - dice) - 1e-9) for b in left]
    # Long words are rare in running text.
    weight = lambda w: 0.01 if w in COMMON else min(len(w), 12) ** 4
    chosen: list[str] = []
    while open_ := [i for i, b in enumerate(left) if b and len(b) >= need[i]]:
        gain: dict[str, float] = {}
        for i in open_:
            for b in left[i]:
                for w in set(b.split(" ")):
                    gain[w] = gain.get(w, 0) + weight(w) / len(left[i])
        best = max(sorted(gain), key=gain.get)
        chosen.append(best)
        left = [[b for b in rest if best not in b.split(" ")] for rest in left]
    return sorted(chosen)


def any_word(words: list[str]) -> str:
    """A pattern of any of the words, grouped by first letter so that few branches are tried at a place."""
    starts = sorted({w[0] for w in words})
    branches = [f"{c}(?:{'|'.join(re.escape(w[1:]) for w in words if w[0] == c)})" for c in starts]
    return f"(?<![a-z0-9])(?=[{''.join(starts)}])(?:{'|'.join(branches)})(?![a-z0-9])"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " "))


def once(value: Column) -> Column:
    """The value as a row's own column: later expressions and lambdas use it instead of computing it again."""
    return F.explode(F.array(value))


def units(text: Column) -> Column:
    """The text's units, as an array of ``(unit, place, content)``."""
    place = lambda name, parts: F.transform(parts, lambda x, i: F.struct(F.lit(name).alias("unit"), i.alias("place"), x.alias("content")))
    paragraphs = F.split(text, "\n[ \t\r]*\n")
    several = F.filter(place("paragraph", paragraphs), lambda u: F.contains(u["content"], F.lit("\n")))
    whole = F.when(F.size(paragraphs) > 1, place("text", F.array(text))).otherwise(F.array().cast("array<struct<unit:string,place:int,content:string>>"))
    return F.concat(place("line", F.split(text, "\n")), several, whole)


def windows(parts: Column, marked: Column, n: int) -> Column:
    """Windows of ``n`` sentences of which at least one is marked, as an array of ``(unit, place, content)``."""
    starts = F.when(F.size(parts) >= n, F.sequence(F.lit(0), F.size(parts) - n)).otherwise(F.array().cast("array<int>"))
    # Single entries: slice() copies the whole array each time.
    starts = F.filter(starts, lambda i: reduce(Column.__or__, [F.get(marked, i + k) for k in range(n)]))
    name = "sentence" if n == 1 else f"sentences-{n}"
    return F.transform(starts, lambda i: F.struct(F.lit(name).alias("unit"), i.alias("place"), F.concat_ws(" ", *[F.get(parts, i + k) for k in range(n)]).alias("content")))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, dice: float = DICE) -> DataFrame:
    """One row for each unit of a document that matches a template.

    Columns: doc_id, unit (line, paragraph, text, sentence, or sentences-n for n in
    :func:`window_sizes`), place (from 0, among units of its kind),
    license, shared, unit_bigrams, template_bigrams, dice. A notice may be reported by several of
    its units. Equal coefficients go to the template listed first. Very long texts are cut into units like
    any others, the work grows with their length; extra columns are left out. Null and empty texts match nothing, units and templates of fewer than two words
    have no bigrams and match nothing; repeated rows are scanned like any others; an empty table
    gives an empty result.
    """
    templates = TEMPLATES if templates is None else templates
    listed = [(i, name, sorted(bigrams_of(text))) for i, (name, text) in enumerate(templates) if bigrams_of(text)]
    out_of = 2 - dice
    rows = docs.select("doc_id", "text").where("text is not null")
    marks = marking_words([t for t in templates if bigrams_of(t[1])], dice)
    marked = lambda text: F.translate(text, UPPER, LOWER).rlike(any_word(marks)) if marks else F.lit(True)
    rows = rows.where(marked(F.col("text")))
    rows = rows.select("doc_id", "text", once(F.split("text", SENTENCE)).alias("parts"))
    rows = rows.select("*", once(F.transform("parts", marked)).alias("marked"))
    spans = [windows(F.col("parts"), F.col("marked"), n) for n in window_sizes(templates)]
    blocks = F.filter(units(F.col("text")), lambda u: marked(u["content"]))
    rows = rows.select("doc_id", F.explode(F.concat(blocks, *spans)).alias("u"))
    rows = rows.select("doc_id", "u.unit", "u.place", once(F.split(normal(F.col("u.content")), " ")).alias("words"))
    # More distinct bigrams than words less one can't be; fewer can, so only the upper bound needs the set itself.
    least = min((len(b) for _, _, b in listed), default=0) * dice / out_of
    rows = rows.where((F.size("words") >= 2) & (F.size("words") - 1 >= F.lit(least - 1e-9)))
    bigrams = F.expr("array_distinct(transform(sequence(0, size(words) - 2), i -> words[i] || ' ' || words[i + 1]))")
    rows = rows.select("doc_id", "unit", "place", once(bigrams).alias("bigrams")).withColumn("n", F.size("bigrams"))
    if not listed:
        rows = rows.where(F.lit(False))
        listed = [(0, "", [""])]
    known = F.from_json(
        F.lit(json.dumps([{"at": i, "license": name, "size": len(b), "bigrams": b} for i, name, b in listed])),
        "array<struct<at:int,license:string,size:int,bigrams:array<string>>>",
    )
    near = F.filter(known, lambda t: (t["size"] * dice <= F.col("n") * out_of + 1e-9) & (F.col("n") * dice <= t["size"] * out_of + 1e-9))
    rows = rows.select("*", once(near).alias("near")).where(F.size("near") > 0)
    scored = F.transform(
        "near",
        lambda t: F.struct(
            (2.0 * F.size(F.array_intersect(t["bigrams"], F.col("bigrams"))) / (t["size"] + F.col("n"))).alias("dice"),
            (-t["at"]).alias("order"),
            t["license"].alias("license"),
            F.size(F.array_intersect(t["bigrams"], F.col("bigrams"))).alias("shared"),
            t["size"].alias("template_bigrams"),
        ),
    )
    rows = rows.select("doc_id", "unit", "place", "n", once(F.array_max(scored)).alias("best")).where(F.col("best.dice") >= dice)
    return rows.select("doc_id", "unit", "place", "best.license", "best.shared", F.col("n").alias("unit_bigrams"), "best.template_bigrams", F.round("best.dice", 6).alias("dice"))


def oracle_sql(templates: list[tuple[str, str]] | None = None, dice: float = DICE) -> str:
    """The same result in DuckDB SQL, pruned otherwise: of texts that hold enough of a template's bigrams anywhere, those of all units are joined with all templates'."""
    templates = TEMPLATES if templates is None else templates
    values = ",\n".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(templates))
    parts = "(select r, doc_id, len(ss) as total, unnest(range(1, len(ss) + 1)) as i, unnest(ss) as s from (select r, doc_id, regexp_split_to_array(text, '[.!?][ \\t\\r\\n]+') as ss from d))"
    spans = " union all ".join(
        f"select r, doc_id, total, i, {n} as n, string_agg(s, ' ') over (partition by r order by i rows between current row and {n - 1} following) as body from {parts}" for n in window_sizes(templates)
    )
    words = lambda x: f"string_split(trim(regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ')"
    pair = "unnest(w[1:len(w) - 1]) as x, unnest(w[2:len(w)]) as y"
    return f"""
with template(at_, license, body) as (values {values}),
t as (select distinct at_, license, x || ' ' || y as b from (select at_, license, {pair} from (select *, {words('body')} as w from template) where len(w) > 1)),
tg as (select *, count(*) over (partition by at_) as tn from t),
a as materialized (select row_number() over () as r, doc_id, text from documents where text is not null),
ag as (select distinct r, x || ' ' || y as b from (select r, {pair} from (select *, {words('text')} as w from a) where len(w) > 1)),
enough as (select r from ag join tg using (b) group by r, at_, tn having count(*) >= tn * {dice} / (2 - {dice}) - 1e-9),
d as materialized (select * from a where r in (select r from enough)),
p as (select r, doc_id, text, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') as ps from d),
z as ({spans}),
u as (
  select r, doc_id, 'line' as unit, unnest(range(0, len(ls))) as place, unnest(ls) as content from (select r, doc_id, string_split(text, chr(10)) as ls from d)
  union all select * from (select r, doc_id, 'paragraph' as unit, unnest(range(0, len(ps))) as place, unnest(ps) as content from p) where contains(content, chr(10))
  union all select r, doc_id, 'text', 0, text from p where len(ps) > 1
  union all select r, doc_id, case when n = 1 then 'sentence' else 'sentences-' || n end, i - 1, body from z where i + n - 1 <= total
),
n as (select distinct r, doc_id, unit, place, x || ' ' || y as b from (select r, doc_id, unit, place, {pair} from (select *, {words('content')} as w from u) where len(w) > 1)),
ug as (select *, count(*) over (partition by r, unit, place) as un from n),
c as (select r, doc_id, unit, place, license, at_, un, tn, count(*) as shared from ug join tg using (b) group by all),
s as (select *, cast(2 * shared as double) / (un + tn) as dice from c),
best as (select *, row_number() over (partition by r, unit, place order by dice desc, at_) as k from s where dice >= {dice})
select doc_id, unit, cast(place as int) as place, license, cast(shared as int) as shared, cast(un as int) as unit_bigrams, cast(tn as int) as template_bigrams, round(dice, 6) as dice
from best where k = 1
"""
