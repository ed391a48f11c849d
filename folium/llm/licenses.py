"""Licence scans: passages compared with licence templates by the Dice coefficient over word bigrams.

Words are runs of letters and digits of the lower-cased text. With bags of
bigrams A and B, Dice = 2 |A and B| / (|A| + |B|), which can reach t only if
t / (2 - t) <= |A| / |B| <= (2 - t) / t. The word count of a passage gives |A|,
so templates of other sizes are pruned by an equi-join on the size.

A passage is the whole text, a block between blank lines, a line, or the window
that suits a template best: of all runs of words that begin and end with bigrams
of the template, that have an admissible size and hold enough of its different
bigrams, the one with the most of them for its size. That finds notices that
are wrapped or stand inside other text, whatever stands around them. A passage
that reaches t shares at least |B| t / (2 - t) bigrams with the template, so it
holds one of the template's anchors, the longest of its bigrams, as many as
leave fewer than that. A text without an anchor is left after one pass, and
windows are sought around anchors alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import cut
from folium.llm.decontam import with_bag
from folium.llm.rules import once

#: The clauses that licence bodies share.
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Short notices by which works state their licence, and the bodies of the common short licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-2-Clause", f"{BSD_HEAD} {BSD_TAIL}"),
    ("BSD-3-Clause", f"{BSD_HEAD} {BSD_THIRD} {BSD_TAIL}"),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)

THRESHOLD = 0.8
#: Template rows (one for each admissible size) that may be broadcast.
BROADCAST_ROWS = 200_000


def template_table(spark: SparkSession, rows=TEMPLATES) -> DataFrame:
    return spark.createDataFrame([(k, i, t) for i, (k, t) in enumerate(rows)], "license string, template int, template_text string")


def normal(text: Column) -> Column:
    """Lower case; anything but letters, digits and line ends becomes a space."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")


def passage_words(passage: Column) -> Column:
    trimmed = squeezed(passage)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, " "))


def bigrams(words: Column) -> Column:
    """Hashes of all neighbouring word pairs, repeats included."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.xxhash64(F.slice(words, i, 2)))


def anchored(templates: DataFrame, low: float, high: float) -> DataFrame:
    """``templates`` with the sizes that a window may have, the different bigrams that it needs, all of them, and the anchors.

    Bigrams are ranked by length: long ones are rare in any text.
    """
    pair = lambda i: F.concat_ws(" ", F.slice("tw", i, 2))
    by_length = F.transform(F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("tw") - 1), lambda i: F.struct((-F.length(pair(i))).alias("l"), F.xxhash64(F.slice("tw", i, 2)).alias("h"))))), lambda x: x["h"])
    least = F.ceil(F.col("n") * low - 1e-9).cast("int")
    rows = templates.withColumns({"all": by_length, "least": F.greatest(least, F.lit(1)), "most": F.floor(F.col("n") * high + 1e-9).cast("int")})
    rows = rows.withColumn("need", F.greatest(F.col("least") - F.col("n") + F.size("all"), F.lit(1)))
    return rows.withColumn("anchors", F.slice("all", F.lit(1), F.size("all") - F.col("need") + 1))


def best_window(template: Column) -> Column:
    """Start and size (in bigrams, from 1) of the window of a text that suits a template best; null where there is none.

    The text has ``hashes`` of its bigrams and the places of anchors ``at``.
    """
    h = lambda i: F.element_at("hashes", i)
    near = F.filter("at", lambda i: F.array_contains(template["anchors"], h(i)))
    reach = F.array_sort(F.array_distinct(F.flatten(F.transform(near, lambda x: F.sequence(F.greatest(x - template["most"] + 1, F.lit(1)), F.least(x + template["most"] - 1, F.size("hashes")))))))
    hits = F.filter(reach, lambda i: F.array_contains(template["all"], h(i)))
    none = F.array().cast("array<int>")

    def ends(place: Column, i: Column) -> Column:
        last = F.least(F.size(hits) - 1, i + template["most"] - 1)
        first = i + template["need"] - 1
        inside = F.filter(F.when(first <= last, F.sequence(first, last)).otherwise(none), lambda j: (F.get(hits, j) - place + 1).between(template["least"], template["most"]))

        def scored(j: Column) -> Column:
            size = F.get(hits, j) - place + 1
            kinds = F.size(F.array_distinct(F.transform(F.slice(hits, i + 1, j - i + 1), h)))
            return F.when(kinds >= template["need"], F.struct((kinds * F.lit(2.0) / (size + template["n"])).alias("score"), (-size).alias("size"), (-place).alias("start")))

        return F.array_compact(F.transform(inside, scored))

    return F.array_max(F.flatten(F.transform(hits, ends)))


def squeezed(passage: Column) -> Column:
    return F.btrim(F.regexp_replace(passage, r"[ \n]+", " "), F.lit(" "))


def scan(docs: DataFrame, templates: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows ``doc_id``, ``license``, ``template``, ``passage_words``, ``dice``: passages at or over ``threshold``.

    A passage that stands several times in one text counts once; equal passages
    of several rows (repeated rows included) give a row each. Null, empty and
    one-word passages match nothing. Very long texts are only long passages,
    which the size bound prunes. Of several places in one text that suit a
    template inside other text, the best counts. Other columns are ignored.
    """
    made = once(templates, "tw", passage_words(normal(F.col("template_text")))).filter(F.size("tw") > 1)
    made = cut(with_bag(once(made, "th", bigrams(F.col("tw"))), "th", "tb").select("license", "template", "th", "tb", F.size("th").alias("n")))
    # a template table is small by contract: its bigrams stand as one set of literals in the filter
    known = [r[0] for r in made.select(F.explode("th")).distinct().collect()]
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    shapes = cut(anchored(once(templates, "tw", passage_words(normal(F.col("template_text")))).filter(F.size("tw") > 1).withColumn("n", F.size("tw") - 1), low, high).select("n", "least", "most", "need", "all", "anchors"))
    anchors = [r[0] for r in shapes.select(F.explode("anchors")).distinct().collect()]
    admissible = F.sequence(F.greatest(F.ceil(F.col("n") * low - 1e-9), F.lit(1)), F.floor(F.col("n") * high + 1e-9))
    sized = cut(made.select("template", "n", F.explode(admissible.cast("array<int>")).alias("size")))
    n_sized, widest = sized.agg(F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(0))).first()
    body = once(docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body")), "t", normal(F.col("body"))).select("id", "t")
    body = once(body, "w", passage_words(F.col("t"))).filter(F.size("w") > 1)
    body = once(body, "hashes", bigrams(F.col("w")))
    body = once(body, "at", F.filter(F.sequence(F.lit(1), F.size("hashes")), lambda i: F.element_at("hashes", i).isin(anchors))).filter(F.size("at") > 0)
    body = body.join(F.broadcast(shapes.agg(F.collect_list(F.struct(*shapes.columns)).alias("shapes"))), F.lit(True))
    suited = F.filter("shapes", lambda x: F.arrays_overlap(x["anchors"], F.transform("at", lambda i: F.element_at("hashes", i))))
    body = once(body, "windows", F.array_compact(F.transform(suited, best_window))).drop("shapes", "hashes", "at")
    runs = F.transform("windows", lambda x: F.array_join(F.slice("w", -x["start"], 1 - x["size"]), " "))
    blocks, lines = F.split("t", r"\n *\n"), F.split("t", "\n")
    passages = F.array_distinct(F.concat(F.transform(F.concat(F.array("t"), blocks, lines), squeezed), runs))
    units = body.select("id", F.explode(passages).alias("passage")).filter("passage <> ''")
    units = once(units, "w", F.split("passage", " ")).select("id", "w", (F.size("w") - 1).alias("size")).filter(F.col("size").between(1, widest))
    units = once(units, "hashes", bigrams(F.col("w"))).drop("w")
    # at the threshold a passage shares low times its size with a template, so as many of its bigrams are known
    units = with_bag(units.filter(F.size(F.filter("hashes", lambda x: x.isin(known))) >= F.col("size") * low - 1e-9), "hashes", "b")
    pairs = units.join(F.broadcast(sized) if n_sized <= BROADCAST_ROWS else sized, "size").join(F.broadcast(made.select("license", "template", "tb")), "template")
    dice = F.size(F.array_intersect("b", "tb")) * F.lit(2.0) / (F.col("size") + F.col("n"))
    return pairs.select(F.col("id").alias(doc_id), "license", "template", (F.col("size") + 1).alias("passage_words"), F.round(dice, 6).alias("dice")).filter(F.col("dice") >= threshold)


ORACLE_SQL = """
WITH templates(license, template, template_text) AS (VALUES {values}),
norm AS (SELECT license, template, trim(regexp_replace(lower(template_text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS t FROM templates),
tpl AS (SELECT license, template, string_split(t, ' ') AS w FROM norm),
tbag AS (SELECT template, b, count(*) AS c FROM (SELECT template, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM tpl) GROUP BY ALL),
body AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS t FROM documents),
flat AS (SELECT r, doc_id, string_split(trim(regexp_replace(t, '[ \\n]+', ' ', 'g')), ' ') AS w FROM body),
kinds AS (SELECT DISTINCT template, b FROM tbag),
shape AS (SELECT template, n, ceil(n * 0.8 / 1.2 - 1e-9) AS least, floor(n * 1.2 / 0.8 + 1e-9) AS most, greatest(ceil(n * 0.8 / 1.2 - 1e-9) - n + kinds, 1) AS need FROM (SELECT template, sum(c) AS n, count(*) AS kinds FROM tbag GROUP BY template)),
hits AS (SELECT r, template, i, b, row_number() OVER (PARTITION BY r, template ORDER BY i) AS o FROM (SELECT r, unnest(range(1, len(w))) AS i, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM flat) JOIN kinds USING (b)),
spans AS (SELECT x.r, template, x.i AS a, y.i AS z, x.o AS oa, y.o AS oz, n, need FROM shape JOIN hits x USING (template) JOIN hits y USING (r, template) WHERE y.o - x.o + 1 BETWEEN need AND most AND y.i - x.i + 1 BETWEEN least AND most),
filled AS (SELECT s.r, s.template, a, z, n, need, count(DISTINCT b) AS kinds FROM spans s JOIN hits h ON h.r = s.r AND h.template = s.template AND h.o BETWEEN s.oa AND s.oz GROUP BY ALL),
runs AS (SELECT r, a, z FROM filled WHERE kinds >= need QUALIFY row_number() OVER (PARTITION BY r, template ORDER BY kinds * 2.0::DOUBLE / (z - a + 1 + n) DESC, z - a, a) = 1),
units AS (SELECT r, doc_id, unnest(list_concat([t], regexp_split_to_array(t, '\\n *\\n'), string_split(t, chr(10)))) AS p FROM body UNION ALL SELECT r, doc_id, array_to_string(w[a : z + 1], ' ') FROM runs JOIN flat USING (r)),
words AS (SELECT row_number() OVER () AS u, doc_id, string_split(q, ' ') AS w FROM (SELECT DISTINCT r, doc_id, trim(regexp_replace(p, '[ \\n]+', ' ', 'g')) AS q FROM units) WHERE q <> ''),
cand AS (SELECT u, doc_id, len(w) - 1 AS n, w FROM words WHERE len(w) > 1 AND len(w) - 1 <= (SELECT max(len(w) - 1) * 1.5 FROM tpl)),
ubag AS (SELECT u, b, count(*) AS c FROM (SELECT u, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM cand) GROUP BY ALL),
common AS (SELECT u, template, sum(least(ubag.c, tbag.c)) AS k FROM ubag JOIN tbag USING (b) GROUP BY ALL)
SELECT doc_id, license, template, (n + 1)::INT AS passage_words, round(2.0 * k::DOUBLE / (n + len(tpl.w) - 1), 6) AS dice
FROM common JOIN cand USING (u) JOIN tpl USING (template)
WHERE round(2.0 * k::DOUBLE / (n + len(tpl.w) - 1), 6) >= 0.8
"""


def oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ORACLE_SQL.format(values=", ".join(f"({quote(k)}, {i}, {quote(t)})" for i, (k, t) in enumerate(TEMPLATES)))
