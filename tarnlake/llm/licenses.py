"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams.

``licence_windows`` looks at every run of consecutive words and is what the report uses.  ``scan_licences``
names the units of a text that match: its lines, its paragraphs (between blank lines) and the whole text.  Bigrams are
counted with repetition, so a unit of n words has n - 1 of them and Dice of at least t is possible only for
templates whose own number lies between t / (2 - t) and (2 - t) / t times that: the size bounds, which are
applied before any bigram is built and again for each template.  Bigrams meet the templates through an
inverted index that is broadcast; its size is that of the template bank, not of the data.
"""

from __future__ import annotations

import math
from collections import defaultdict
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.functions.text import let
from tarnlake.llm.common import saved

THRESHOLD = 0.8

# fixed values: bodies shared by the BSD licences
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS
OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY
OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GPL_NOTICE = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation; {version}. This program is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public
License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor,
Boston, MA 02110-1301 USA."""
_LGPL_NOTICE = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation; either version {version} of the License, or (at your
option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public
License for more details. You should have received a copy of the GNU Lesser General Public License along with this library;
if not, {end}"""

# fixed values: short licences, their bodies and notices.  The four short notices of the test tables are among them.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details. You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", f"{_BSD_2} {_BSD_DISCLAIMER}"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    # bodies of paragraphs that stand alone
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:"""),
    ("BSD-2-Clause", _BSD_2),
    ("BSD-3-Clause", f"{_BSD_2} {_BSD_3}"),
    # further short licences
    ("BSD-3-Clause", f"{_BSD_2} {_BSD_3} {_BSD_DISCLAIMER}"),
    ("BSD-4-Clause", f"""{_BSD_2} 3. All advertising materials mentioning features or use of this software must display the
following acknowledgement: This product includes software developed by the organization. {_BSD_3.replace("3.", "4.")}
{_BSD_DISCLAIMER}"""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("BSL-1.0", """Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to
any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the
"Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of
the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The
copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the
Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a
source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO
EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY,
WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""),
    ("BSL-1.0", """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy
at http://www.boost.org/LICENSE_1_0.txt)"""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or
authors of this software dedicate any and all copyright interest in the software to the public domain. We make this
dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this
dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under
copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please
refer to <https://unlicense.org/>"""),
    # notices of the licences whose whole texts lie in licence_texts, and of the AGPL
    ("GPL-2.0", _GPL_NOTICE.format(version="either version 2 of the License, or (at your option) any later version")),
    ("GPL-2.0", _GPL_NOTICE.format(version="version 2 of the License")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", _LGPL_NOTICE.format(version="2.1", end="write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA")),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", _LGPL_NOTICE.format(version="3", end="see <https://www.gnu.org/licenses/>.")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for
more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>."""),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("CC0-1.0", """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring
rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have
received a copy of the CC0 Public Domain Dedication along with this software. If not, see
<http://creativecommons.org/publicdomain/zero/1.0/>."""),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]

TEXTS = Path(__file__).parent / "licence_texts"
STOP = set("a all and any are as at be by for from if in is it may not of on or other such that the this to under with you your".split())
LARGE = 100  # bigrams of a template from which on one rare bigram says little
CELL = 64


def whole_bank() -> list[tuple[str, str]]:
    """The templates above and the whole texts of the longer licences, each named as its file."""
    return TEMPLATES + [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(TEXTS.glob("*.txt"))]


def normal_words(text: Column) -> Column:
    """Lower-case words of letters and digits; every other character separates."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bigrams(words: Column) -> Column:
    pairs = F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))
    return F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0)))


def template_index(spark, templates: list[tuple[str, str]]) -> DataFrame:
    """(bigram, template, licence, t_size, t_count): the inverted index of the bank."""
    bank = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(templates)], "template int, licence string, body string")
    w = bank.withColumn("w", normal_words(F.col("body")))
    rows = w.select("template", "licence", (F.size("w") - 1).alias("t_size"), F.explode(bigrams(F.col("w"))).alias("bigram"))
    return rows.groupBy("template", "licence", "t_size", "bigram").agg(F.count("*").alias("t_count"))


def units(docs: DataFrame, text: Column, lower: float, upper: float) -> DataFrame:
    """(doc_id, unit, words) of every unit whose number of bigrams lies in the bounds of some template.

    A unit's name is its kind and number; the text's hash keeps documents with one id apart.
    """
    base = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("t"))
    parts = lambda kind, cells: F.transform(cells, lambda c, i: F.struct(F.concat(F.lit(kind), i.cast("string")).alias("unit"), c.alias("body")))
    blank = r"\n[\x20\x09-\x0D]*\n"
    found = F.concat(
        parts("line ", F.split("t", "\n")),
        F.when(F.col("t").rlike(blank), parts("paragraph ", F.split("t", blank))).otherwise(F.array().cast("array<struct<unit:string,body:string>>")),
        # a text of one line is its own line
        F.when(F.instr("t", "\n") > 0, F.array(F.struct(F.lit("text").alias("unit"), F.col("t").alias("body")))).otherwise(F.array().cast("array<struct<unit:string,body:string>>")),
    )
    # a unit of n bigrams has 2n + 1 characters at least, which spares most units the splitting
    rows = base.select("doc_id", F.explode(found).alias("u"), F.xxhash64("t").alias("text_hash")).filter(F.length("u.body") >= 2 * lower + 1)
    w = rows.select("doc_id", "text_hash", "u.unit", normal_words(F.col("u.body")).alias("w"))
    return w.filter((F.size("w") - 1 >= F.lit(lower)) & (F.size("w") - 1 <= F.lit(upper)))


def scan_licences(docs: DataFrame, text: Column, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Units that match a template: doc_id, unit, licence, template, dice; one row for each unit and licence.

    Null and empty texts have no unit.  Repeated rows give one set of matches; of equal matches of one
    licence the smallest template number is named.  An empty table or bank gives no rows.
    """
    spark = docs.sparkSession
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    index = template_index(spark, templates)
    span = [len(t.split()) for _, t in templates] or [0]
    sizes = index.agg(F.min("t_size"), F.max("t_size")).first() if templates else (None, None)
    if sizes[0] is None:
        sizes = (min(span), max(span))
    u = units(docs, text, low * sizes[0], high * sizes[1])
    grams = u.select("doc_id", "text_hash", "unit", (F.size("w") - 1).alias("u_size"), F.posexplode(bigrams(F.col("w"))).alias("pos", "bigram"))
    met = grams.join(F.broadcast(index), "bigram").filter(
        (F.col("t_size") >= F.col("u_size") * low - 1e-9) & (F.col("t_size") <= F.col("u_size") * high + 1e-9)
    )
    unit = ["doc_id", "text_hash", "unit", "u_size", "template", "licence", "t_size"]
    shared = met.groupBy(*unit, "bigram", "t_count").agg(F.countDistinct("pos").alias("n"))
    scored = shared.groupBy(*unit).agg(F.sum(F.least("n", "t_count")).alias("both")).withColumn(
        "dice", 2 * F.col("both") / (F.col("u_size") + F.col("t_size"))
    ).filter(F.col("dice") >= threshold)
    best = F.max(F.struct("dice", (-F.col("template")).alias("t"))).alias("b")
    return scored.groupBy("doc_id", "text_hash", "unit", "licence").agg(best).select(
        "doc_id", "text_hash", "unit", "licence", (-F.col("b.t")).cast("int").alias("template"), F.col("b.dice").alias("dice")
    )


def _needed(size: int, low: float) -> int:
    """Bigrams that a window must share with a template of ``size`` bigrams."""
    return max(1, math.ceil(size * low - 1e-9))


def seeds(index_rows, low: float) -> tuple[set[str], set[str], int]:
    """Bigrams one of which is in every match of a short template; those for long ones and how many of them are.

    A match lacks at most size - needed bigrams of its template, so it has some of any larger choice.  The
    choice takes what is likely to be rare, which matters for speed only.
    """
    by = defaultdict(list)
    for r in index_rows:
        by[r.template, r.t_size].append((r.bigram, r.t_count))
    short, long, least = set(), set(), []
    for (_, size), grams in by.items():
        missing = size - _needed(size, low)
        extra = min(size - missing, size // 10) if size >= LARGE else 1
        taken = 0
        for g, n in sorted(grams, key=lambda x: (sum(w in STOP for w in x[0].split()), -len(x[0]), x[0])):
            (long if size >= LARGE else short).add(g)
            taken += n
            if taken >= missing + extra:
                break
        if size >= LARGE:
            least.append(taken - missing)
    return short, long, min(least, default=1)


def _candidates(docs: DataFrame, text: Column, index_rows, low: float) -> DataFrame:
    """(doc_id, text_hash, t) of the distinct documents that have the seeds of some template; tested inside the row."""
    short, long, least = seeds(index_rows, low)
    base = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("t"))

    def has(grams: Column) -> Column:
        tests = [F.exists(grams, lambda g: g.isin(list(short)))] if short else []
        if long:
            tests.append(F.size(F.filter(grams, lambda g: g.isin(list(long)))) >= least)
        return tests[0] | tests[1] if len(tests) == 2 else tests[0]

    found = base.filter(let(normal_words(F.col("t")), lambda w: let(bigrams(w), has)))
    return found.select("doc_id", F.xxhash64("t").alias("text_hash"), "t").dropDuplicates(["doc_id", "text_hash"])


def licence_windows(docs: DataFrame, text: Column, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Runs of words that match a template: doc_id, text_hash, licence, template, first, last, shared, dice.

    Every run of consecutive words of the text is looked at, so lines, sentences, paragraphs and runs of them
    are among these; ``first`` and ``last`` number its bigrams.  A hit at p adds to a window that starts at s
    unless as many equal ones as the template has lie between them, which the place of the equal hit so many
    before p tells.  Windows start where the bigram before would not add to the longest one, since a window
    with it would be better; each start gives its best end.  Of matches the middle of which lies in another
    one, those that share less are left out.  Repeated rows, null and empty texts are as in ``scan_licences``.
    """
    spark = docs.sparkSession
    templates = whole_bank() if templates is None else templates
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    schema = "doc_id long, text_hash long, licence string, template int, first int, last int, shared long, dice double"
    index = template_index(spark, templates)
    index_rows = index.collect() if templates else []
    if not index_rows:
        return spark.createDataFrame([], schema)
    found = saved(_candidates(docs, text, index_rows, low), "licence_candidates")
    grams = found.select("doc_id", "text_hash", F.posexplode(let(normal_words(F.col("t")), bigrams)).alias("pos", "bigram"))
    pair = ["doc_id", "text_hash", "template", "licence", "t_size"]
    places = grams.join(F.broadcast(index), "bigram").groupBy(*pair, "bigram", "t_count").agg(F.sort_array(F.collect_list("pos")).alias("places"))
    both = F.sum(F.least(F.size("places"), F.col("t_count"))).over(Window.partitionBy(*pair))
    hits = places.withColumn("both", both).filter(F.col("both") >= F.col("t_size") * low - 1e-9).select(
        *pair, "t_count", "places", F.posexplode("places").alias("nth", "pos")
    )
    other = lambda i: F.when(i >= 0, F.get("places", i))
    nth, times = F.col("nth"), F.col("t_count").cast("int")
    hits = hits.select(
        *pair, "pos", other(nth - times).alias("equal_before"), other(nth + times).alias("equal_after"), F.floor(F.col("t_size") * high + 1e-9).cast("int").alias("longest")
    )
    hits = saved(hits, "licence_hits")
    w = Window.partitionBy(*pair).orderBy("pos")
    joined = (F.lag("pos").over(w) == F.col("pos") - 1) & F.coalesce(F.lag("equal_after").over(w) >= F.col("pos") + F.col("longest"), F.lag("pos").over(w).isNotNull())
    starts = hits.withColumn("inner", F.coalesce(joined, F.lit(False))).filter("NOT inner")
    cell = F.floor(F.col("pos") / F.col("longest"))
    starts = starts.select(
        F.col("doc_id").alias("s_doc"), F.col("text_hash").alias("s_hash"), F.col("template").alias("s_template"), F.col("pos").alias("first"), F.explode(F.array(cell, cell + 1)).alias("s_cell")
    )
    near = hits.withColumn("cell", cell).join(
        starts,
        F.col("doc_id").eqNullSafe(F.col("s_doc")) & (F.col("text_hash") == F.col("s_hash")) & (F.col("template") == F.col("s_template")) & (F.col("cell") == F.col("s_cell"))
        & (F.col("pos") >= F.col("first")) & (F.col("pos") < F.col("first") + F.col("longest")),
    )
    adds = F.coalesce(F.col("equal_before") < F.col("first"), F.lit(True)).cast("long")
    shared = F.sum(adds).over(Window.partitionBy(*pair, "first").orderBy("pos"))
    ends = near.withColumn("shared", shared).withColumn("dice", 2 * F.col("shared") / (F.col("pos") - F.col("first") + 1 + F.col("t_size"))).filter(F.col("dice") >= threshold)
    best = ends.groupBy(*pair, "first").agg(F.max(F.struct("dice", "shared", F.col("pos").alias("last"))).alias("b"))
    out = saved(best.select("doc_id", "text_hash", "licence", "template", "first", "b.last", "b.shared", "b.dice"), "licence_windows")

    middle = F.floor((F.col("first") + F.col("last")) / 2)
    value = F.struct("shared", "dice", -F.col("template"), -F.col("first"))
    larger = out.select(
        F.col("doc_id").alias("l_doc"), F.col("text_hash").alias("l_hash"), F.col("first").alias("l_first"), F.col("last").alias("l_last"), value.alias("l_value"),
        F.explode(F.sequence(F.floor(F.col("first") / CELL), F.floor(F.col("last") / CELL))).alias("l_cell"),
    )
    held = out.withColumns({"middle": middle, "cell": F.floor(middle / CELL), "value": value}).join(
        larger,
        F.col("doc_id").eqNullSafe(F.col("l_doc")) & (F.col("text_hash") == F.col("l_hash")) & (F.col("cell") == F.col("l_cell"))
        & (F.col("middle") >= F.col("l_first")) & (F.col("middle") <= F.col("l_last")) & (F.col("l_value") > F.col("value")),
        "left_anti",
    )
    return held.select("doc_id", "text_hash", "licence", "template", "first", "last", "shared", "dice")


def licence_report(docs: DataFrame, text: Column, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: its best licence, that match's dice, all licences found, number of matching runs of words."""
    found = licence_windows(docs, text, templates, threshold)
    by_doc = found.groupBy("doc_id", "text_hash").agg(
        F.max(F.struct("dice", "licence")).alias("b"), F.sort_array(F.collect_set("licence")).alias("licences"), F.count("*").alias("n_units")
    )
    ids = docs.select("doc_id", F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"))
    same = ids["doc_id"].eqNullSafe(by_doc["doc_id"]) & (ids["text_hash"] == by_doc["text_hash"])
    return ids.join(by_doc, same, "left").select(
        ids["doc_id"], F.col("b.licence").alias("licence"), F.coalesce(F.col("b.dice"), F.lit(0.0)).alias("dice"),
        F.coalesce(F.col("licences"), F.array().cast("array<string>")).alias("licences"), F.coalesce(F.col("n_units"), F.lit(0)).cast("long").alias("n_units"),
    )
