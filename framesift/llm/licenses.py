"""License scans: MinHash bands over overlapping windows of words retrieve templates, exact containment verifies them.

A template is a license's notice, header or body; its shingles are its distinct runs of five words. Windows of a template's
own length (in shingles) begin at every word, and a window meets a template if one of BANDS hash functions (bands of one
row) has the same least shingle on both: with probability J for a window of resemblance J in each band, so a window of
containment 0.8 (J = 2/3) is missed with probability (1/3)^8, 0.0002, and a template that several windows hold nearly never.

A band's least shingle of a window is the template's only if the window holds that shingle and none that hashes lower. So
bands are looked up by the templates' own least shingles, and a text that holds one is cut, for that band, at the shingles
that hash lower: a piece of at least a window's length with the least shingle in it is a window that meets. This is linear
in the text for each band looked up, whatever repeats in it.

For each template that a text meets, containment is exact for all of the text's windows: the occurrence of a template's shingle
at place j counts for the windows that hold j and not the occurrence before; running sums over the ends of these ranges give
the containment of every window, in time linear in occurrences. A window matches if it holds at least 0.8 of the shingles.

The templates are a parameter; their bands and shingles are broadcast (tens of kB a hundred templates; more than MOST_SHINGLES shingles
are scanned in parts). Everything is SQL functions; no Python runs on the executors.

Defined results: null and empty texts and texts of fewer than five words match nothing unless a template is that short; a
template of fewer than five words is one shingle of all its words, one without words matches nothing; texts shorter than a
template are one window; a document gives one row for each template that it matches; repeated rows and rows with equal ids
or without one give rows each; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.llm.columns import run_hashes, word_array

RUN, CONTAINED, BANDS, MOST_SHINGLES = 5, 0.8, 8, 200_000
#: Common license notices, headers and bodies.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "Apache-2.0 header",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License.""",
    ),
    (
        "BSD-2-Clause body",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    ),
    (
        "BSD disclaimer",
        """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN
NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
SUCH DAMAGE.""",
    ),
    (
        "GPL-3.0 header",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    ),
    (
        "ISC body",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.""",
    ),
    (
        "MIT body",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "Unlicense body",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.""",
    ),
    (
        "zlib body",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The
origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice
may not be removed or altered from any source distribution.""",
    ),
)


def shingles(text: Column) -> Column:
    """Hashes of the runs of five words in order; of all words together if there are one to four."""
    return run_hashes(F.transform(word_array(text), lambda w: F.xxhash64(w)), RUN)


def _hashed(x: Column, band: Column) -> Column:
    return F.xxhash64(x, band)


def _meets(s: Column, band: Column, least: Column, m: Column) -> Column:
    """Whether some window of m shingles of s (of all of them, if there are fewer) has this least shingle in this band."""
    size = F.least(m, F.size(s))
    bound = _hashed(least, band)
    marks = F.array_join(F.transform(s, lambda x: F.when(_hashed(x, band) < bound, ",").when(x == least, "=").otherwise("-")), "")
    return F.exists(F.split(marks, ","), lambda piece: (F.length(piece) >= size) & (F.instr(piece, "=") > 0))


def _scan(documents: DataFrame, known: list[tuple[str, list[int]]]) -> DataFrame:
    spark = documents.sparkSession
    own = spark.createDataFrame([(n, x, len(s)) for n, s in known for x in s], "license string, x long, m int")
    kinds = spark.createDataFrame(known, "license string, own array<long>").select("license", F.size("own").alias("m"), "own")
    least = F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.element_at(F.array_sort(F.transform("own", lambda x: F.struct(_hashed(x, F.lit(b)).alias("h"), x.alias("x")))), 1)["x"].alias("least")) for b in range(BANDS))))  # noqa: B023
    bands = [tuple(r) for r in kinds.select("license", "m", least.alias("b")).select("license", "m", "b.*").orderBy("license", "band").collect()]
    table = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(b, ("license", "m", "band", "least"), strict=True))) for b in bands))
    probes = sorted({b[3] for b in bands})
    docs = documents.select("doc_id", F.monotonically_increasing_id().alias("row"), shingles(F.col("text")).alias("s"))
    some = docs.withColumn("held", F.array_distinct(F.filter("s", lambda x: x.isin(probes)))).where(F.size("held") > 0)
    met = F.filter(F.filter(table, lambda b: F.array_contains("held", b["least"])), lambda b: _meets(F.col("s"), b["band"], b["least"], b["m"]))
    asked = some.select("doc_id", "row", "s", F.explode(F.array_distinct(F.transform(met, lambda b: b["license"]))).alias("license"))
    each = asked.select("doc_id", "row", "license", F.size("s").alias("n"), F.posexplode("s").alias("at", "x"))
    hits = each.join(F.broadcast(own), ["license", "x"])
    text = ["doc_id", "row", "license", "m"]
    before = F.lag("at").over(Window.partitionBy("row", "license", "x").orderBy("at"))
    first = F.greatest(F.col("at") - F.col("m") + 1, before + 1, F.lit(0))
    ranges = hits.select(*text, first.alias("first"), F.least(F.col("at"), F.greatest(F.col("n") - F.col("m"), F.lit(0))).alias("last")).where("first <= last")
    ends = ranges.select(*text, F.inline(F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("step")), F.struct((F.col("last") + 1).alias("at"), F.lit(-1).alias("step")))))
    steps = ends.groupBy(*text, "at").agg(F.sum("step").alias("step"))
    order = Window.partitionBy("row", "license").orderBy("at")
    held = steps.withColumns({"held": F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lead("at").over(order)})
    good = held.withColumn("part", F.col("held") / F.col("m")).where(F.col("part") >= CONTAINED)
    return good.groupBy("doc_id", "row", "license").agg(F.max("part").alias("containment"), F.sum(F.col("next") - F.col("at")).alias("n_windows"), F.min("at").cast("long").alias("first_word")).drop("row")


def scan(documents: DataFrame, notices=NOTICES, most: int = MOST_SHINGLES) -> DataFrame:
    """doc_id, license, containment (largest), n_windows (that match), first_word (number of the first one's first word, from 0)."""
    spark = documents.sparkSession
    listed = spark.createDataFrame([*notices], "license string, notice string")
    templates = listed.select("license", F.array_distinct(shingles(F.col("notice"))).alias("own")).where(F.size("own") > 0)
    parts: list[list[tuple[str, list[int]]]] = [[]]
    for r in templates.orderBy("license").collect():
        if parts[-1] and sum(len(own) for _, own in parts[-1]) + len(r.own) > most:
            parts.append([])
        parts[-1].append((r.license, r.own))
    if not parts[0]:
        return documents.select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("n_windows"), F.lit(0).cast("long").alias("first_word")).where("false")
    return reduce(DataFrame.unionByName, (_scan(documents, known) for known in parts))


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
with templates(license, notice) as (values %s),
grams as (
  select license, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: list_aggregate(w[i:i+4], 'string_agg', ' '))) as own
  from (select license, list_filter(regexp_split_to_array(lower(notice), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from templates)),
docs as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents),
runs as (
  select doc_id, list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: list_aggregate(w[i:i+4], 'string_agg', ' ')) as s
  from docs where len(w) > 0),
hits as (
  select r.doc_id, g.license, g.own, r.s, unnest(list_filter(range(0, len(r.s)), lambda i: list_contains(g.own, r.s[i+1]))) as hit
  from runs r join grams g on list_has_any(r.s, g.own)),
starts as (
  select distinct doc_id, license, own, s, unnest(range(greatest(hit - len(own) + 1, 0), greatest(least(hit, len(s) - len(own)), greatest(hit - len(own) + 1, 0)) + 1)) as place from hits),
parts as (
  select doc_id, license, place, len(list_distinct(list_filter(s[place+1:place+len(own)], lambda x: list_contains(own, x))))::double / len(own) as part from starts)
select doc_id, license, max(part) as containment, count(*) as n_windows, min(place)::bigint as first_word
from parts where part >= 0.8 group by doc_id, license
""" % ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in NOTICES)
