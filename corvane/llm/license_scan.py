"""License scans, with DataFrame functions only.

Templates and texts are cut into lower-cased words and hashed to 5-word shingles. For each class of template
lengths (powers of two) a text has overlapping windows of twice that many shingles, beginning at each multiple of it, so
that a template's occurrence lies wholly in one. Windows that share a MinHash with a template retrieve it;
the number of bands is the least for which a window that holds the asked share of a template does so with
probability COLLIDE. Exact containment of the template's shingles in the window then decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch

K = 5
CONTAINED, COLLIDE = 0.75, 0.9999
#: Templates of a scan: their shingles are constants of the plan, and their bands are broadcast.
MOST_TEMPLATES = 5_000

# Statements, notices and texts of licenses in use (SPDX identifier or a name of its own, text). A license may have several.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a '
        "copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
        'under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License '
        "for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Distributed under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT-permission",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("ISC", "Licensed under the ISC License."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions "
        "in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        'materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO "
        "EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
        "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
        "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions "
        "in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
        'CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS '
        "FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
        "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
        "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In "
        "jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to "
        "the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend "
        "this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ),
    (
        "Zlib",
        'This software is provided "as-is", without any express or implied warranty. In no event will the authors be held liable for any damages arising '
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You "
        "can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/",
    ),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
)


def bands_for(share: float) -> int:
    """Single MinHashes needed for a collision with probability COLLIDE at this Jaccard similarity."""
    n = 1
    while 1 - (1 - share) ** n < COLLIDE:
        n += 1
    return n


def bands_at(contained: float) -> int:
    """The bands of a scan: a template has more than half as many shingles as its class c says, a window 2c, which gives the least similarity."""
    return bands_for(contained * 0.5 / (2 + 0.5 * (1 - contained)))


def with_shingles(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``__s``: the shingle hashes of ``text`` in order. Fewer than five words are one shingle, no word none."""
    at = ", ".join(f"w[i + {j}]" for j in range(K))
    words = rf"filter(split(lower(coalesce(`{text}`, '')), '[^\\p{{L}}\\p{{N}}]+'), x -> x <> '')"
    shingles = f"case when size(w) = 0 then cast(array() as array<bigint>) when size(w) < {K} then array(xxhash64(w)) else transform(sequence(0, size(w) - {K}), i -> xxhash64({at})) end"
    # The lambda computes the words once, and the generator the shingles: no filter is pushed below it.
    return df.withColumn("__s", F.explode_outer(F.expr(f"transform(array({words}), w -> {shingles})")))


def minhashes(shingles: str, bands: int) -> Column:
    return F.expr(f"transform(sequence(0, {bands - 1}), j -> array_min(transform({shingles}, x -> xxhash64(x, j))))")


def scan(df: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, key: str = "doc_id", text: str = "text", contained: float = CONTAINED) -> DataFrame:
    """The licenses that each text states: ``(doc_id, license, containment, start)``.

    A row for each key and template of which a window of the whole text holds ``contained`` or more of the distinct
    shingles: the most that any window holds, and the first shingle of the first window that holds ``contained``. Texts without a license,
    null and empty texts have no row. Rows with the same key, null included, are taken together; templates with one name
    count as one license, each is verified alone. Without templates or rows the result is empty.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    bands = bands_at(contained)
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates: scan by parts of the library")
    t = spark.createDataFrame(list(templates), "license string, body string")
    t = with_shingles(t, "body").withColumn("__s", F.array_distinct("__s")).where("size(__s) > 0")
    t = t.withColumn("c", F.expr("cast(pow(2, ceil(log2(size(__s)))) as int)"))
    t = scratch.save(t.select("license", "c", F.col("__s").alias("ts"), F.posexplode(minhashes("__s", bands)).alias("band", "low")))
    # The library's shingles by class, to pass over texts and windows that share none: these hold no part of a template.
    by_class = {r["c"]: r["s"] for r in t.groupBy("c").agg(F.array_distinct(F.flatten(F.collect_set("ts"))).alias("s")).collect()}
    known = sorted({s for v in by_class.values() for s in v})
    d = with_shingles(df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text").drop("text")
    d = d.where(F.arrays_overlap("__s", F.lit(known) if known else F.expr("cast(array() as array<bigint>)")))
    classes = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(s).alias("known")) for c, s in sorted(by_class.items())]) if by_class else F.expr("cast(array() as array<struct<c: int, known: array<bigint>>>)")
    d = d.withColumn("k", F.explode_outer(classes)).select("doc_id", "__s", "k.c", "k.known")
    d = d.where(F.arrays_overlap("__s", "known"))
    d = d.withColumn("start", F.explode_outer(F.expr("transform(sequence(0, cast((size(__s) - 1) div c as int)), x -> x * c)")))
    d = d.withColumn("win", F.explode_outer(F.array(F.expr("slice(__s, start + 1, 2 * c)")))).where(F.arrays_overlap("win", "known")).drop("__s", "known")
    d = d.select("doc_id", "c", "start", "win", F.posexplode_outer(minhashes("win", bands)).alias("band", "low"))
    met = d.join(F.broadcast(t), ["c", "band", "low"])
    held = F.size(F.array_intersect("ts", "win")) / F.size("ts")
    return met.withColumn("held", held).where(F.col("held") >= contained).groupBy("doc_id", "license").agg(F.max("held").alias("containment"), F.min("start").cast("bigint").alias("start"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SQL = rf"""
with t(tpl, license, body) as (values {", ".join(f"({i}, {_quoted(a)}, {_quoted(b)})" for i, (a, b) in enumerate(TEMPLATES))}),
tw as (select tpl, license, regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+') as w from t),
ts as (select distinct tpl, license, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from tw),
tn as (select tpl, count(*) as n, pow(2, ceil(log2(count(*))))::bigint as c from ts group by tpl),
dw as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') as w from documents),
ds as (select doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: struct_pack(p := i - 1, s := array_to_string(w[i:i + 4], ' ')))) as x from dw where len(w) > 0),
hit as (select ds.doc_id, ts.tpl, ts.license, ts.s, tn.n, tn.c, ds.x.p // tn.c as k from ds join ts on ts.s = ds.x.s join tn on tn.tpl = ts.tpl),
win as (select doc_id, tpl, license, n, c, k, s from hit union select doc_id, tpl, license, n, c, k - 1, s from hit where k > 0),
held as (select doc_id, license, c * k as start, count(distinct s)::double / n as held from win group by doc_id, tpl, license, n, c, k)
select doc_id, license, max(held) as containment, min(start)::bigint as start from held where held >= 0.75 group by doc_id, license
"""
