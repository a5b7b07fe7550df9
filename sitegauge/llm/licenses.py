"""License scan: MinHash bands over overlapping windows, then exact containment.  DataFrame functions only.

Words are runs of letters and digits, lower-cased; shingles are five words.
Templates of WIDTH shingles or more are cut into windows of WIDTH shingles at
every offset, texts at every STRIDE.  A window has BANDS bands of ROWS minima: a
window of similarity 0.8 to the template's at its place collides with
probability 1 - (1 - 0.8**2)**5 = 0.994, and a copy has one window for every
STRIDE shingles.  A shorter template (a notice of one line) has windows of one
shingle, whose minimum is that shingle.  Retrieved templates stay if the text
holds at least CONTAINED of their distinct shingles.  Of a family of versions
(names alike but for the digits) that of the largest share counts; equal shares
all do.

The signatures known from templates are a bitmap of SLOTS bytes, of one size
however many there are; what it lets through is joined with the templates.

Results: one row for each document id and license found, none for null, empty or
unlicensed texts.  Repeated rows with one id give one row for each license, and
a null id is an id like others.  Texts are read whole, however long.  Templates
of fewer than five words are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_side

SHINGLE, WIDTH, STRIDE, BANDS, ROWS, CONTAINED, SLOTS = 5, 16, 8, 5, 2, 0.8, 1 << 18

# Public license notices and texts.
TEMPLATES = {
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "MIT notice": "Released under the MIT License",
    "MIT notice 2": "Licensed under the MIT License",
    "GPL-3.0 notice": "licensed under the GNU General Public License, version 3",
    "GPL-2.0 notice": "licensed under the GNU General Public License, version 2",
    "BSD-3-Clause notice": "Licensed under the BSD 3-Clause License",
    "MPL-2.0 notice": "subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0",
    "CC-BY-4.0 name": "Creative Commons Attribution 4.0 International License",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "Apache-2.0 header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "BSD conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "ISC grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
}


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column) -> Column:
    """Hashes of the five-word runs of the whole text, in order; empty for fewer words."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    return _let(words, lambda w: F.when(F.size(w) >= SHINGLE, F.transform(
        F.sequence(F.lit(1), F.size(w) - SHINGLE + 1), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))).otherwise(F.array().cast("array<bigint>")))


def _windows(shingles: Column, step: int) -> Column:
    """The band signatures of all windows of WIDTH shingles."""
    starts = F.sequence(F.lit(1), F.size(shingles) - WIDTH + 1, F.lit(step))

    def low(seed: int) -> Column:
        seeded = F.transform(shingles, lambda x: F.xxhash64(x, F.lit(seed)))
        return _let(seeded, lambda h: F.transform(starts, lambda i: F.array_min(F.slice(h, i, WIDTH))))

    def band(number: int) -> Column:
        key = low(number * ROWS)
        for row in range(1, ROWS):
            key = F.zip_with(key, low(number * ROWS + row), lambda x, y: F.xxhash64(F.lit(number), x, y))
        return key

    bands = [band(b) for b in range(BANDS)]
    return F.when(F.size(shingles) >= WIDTH, F.concat(*bands)).otherwise(F.array().cast("array<bigint>"))


def template_index(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """name, family, shingles, signature: bands of templates of WIDTH shingles or more, shingles of shorter ones."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, body string").select("name", F.array_distinct(shingle_hashes(F.col("body"))).alias("shingles"), shingle_hashes(F.col("body")).alias("_all"))
    return rows.select("name", F.regexp_replace("name", r"-?\d+(?:\.\d+)*", "").alias("family"), "shingles",
                       F.explode(F.when(F.size("_all") >= WIDTH, F.array_distinct(_windows(F.col("_all"), 1))).otherwise(F.col("shingles"))).alias("signature"))


def _slot(signature: Column) -> Column:
    return F.pmod(signature, F.lit(SLOTS)).cast("int")


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """-> doc_id, license, contained (share of the template's shingles in the text)."""
    spark, templates = docs.sparkSession, templates or TEMPLATES
    scratch = Scratch(spark)
    index = scratch.save(template_index(spark, templates), "index")
    missing = set(templates) - {r["name"] for r in index.select("name").distinct().collect()}
    if missing:
        raise ValueError(f"templates need {SHINGLE} words: {sorted(missing)}")
    marks = bytearray(SLOTS)
    for r in index.select(_slot(F.col("signature")).alias("slot")).distinct().collect():
        marks[r["slot"]] = 1
    known = F.lit(bytes(marks))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shingle_hashes(F.col("text")).alias("s"))
    hits = texts.select("doc_id", "s", F.filter(F.concat("s", _windows(F.col("s"), STRIDE)), lambda x: F.substring(known, _slot(x) + 1, 1) == F.lit(b"\x01")).alias("hit"))
    rows = hits.select("doc_id", "s", F.explode(F.array_distinct("hit")).alias("signature")).join(small_side(index, scratch, "index"), "signature")
    held = rows.select("doc_id", F.col("name").alias("license"), "family", (F.size(F.array_intersect("shingles", "s")) / F.size("shingles")).alias("contained"))
    held = held.filter(F.col("contained") >= CONTAINED).groupBy("doc_id", "family", "license").agg(F.max("contained").alias("contained"))
    best = held.groupBy("doc_id", "family").agg(F.collect_list(F.struct("license", "contained")).alias("found"), F.max("contained").alias("most"))
    return best.select("doc_id", F.explode(F.filter("found", lambda f: f["contained"] == F.col("most"))).alias("f")).select("doc_id", "f.license", "f.contained")
