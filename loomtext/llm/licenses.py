"""License scans with DataFrame functions only.

Texts are cut into words (runs of letters and digits, lower-cased) and hashed word shingles. A template of T
words is found where a run of at most 2 T words, at any word, holds ``CONTAINED`` of its shingles, so an edited
copy may be up to twice as long. Templates of like length form a class, whose longest has L words, at most 1.5
times its shortest. Windows of 2 L + L // 2 words start every L // 2 + 1 words: any such run lies whole in one
of them. A window's MinHash values, one a band, retrieve templates; exact containment of every run in the
window decides.

Band settings: a window that holds a run with 80 % of the shingles of a template has at most 2.5 L, so at most
3.75 T, shingles in all: their resemblance is at least 0.8 / (3.75 + 0.2), over 0.2. With 64 bands of one row
the chance that no band agrees is below 1 in a million, whatever else the window holds. Two savings change
nothing: shingles of no template at all are left out of windows, which only raises a resemblance, and windows
that hold none are not made, since their containment is 0. They keep 64 values a window affordable.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
BANDS = 64
CONTAINED = 0.8
CLASS = 1.5

# License texts and notices to look for, by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        'shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT '
        "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES "
        "OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
        "the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS "
        'SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
        "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        'provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" '
        "AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later "
        "version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)
SPLIT = r"[^\p{L}\p{N}]+"


def _shingles(text: str) -> F.Column:
    """64-bit hashes of every ``SHINGLE`` words in sequence; none if there are fewer words.

    The words are bound to a lambda variable: were they a column, the optimizer could move their expression
    into the inner lambda and split the text again for every shingle.
    """
    words = F.array(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPLIT, -1), lambda w: w != ""))
    return F.transform(words, lambda w: F.when(F.size(w) < SHINGLE, F.expr("cast(array() as array<bigint>)")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[w[i + k] for k in range(SHINGLE)]))))[0]


def _bands(shingles: str) -> F.Column:
    return F.expr(f"transform(sequence(0, {BANDS - 1}), j -> named_struct('band', j, 'value', array_min(transform({shingles}, x -> xxhash64(x, j)))))")


def _templates(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    rows = [(i, name, text) for i, (name, text) in enumerate(templates) if len([w for w in re.split(r"[\W_]+", text) if w]) >= SHINGLE]
    found = spark.createDataFrame(rows, "template int, license string, _t string").withColumn("_shingles", _shingles("_t"))
    return found.select("template", "license", (F.size("_shingles") + SHINGLE - 1).alias("length"), F.array_distinct("_shingles").alias("wanted"))


def _classes(lengths: list[int]) -> dict[int, int]:
    """The longest length of each length's class."""
    out, top = {}, 0
    for n in sorted(set(lengths), reverse=True):
        top = n if not top or n * CLASS < top else top
        out[n] = top
    return out


def scan(
    docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, contained: float = CONTAINED, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document and template found: id, license, template, containment, n_windows, start_word, end_word.

    containment is the largest share of the template's shingles in a run of twice its words, wherever the run
    starts; n_windows counts the windows that hold a run of enough, start_word and end_word bound the first such
    window, counted in words. Null texts and those of under five words match nothing; very long texts have as
    many windows as they need. Rows that repeat an identifier count as one document, with null as an identifier
    like others; of windows that are equally good the first is told. An empty table gives an empty one. Only
    identifier and text are read, so other columns cannot clash. ``templates`` is a fixed list: its table is
    broadcast.
    """
    spark = docs.sparkSession
    known = [r.asDict() for r in _templates(spark, templates).collect()]
    top = _classes([t["length"] for t in known])
    every = sorted({h for t in known for h in t["wanted"]})
    columns = "template int, license string, length int, class int, wanted array<bigint>"
    table = spark.createDataFrame([(t["template"], t["license"], t["length"], top[t["length"]], t["wanted"]) for t in known], columns)
    # one row for each band value of each template
    bands = table.withColumn("_b", F.explode(_bands("wanted"))).select("template", "class", F.col("_b.band"), F.col("_b.value"))
    hashes = F.split(F.lit(",".join(map(str, every))), ",").cast("array<bigint>") if every else F.expr("cast(array() as array<bigint>)")
    rows = docs.select(F.col(id_col).alias("_id"), _shingles(text_col).alias("_shingles")).filter(F.arrays_overlap("_shingles", hashes))

    def hits(s: Column) -> Column:
        """Where shingles of templates are, and which; all is bound, so that text and intersection are taken once."""
        at = F.transform(
            F.array(F.array_intersect(s, hashes)),
            lambda found: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.array_contains(found, s[i])),
        )[0]
        return F.transform(at, lambda i: F.struct(i.alias("at"), s[i].alias("hash")))

    rows = rows.select("_id", F.transform(F.array("_shingles"), hits)[0].alias("_hits"))
    sizes = [F.struct(F.lit(n).alias("class"), F.lit(n // 2 + 1).alias("step"), F.lit(2 * n + n // 2).alias("width")) for n in sorted(set(top.values()))]
    none = F.expr("cast(array() as array<struct<class:int,step:int,width:int>>)")
    rows = rows.withColumn("_class", F.explode(F.array(*sizes) if sizes else none))
    rows = rows.select("_id", F.col("_class.class"), F.col("_class.step").alias("_step"), F.col("_class.width").alias("_width"), "_hits")
    # windows k * step .. k * step + width that hold a hit: a hit at h needs k * step <= h <= k * step + width - SHINGLE
    first = f"greatest(0, x.at - _width + {SHINGLE} + _step - 1) div _step"
    windows = f"array_distinct(flatten(transform(_hits, x -> sequence({first}, greatest(x.at div _step, {first})))))"
    rows = rows.withColumn("_k", F.explode(F.expr(windows))).withColumn("_start", F.expr("cast(_k * _step as int)"))
    held = F.expr(f"filter(_hits, x -> x.at >= _start AND x.at <= _start + _width - {SHINGLE})").alias("_held")
    rows = rows.select("_id", "_start", "_width", "class", held).filter(F.size("_held") > 0)
    banded = rows.withColumn("_set", F.array_distinct("_held.hash")).withColumn("_b", F.explode(_bands("_set")))
    banded = banded.select("*", F.col("_b.band"), F.col("_b.value"))
    near = banded.join(F.broadcast(bands), ["class", "band", "value"]).select("_id", "_start", "_width", "_held", "template").distinct()
    near = near.join(F.broadcast(table.select("template", "license", "length", "wanted")), "template")
    checked = near.withColumn("_held", F.expr("filter(_held, x -> array_contains(wanted, x.hash))"))
    # a best run starts at a hit
    run = f"size(array_distinct(transform(filter(_held, y -> y.at >= x.at AND y.at <= x.at + 2 * length - {SHINGLE}), y -> y.hash)))"
    share = F.expr(f"array_max(transform(_held, x -> {run}))") / F.size("wanted")
    checked = checked.withColumn("_share", share).filter(F.col("_share") >= contained)
    best = checked.groupBy("_id", "license", "template").agg(
        F.max("_share").alias("containment"), F.countDistinct("_start").alias("n_windows"), F.min(F.struct("_start", "_width")).alias("_w")
    )
    ends = [F.col("_w._start").alias("start_word"), (F.col("_w._start") + F.col("_w._width")).alias("end_word")]
    return best.select(F.col("_id").alias(id_col), "license", "template", "containment", "n_windows", *ends)
