"""License scans, in DataFrame functions only.

Text that holds none of a template's marking words cannot hold four fifths of its shingles: the words are chosen so
that the shingles without any of them are too few. The other documents are cut into overlapping text windows, one
size for each class of template lengths, and those with a marking word stay. MinHash bands over a window's shingles retrieve templates of that class,
and exact containment of a template's shingles in the window verifies them.

A match is a passage of WINDOW times the shingles of its class's longest template, wherever it begins: words may be
inserted up to that span, and every passage lies whole in a window, which is longer than it by the windows' distance.
Each band is one coordinate. Templates of a class have four fifths of its longest one's shingles at least, and a
window (2 * WINDOW - 1) times the longest one's, so that the similarity of a window with a match to a template without
repeated shingles is at least s = 0.8 / (1.25 * (2 * WINDOW - 1) + 0.2) = 0.29, and BANDS bands meet with probability
1 - (1 - s) ** BANDS: all but 2 of 10 million.
"""

from __future__ import annotations

from collections import Counter
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import common, winnow

#: Words in a shingle, the least share of a template's shingles, coordinates, and the longest span of a match in lengths of its class.
SHINGLE, CONTAINED, BANDS, WINDOW = 5, 0.8, 44, 1.5
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
)
_GNU = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} Public License as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."
#: Public notices, and the full texts of short licenses: (license, text).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT[0]),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU.format("program", ":", "General", ",", "3")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", _BSD[0]),
    ("MIT", _MIT[1]),
    ("MIT", _MIT[2]),
    ("MIT", " ".join(_MIT)),
    ("ISC", _ISC[0]),
    ("ISC", " ".join(_ISC)),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("BSD-2-Clause", " ".join(_BSD[:2])),
    ("BSD-3-Clause", _BSD[2]),
    ("BSD-3-Clause", " ".join(_BSD)),
    ("GPL-2.0", _GNU.format("program", ";", "General", ";", "2")),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-2.1", _GNU.format("library", ";", "Lesser General", ";", "2.1")),
    ("LGPL-3.0", _GNU.format("library", ":", "Lesser General", ",", "3")),
    ("AGPL-3.0", _GNU.format("program", ":", "Affero General", ",", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so'),
)
#: Templates that a scan takes, at most: their words are matched as one pattern, and their bands go to every task.
MOST_TEMPLATES = 5_000


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template_id, license, text) of a list of (license, text)."""
    return spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template_id int, license string, text string")


def _shingles(words: str) -> Column:
    """Hashes of the runs of SHINGLE words; of fewer words, but not none, that of all."""
    n = F.size(words)
    run = lambda i: F.xxhash64(F.concat_ws(" ", F.slice(words, i, F.least(n, F.lit(SHINGLE)))))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n - SHINGLE + 1, F.lit(1))), run)).otherwise(F.array().cast("array<bigint>"))


def _bands(shingles: str) -> Column:
    """Coordinate b: the least of all shingles' hashes with seed b."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, b))))


def marking_words(texts: list[list[str]]) -> set[str]:
    """Words such that any four fifths of the shingles of any text include one that holds such a word; long words first."""
    found: set[str] = set()
    for words in texts:
        spans = [words[i : i + SHINGLE] for i in range(max(1, len(words) - SHINGLE + 1))]
        n = len(set(map(tuple, spans)))
        usual = Counter(w for w in words)
        for word in sorted(set(words), key=lambda w: (w not in found, -len(w), usual[w], w)):
            # As scan_licenses compares shares: a quotient of integers, exact where it equals CONTAINED.
            if len({tuple(s) for s in spans if not found.intersection(s)}) / n < CONTAINED:
                break
            found.add(word)
    return found


def scan_licenses(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """Templates whose five-word shingles are contained, to four fifths or more, in a passage of a document.

    A passage is a run of WINDOW times as many shingles as the longest template of the class has, at any place.

    docs: doc_id and text; templates: template_id, license, text, at most MOST_TEMPLATES rows (more are refused); other
    columns are ignored. Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. Null and empty texts
    match nothing, nor does a template without words. Rows of equal doc_id and text are one document; rows that repeat a
    doc_id, or have none, are told apart by their texts. Result, a row per document and template found: doc_id,
    template_id, license, contained (the largest share of its shingles in a passage), first_word (where the first such
    passage begins, from 0), doc_hash (of the text). A document without a license has no row.
    """
    docs = common.spread(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    known = templates.select("template_id", "license", winnow.words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    known = common.materialize(known.withColumn("shingles", F.array_distinct(_shingles("words"))).withColumn("n", F.size("words")))
    texts = [r.words for r in known.limit(MOST_TEMPLATES + 1).select("words").collect()]
    if len(texts) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    schema = "doc_id long, template_id int, license string, contained double, first_word int, doc_hash long"
    if not texts:
        return docs.sparkSession.createDataFrame([], schema)
    marks = marking_words(texts)
    # Marking words are matched as parts of the text, whatever stands around them: more pass than need be.
    near = docs.where(F.col("text").rlike("(?i)" + "|".join(sorted(marks)))).select("doc_id", F.xxhash64("text").alias("doc_hash"), winnow.words_of(F.col("text")).alias("words"))
    marked = F.transform("words", lambda w, i: F.when(w.isin(*sorted(marks)), i + 1))
    near = near.withColumn("marked", F.filter(marked, lambda i: i.isNotNull())).where(F.size("marked") > 0)
    near = common.materialize(near.withColumn("shingles", _shingles("words")))
    # Classes of template lengths, each half as long again as the one before: a window of a class holds its templates whole.
    sizes, size = [], SHINGLE
    longest = max(map(len, texts))
    while not sizes or sizes[-1] < longest:
        sizes.append(size)
        size = max(size + 1, int(size * 1.25))
    # All classes share one plan: a row of a document and class carries the class's lengths.
    classes = []
    for low, high in pairwise([0, *sizes]):
        if any(low < len(t) <= high for t in texts):
            span = max(1, int(WINDOW * (high - SHINGLE + 1)))
            stride = max(1, span - (high - SHINGLE + 1))
            width = span + stride  # a passage that begins before the next window lies whole in this one
            classes.append((low, high, span, stride, width))
    document, lengths = ["doc_id", "doc_hash"], ["high", "span", "stride", "width"]
    listed = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(lengths, c[1:]))) for c in classes))
    each = near.where(F.size("words") > 0).select(*document, "shingles", "marked", F.explode(listed).alias("c")).select(*document, "shingles", "marked", "c.*")
    at = F.sequence(F.lit(1), F.greatest(F.size("shingles") - F.col("span") + 1, F.lit(1)), F.col("stride"))
    # What holds for the text holds for a window: one without a marking word has too few of any template's shingles.
    at = F.filter(at, lambda i: F.exists("marked", lambda m: (m >= i) & (m < i + F.col("width") + SHINGLE - 1)))
    windows = each.select(*document, *lengths, F.explode(F.transform(at, lambda i: F.struct((i - 1).alias("at"), F.slice("shingles", i, F.col("width")).alias("held")))).alias("w")).select(*document, *lengths, "w.at", "w.held")
    keys = windows.select(*document, "high", "span", "stride", "at", "held", F.posexplode_outer(_bands("held")).alias("band", "key"))
    of = F.coalesce(*(F.when((F.col("n") > low) & (F.col("n") <= high), F.lit(high)) for low, high, *_ in classes))
    marks_of = known.select("template_id", "license", "shingles", of.alias("high"), F.posexplode_outer(_bands("shingles")).alias("band", "key"))
    met = keys.join(F.broadcast(marks_of), ["high", "band", "key"]).dropDuplicates([*document, "at", "template_id"])  # a template is of one class
    # No passage holds more of a template than its window.
    met = met.where(F.size(F.array_intersect("shingles", "held")) / F.size("shingles") >= CONTAINED)
    share = lambda i: F.size(F.array_intersect("shingles", F.slice("held", i + 1, F.col("span")))) / F.size("shingles")
    passages = F.transform(F.sequence(F.lit(0), F.col("stride") - 1), lambda i: F.struct((F.col("at") + i).alias("at"), share(i).alias("contained")))
    found = met.select(*document, "template_id", "license", F.explode(passages).alias("p")).select(*document, "template_id", "license", "p.at", "p.contained").where(F.col("contained") >= CONTAINED)
    out = found.groupBy(*document, "template_id", "license").agg(F.max("contained").alias("contained"), F.min("at").cast("int").alias("first_word"))
    return out.select("doc_id", "template_id", "license", "contained", "first_word", "doc_hash")


def op3_license_scans(spark, sf_dir: str) -> DataFrame:
    """License notices in `documents`."""
    found = scan_licenses(common.read(spark, sf_dir, "documents"), template_table(spark))
    return found.select("doc_id", "template_id", "license", "contained", "first_word")


def _oracle() -> str:
    """The same rows by plain SQL over all passages that begin near a shared shingle; passages as long as the class allows."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(name)}, {quoted(text)})" for i, (name, text) in enumerate(TEMPLATES))
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH RECURSIVE classes AS (SELECT {SHINGLE} AS size UNION ALL SELECT greatest(size + 1, CAST(floor(size * 1.25) AS INTEGER)) FROM classes WHERE size < 5000),
t AS (SELECT template_id, license, {words} AS ws FROM (VALUES {rows}) AS v(template_id, license, text)),
c AS (SELECT t.*, greatest(1, CAST(floor({WINDOW} * ((SELECT min(size) FROM classes WHERE size >= len(ws)) - {SHINGLE - 1})) AS INTEGER)) AS span FROM t WHERE len(ws) > 0),
ts AS (SELECT DISTINCT template_id, array_to_string(ws[i : i + least(len(ws), {SHINGLE}) - 1], ' ') AS g FROM (SELECT template_id, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 2}, 2))) AS i FROM c)),
tn AS (SELECT template_id, count(*) AS n FROM ts GROUP BY template_id),
d AS (SELECT doc_id, {words} AS ws FROM documents),
ds AS (SELECT doc_id, len(ws) AS n_words, i - 1 AS p, array_to_string(ws[i : i + least(len(ws), {SHINGLE}) - 1], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(ws) > 0)),
h AS (SELECT doc_id, n_words, p, g, template_id FROM ds JOIN ts USING (g)),
near AS (SELECT doc_id, template_id FROM h JOIN tn USING (template_id) GROUP BY doc_id, template_id, n HAVING count(DISTINCT g) / n >= {CONTAINED}),
s AS (SELECT DISTINCT doc_id, template_id, span, unnest(range(greatest(p - span + 1, 0), least(p, greatest(n_words - {SHINGLE - 1} - span, 0)) + 1)) AS pos FROM h JOIN near USING (doc_id, template_id) JOIN c USING (template_id)),
f AS (SELECT s.doc_id, s.template_id, s.pos, count(DISTINCT h.g) / n AS contained FROM s JOIN h ON h.doc_id = s.doc_id AND h.template_id = s.template_id AND h.p BETWEEN s.pos AND s.pos + s.span - 1 JOIN tn ON tn.template_id = s.template_id GROUP BY s.doc_id, s.template_id, s.pos, n)
SELECT doc_id, CAST(template_id AS INTEGER) AS template_id, license, max(contained) AS contained, CAST(min(pos) AS INTEGER) AS first_word
FROM f JOIN c USING (template_id) WHERE contained >= {CONTAINED} GROUP BY doc_id, template_id, license
"""


ORACLE = _oracle()
