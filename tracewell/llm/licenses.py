"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Comment marks are stripped; then single lines, sentences (wrapped ones too), paragraphs of several lines, the leading comment block and, of files named as licence files, the whole text
are compared with each template. Long templates count as a whole and by their first clause. A machine-readable tag names its licence by itself. A term weighs 1 + ln(tf), times its idf; document frequencies are counted over all files. By Cauchy-Schwarz a segment can only reach the
threshold if it has one of each template's rarest terms, so many that the others are too light; segments without any are left out exactly, before vectors are built. The
frequencies of the other words of those that remain are counted over all files too. A file without a licence of its own takes that of the
nearest directory above it that holds a licence file, found by joining its ancestor paths with those directories.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import bounded, materialise, words

THRESHOLD = 0.6
#: A file is a licence file of its directory if it is named like one, or if this share of its words is in one segment that declares a licence.
FILE_SHARE = 0.25
NAMED = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)([._-][^/]*)?$"
#: What starts a line of a comment and isn't part of its text, and a comment block at the beginning of a text. Java's ^ would know other ends of lines without (?d).
MARK = r"[ \t]*(?://+!?|#+|/?\*+/?|--+|;+|%+|<!--+)?[ \t]*"
HEADER = r"^(?:[ \t]*(?:(?://|#|/?\*|--|;|%)[^\n]*)?\n)+"
PARAGRAPH = r"\n(?:[ \t\r]*\n)+"
SENTENCE = r"[.!?;:][ \t\r\n]+|\n(?:[ \t\r]*\n)+"
#: The tag of a licence, and what of its name tells later versions only; a template of more words than LONG has its first clause as another template.
TAG, LATER, LONG, CLAUSE = r"spdx-license-identifier:[ \t]*\(?([a-z0-9.+-]+)", r"(-only|-or-later|\+)?\.*$", 60, 12

WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
NO_ENDORSEMENT = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
FREE = "is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
USEFUL = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program."
GPL, LGPL, AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"

# Short notices, standard headers and short texts by which files declare these licences; of the long texts the opening.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", "Use of this source code is governed by the BSD 2-Clause License."),
    ("BSD-2-Clause", f"{CLAUSES} {DISCLAIMER}"),
    ("BSD-3-Clause", "Use of this source code is governed by the BSD 3-Clause License."),
    ("BSD-3-Clause", f"{CLAUSES} {NO_ENDORSEMENT} {DISCLAIMER}"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", f"This program {FREE.format(GPL, 2)} {USEFUL.format(GPL)}"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", f"This program {FREE.format(GPL, 3)} {USEFUL.format(GPL)}"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", f"This program {FREE.format('Affero ' + GPL, 3)} {USEFUL.format(AGPL)}"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", f"This library {FREE.format(LGPL, 3)} {USEFUL.format(LGPL)}"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", f'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {WARRANTY}'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("all-rights-reserved", "All rights reserved."),
]


def with_first_clauses(templates: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """templates, and the first clause of each long one, if it has CLAUSE words at least and no other licence begins alike."""
    clauses = sorted({(name, re.split(r"[.:](?:\s|$)", text)[0]) for name, text in templates if len(text.split()) > LONG})
    shared = Counter(text for _, text in clauses)
    return templates + [(name, text) for name, text in clauses if shared[text] == 1 and len(text.split()) >= CLAUSE and (name, text) not in templates]


TEMPLATES = with_first_clauses(TEMPLATES)
NAMES = sorted({name for name, _ in TEMPLATES})


def vocabulary() -> list[str]:
    return sorted({w for _, text in TEMPLATES for w in re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())})


def idf_of(df: Column, total: int) -> Column:
    return F.log((1 + total) / (1 + F.coalesce(df, F.lit(0)))) + 1


def weights(files: DataFrame, text: str, total: int) -> DataFrame:
    """(term, idf) of the templates' terms, ln((1 + n) / (1 + df)) + 1 over all files."""
    terms = files.sparkSession.createDataFrame([(t,) for t in vocabulary()], "term string")
    found = files.select(F.explode(F.array_intersect(words(F.col(text)), F.array(*map(F.lit, vocabulary())))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return terms.join(found, "term", "left").select("term", idf_of(F.col("df"), total).alias("idf"))


def weights_of(files: DataFrame, text: str, total: int, known: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, idf) of known and of all wanted terms: files are read once more, and only their wanted terms are counted."""
    more = materialise(wanted.select("term").distinct().join(F.broadcast(known), "term", "left_anti"), "more-terms")
    found = files.select(F.explode(F.array_distinct(words(F.col(text)))).alias("term")).join(bounded(more), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return known.unionByName(found.select("term", idf_of(F.col("df"), total).alias("idf")))


def template_vectors(spark: SparkSession, idf: DataFrame) -> DataFrame:
    """(template, licence, term, idf, w): unit vectors."""
    table = spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "template int, licence string, text string")
    tf = table.select("template", "licence", F.explode(words(F.col("text"))).alias("term")).groupBy("template", "licence", "term").agg(F.count(F.lit(1)).alias("tf"))
    raw = tf.join(idf, "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    return raw.select("template", "licence", "term", "idf", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("template")))).alias("w"))


def strong_terms(vectors: DataFrame, threshold: float) -> list[str]:
    """The terms of which a segment must have one to reach the threshold with any template: of each template the rarest, until the rest is lighter than the threshold. Bounded by the vocabulary."""
    lighter = F.sum(F.col("w") * F.col("w")).over(W.partitionBy("template").orderBy("idf", "term").rowsBetween(W.unboundedPreceding, 0))
    return [r.term for r in vectors.withColumn("rest", F.sqrt(lighter)).where(F.col("rest") >= threshold * 0.999999).select("term").distinct().collect()]


def term_counts(segments: DataFrame) -> DataFrame:
    """Writes and returns (row, seg, term, tf)."""
    return materialise(segments.select("row", "seg", F.explode("tokens").alias("term")).groupBy("row", "seg", "term").agg(F.count(F.lit(1)).alias("tf")), "term-counts")


def best_match(counts: DataFrame, idf: DataFrame, vectors: DataFrame) -> DataFrame:
    """(row, seg, words, licence, score): of each segment the licence of the template with the highest cosine, the first by name of equal ones."""
    each = counts.join(bounded(idf), "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norms = each.groupBy("row", "seg").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("words"))
    dots = each.join(F.broadcast(vectors.select("template", "licence", "term", F.col("w").alias("t"))), "term").groupBy("row", "seg", "template", "licence").agg(F.sum(F.col("w") * F.col("t")).alias("dot"))
    cosine = dots.join(norms, ["row", "seg"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9))  # so that equal lines tie whatever the order of their sums
    best = cosine.groupBy("row", "seg", "words").agg(F.min(F.struct((-F.col("score")).alias("less"), "licence")).alias("best"))
    return best.select("row", "seg", "words", F.col("best.licence").alias("licence"), (-F.col("best.less")).alias("score"))


def directories(path: Column) -> Column:
    """The ancestor directories of a path, from the root ('') down."""
    parts = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def stripped(text: Column) -> Column:
    """The text without what starts lines of comments."""
    return F.regexp_replace(text, F.lit("(?md)^" + MARK), F.lit(""))


def scan(files: DataFrame, path: str = "path", text: str = "text", keep: list[str] = (), threshold: float = THRESHOLD, file_share: float = FILE_SHARE) -> DataFrame:
    """One row per row of files: the columns of ``keep``, path, own (its own licence or null), score, licence, origin ('own', 'inherited' or null), licence_from (path of the licence file inherited from).

    A file's own licence is that of its best segment (of its whole text, too, if it is named as a licence file), or that of its first tag, with score 1; ties go to the first name. A tag alone doesn't make a licence file. Directories with several
    licence files take the best score, then the first path. Null or empty texts have no licence of their own, a null path inherits nothing; repeated rows are rows like others.
    """
    spark, total = files.sparkSession, files.count()
    known = materialise(weights(files, text, total), "idf")
    vectors = materialise(template_vectors(spark, known), "vectors")
    heavy = sorted(strong_terms(vectors, threshold))
    strong = F.array(*map(F.lit, heavy))
    has = lambda s: F.arrays_overlap(words(s), strong)
    t = F.coalesce(F.col(text), F.lit(""))
    named = F.coalesce(F.col(path).rlike(NAMED), F.lit(False))
    rows = files.select(F.monotonically_increasing_id().alias("row"), *keep, F.col(path).alias("path"), named.alias("named"), t.alias("t"))
    tag = F.regexp_replace(F.regexp_extract(F.lower("t"), TAG, 1), LATER, "")
    names = F.create_map(*(F.lit(x) for n in NAMES for x in (n.lower(), n)))
    tagged = F.when(F.contains(F.lower("t"), F.lit("spdx-license-identifier:")), F.try_element_at(names, tag))
    rows = rows.withColumn("tag", tagged).withColumn("t", F.when(has(F.col("t")), F.col("t")))
    lines = materialise(rows, "lines")  # texts of the few rows that may declare a licence
    plain = lines.where("t IS NOT NULL").withColumn("plain", stripped(F.col("t"))).withColumn("header", stripped(F.regexp_extract("t", HEADER, 0)))
    parts = F.concat(F.split("plain", "[\r\n]+"), F.split("plain", SENTENCE), F.filter(F.array_append(F.split("plain", PARAGRAPH), F.col("header")), lambda s: s.contains("\n")))
    plain = plain.select("row", "named", "plain", F.when(F.col("named"), F.array_append(parts, F.col("plain"))).otherwise(parts).alias("cut"))
    cut = materialise(plain.select("row", F.size(words(F.col("plain"))).alias("n_words"), F.filter(F.array_distinct("cut"), has).alias("cut")).where(F.size("cut") > 0), "segments")
    segments = cut.select("row", F.posexplode("cut").alias("seg", "s"))
    counts = term_counts(segments.select("row", "seg", words(F.col("s")).alias("tokens")))
    idf = materialise(weights_of(files, text, total, known, counts), "all-idf")
    best = best_match(counts, idf, vectors).where(F.col("score") >= threshold).join(cut.select("row", "n_words"), "row")
    most = (F.max("words") >= file_share * F.max("n_words")).alias("near")
    told = lines.where("tag IS NOT NULL").select("row", F.lit(0).cast("long").alias("words"), F.col("tag").alias("licence"), F.lit(1.0).alias("score"), F.lit(1).alias("n_words"))
    best = best.select("row", "words", "licence", "score", "n_words").unionByName(told)
    own = best.groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("less"), "licence")).alias("best"), most)
    own = materialise(own.select("row", F.col("best.licence").alias("own"), (-F.col("best.less")).alias("score"), "near"), "own")
    base = lines.drop("t", "tag").join(bounded(own), "row", "left")
    above = F.element_at(directories(F.col("path")), -1)
    declared = base.where(F.col("own").isNotNull() & F.col("path").isNotNull() & (F.col("named") | F.col("near"))).groupBy(above.alias("dir")).agg(F.min(F.struct((~F.col("named")).alias("unnamed"), (-F.col("score")).alias("less"), "path", "own")).alias("best"))
    declared = materialise(declared.select("dir", F.col("best.path").alias("licence_from"), F.col("best.own").alias("inherited")), "declared")
    wanting = base.where(F.col("own").isNull()).select("row", F.posexplode(directories(F.col("path"))).alias("depth", "dir"))
    nearest = wanting.join(bounded(declared), "dir").groupBy("row").agg(F.max_by(F.struct("licence_from", "inherited"), "depth").alias("near_file"))
    out = base.join(nearest, "row", "left")
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("near_file").isNotNull(), "inherited")
    return out.select(*keep, "path", "own", "score", F.coalesce("own", F.col("near_file.inherited")).alias("licence"), origin.alias("origin"), F.col("near_file.licence_from").alias("licence_from"))


def query(spark, sf_dir: str) -> DataFrame:
    """documents as a tree of files: source / language / id; texts that are mostly a notice are the licence files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string"))
    return scan(docs.select("doc_id", "text", path.alias("path")), keep=["doc_id"]).withColumn("score", F.round("score", 6))


WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL = rf"""
WITH t(template, licence, text) AS (VALUES {", ".join(f"({i}, {_quoted(n)}, {_quoted(t)})" for i, (n, t) in enumerate(TEMPLATES))}),
tt AS (SELECT template, licence, w, count(*) AS tf FROM (SELECT template, licence, unnest(regexp_extract_all(lower(text), {WORD})) AS w FROM t) GROUP BY ALL),
d AS (SELECT doc_id, concat_ws('/', coalesce(source, ''), coalesce(lang, ''), CAST(doc_id AS VARCHAR)) AS path, coalesce(source, '') || '/' || coalesce(lang, '') AS dir, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
df AS (SELECT w, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(low, {WORD})) AS w FROM d) GROUP BY w),
idf AS (SELECT w, ln((1 + (SELECT count(*) FROM d)) / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT w FROM tt UNION SELECT w FROM df) LEFT JOIN df USING (w)),
tv AS (SELECT template, licence, w, (1 + ln(tf)) * idf / sqrt(sum((1 + ln(tf)) * idf * (1 + ln(tf)) * idf) OVER (PARTITION BY template)) AS x FROM tt JOIN idf USING (w)),
p AS (SELECT doc_id, low, regexp_replace(low, '(?m)^{MARK}', '', 'g') AS plain, regexp_replace(regexp_extract(low, '{HEADER}', 0), '(?m)^{MARK}', '', 'g') AS header FROM d),
segs AS (SELECT doc_id, unnest(list_concat(regexp_split_to_array(plain, '[\r\n]+'), regexp_split_to_array(plain, '{SENTENCE}'), list_filter(list_append(regexp_split_to_array(plain, '{PARAGRAPH}'), header), lambda s: contains(s, chr(10))))) AS s FROM p),
l AS (SELECT doc_id, row_number() OVER () AS i, s FROM segs),
lw AS (SELECT doc_id, i, w, count(*) AS tf, (1 + ln(count(*))) * any_value(idf) AS x FROM (SELECT doc_id, i, unnest(regexp_extract_all(s, {WORD})) AS w FROM l) JOIN idf USING (w) GROUP BY doc_id, i, w),
nrm AS (SELECT i, sqrt(sum(x * x)) AS n, sum(tf) AS words FROM lw GROUP BY i),
cosine AS (SELECT doc_id, licence, words, round(s / n, 9) AS score FROM (SELECT doc_id, i, template, licence, sum(lw.x * tv.x) AS s FROM lw JOIN tv USING (w) GROUP BY ALL) JOIN nrm USING (i) WHERE round(s / n, 9) >= {THRESHOLD}),
told AS (SELECT doc_id, name AS licence, 0 AS words, 1.0::DOUBLE AS score FROM d JOIN (VALUES {", ".join(f"({_quoted(n.lower())}, {_quoted(n)})" for n in NAMES)}) names(tag, name) ON tag = regexp_replace(regexp_extract(low, '{TAG}', 1), '{LATER}', '')),
own AS (SELECT doc_id, arg_min(licence, (-score, licence)) AS own, max(score) AS score, max(words) AS words FROM (SELECT * FROM cosine UNION ALL SELECT * FROM told) GROUP BY doc_id),
decl AS (SELECT dir, arg_min(path, (-score, path)) AS licence_from, arg_min(own, (-score, path)) AS near FROM d JOIN own USING (doc_id) JOIN p USING (doc_id) WHERE words >= {FILE_SHARE} * len(regexp_extract_all(plain, {WORD})) GROUP BY dir)
SELECT doc_id, path, own, round(score, 6) AS score, coalesce(own, near) AS licence, CASE WHEN own IS NOT NULL THEN 'own' WHEN near IS NOT NULL THEN 'inherited' END AS origin, CASE WHEN own IS NULL THEN licence_from END AS licence_from
FROM d LEFT JOIN own USING (doc_id) LEFT JOIN decl USING (dir)
"""
