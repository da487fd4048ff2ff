"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A header is a line, a sentence of a line, a paragraph or a comment block that holds an anchor word of licence language; a licence file
is a file named so, or one whose anchored lines hold a good part of its words. Headers, and named licence files as a whole, are compared
with every template they share a term with, by an equi-join on terms: notices, titles, SPDX lines, standard headers and the bodies of the
short licences. A file takes the licence of its best header, a reserved right only where nothing is granted; without one it inherits that of the licence file in the nearest
directory above it. Directories are resolved once each, before files are joined to them. DataFrame expressions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.llm.support import written

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
)
_GNU = {"GPL-2.0": ("", "2", "June 1991"), "GPL-3.0": ("", "3", "29 June 2007"), "LGPL-2.1": ("Lesser ", "2.1", "February 1999"), "LGPL-3.0": ("Lesser ", "3", "29 June 2007"), "AGPL-3.0": ("Affero ", "3", "19 November 2007")}
_SPDX = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "ISC", "MIT", "MPL-2.0", "Unlicense")

# Texts by which licences are declared, without apostrophes. Callers may pass their own list of (licence, text).
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License. Redistribution and use in source and binary forms are permitted."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License. Redistribution and use in source and binary forms are permitted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose is granted under the ISC License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", _MIT[0]),
    ("MIT", " ".join(_MIT)),
    ("ISC", "ISC License"),
    ("ISC", _ISC),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", _BSD[1]),
    ("BSD-2-Clause", " ".join((_BSD[0], _BSD[2]))),
    ("BSD-3-Clause", " ".join(_BSD)),
    *((name, f"GNU {kind}General Public License Version {version}, {date}") for name, (kind, version, date) in _GNU.items()),
    *((name, f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")
      for name, (kind, version, _) in _GNU.items()),
    *((name, f"SPDX-License-Identifier: {name}-{which}") for name in _GNU for which in ("only", "or-later")),
    *((name, f"SPDX-License-Identifier: {name}") for name in (*_GNU, *_SPDX)),
)
RESERVED = "Proprietary"  # found beside a licence, as in the first line of most BSD texts, it does not stand against it
SENTENCE = "(?<=[.!?])\\s+"
PARAGRAPH = "\n[ \t\r]*\n"
COMMENTS = "(?m)(?:^[ \t]*+(?:#|//|/?[*]|--|;|%)[^\n]*+(?:\n|$)){2,80}"  # bounded, as the pattern is matched by recursion
ANCHORS = ("licen", "copyright", "rights reserved", "public domain", "permission", "spdx")
FILE_NAMES = "(?i)^(licen[cs]e|copying|copyright|notice|unlicense)([.-].*)?$"
LEAST_COSINE = 0.6
FILE_SHARE = 0.25  # a file is a licence file if its headers hold this share of its words
TERM = "[a-z0-9]+(?:[.][0-9]+)*"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _anchored(text: Column) -> Column:
    lowered = F.lower(text)
    found = F.contains(lowered, F.lit(ANCHORS[0]))
    for anchor in ANCHORS[1:]:
        found = found | F.contains(lowered, F.lit(anchor))
    return found


def _template_weights(spark, templates) -> tuple[DataFrame, DataFrame, float]:
    """Inverse document frequency of every template term, weights per template (unit length), and the frequency of unknown terms.

    The size of both tables is that of the list of templates."""
    rows = spark.createDataFrame(list(templates), "licence string, notice string").select("licence", "notice", F.explode(_terms(F.col("notice"))).alias("term"))
    counts = rows.groupBy("licence", "notice", "term").agg(F.count("*").alias("times"))
    n = len(templates)
    idf = counts.groupBy("term").agg((F.log((1.0 + n) / (1.0 + F.count("*"))) + 1.0).alias("idf"))
    weights = counts.join(F.broadcast(idf), "term").withColumn("w", F.col("times") * F.col("idf"))
    lengths = weights.groupBy("licence", "notice").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("length"))
    unit = weights.join(F.broadcast(lengths), ["licence", "notice"]).select("licence", "notice", "term", (F.col("w") / F.col("length")).alias("unit"))
    return idf, unit, F.log(F.lit(1.0 + n)) + 1.0


def scan(files: DataFrame, path: str = "path", text: str = "text", templates=TEMPLATES, least: float = LEAST_COSINE) -> DataFrame:
    """``path, licence, score, licence_file`` of every path with a header or licence file that matches a template.

    Texts are scanned whole. Null texts and paths are left out; rows with the same path are one file. Ties of the rounded score go
    to the first licence by name; reserved rights come after all licences."""
    idf, unit, unknown = _template_weights(files.sparkSession, templates)
    rows = files.select(F.col(path).alias("path"), F.col(text).alias("text")).filter("path IS NOT NULL AND text IS NOT NULL")
    named = F.element_at(F.split("path", "/"), -1).rlike(FILE_NAMES)
    likely = rows.filter(named | _anchored(F.col("text"))).withColumn("named", named).withColumn("words", F.size(F.filter(F.split("text", "\\s+"), lambda w: w != "")))
    lines = likely.select("path", "words", "named", F.explode(F.split("text", "\n")).alias("unit_text")).filter(_anchored(F.col("unit_text"))).withColumn("whole", F.lit(False))
    whole = likely.filter("named").select("path", "words", "named", F.col("text").alias("unit_text"), F.lit(True).alias("whole"))
    pieces = lines.select("path", "words", "named", F.split("unit_text", SENTENCE).alias("parts")).filter(F.size("parts") > 1)
    pieces = pieces.unionByName(likely.select("path", "words", "named", F.concat(F.filter(F.split("text", PARAGRAPH), lambda p: F.contains(F.trim(p), F.lit("\n"))),
                                                                                F.regexp_extract_all("text", F.lit(COMMENTS), F.lit(0))).alias("parts")))
    blocks = pieces.select("path", "words", "named", F.explode("parts").alias("unit_text"), F.lit(True).alias("whole")).filter(_anchored(F.col("unit_text")))
    units = lines.unionByName(whole).unionByName(blocks).withColumn("unit_id", F.xxhash64("unit_text", "whole")).withColumn("unit_words", F.size(F.filter(F.split("unit_text", "\\s+"), lambda w: w != "")))
    per_unit = units.groupBy("path", "unit_id", "named", "words").agg(F.first("unit_text").alias("unit_text"), F.sum(F.when(~F.col("whole"), F.col("unit_words")).otherwise(0)).alias("unit_words"))
    shares = per_unit.groupBy("path").agg((F.max("named") | (F.sum("unit_words") >= FILE_SHARE * F.max("words"))).alias("licence_file"))
    terms = per_unit.select("path", "unit_id", F.explode(_terms(F.col("unit_text"))).alias("term")).groupBy("path", "unit_id", "term").agg(F.count("*").alias("times"))
    weighed = terms.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("times") * F.coalesce("idf", unknown))
    lengths = weighed.groupBy("path", "unit_id").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("length"))
    products = weighed.join(F.broadcast(unit), "term").groupBy("path", "unit_id", "licence", "notice").agg(F.sum(F.col("w") * F.col("unit")).alias("dot"))
    scores = products.join(lengths, ["path", "unit_id"]).withColumn("score", F.round(F.col("dot") / F.col("length"), 6)).filter(F.col("score") >= least)
    best = scores.groupBy("path").agg(F.min(F.struct((F.col("licence") == RESERVED).alias("reserved"), (-F.col("score")).alias("minus"), F.col("licence"))).alias("b"))
    return best.join(shares, "path").select("path", "b.licence", (-F.col("b.minus")).alias("score"), "licence_file")


def _directory(path: Column) -> Column:
    """Everything before the last slash; the root is the empty text."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def _above(directory: Column) -> Column:
    """The directory and all above it, with their depth."""
    parts = F.when(directory == "", F.array().cast("array<string>")).otherwise(F.split(directory, "/"))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")))


def inherit(paths: DataFrame, found: DataFrame, path: str = "path") -> DataFrame:
    """``path, licence, origin, score, inherited_from`` of every distinct non-null path; ``origin`` is header, file, inherited or null."""
    every = paths.select(F.col(path).alias("path")).filter("path IS NOT NULL").distinct().withColumn("directory", _directory(F.col("path")))
    files = found.filter("licence_file").withColumn("above", _directory(F.col("path")))
    declared = files.groupBy("above").agg(F.min(F.struct((-F.col("score")).alias("minus"), F.col("path"), F.col("licence"))).alias("d"))
    climbed = every.select("directory").distinct().select("directory", F.explode(_above(F.col("directory"))).alias("a")).select("directory", "a.*")
    nearest = climbed.join(declared, "above").groupBy("directory").agg(F.max(F.struct("depth", "above", F.col("d.licence").alias("licence"))).alias("n"))
    own = every.join(found, "path", "left").join(nearest, "directory", "left")
    inherited = F.col("licence").isNull()
    return own.select("path", F.coalesce("licence", "n.licence").alias("licence"),
                      F.when(~inherited, F.when(F.col("licence_file"), "file").otherwise("header")).when(F.col("n.licence").isNotNull(), "inherited").alias("origin"),
                      "score", F.when(inherited, F.col("n.above")).alias("inherited_from"))


def licences(files: DataFrame, path: str = "path", text: str = "text", **rules) -> DataFrame:
    """Scan and inheritance; one row per distinct path, rows without a path left out."""
    return inherit(files, written(scan(files, path, text, **rules), "licences"), path)


def sql_twin(files_sql: str) -> str:
    """The same over a DuckDB query that gives ``path`` and ``text``; for tests and the query's check."""
    values = ", ".join(f"('{name}', '{notice}')" for name, notice in TEMPLATES)
    anchored = " OR ".join(f"contains(lower({{0}}), '{a}')" for a in ANCHORS)
    term, n = TERM, len(TEMPLATES)
    return f"""
WITH files AS ({files_sql}),
tpl(licence, notice) AS (VALUES {values}),
tt AS (SELECT licence, notice, term, count(*) AS times FROM (SELECT licence, notice, unnest(regexp_extract_all(lower(notice), '{term}')) AS term FROM tpl) GROUP BY ALL),
idf AS (SELECT term, ln((1.0 + {n}) / (1.0 + count(*))) + 1.0 AS idf FROM tt GROUP BY term),
tw AS (SELECT licence, notice, term, times * idf / sqrt(sum((times * idf) ** 2) OVER (PARTITION BY licence, notice)) AS unit FROM tt JOIN idf USING (term)),
likely AS (SELECT path, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words FROM files WHERE {anchored.format('text')}),
units AS (SELECT DISTINCT path, words, unit_text, sum(len(list_filter(regexp_split_to_array(unit_text, '\\s+'), lambda w: w <> ''))) OVER (PARTITION BY path) AS in_headers
  FROM (SELECT path, words, unnest(string_split(text, chr(10))) AS unit_text FROM likely) WHERE {anchored.format('unit_text')}),
terms AS (SELECT path, unit_text, term, count(*) AS times FROM (SELECT path, unit_text, unnest(regexp_extract_all(lower(unit_text), '{term}')) AS term FROM units) GROUP BY ALL),
w AS (SELECT path, unit_text, term, times * coalesce(idf, ln(1.0 + {n}) + 1.0) AS w FROM terms LEFT JOIN idf USING (term)),
sizes AS (SELECT path, unit_text, sqrt(sum(w ** 2)) AS size FROM w GROUP BY ALL),
scores AS (SELECT path, licence, round(dot / size, 6) AS score FROM (SELECT path, unit_text, licence, notice, sum(w * unit) AS dot FROM w JOIN tw USING (term) GROUP BY ALL) JOIN sizes USING (path, unit_text)),
best AS (SELECT path, licence, score FROM scores WHERE score >= {LEAST_COSINE} QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, licence) = 1),
found AS (SELECT path, licence, score, in_headers >= {FILE_SHARE} * words AS licence_file FROM best JOIN (SELECT DISTINCT path, words, in_headers FROM units) USING (path)),
paths AS (SELECT DISTINCT path, regexp_replace(path, '/[^/]*$', '') AS directory FROM files),
declared AS (SELECT regexp_replace(path, '/[^/]*$', '') AS above, licence FROM found WHERE licence_file
  QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY score DESC, path) = 1),
nearest AS (SELECT directory, above, licence FROM (SELECT DISTINCT directory FROM paths) JOIN declared ON directory = above OR starts_with(directory, above || '/')
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY length(above) DESC) = 1)
SELECT p.path, coalesce(f.licence, n.licence) AS licence,
  CASE WHEN f.licence_file THEN 'file' WHEN f.licence IS NOT NULL THEN 'header' WHEN n.licence IS NOT NULL THEN 'inherited' END AS origin,
  f.score, CASE WHEN f.licence IS NULL THEN n.above END AS inherited_from
FROM paths p LEFT JOIN found f USING (path) LEFT JOIN nearest n USING (directory)
"""
