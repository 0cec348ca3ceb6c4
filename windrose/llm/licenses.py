"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance from directories.

A file's own licence is the template that one of its passages is closest to: a line, a run of up to RUN lines (a
header that is broken across lines), a paragraph (a header block or the body of a licence), or the whole text of a
licence file. A licence file passes its licence on to its directory; every file without its own takes that of its
nearest ancestor directory. Vectors are sparse: rows of (passage, term, weight) joined to the templates' terms.

Only built-in expressions, joins and aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.llm.common import checkpoint, join_hot

#: Statements as they stand in headers, one or more for each licence.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "licensed under the apache license version 2.0"),
    ("Apache-2.0", "spdx license identifier apache 2.0"),
    ("MIT", "released under the mit license"),
    ("MIT", "spdx license identifier mit"),
    ("BSD-3-Clause", "use of this source code is governed by a bsd style license"),
    ("BSD-3-Clause", "spdx license identifier bsd 3 clause"),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    ("GPL-3.0", "spdx license identifier gpl 3.0"),
    ("GPL-2.0", "free software under the gnu general public license version 2"),
    ("LGPL-3.0", "licensed under the gnu lesser general public license version 3"),
    ("AGPL-3.0", "licensed under the gnu affero general public license version 3"),
    ("MPL-2.0", "subject to the terms of the mozilla public license version 2.0"),
    ("CC-BY-4.0", "licensed under a creative commons attribution 4.0 international license"),
    ("CC-BY-4.0", "licensed under cc by 4.0"),
    ("CC-BY-SA-4.0", "licensed under cc by sa 4.0"),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4.0"),
    ("CC0-1.0", "dedicated to the public domain under cc0 1.0"),
    ("Unlicense", "released into the public domain unlicense"),
    ("Proprietary", "all rights reserved no part may be reproduced without permission"),
)
_GNU = "this program is free software you can redistribute it and or modify it under the terms of the gnu {}general public license as published by the free software foundation either version {} of the license or at your option any later version"
_AS_IS = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
_MIT_END = "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
#: Headers, titles and bodies of full texts.
BODIES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www.apache.org licenses license 2.0"),
    ("Apache-2.0", "apache license version 2.0 january 2004 http www.apache.org licenses terms and conditions for use reproduction and distribution"),
    ("MIT", _MIT), ("MIT", f"mit license {_MIT} {_MIT_END}"),
    ("BSD-2-Clause", f"{_BSD} {_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD} neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_AS_IS}"),
    ("BSD-3-Clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("GPL-3.0", _GNU.format("", 3)), ("GPL-2.0", _GNU.format("", 2)), ("LGPL-3.0", _GNU.format("lesser ", 3)), ("AGPL-3.0", _GNU.format("affero ", 3)),
    ("GPL-3.0", "gnu general public license version 3 29 june 2007"), ("GPL-2.0", "gnu general public license version 2 june 1991"), ("LGPL-3.0", "gnu lesser general public license version 3 29 june 2007"), ("AGPL-3.0", "gnu affero general public license version 3 19 november 2007"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0"),
    ("Unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
)
#: Least cosine of a passage to a template; lines in a run at most.
COSINE, RUN = 0.7, 4
#: So many directories with a licence are broadcast; more are joined by directory and salt.
BROADCAST_DIRS = 500_000
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.\-][^/]*)?$"
_SPLIT = r"[^\p{L}\p{N}.]+|\.(?![0-9])"


def terms(text: Column) -> Column:
    """Lower-cased runs of letters, digits and the dots between digits."""
    return F.filter(F.split(F.lower(text), _SPLIT), lambda x: x != "")


def _templates(spark: SparkSession, templates) -> DataFrame:
    rows = [(k, name, text) for k, (name, text) in enumerate(templates)]
    t = spark.createDataFrame(rows, "template int, license string, text string").select("template", "license", F.explode(terms(F.col("text"))).alias("term"))
    return t.groupBy("template", "license", "term").agg(F.count("*").cast("double").alias("tf"))


def _needed(weights: list[tuple[int, str, float]], n: dict[str, int], cosine: float) -> list[str]:
    """Terms of which a passage must have one to reach the cosine, from (template, term, weight) of unit length.

    A passage that shares the terms S with a template has at most the cosine sqrt(sum of S's squared weights), however
    it weighs them. So each template's commonest terms are left out as long as they can't reach the cosine.
    """
    left: dict[int, float] = {}
    needed = set()
    for k, term, w in sorted(weights, key=lambda x: (-n.get(x[1], 0), x[1])):
        left[k] = left.get(k, 0.0) + w * w
        if left[k] >= (cosine - 1e-5) ** 2:  # the cosine is rounded to six digits
            needed.add(term)
    return sorted(needed)


def _units(files: DataFrame, vocabulary: list[str], needed: list[str], whole: Column) -> DataFrame:
    """path, is_file, whole, t (sorted terms of the templates), odd (other words) of each passage that can match.

    A text's lines are cut into terms once; runs and paragraphs are put together from them. Of a whole text the other
    words count, too: a licence file says hardly anything else, while a header stands in a file of other things.
    """
    must, known = F.array(*map(F.lit, needed)), lambda t: F.filter(t, lambda x: x.isin(vocabulary))
    hinted = files.select("*", terms(F.coalesce("text", F.lit(""))).alias("all")).filter(F.arrays_overlap("all", must))
    lines = hinted.select("path", "is_file", "all", F.transform(F.split("text", "\n"), lambda x: known(terms(x))).alias("lt"), F.transform(F.split("text", "\n"), lambda x: ~x.rlike(r"[\p{L}\p{N}]")).alias("blank"))
    at = F.filter(F.sequence(F.lit(1), F.size("lt")), lambda i: F.size(F.element_at("lt", i)) > 0)
    runs = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(RUN), F.size("lt") - i + 1)), lambda k: F.flatten(F.slice("lt", i, k)))))
    # A paragraph begins after a blank line and ends before the next.
    edges = F.concat(F.array(F.lit(0)), F.filter(F.sequence(F.lit(1), F.size("lt")), lambda i: F.element_at("blank", i)), F.array(F.size("lt") + 1))
    lines = lines.withColumn("edges", edges)
    blocks = F.filter(F.transform("edges", lambda e, k: F.when(F.get("edges", k + 1) > e + 1 + RUN, F.flatten(F.slice("lt", e + 1, F.get("edges", k + 1) - e - 1))).otherwise(F.array().cast("array<string>"))), lambda t: F.size(t) > 0)
    part = F.transform(F.array_distinct(F.transform(F.filter(F.concat(runs, blocks), lambda t: F.arrays_overlap(t, must)), lambda t: F.array_sort(t))), lambda t: F.struct(F.lit(False).alias("whole"), t.alias("t"), F.lit(0).alias("odd")))
    all_of = F.array_sort(known(F.col("all")))
    full = F.array(F.struct(F.lit(True).alias("whole"), all_of.alias("t"), (F.size("all") - F.size(all_of)).alias("odd")))
    return lines.select("path", "is_file", F.explode(F.concat(part, F.when(whole, full).otherwise(F.slice(full, 1, 0)))).alias("u")).select("path", "is_file", "u.whole", "u.t", "u.odd")


def scan(df: DataFrame, *, path_col: str = "path", text_col: str = "text", templates=TEMPLATES + BODIES, cosine: float = COSINE, is_file: Column | None = None, by_text: bool = False) -> DataFrame:
    """path, own (licence of the file's best passage), cosine, license (own, else inherited), source ('own',
    'inherited' or null) of every row with a path.

    idf is ln((1 + N) / (1 + n)) + 1 over all N texts, for the terms of the templates; in a whole text other words
    weigh as if no other text had them, elsewhere nothing. Of equal cosines the licence first in the alphabet wins.
    Licence files are those whose name says so, or the rows where ``is_file`` holds, or (by_text) those whose whole
    text is close enough to a template; of several in a directory the best cosine, then the first licence counts.
    Null and empty texts have no own licence; texts of any length are read whole; repeated rows of a path are one
    file; null paths are left out; other columns are ignored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    named = F.lit(False) if by_text else F.col(path_col).rlike(LICENSE_FILE) if is_file is None else F.coalesce(is_file, F.lit(False))
    files = df.filter(F.col(path_col).isNotNull()).select(F.col(path_col).alias("path"), F.col(text_col).alias("text"), named.alias("is_file"))
    tf = checkpoint(_templates(spark, templates))
    vocabulary = sorted(r.term for r in tf.select("term").distinct().collect())  # the templates' words
    known = F.array(*map(F.lit, vocabulary))
    counted = files.select(F.explode(F.array_union(F.array_intersect(terms(F.coalesce("text", F.lit(""))), known), F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()
    n = {r.term: r.n for r in counted}  # one row for each word of the templates
    total = n.get("", 0)
    idf = spark.createDataFrame([(t, n.get(t, 0)) for t in vocabulary], "term string, n long").select("term", (F.log((F.lit(1.0) + total) / (1 + F.col("n"))) + 1).alias("idf"))
    weights = tf.join(F.broadcast(idf), "term").select("template", "license", "term", (F.col("tf") * F.col("idf")).alias("tw"))
    norms = weights.groupBy("template").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tn"))
    weights = weights.join(F.broadcast(norms), "template").select("template", "license", "term", (F.col("tw") / F.col("tn")).alias("tw"))
    needed = _needed([(r.template, r.term, r.tw) for r in weights.select("template", "term", "tw").collect()], n, cosine)  # a row for each word of a template

    units = checkpoint(_units(files, vocabulary, needed, F.lit(True) if by_text else F.col("is_file")).select("path", "is_file", "whole", "t", "odd", F.xxhash64("t", "odd").alias("h1"), F.xxhash64("odd", "t").alias("h2")))
    # Equal passages are scored once, however many files have them.
    said = units.groupBy("h1", "h2").agg(F.first("t").alias("t"), F.first("odd").alias("odd"))
    vector = said.select("h1", "h2", "odd", F.explode("t").alias("term")).groupBy("h1", "h2", "term").agg(F.count("*").alias("tf"), F.first("odd").alias("odd")).join(F.broadcast(idf), "term").select("h1", "h2", "term", "odd", (F.col("tf") * F.col("idf")).alias("w"))
    alone = F.pow(F.log((F.lit(1.0) + total) / 2) + 1, F.lit(2.0))
    norm = vector.groupBy("h1", "h2").agg(F.sqrt(F.sum(F.col("w") * F.col("w")) + F.first("odd") * alone).alias("norm"))
    dot = vector.join(F.broadcast(weights), "term").groupBy("h1", "h2", "template", "license").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    close = dot.join(norm, ["h1", "h2"]).select("h1", "h2", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")).filter(F.col("cosine") >= cosine)
    best = checkpoint(close.groupBy("h1", "h2").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b")))
    own = units.drop("t", "odd").join(best, ["h1", "h2"]).groupBy("path").agg(F.min("b").alias("b"), F.max("is_file").alias("is_file"), F.min(F.when(F.col("whole"), F.col("b"))).alias("all"))
    own = checkpoint(own.select("path", "is_file", F.col("b.license").alias("own"), (-F.col("b.c")).alias("cosine"), "b", "all"))

    folder = lambda p: F.regexp_extract(p, r"(?s)^(.*)/[^/]*$", 1)
    passed = own.select("path", F.col("all").alias("b")).filter("b IS NOT NULL") if by_text else own.filter("is_file").select("path", "b")
    holds = checkpoint(passed.groupBy(folder(F.col("path")).alias("dir")).agg(F.min("b").alias("b")).select("dir", F.col("b.license").alias("license")))
    # Directories, not files, look up their ancestors. An upper directory is many others' ancestor.
    dirs = files.select(folder(F.col("path")).alias("of")).distinct()
    steps = F.split("of", "/")
    above = dirs.select("of", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, 1, k), "/").alias("dir")))).alias("a"))
    near = join_hot(above.select("of", "a.depth", "a.dir"), holds, "dir", holds.count(), BROADCAST_DIRS, ["of"]).filter("license IS NOT NULL")
    near = near.groupBy("of").agg(F.max(F.struct("depth", "license")).alias("n")).select("of", F.col("n.license").alias("inherited"))
    every = files.select("path").distinct().withColumn("of", folder(F.col("path")))
    near = checkpoint(near)
    out = join_hot(every.join(own.select("path", "own", "cosine"), "path", "left"), near, "of", near.count(), BROADCAST_DIRS, ["path"])
    source = F.when(F.col("own").isNotNull(), F.lit("own")).when(F.col("inherited").isNotNull(), F.lit("inherited"))
    return out.select("path", "own", "cosine", F.coalesce("own", "inherited").alias("license"), source.alias("source"))
