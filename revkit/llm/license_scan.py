"""License scans (native): sparse TF-IDF cosine to templates, then inheritance
from the nearest ancestor directory.

Every line of every file, and the whole text of a file named like a licence, is
a segment. Segments and templates are vectors of term counts times idf, with
document frequencies over all files for the templates' terms; a term that no
template has weighs as one never seen. A segment can only reach the threshold
with a template if it has one of the template's heaviest terms (the rest is too
short a vector, by Cauchy-Schwarz), so segments without any such term are left
out at the scan and nothing is lost. What remains is exploded to terms, joined
to the templates' weights and summed per segment and template.

A file's own licence is its best segment. Files without one inherit from the
deepest ancestor directory that holds a licence file with a licence, by a join
of each file's ancestor paths with the licence directories of its repository.

Defined results: null or empty text has no segments; a null path is never a
licence file and inherits nothing; equal rows get equal results; ties go to the
higher score (rounded to 4 places), then the first licence name, then the first
path; a text of any length is read whole, line by line; an empty table gives no
rows; columns other than id, repository, path and text are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revkit.llm.common import materialize

#: Least cosine of a segment and a template.
THRESHOLD = 0.6
LICENSE_FILE = r"^(?i:licen[cs]e|copying|notice)(?:[.-][A-Za-z0-9.-]*)?$"

# Licence -> the notices and opening sentences it is known by.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def terms_of(text: str) -> list[str]:
    return [t for t in re.split(r"[^a-z0-9]+", text.lower()) if t]


def terms(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+", -1), lambda t: t != "")


VOCABULARY = tuple(sorted({t for _, text in TEMPLATES for t in terms_of(text)}))


def document_counts(texts: DataFrame) -> tuple[int, dict[str, int]]:
    """(files, files that have each template term): one number a vocabulary term."""
    known = F.array(*[F.lit(t) for t in VOCABULARY])
    seen = texts.select(F.explode(F.array_intersect(terms(F.col("text")), known)).alias("term"))
    counts = {r["term"]: r["count"] for r in seen.groupBy("term").count().collect()}
    return texts.count(), counts


def weights(files: int, counts: dict[str, int]) -> dict[str, float]:
    return {t: math.log((files + 1) / (counts.get(t, 0) + 1)) + 1 for t in VOCABULARY}


def unseen(files: int) -> float:
    return math.log(files + 1) + 1


def _vector(text: str, idf: dict[str, float]) -> dict[str, float]:
    return {t: n * idf[t] for t, n in Counter(terms_of(text)).items()}


def needed_terms(idf: dict[str, float], threshold: float = THRESHOLD) -> list[str]:
    """Terms of which a segment must have one to reach the threshold with any template."""
    out: set[str] = set()
    for _, text in TEMPLATES:
        vector = sorted(_vector(text, idf).items(), key=lambda kv: (-kv[1], kv[0]))
        left = norm = sum(w * w for _, w in vector)
        for t, w in vector:
            if left < (threshold - 1e-3) ** 2 * norm:
                break
            out.add(t)
            left -= w * w
    return sorted(out)


def own_licenses(segments: DataFrame, idf: dict[str, float], rare: float, threshold: float = THRESHOLD) -> DataFrame:
    """(key, license, score): the best licence of each key's segments (key, segment).

    Texts are exploded once and then known by their MD5 (``sid``)."""
    spark = segments.sparkSession
    segments = segments.withColumn("sid", F.unhex(F.md5(F.col("segment").cast("binary"))))
    cells, norms = [], []
    for i, (_, text) in enumerate(TEMPLATES):
        vector = _vector(text, idf)
        norms.append((i, TEMPLATES[i][0], math.sqrt(sum(w * w for w in vector.values()))))
        cells += [(t, i, w) for t, w in vector.items()]
    vectors = spark.createDataFrame(cells, "term string, template int, tw double")
    sizes = spark.createDataFrame(norms, "template int, license string, norm double")
    known = spark.createDataFrame([(t, w) for t, w in idf.items()], "term string, idf double")
    # equal segments are scored once
    counted = segments.dropDuplicates(["sid"]).select("sid", F.explode(terms(F.col("segment"))).alias("term")).groupBy("sid", "term").count()
    weighed = materialize(counted.join(known, "term", "left").select("sid", "term", (F.col("count") * F.coalesce("idf", F.lit(rare))).alias("w")), "terms")
    own = weighed.groupBy("sid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("own"))
    dots = weighed.join(vectors, "term").groupBy("sid", "template").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    score = F.round(F.col("dot") / (F.col("own") * F.col("norm")), 4)
    scored = dots.join(sizes, "template").join(own, "sid").select("sid", "license", score.alias("score")).where(F.col("score") >= threshold)
    best = scored.groupBy("sid").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    held = segments.select("key", "sid").join(best, "sid").groupBy("key").agg(F.min("b").alias("b"))
    return held.select("key", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``files`` (doc_id, repo, path, text) -> doc_id, repo, path, license, score,
    how ("own", "inherited" or null) and from_dir."""
    n, counts = document_counts(files.select("text"))
    idf = weights(n, counts)
    must = r"(?<![a-z0-9])(?:" + "|".join(needed_terms(idf, threshold)) + r")(?![a-z0-9])"
    name = F.element_at(F.split("path", "/", -1), -1)
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    is_license = F.coalesce(name.rlike(LICENSE_FILE), F.lit(False))
    body = F.coalesce("text", F.lit(""))
    lines = F.split(body, "\n", -1)
    found = F.filter(F.when(is_license, F.array_append(lines, body)).otherwise(lines), lambda s: F.lower(s).rlike(must))
    slim = files.select("doc_id", "repo", "path", folder.alias("dir"), is_license.alias("is_license"), F.xxhash64("repo", "path", "text").alias("key"), F.array_distinct(found).alias("segments"))
    slim = materialize(slim, "segments")
    segments = slim.select("key", F.explode("segments").alias("segment")).distinct()
    own = materialize(own_licenses(segments, idf, unseen(n), threshold), "licenses")
    marked = slim.drop("segments").join(own, "key", "left")
    marked = materialize(marked, "marked")
    holders = marked.where("is_license AND license IS NOT NULL").groupBy("repo", "dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    holders = holders.select(F.col("repo").alias("h_repo"), F.col("dir").alias("ancestor"), "b")
    parts = F.split("dir", "/", -1)
    levels = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    )
    # one row per directory and ancestor, however many files it holds
    dirs = marked.where("license IS NULL AND dir IS NOT NULL").select("repo", "dir").distinct()
    up = dirs.select("repo", "dir", F.posexplode(levels).alias("depth", "ancestor"))
    near = up.join(holders, (F.col("repo").eqNullSafe(F.col("h_repo"))) & (up["ancestor"] == holders["ancestor"]))
    near = near.groupBy("repo", "dir").agg(F.max(F.struct("depth", up["ancestor"].alias("from_dir"), F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))).alias("up"))
    near = near.select(F.col("repo").alias("u_repo"), F.col("dir").alias("u_dir"), "up")
    out = marked.join(near, F.col("repo").eqNullSafe(F.col("u_repo")) & (F.col("dir") == F.col("u_dir")) & F.col("license").isNull(), "left")
    how = F.when(F.col("license").isNotNull(), "own").when(F.col("up").isNotNull(), "inherited")
    return out.select(
        "doc_id", "repo", "path", F.coalesce("license", "up.license").alias("license"), F.coalesce("score", "up.score").alias("score"), how.alias("how"),
        F.coalesce(F.when(F.col("license").isNotNull(), F.col("dir")), F.col("up.from_dir")).alias("from_dir"),
    )
