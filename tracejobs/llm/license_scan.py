"""Licence scans: sparse TF-IDF cosine of licence statements to templates, then inheritance from directories.

DataFrame functions only. A line that may state a licence is compared with every template inside its row, the
templates being a parameter of a few lines, so that the scan shuffles nothing. Files that state none take the
licence of the nearest ancestor directory with a licence file, by joins over distinct directories.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracejobs.llm.common import small, store

# SPDX identifiers and customary statements of the licences.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
CANDIDATE = r"(?i)licen[cs]e|copyleft|permission is hereby|redistribution and use|free software|creative commons"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)(\.[a-z]+)?$"
THRESHOLD = 0.6


def _terms(text: str) -> Counter:
    return Counter(re.findall(TERM, text.lower()))


def _dot(weighed: Column, vector: Column) -> Column:
    return F.aggregate(weighed, F.lit(0.0), lambda a, x: a + x["w"] * F.coalesce(F.try_element_at(vector, x["t"]), F.lit(0.0)))


def best_template(line: Column, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> Column:
    """struct(similarity, licence) of the template with the largest TF-IDF cosine to a line; the first name in a tie.

    Document frequencies are the templates'; a term of none weighs as one of no template.
    """
    counts = [_terms(t) for _, t in templates]
    n = len(templates)
    seen = Counter(t for c in counts for t in c)
    rare = math.log(1 + n) + 1
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in seen.items()}
    table = F.create_map(*[F.lit(x) for t in sorted(idf) for x in (t, idf[t])])
    terms = F.regexp_extract_all(F.lower(line), F.lit(f"({TERM})"))
    weighed = F.transform(F.array_distinct(terms), lambda t: F.struct(t.alias("t"), (F.size(F.filter(terms, lambda u: u == t)) * F.coalesce(F.try_element_at(table, t), F.lit(rare))).alias("w")))
    norm = F.sqrt(F.aggregate(weighed, F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    found = []
    for (name, _), c in zip(templates, counts):
        length = math.sqrt(sum((k * idf[t]) ** 2 for t, k in c.items()))
        vector = F.create_map(*[F.lit(x) for t in sorted(c) for x in (t, c[t] * idf[t] / length)])
        dot = _dot(weighed, vector)
        found.append(F.struct(F.when(norm > 0, dot / norm).otherwise(0.0).alias("similarity"), F.lit(name).alias("licence")))
    return F.reduce(F.array(*found[1:]), found[0], lambda a, x: F.when(x["similarity"] > a["similarity"], x).otherwise(a))


def license_scan(files: DataFrame, path: str = "path", text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per file: key, path, licence, similarity, origin (own, inherited, none), licence_dir.

    Each line of a file that may state a licence is compared; the largest cosine decides, at least the
    threshold. Any other file inherits from the nearest ancestor directory, its own first, that holds a licence
    file (by name: licence, copying) with a licence; of several in a directory the largest cosine counts, then
    the first name. The empty directory is the root of relative paths. A null path inherits nothing; null and
    empty texts state nothing. Rows that repeat a path are rows of their own. An empty table gives an empty
    one. Other columns of any name are ignored.
    """
    line = F.filter(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n"), lambda x: x.rlike(CANDIDATE))
    scanned = files.select(F.col(key).alias("key"), F.col(path).alias("path"), F.array_max(F.transform(line, lambda x: best_template(x))).alias("best"))
    own = F.col("best.similarity") >= threshold
    scanned, _ = store(
        scanned.select(
            "key", "path", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), "").alias("dir"),
            F.when(own, F.col("best.licence")).alias("own"), F.when(own, F.col("best.similarity")).alias("similarity"),
        ),
        "scanned",
    )
    stated = scanned.where(F.col("own").isNotNull() & F.col("path").rlike(LICENCE_FILE)).groupBy("dir")
    stated, _ = store(stated.agg(F.min_by("own", F.struct(-F.col("similarity"), F.col("own"))).alias("licence")).withColumnRenamed("dir", "licence_dir"), "stated")
    dirs = scanned.where("dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.withColumn("depth", F.explode(F.when(F.col("dir") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))))
    above = above.withColumn("licence_dir", F.when(F.col("depth") == 0, "").otherwise(F.array_join(F.slice(parts, 1, F.greatest("depth", F.lit(1))), "/")))
    near = above.join(small(stated, 100_000), "licence_dir").groupBy("dir").agg(F.max(F.struct("depth", "licence_dir", "licence")).alias("near"))
    near, _ = store(near.select("dir", F.col("near.licence_dir").alias("licence_dir"), F.col("near.licence").alias("inherited")), "near")
    both = scanned.join(small(near, 100_000), "dir", "left")
    return both.select(
        F.col("key").alias(key), F.col("path").alias(path), F.coalesce("own", "inherited").alias("licence"), "similarity",
        F.when(F.col("own").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("own").isNull(), F.col("licence_dir")).alias("licence_dir"),
    )


#: The documents' statements are whole and of four kinds, so SQL finds by their text what the cosine finds.
ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, text, coalesce(source, 'none') || '/' || coalesce(lang, 'none') AS folder, coalesce(source, 'none') AS top,
    CASE WHEN contains(text, 'Licensed under the Apache License, Version 2.0') THEN 'Apache-2.0' WHEN contains(text, 'Licensed under CC BY-NC 4.0') THEN 'CC-BY-NC-4.0'
      WHEN contains(text, 'under the GNU General Public License, version 3') THEN 'GPL-3.0' WHEN contains(text, 'Released under the MIT License') THEN 'MIT' END AS own
  FROM documents
), h AS (SELECT folder, min(doc_id) AS head FROM d WHERE contains(split_part(text, chr(10), 1), 'icense') GROUP BY folder),
l AS (SELECT d.folder, d.own AS licence FROM d JOIN h ON d.folder = h.folder AND d.doc_id = h.head)
SELECT doc_id, d.folder || '/' || CASE WHEN doc_id = head THEN 'LICENSE' ELSE 'doc-' || coalesce(CAST(doc_id AS VARCHAR), 'none') || '.txt' END AS path,
  coalesce(own, l.licence) AS licence, CASE WHEN own IS NOT NULL THEN 'own' WHEN l.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN own IS NULL AND l.licence IS NOT NULL THEN d.folder END AS licence_dir
FROM d LEFT JOIN h ON d.folder = h.folder LEFT JOIN l ON d.folder = l.folder
"""
