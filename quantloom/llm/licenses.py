"""License scans: TF-IDF cosine of lines to license templates, then inheritance from the nearest ancestor directory.

Every line of every file is compared. A word's weight is its number in the line times ln((1 + lines) / (1 + lines with it)) + 1,
where lines are counted over all files; a word that no template has counts as one that no line has. By Cauchy-Schwarz a
line reaches the cosine `least` only if the template words it holds carry least^2 of the template's squared length, so a
line without one of each template's heaviest words can be passed over; the rest is scored through joins on words.

A file with a matching line has that license. A file with a license file's name, or of which the line is a large share,
also gives its license to its directory; files without one take that of the nearest directory above them that has one.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Header lines of licenses by SPDX identifier (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
LEAST = 0.8
#: Least share of a file's words in its license line that makes it a license file.
SHARE = 0.25
FILE_NAME = "(?i)(^|/)(licen[cs]e|copying|notice)([._-][^/]*)?$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_words(line: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased."""
    return F.filter(F.split(F.translate(line, UPPER, LOWER), "[^a-z0-9]+"), lambda w: w != "")


def _template_words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def matching_lines(files: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(path, license, similarity, line_words, file_words): the best line of each file that has a matching one.

    `files` has (path, text). Ties go to the first license by name, then to the shorter line.
    """
    vocabulary = sorted({w for t in templates.values() for w in _template_words(t)})
    known = F.array(*[F.lit(w) for w in vocabulary])
    lines = files.select("path", F.xxhash64("text").alias("h"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    worded = lines.select("path", "h", "line_no", line_words(F.col("line")).alias("words")).where(F.size("words") > 0)
    counted = worded.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect("words", known))).alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in counted.collect()}  # at most the templates' words
    total = found.get("", 0)
    weight = {w: math.log((1 + total) / (1 + found.get(w, 0))) + 1 for w in vocabulary}
    unseen = math.log(1 + total) + 1
    rows, heavy = [], set()
    for name, text in templates.items():
        parts = {w: n * weight[w] for w, n in Counter(_template_words(text)).items()}
        length = math.sqrt(sum(x * x for x in parts.values()))
        rows += [(name, w, x / length) for w, x in parts.items()]
        left = 1.0
        for w, x in sorted(parts.items(), key=lambda item: -item[1]):
            if left < least * least:
                break
            heavy.add(w)
            left -= (x / length) ** 2
    spark = files.sparkSession
    template_rows = spark.createDataFrame(rows, "license string, word string, part double")
    weights = spark.createDataFrame([(w, x) for w, x in weight.items()], "word string, weight double")
    near = worded.where(F.arrays_overlap("words", F.array(*[F.lit(w) for w in sorted(heavy)])))
    terms = (
        near.select("path", "h", "line_no", F.explode("words").alias("word")).groupBy("path", "h", "line_no", "word").count()
        .join(weights, "word", "left").withColumn("x", F.col("count") * F.coalesce("weight", F.lit(unseen)))
    )
    terms = materialize(terms, "terms")
    line = ["path", "h", "line_no"]
    lengths = terms.groupBy(*line).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"), F.sum("count").alias("line_words"))
    dots = terms.join(template_rows, "word").groupBy(*line, "license").agg(F.sum(F.col("x") * F.col("part")).alias("dot"))
    scored = dots.join(lengths, line).withColumn("similarity", F.round(F.col("dot") / F.col("length"), 9)).where(F.col("similarity") >= least)
    best = Window.partitionBy("path").orderBy(F.desc("similarity"), "license", "line_words", "h", "line_no")
    top = scored.withColumn("n", F.row_number().over(best)).where("n = 1").select("path", "h", "license", "similarity", "line_words")
    sizes = worded.groupBy("path", "h").agg(F.sum(F.size("words")).alias("file_words"))  # partial sums: one row for each file is shuffled
    return top.join(sizes, ["path", "h"]).select("path", "license", "similarity", "line_words", "file_words")


def directory(path: Column) -> Column:
    """All before the last slash; files without one lie in the directory ''."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan_licenses(files: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST, share: float = SHARE) -> DataFrame:
    """(path, license, similarity, origin, directory) for each distinct path of `files` (path, text).

    origin is 'own', 'inherited' (`directory` is where from, similarity that of its license file) or 'none' (NULLs). Of
    several license files in a directory the most similar counts, then the first by path. Rows of one path are one file
    of several texts; a NULL path is left out, a NULL text is empty. Other columns are ignored. Inheritance is found once
    for each distinct directory, so a directory of very many files is no hot key of the ancestors' join.
    """
    files = files.select("path", "text").where("path is not null")
    matched = materialize(matching_lines(files, templates, least), "matched")
    givers = matched.where((F.col("line_words") >= share * F.col("file_words")) | F.col("path").rlike(FILE_NAME))
    first = Window.partitionBy("directory").orderBy(F.desc("similarity"), "path")
    licensed = (
        givers.withColumn("directory", directory(F.col("path"))).withColumn("n", F.row_number().over(first)).where("n = 1")
        .select("directory", F.col("license").alias("given"), F.col("similarity").alias("given_similarity"))
    )
    paths = files.select("path").distinct()
    homes = paths.select(directory(F.col("path")).alias("home")).distinct()
    parts = F.split("home", "/")
    above = homes.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(parts)))).select(
        "home", "depth", F.when(F.col("depth") == 0, "").otherwise(F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/")).alias("directory")
    )
    nearest = Window.partitionBy("home").orderBy(F.desc("depth"))
    inherited = above.join(licensed, "directory").withColumn("n", F.row_number().over(nearest)).where("n = 1").drop("n", "depth")
    everything = paths.withColumn("home", directory(F.col("path"))).join(matched, "path", "left").join(inherited, "home", "left")
    own = F.col("license").isNotNull()
    return everything.select(
        "path", F.coalesce("license", "given").alias("license"),
        F.when(own, F.col("similarity")).otherwise(F.col("given_similarity")).alias("similarity"),
        F.when(own, "own").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~own, F.col("directory")).alias("directory"),
    )
