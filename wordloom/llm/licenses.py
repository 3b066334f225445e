"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest directory.

Units are compared with templates: every line of a file, as a header may stand anywhere,
and the whole text of a licence file.  Inverse document frequencies of the templates' words are counted
over all files; any other word weighs as one that a single file has.  A template's index
words are its heaviest, so many that the rest of it cannot reach the threshold (Cauchy and
Schwarz); a unit without an index word of any template cannot match and is not scored.
DataFrame operations only; what is gathered or broadcast has a row for each template word.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.scratch import stored

# Short public notices of the licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without "
                    "modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, "
               "v. 2.0.",
}
THRESHOLD = 0.6
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.][a-z]+)?$"
SEPARATORS = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda w: w != "")


def template_words(templates: dict[str, str]) -> dict[str, Counter]:
    return {
        name: Counter(w for w in re.split(r"[\W_]+", text.lower()) if w)
        for name, text in templates.items()}


def frequencies(files: DataFrame, words: list[str], text_col: str) -> tuple[int, dict[str, int]]:
    """The number of files, and how many of them have each of `words`."""
    asked = F.array(*[F.lit(w) for w in words])
    rows = files.select(F.array_intersect(words_of(F.col(text_col)), asked).alias("words"))
    found = rows.select(F.explode(F.concat("words", F.array(F.lit("")))).alias("word")).groupBy(
        "word").count().collect()
    counts = {r["word"]: r["count"] for r in found}
    return counts.pop("", 0), counts


def index_words(weights: dict[str, dict[str, float]], threshold: float) -> list[str]:
    """Words without one of which no unit reaches the threshold with any template."""
    chosen = set()
    for weight in weights.values():
        left = math.fsum(w * w for w in weight.values())
        least = left * threshold * threshold
        for word, w in sorted(weight.items(), key=lambda x: (-x[1], x[0])):
            if left < least * (1 - 1e-9):
                break
            chosen.add(word)
            left -= w * w
    return sorted(chosen)


def licensed(
    files: DataFrame, path_col: str = "path", text_col: str = "text",
    templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD,
    id_col: str | None = None,
) -> DataFrame:
    """`(path, own, score, licence, inherited_from)` for every row of `files`, after its id.

    `own` is the template nearest to a unit of the file, if the cosine is at least
    `threshold`; ties go to the smaller name.  A file without an own licence has that of the
    nearest directory above or around it that holds a licence file with one; the best match
    counts, then the smaller name.  A null text has no units, a null path no directory.
    Rows that repeat a path are each scanned; an empty table gives no rows; other columns
    are not looked at.
    """
    spark = files.sparkSession
    rows = files.select(
        F.col(id_col or path_col).alias("id"), F.col(path_col).alias("path"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = template_words(templates)
    vocabulary = sorted(set().union(*counts.values()))
    total, having = frequencies(rows, vocabulary, "text")
    rarest = math.log((1 + total) / 2) + 1
    idf = {w: math.log((1 + total) / (1 + max(1, having.get(w, 0)))) + 1 for w in vocabulary}
    weights = {n: {w: c * idf[w] for w, c in words.items()} for n, words in counts.items()}
    strong = F.array(*[F.lit(w) for w in index_words(weights, threshold)])
    norms = {n: math.sqrt(math.fsum(w * w for w in ws.values())) for n, ws in weights.items()}
    table = spark.createDataFrame(
        [(w, n, x / norms[n]) for n, ws in weights.items() for w, x in ws.items()],
        "word string, template string, weight double")
    idfs = spark.createDataFrame(list(idf.items()), "word string, idf double")

    is_file = F.coalesce(F.regexp_like("path", F.lit(LICENCE_FILE)), F.lit(False))
    units = F.filter(
        F.concat(F.split("text", "\n"),
                 F.when(is_file, F.array("text")).otherwise(F.array().cast("array<string>"))),
        lambda unit: F.arrays_overlap(words_of(unit), strong))
    rows = stored(
        rows.withColumn("dir", F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1))
        .select("id", "path", "dir", is_file.alias("is_file"),
                F.array_distinct(units).alias("texts"))
        .withColumn("units", F.transform("texts", lambda unit: F.sha2(unit, 256))),
        "licence-units")

    # A unit goes by its hash: a long text must not be repeated for each of its words.
    unit = stored(
        rows.select(F.explode("texts").alias("text")).distinct()
        .select(F.sha2("text", 256).alias("unit"), "text"),
        "units")
    words = (
        unit.select("unit", F.explode(words_of(F.col("text"))).alias("word"))
        .groupBy("unit", "word").agg(F.count("*").alias("times"))
        .join(F.broadcast(idfs), "word", "left")
        .withColumn("weight", F.col("times") * F.coalesce("idf", F.lit(rarest)))
    )
    lengths = words.groupBy("unit").agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    products = (
        words.select("unit", "word", F.col("weight").alias("unit_weight"))
        .join(F.broadcast(table), "word")
        .groupBy("unit", "template").agg(F.sum(F.col("unit_weight") * F.col("weight")).alias("dot"))
    )
    best = Window.partitionBy("unit").orderBy(F.desc("score"), "template")
    matched = stored(
        products.join(lengths, "unit")
        .withColumn("score", F.round(F.col("dot") / F.col("length"), 9))
        .filter(F.col("score") >= threshold)
        .withColumn("n", F.row_number().over(best)).filter("n = 1")
        .select("unit", "template", "score"),
        "licence-matches")

    key = stored(rows.drop("texts").withColumn("key", F.monotonically_increasing_id()), "licence-files")
    first = Window.partitionBy("key").orderBy(F.desc("score"), "template")
    own = stored(
        key.select("key", F.explode("units").alias("unit")).join(matched, "unit")
        .withColumn("n", F.row_number().over(first)).filter("n = 1")
        .select("key", F.col("template").alias("own"), "score"),
        "own-licences")
    known = stored(key.drop("units").join(own, "key", "left"), "known-licences")

    of_dir = Window.partitionBy("above").orderBy(F.desc("score"), "own")
    given = (
        known.filter(F.col("is_file") & F.col("own").isNotNull())
        .select(F.col("dir").alias("above"), "own", "score").distinct()
        .withColumn("n", F.row_number().over(of_dir)).filter("n = 1")
        .select("above", F.col("own").alias("given"))
    )
    dirs = known.filter(F.col("dir").isNotNull()).select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    nearest = Window.partitionBy("dir").orderBy(F.desc(F.length("above")))
    inherited = stored(
        dirs.select("dir", F.explode(F.array_distinct(above)).alias("above"))
        .join(given, "above")
        .withColumn("n", F.row_number().over(nearest)).filter("n = 1")
        .select("dir", "above", "given"),
        "inherited-licences")
    joined = known.join(inherited, "dir", "left")
    lacking = F.col("own").isNull() & F.col("given").isNotNull()
    return joined.select(
        *([F.col("id").alias(id_col)] if id_col else []), F.col("path").alias(path_col), "own", "score",
        F.coalesce("own", "given").alias("licence"),
        F.when(lacking, F.col("above")).alias("inherited_from"))
