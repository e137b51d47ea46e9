"""License scans with DataFrame functions alone.

A text becomes words (lower case, letters and digits), five-word shingles and overlapping windows of shingles.
Every window has 128 MinHash values, each a band of its own, and a template is retrieved where one of its bands is
equal. A window of 12 shingles that holds even a one-shingle template has a Jaccard similarity of 1/12 or more with
it, so a collision has a probability of 1 - (11/12)^128 = 1 - 1.5e-5 at least. A retrieved template is verified on
the shingles themselves: the share of the template's shingles that the text holds must reach the threshold.
A window without any shingle of any template cannot be equal in a band and is not sketched.

Null, empty and short texts give no rows; a template found twice in a text gives one row; repeated rows each give
theirs; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmiss.llm.common import cut_lineage, documents

WORDS, BANDS, WINDOW, STRIDE, CONTAINMENT = 5, 128, 12, 4, 0.8

#: Public notices as their licences give them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                         "except in compliance with the License. You may obtain a copy of the License at",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                  "provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                  "General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                  "associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def words(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def shingle(words: Column, at: Column) -> Column:
    return F.concat_ws(" ", F.slice(words, at + 1, F.lit(WORDS)))


def bands(shingles: Column) -> Column:
    """A hash for every band: its number and the smallest hash of the shingles under it."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(
        k, F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, k)))))


def bind(value: Column, use) -> Column:
    """An array of one element: use(value), with the value computed once."""
    return F.transform(F.array(value), use)


def template_tables(spark: SparkSession, templates: dict[str, str]) -> list[tuple[str, list[str], list[int]]]:
    """name, shingles and bands of each template. The driver holds the templates alone, a fixed list."""
    df = spark.createDataFrame(list(templates.items()), "template string, text string").coalesce(1)
    df = df.withColumn("w", words(F.col("text"))).where(F.size("w") >= WORDS)
    df = df.withColumn("s", F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - WORDS),
                                                         lambda i: shingle(F.col("w"), i))))
    return [tuple(r) for r in df.select("template", "s", bands(F.col("s"))).collect()]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, template, n_matched and n_shingles (of the template's), containment, first_word (the place of the
    first matching shingle)."""
    spark = docs.sparkSession
    known = template_tables(spark, TEMPLATES if templates is None else templates)
    every = sorted({s for _, shingles, _ in known for s in shingles})
    hashes = spark.createDataFrame([(s,) for s in every], "s string").coalesce(1).select(F.xxhash64("s")).collect()
    wanted = [r[0] for r in hashes]
    keys = sorted({b for _, _, own in known for b in own})
    table = F.broadcast(spark.createDataFrame(known, "template string, shingles array<string>, bands array<bigint>")
                        .select("template", "shingles", F.explode("bands").alias("band")).coalesce(1))
    def hits(w: Column) -> Column:
        places = F.when(F.size(w) >= WORDS, F.sequence(F.lit(0), F.size(w) - WORDS)).otherwise(
            F.array().cast("array<int>"))
        return F.filter(places, lambda i: F.xxhash64(shingle(w, i)).isin(wanted))

    # words are bound once: as a column they would be made again for every shingle
    held = bind(words(F.col("text").cast("string")), lambda w: F.struct(w.alias("w"), hits(w).alias("hits")))
    # rows are told apart by number, so equal ids stay apart; the few texts with a hit are stored once
    hit = docs.select(F.col("doc_id").cast("long"), F.explode(F.filter(held, lambda h: F.size(h["hits"]) > 0)).alias("h"))
    hit = cut_lineage(hit.select("doc_id", "h.w", "h.hits").withColumn("row", F.monotonically_increasing_id()), "hits")
    starts = F.array_distinct(F.flatten(F.transform("hits", lambda p: F.transform(
        F.sequence(F.lit(0), F.lit(WINDOW // STRIDE - 1)),
        lambda k: F.greatest(F.floor(p / STRIDE) - k, F.lit(0)).cast("int") * STRIDE))))
    last = F.size("w") - WORDS
    window = hit.select("row", "w", F.explode(starts).alias("start")).where(F.col("start") <= F.size("w") - WORDS)
    inside = F.transform(F.sequence(F.col("start"), F.least(F.col("start") + (WINDOW - 1), last)),
                         lambda i: shingle(F.col("w"), i))
    # values that no template has are left out before they become rows
    equal = F.flatten(bind(F.array_distinct(inside), lambda x: F.filter(bands(x), lambda b: b.isin(keys))))
    found = (window.select("row", F.explode(equal).alias("band"))
             .join(table.select("template", "band"), "band").select("row", "template").distinct())
    sets = F.broadcast(spark.createDataFrame([x[:2] for x in known], "template string, shingles array<string>").coalesce(1))
    own = hit.select("row", "doc_id", "hits", F.transform("hits", lambda i: shingle(F.col("w"), i)).alias("own"))
    both = found.join(own, "row").join(sets, "template")
    matched = F.array_intersect("shingles", "own")
    return both.withColumn("matched", matched).select(
        "doc_id", "template", F.size("matched").cast("long").alias("n_matched"),
        F.size("shingles").cast("long").alias("n_shingles"),
        (F.size("matched") / F.size("shingles")).alias("containment"),
        F.array_min(F.filter(F.arrays_zip("hits", "own"), lambda z: F.array_contains(F.col("shingles"), z["own"]))["hits"]
                    ).cast("long").alias("first_word")).where(F.col("containment") >= containment)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


OP1_SQL = rf"""
WITH t(template, text) AS (VALUES {", ".join(f"({_text(k)}, {_text(v)})" for k, v in TEMPLATES.items())}),
plain(kind, template, doc_id, r, w) AS (
  SELECT 'd', NULL, doc_id, row_number() OVER (), string_split(trim(regexp_replace(lower(coalesce(text, '')),
         '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') FROM documents
  UNION ALL SELECT 't', template, NULL, 0, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')
  FROM t),
s AS (SELECT kind, template, doc_id, r, unnest(range(0, len(w) - 4)) AS pos, w FROM plain WHERE len(w) >= 5),
g AS (SELECT kind, template, doc_id, r, pos, array_to_string(w[pos + 1:pos + 5], ' ') AS g FROM s),
ts AS (SELECT DISTINCT template, g FROM g WHERE kind = 't'),
n AS (SELECT template, count(*) AS n_shingles FROM ts GROUP BY template),
m AS (SELECT g.doc_id, g.r, ts.template, count(DISTINCT g.g) AS n_matched, min(g.pos) AS first_word
      FROM g JOIN ts ON g.g = ts.g WHERE g.kind = 'd' GROUP BY g.doc_id, g.r, ts.template)
SELECT doc_id, template, n_matched, n_shingles, n_matched / n_shingles AS containment, first_word
FROM m JOIN n USING (template) WHERE n_matched / n_shingles >= {CONTAINMENT}
"""
