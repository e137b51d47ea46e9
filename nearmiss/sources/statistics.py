"""Accident statistics kept as CSV files with thousands separators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stats_csv(spark: SparkSession, path: str, labels: tuple[str, ...]) -> DataFrame:
    """Label columns as text, all others as numbers with the separators removed. The leading byte-order
    mark of the header is dropped by the UTF-8 reader or here."""
    raw = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8")
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    return raw.select(*[
        F.col(f"`{c}`") if c in labels
        else F.regexp_replace(F.col(f"`{c}`"), ",", "").try_cast("double").alias(c)
        for c in raw.columns])


def read_glob_union(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All CSV files of one schema whose name matches the pattern, as one table."""
    return spark.read.csv(pattern, header=True, schema=schema)
