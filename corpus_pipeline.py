"""Corpus pipeline: quality rules, language ID, exact dedup, n-gram Jaccard join, best-fit packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from nearmiss.llm import exact_dedup, jaccard_join, language_id, packing, quality_rules
from nearmiss.llm.common import cut_lineage, documents, labels
from nearmiss.session import drop_tables, tables_written

#: Tables that the stage before stored for its own work.
_before: list[str] = []


def stage(function):
    """Drops the tables of the stage before, whose result has been written by then, unless the documents read them."""
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _before:
            read = docs.inputFiles()
            drop_tables(spark, *(t for t in _before if not any(t.split(":")[-1].lstrip("/") in f for f in read)))
        first = len(tables_written())
        out = function(spark, docs, sf_dir)
        _before[:] = tables_written(first)
        return out

    return run_stage


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, labels(spark, sf_dir))


@stage
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs)


@stage
def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


@stage
def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


@stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("exact_dedup", copies_stage),
    ("ngram_jaccard_join", near_copies_stage),
    ("best_fit_packing", packing_stage),
]

#: An isolation forest and a greedy packing are no SQL; tests/llm/test_pipeline.py compares run() with its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = cut_lineage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
