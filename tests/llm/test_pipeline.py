"""The stages one after the other on odd rows: what stays, and that finished tables go."""

import os

import corpus_pipeline
from nearmiss import session
from nearmiss.llm.common import documents

SF = "/root/testdata/sf0.001"


def test_run_equals_its_stages_written_and_read_again(spark, tmp_path):
    first = len(session.tables_written())
    got = {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect()}
    left = [t for t in session.tables_written(first) if os.path.exists(t)]
    names = [os.path.basename(t).rsplit("-", 1)[0] for t in left]
    # the results of the stages, and what the last one works on
    assert {"sketches", "unique", "codes", "rows", "texts", "judged"}.isdisjoint(names)
    docs = documents(spark, SF)
    columns = docs.columns
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, SF)
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        assert kept.select("doc_id").subtract(docs.select("doc_id")).isEmpty() and 0 < kept.count() <= docs.count()
        docs = kept
    again = corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id", "piece", "ids_crc32").collect()
    assert got == {tuple(r) for r in again} and {r["doc_id"] for r in again} == {r["doc_id"] for r in docs.collect()}


def test_empty_and_clashing_documents(spark, tmp_path):
    docs = documents(spark, SF)
    for i, some in enumerate((docs.limit(0), docs.limit(30).selectExpr("*", "1 AS number", "2 AS row_0", "3 AS pred_0", "4 AS misfit_0", "5 AS own_id"))):
        for name, function in corpus_pipeline.STAGES[:-1]:
            out = function(spark, some, SF)
            assert out.columns == some.columns
            out.write.parquet(f"{tmp_path}/{i}-{name}")
            some = spark.read.parquet(f"{tmp_path}/{i}-{name}")
        assert corpus_pipeline.STAGES[-1][1](spark, some, SF).count() >= some.count()
