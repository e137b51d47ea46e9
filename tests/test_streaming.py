from nearmiss.operators.indicators import risk_scores
from nearmiss.plans import fixture
from nearmiss.session import scratch_path
from nearmiss.streaming.scoring import read_pair_stream, write_scores


def test_stream_equals_batch(spark):
    source, out, log = (scratch_path(spark, n) for n in ("pairs", "scores", "log"))
    fixture.pairs(spark, "/root/testdata/sf0.001").repartition(3).write.parquet(source)
    batch = spark.read.parquet(source)
    query = write_scores(read_pair_stream(spark, source, batch.schema, 1), ["TTC2D", "EI"], out, log)
    assert query.awaitTermination(120) is not False
    got = spark.read.parquet(out)
    assert got.count() == batch.count()
    assert got.exceptAll(risk_scores(batch, ["TTC2D", "EI"])).count() == 0
