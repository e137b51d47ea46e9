"""What is paid per row: vectors and rounding in generated code."""

import datetime
import math

from nearmiss.functions.numeric import rounded_double
from nearmiss.operators import frames as op
from nearmiss.plans import factors as fc
from nearmiss.plans import fixture


def test_vectors_are_generated_code_and_hold_the_same_elements(spark, tmp_path):
    start = datetime.datetime(2026, 1, 1)
    rows = [(100 * t + i, start + datetime.timedelta(seconds=i), 5 * t, ("view", "click", "error")[i % 3], 5.0 + i % 7 + t, f'{{"k": {(i * 7 + t) % 100}}}')
            for t in (3, 4, 5) for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(
        str(tmp_path / "events.parquet"))
    vectors = fc.scene_vectors(spark, str(tmp_path))
    tree = vectors.select("f")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in tree.split("Window")[0]
    context = ", ".join(f"{c} / {d!r}D" for c, d in fc.CONTEXT.items())
    labels = ", ".join(f"transform(sequence(0, {n - 1}), i -> IF(event_id div {by} % {n} = i, 1D, 0D))" for n, by in fc.SURROUNDINGS.values())
    row = ", ".join(f"p.{c} / {d!r}D" for c, d in fc.PROFILE.items())
    scenes = op.every_frame_scenes(fixture.pairs(spark, str(tmp_path), varied_dims=True))
    want = scenes.selectExpr("event_id", "target_id", "k", "s", f"concat(array({context}), {labels}, flatten(transform(profiles, p -> array({row})))) AS f")
    got, want = ({tuple(r)[:3]: (r["s"], r["f"]) for r in df.collect()} for df in (vectors, want))
    assert got == want and len(got) == 3 * (60 - 26) and all(len(f) == fc.SIZE for _, f in got.values())


def test_quick_rounding_is_round(spark):
    odd = [None, 0.0, -0.0, math.inf, -math.inf, 1e300, -1e-300, 1.00005, -1.00005, 2.5, 123456.00005, 99999.99995, 0.1 + 0.2]
    numbers = spark.createDataFrame([(x,) for x in odd], "x double").union(spark.sql("SELECT double('nan')"))
    numbers = numbers.union(spark.range(-20000, 20000).selectExpr("id * 0.00005D")).union(
        spark.range(20000).selectExpr("(rand(7) - 0.5D) * pow(10D, CAST(id % 14 AS INT) - 4)"))
    for digits in (2, 4, 6):
        quick = f"{rounded_double('x', digits)} + 0D"
        assert numbers.selectExpr(f"round(x, {digits}) + 0D AS a", f"{quick} AS b").where("NOT (a <=> b)").isEmpty()
