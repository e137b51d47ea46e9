"""Report tables on rows that the fixture does not reach."""

from nearmiss.operators import reports as rp


def test_marks_leave_nan_out(spark):
    t = spark.createDataFrame([("x", 0.5), ("y", 0.7), ("z", float("nan")), ("w", None)], "model string, a double")
    got = {r["model"]: r["a_mark"] for r in rp.best_second_flag(t, ["a"]).collect()}
    assert got == {"y": 1, "x": 2, "z": 0, "w": 0}
