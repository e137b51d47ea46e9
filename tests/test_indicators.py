"""Known answers for two boxes of 4 m x 2 m in simple positions."""

import math

import pytest

from nearmiss.operators import indicators as ind

SCHEMA = ("event_id long, target_id long, k long, time double, x_ego double, y_ego double, v_ego double, psi_ego double, acc_ego double, "
          "x_sur double, y_sur double, v_sur double, psi_sur double, length_ego double, width_ego double, length_sur double, width_sur double")


def frame(spark, rows):
    """rows: (x, y, v, heading) of ego and surrounding, optionally the ego acceleration."""
    data = []
    for i, (e, s, *acc) in enumerate(rows):
        data.append((1, 1, i, i / 10, *map(float, e), float(acc[0] if acc else 0), *map(float, s), 4.0, 2.0, 4.0, 2.0))
    df = spark.createDataFrame(data, SCHEMA)
    return df.selectExpr("*", "cos(psi_ego) AS hx_ego", "sin(psi_ego) AS hy_ego", "cos(psi_sur) AS hx_sur", "sin(psi_sur) AS hy_sur")


def values(df, name):
    return [r[name] for r in df.orderBy("k").select(name).collect()]


HEAD_ON = ((0, 0, 10, 0), (24, 0, 10, math.pi))
FOLLOWING = ((0, 0, 15, 0), (24, 0, 5, 0))
LEAVING = ((0, 0, 5, 0), (24, 0, 15, 0))
CROSSING = ((0, 0, 10, 0), (20, -20, 10, math.pi / 2))
OVERLAP = ((0, 0, 10, 0), (1, 0.5, 5, 0))
ASIDE = ((0, 0, 10, 0), (24, 10, 10, math.pi))


def test_ttc(spark):
    got = values(ind.ttc(frame(spark, [HEAD_ON, FOLLOWING, LEAVING, OVERLAP, ASIDE])), "TTC")
    assert got[0] == pytest.approx(1.0) and got[1] == pytest.approx(2.0)
    assert got[2] == math.inf and got[3] == -1.0 and got[4] == math.inf


def test_drac_and_psd(spark):
    rows = [FOLLOWING, LEAVING, OVERLAP]
    drac = values(ind.drac(frame(spark, rows)), "DRAC")
    assert drac[0] == pytest.approx(100 / 40) and drac[1] == 0 and drac[2] == math.inf
    psd = values(ind.psd(frame(spark, rows)), "PSD")
    assert psd[0] == pytest.approx(20 / (225 / 11)) and psd[1] == 10 and psd[2] == -1


def test_mttc(spark):
    still = (*FOLLOWING, 0.0)
    gaining = (*FOLLOWING, 2.0)
    got = values(ind.mttc(frame(spark, [still, gaining, (*OVERLAP, 1.0)])), "MTTC")
    assert got[0] == pytest.approx(2.0)
    assert got[1] == pytest.approx((-10 + math.sqrt(100 + 80)) / 2)
    assert got[2] == -1


def test_current_distance(spark):
    rows = [HEAD_ON, ((0, 0, 1, 0), (0, 6, 1, 0)), OVERLAP, ((0, 0, 1, 0), (10, 8, 1, 0))]
    got = values(ind.current_distance(frame(spark, rows)), "CurrentD")
    assert got[0] == pytest.approx(20) and got[1] == pytest.approx(4) and got[2] == 0
    assert got[3] == pytest.approx(math.hypot(6, 6))


def test_containment_is_not_zero(spark):
    df = frame(spark, [((0, 0, 1, 0), (0, 0, 1, 0))])
    df = df.selectExpr("* except (length_sur, width_sur)", "12D AS length_sur", "8D AS width_sur")
    assert values(ind.current_distance(df), "CurrentD")[0] == pytest.approx(3)


def test_tadv(spark):
    got = values(ind.tadv(frame(spark, [CROSSING, HEAD_ON, LEAVING])), "TAdv")
    # equal corners meet at the same time somewhere on the crossing
    assert got[0] == pytest.approx(0.0, abs=1e-9)
    assert got[1] == pytest.approx(1.0) and got[2] == math.inf


def test_ttc2d(spark):
    got = values(ind.ttc2d(frame(spark, [FOLLOWING, LEAVING])), "TTC2D")
    assert got[0] == pytest.approx(2.0) and got[1] == math.inf


def test_act(spark):
    got = values(ind.act(frame(spark, [HEAD_ON, FOLLOWING, LEAVING])), "ACT")
    assert got[0] == pytest.approx(1.0) and got[1] == pytest.approx(2.0) and got[2] == math.inf


def test_ei(spark):
    got = values(ind.ei(frame(spark, [HEAD_ON, LEAVING, ASIDE])), "EI")
    # head-on: the boxes pass through each other 2 m deep, centres meet after 1.2 s
    assert got[0] == pytest.approx(2 / 1.2) and got[1] == -math.inf and got[2] == -math.inf


def test_registry_takes_new_indicator(spark):
    from pyspark.sql import functions as F
    ind.register_indicator("Headway", lambda p: p.withColumn("Headway", F.col("x_sur") - F.col("x_ego")))
    try:
        out = ind.risk_scores(frame(spark, [HEAD_ON]), ["Headway", "ACT"])
        assert out.first()["Headway"] == 24 and out.columns == ["event_id", "target_id", "k", "time", "Headway", "ACT"]
        with pytest.raises(ValueError):
            ind.register_indicator("ACT", ind.act)
    finally:
        ind.INDICATORS.pop("Headway")
