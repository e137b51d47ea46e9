"""Blocked windows against plain ones, with blocks far smaller than the tracks and one hot track."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from nearmiss.operators import frames as op
from nearmiss.operators import metrics as mt
from nearmiss.operators import tracks as tr


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(3)
    rows = []
    for track, n in ((1, 700), (2, 40), (3, 1), (4, 60)):
        k = 0
        for _ in range(n):
            k += rnd.choice((1, 1, 1, 2, 40))
            rows.append((track, k, rnd.choice([None, rnd.uniform(-9, 9)]), rnd.uniform(-1, 1)))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "track long, k long, y double, v double").repartition(5).cache()


def test_number_rows_and_sums(series):
    w = Window.partitionBy("track").orderBy("k")
    got = tr.number_rows(series, ["track"], ["k"], tr.time_chunk("k", 16), total="n", sums={"run": F.col("v")})
    want = series.withColumns({"i": F.row_number().over(w) - 1, "m": F.count("*").over(Window.partitionBy("track")),
                               "s": F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    bad = got.join(want.select("track", "k", "i", "m", "s"), ["track", "k"]).where(
        "idx <> i OR n <> m OR abs(run - s) > 1e-9")
    assert got.count() == series.count() and bad.count() == 0


def test_number_rows_in_levels(spark):
    df = spark.range(0, 5000, 3).repartition(7)
    got = tr.number_rows(df, [], ["id"], [F.expr("shiftright(id, 9)"), F.expr("shiftright(id, 4)")], total="n")
    assert got.where("idx * 3 <> id").count() == 0 and got.select("n").distinct().collect()[0][0] == 1667


@pytest.mark.parametrize("before,after", [(0, 1), (1, 0), (5, 2)])
def test_blocks_equal_plain_window(series, before, after):
    numbered = tr.number_rows(series, ["track"], ["k"], tr.time_chunk("k", 32))
    plain = Window.partitionBy("track").orderBy("k").rowsBetween(-before, after)
    want = series.withColumn("w", F.collect_list("k").over(plain))
    spread = tr.spread_blocks(numbered, before=before, after=after, block=8)
    got = tr.own_rows(spread.withColumn("w", F.collect_list("k").over(
        tr.block_window(["track"]).rowsBetween(-before, after))))
    assert got.count() == series.count()
    assert got.select("track", "k", "w").exceptAll(want.select("track", "k", "w")).count() == 0


def test_reach_must_fit_block(series):
    with pytest.raises(ValueError):
        tr.spread_blocks(series, before=9, block=8)


def test_quantiles_match_numpy(spark):
    rnd = np.random.default_rng(5)
    groups = {1: np.r_[np.full(500, 1e6), rnd.normal(0, 30, 200)], 2: rnd.exponential(1, 7), 3: np.array([4.0]), 4: -rnd.random(50)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [(2, None), (2, float("nan"))], "g long, v double")
    probs = {"a": 0.1, "b": 0.25, "c": 0.5, "d": 0.99}
    for row in tr.exact_quantiles(df, ["g"], "v", probs).collect():
        for name, p in probs.items():
            assert row[name] == pytest.approx(np.quantile(groups[row["g"]], p), rel=1e-12)
    assert tr.exact_quantiles(df.where("g = 4"), [], "v", {"m": 0.5}).first()["m"] == pytest.approx(np.median(groups[4]))


def test_codes_are_the_bits_of_doubles(spark):
    import struct
    rnd = np.random.default_rng(2)
    values = [0.0, -0.0, float("inf"), float("-inf"), 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308,
              1.0, 0.9999999999999999, 1.0000000000000002, *(2.0 ** e for e in range(-1074, 1024, 7)), *np.nextafter(2.0 ** np.arange(-1000, 1000, 13), 0),
              *rnd.normal(0, 1, 500), *(rnd.normal(0, 1, 500) * 10.0 ** rnd.integers(-300, 300, 500))]
    df = tr.with_code(spark.createDataFrame([(float(v),) for v in values], "v double"), "v", "code")
    for r in df.collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(r["v"])))[0]
        assert r["code"] == (-bits if r["v"] < 0 else bits), r["v"]
    odd = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert tr.with_code(odd, "v", "code").where("code IS NOT NULL").count() == 0


def test_selection_over_any_range(spark):
    rnd = np.random.default_rng(4)
    groups = {1: 5 + rnd.uniform(0, 1e-6, 999), 2: rnd.normal(0, 1, 400) * 10.0 ** rnd.integers(-300, 300, 400), 3: np.zeros(7),
              4: np.array([-np.inf, 0.0, 1e-300, 3.0, np.inf, np.inf]), 5: np.array([-1e-310, 1e-310, 2e-310])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [(3, None), (3, float("nan"))], "g int, v double")
    ranks = {"low": F.lit(0), "mid": F.floor((F.col("n") - 1) / 2), "high": F.col("n") - 1, "beyond": F.col("n")}
    for r in tr.order_statistics(df, ["g"], "v", ranks).collect():
        vs = np.sort(groups[r["g"]])
        assert (r["n"], r["low"], r["mid"], r["high"], r["beyond"]) == (len(vs), vs[0], vs[(len(vs) - 1) // 2], vs[-1], None)


def test_unwrap_and_gradient_match_numpy(spark):
    rnd = np.random.default_rng(1)
    angle = (np.cumsum(rnd.uniform(-3, 3, 300)) + np.pi) % (2 * np.pi) - np.pi
    t = np.cumsum(rnd.uniform(0.1, 0.5, 300))
    df = spark.createDataFrame([(1, i, float(a), float(x)) for i, (a, x) in enumerate(zip(angle, t))], "track long, k long, a double, t double")
    got = [r["u"] for r in op.unwrap_angle(df, ["track"], "a", "u").orderBy("k").collect()]
    assert got == pytest.approx(list(np.unwrap(angle)), abs=1e-9)
    got = [r["g"] for r in op.gradient(df, ["track"], "a", "t", "g").orderBy("k").collect()]
    assert got == pytest.approx(list(np.gradient(angle, t)), abs=1e-9)


def test_regrid_matches_interp(spark):
    k = [3, 4, 7, 8, 12, 15]
    y = [None, 1.0, None, 5.0, 2.0, None]
    df = spark.createDataFrame([(1, a, a * 100, b) for a, b in zip(k, y)], "track long, k long, timestamp long, y double")
    got = {r["k"]: (r["timestamp"], r["y"]) for r in op.regrid_interpolate(df, ["track"], ["y"]).collect()}
    known = [(a, b) for a, b in zip(k, y) if b is not None]
    want = np.interp(range(3, 15), *zip(*known))
    assert sorted(got) == list(range(3, 15))
    assert [got[i][1] for i in range(3, 15)] == pytest.approx(list(want))
    assert [got[i][0] for i in range(3, 15)] == [i * 100 if i in k else -1 for i in range(3, 15)]


def test_half_binomial_quantile(spark):
    def exact(n, p):
        total = 0
        for k in range(n + 1):
            total += math.comb(n, k)
            if Fraction(total, 2 ** n) >= Fraction(str(p)):
                return k
    for n in (1, 2, 9, 40, 333, 1500, 4000):
        row = spark.range(1).selectExpr(*[f"{mt.half_binomial_quantile(f'{n}L', p)} AS q{i}" for i, p in enumerate((0.005, 0.025, 0.975))]).first()
        assert tuple(row) == tuple(exact(n, p) for p in (0.005, 0.025, 0.975))


def test_curve_and_area_match_numpy(spark):
    rnd = np.random.default_rng(2)
    x, y = np.sort(rnd.random(30)), np.sort(rnd.random(30))
    df = spark.createDataFrame([("m", float(a), float(b)) for a, b in zip(x, y)], "model string, x double, y double")
    curve = mt.curve_points(df, "x", "y", ["model"])
    gx = np.linspace(1e-6, 1 - 1e-6, 1000)
    want = np.interp(gx, x, y)
    assert [r["y"] for r in curve.orderBy("g").collect()] == pytest.approx(list(want), abs=1e-9)
    above = want >= 0.6
    area = np.trapezoid(want[above] - 0.6, gx[above]) / 0.4
    assert mt.area(curve, ["model"], 0.6).first()["area"] == pytest.approx(area, abs=1e-9)
    flat = spark.createDataFrame([("m", 0.0, 1.0)], "model string, x double, y double")
    assert mt.area(mt.curve_points(flat, "x", "y", ["model"]), ["model"]).first()["area"] == pytest.approx(1, abs=1e-5)


def test_ranges_number_sparse_ids_and_a_hot_one_evenly(spark):
    from nearmiss.operators.tracks import number_groups, number_ranges, range_rows
    rnd = np.random.default_rng(8)
    ids = [int(x) for x in rnd.integers(-2**62, 2**62, 2000)]
    rows = [(7 if rnd.random() < 0.9 else ids[i % 2000], i) for i in range(20000)] + [(None, -1)]
    df = spark.createDataFrame(rows, "event_id long, k long").repartition(5)
    want = sorted(rows, key=lambda r: (r[0] is not None, r))
    got = {(r["event_id"], r["k"]): (r["idx"], r["n"]) for r in number_ranges(df, ["event_id", "k"], total="n", partitions=8).collect()}
    assert got == {r: (i, len(rows)) for i, r in enumerate(want)}
    sizes = [r["count"] for r in range_rows(df, ["event_id", "k"], 8).groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * len(rows) / 8
    inside = {(r["event_id"], r["k"]): r["idx"] for r in number_groups(df, "event_id", ["k"]).collect()}
    seen = {}
    for r in want:
        assert inside[r] == seen.setdefault(r[0], 0)
        seen[r[0]] += 1
    assert number_ranges(df.limit(0), ["event_id", "k"]).isEmpty()


def test_gaps_over_block_ends_are_filled_like_interp(spark, monkeypatch):
    monkeypatch.setattr(op, "time_chunk", lambda k="k", size=16: F.floor(F.col(k) / F.lit(16)).cast("long"))
    rnd, rows = random.Random(6), []
    for track in (1, 2, None):
        k = -40
        while k < 200:
            rows.append((track, k, k * 100, rnd.choice([None, float("nan"), rnd.random()]) if 20 < k < 160 or track == 2 else rnd.random(),
                         rnd.random() if k > 90 else None, None))
            k += rnd.choice([1, 1, 1, 2, 45])
    df = spark.createDataFrame(rows, "track long, k long, timestamp long, a double, b double, c double").repartition(4)
    got = {(r["track"], r["k"]): r for r in op.regrid_interpolate(df, ["track"], ["a", "b", "c"]).collect()}
    assert len(got) == sum(max(r[1] for r in rows if r[0] == t) + 40 for t in (1, 2, None))
    for track in (1, 2, None):
        mine = [r for r in rows if r[0] == track]
        grid = list(range(-40, mine[-1][1]))
        for i, name in ((3, "a"), (4, "b")):
            known = [r for r in mine if r[i] is not None and not math.isnan(r[i])]
            want = np.interp(grid, [r[1] for r in known], [r[i] for r in known])
            assert [got[track, k][name] for k in grid] == pytest.approx(list(want), abs=1e-12)
        observed = {r[1] for r in mine}
        assert [got[track, k]["timestamp"] for k in grid] == [k * 100 if k in observed else -1 for k in grid]
        assert all(got[track, k]["c"] is None for k in grid)


def test_gap_filling_shuffles_whole_rows_once(spark):
    df = spark.range(1000).selectExpr("id % 3 AS track", "id AS k", "id * 100 AS timestamp", "rand(1) AS a", "uuid() AS note")
    out = op.regrid_interpolate(df, ["track"], ["a"], kept=("timestamp", "note"))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    nodes = out._jdf.queryExecution().explainString(mode).split("\n\n")
    assert sum(") Exchange" in node and "note#" in node for node in nodes) == 1
