"""Mini-batch centres, factors and their attribution against plain NumPy."""

import numpy as np
import pytest

from nearmiss.operators import attribution as att
from nearmiss.plans import factors as fc


def test_first_centres_are_spread_and_different():
    rnd = np.random.default_rng(0)
    groups = np.repeat(np.array([[0.0, 0.0], [50.0, 0.0], [0.0, 50.0], [50.0, 50.0]]), 100, axis=0)
    found = att.spread_centres(groups + rnd.normal(0, 0.1, groups.shape), 4, 1)
    assert {tuple(np.round(c / 50).astype(int)) for c in found} == {(0, 0), (1, 0), (0, 1), (1, 1)}
    assert len(att.spread_centres(groups, 10, 1)) == 4


def test_mini_batches_find_the_groups(spark):
    rnd = np.random.default_rng(3)
    middle = np.array([[0.0, 0.0], [10.0, 0.0], [0.0, 10.0]])
    rows = [(i, [float(v) for v in middle[i % 3] + rnd.normal(0, 0.3, 2)]) for i in range(3000)]
    df = spark.createDataFrame([*rows, (9999, None)], "id long, v array<double>").repartition(5)
    centres = att.mini_batch_centres(df, "v", k=3, batches=4)
    centres = centres[np.lexsort(np.round(centres).T)]
    assert centres == pytest.approx(middle[np.lexsort(middle.T)], abs=0.1)
    # counts are the weights: after every batch a centre is the mean of all rows it has won
    got = {r["id"]: r["centre"] for r in att.nearest_centre(df, "v", centres, ["id"]).collect()}
    x = np.array([v for _, v in rows])
    assert len(got) == 3000 and [got[i] for i in range(3000)] == att.nearest_places(x, centres).tolist()
    assert att.mini_batch_centres(df.limit(0), "v").shape == (0, 0)


def test_nearest_place_is_the_first_on_a_tie():
    assert att.nearest_places(np.array([[1.0], [3.0]]), np.array([[0.0], [2.0], [2.0], [4.0]])).tolist() == [0, 1]


def test_blocks_of_points_merge(monkeypatch):
    rnd = np.random.default_rng(5)
    s, mu, lv = rnd.uniform(1, 30, 40), rnd.normal(2, 0.3, 40), rnd.normal(-1, 0.2, 40)
    own, other = rnd.normal(0, 0.2, (40, 2)), rnd.normal(0, 0.2, (1000, 2))
    base = att._np_intensity(s, mu, lv)
    whole = base[:, None] - att._np_intensity(s[:, None], mu[:, None] + other[:, 0] - own[:, :1], lv[:, None] + other[:, 1] - own[:, 1:])
    for size in (1000, 256, 7):
        monkeypatch.setattr(att, "CENTRES", size)
        mean, std = att.falls(s, mu, lv, base, own, other)
        assert mean == pytest.approx(whole.mean(axis=1), abs=1e-12) and std == pytest.approx(whole.std(axis=1), abs=1e-12)


def test_every_feature_is_in_one_factor():
    at = fc.positions()
    assert len(at) == 21 and sorted(i for own in at.values() for i in own) == list(range(139))
    assert at["passed_0_5"][-1] == 138 and len(at["lighting"]) + len(at["weather"]) + len(at["surface"]) + len(at["traffic"]) == 27


def test_table_of_the_intensity_gives_the_published_values():
    rnd = np.random.default_rng(8)
    n = 300
    s, mu, lv = np.exp(rnd.normal(1, 1.5, n)), rnd.normal(1, 0.5, n), rnd.normal(-0.5, 0.5, n)
    own, other = rnd.normal(0, 0.4, (n, 2)), rnd.normal(0, 0.4, (500, 2))
    s[:3], mu[3], lv[4:6] = (0.0, np.inf, 1e-9), np.nan, (-5000.0, 5000.0)
    base = att._np_intensity(s, mu, lv)
    with np.errstate(all="ignore"):
        whole = base[:, None] - att._np_intensity(s[:, None], mu[:, None] + other[:, 0] - own[:, :1], lv[:, None] + other[:, 1] - own[:, 1:])
    mean, std = att.falls(s, mu, lv, base, own, other)
    for got, want in ((mean, whole.mean(axis=1)), (std, whole.std(axis=1))):
        assert (np.isnan(got) == np.isnan(want)).all() and np.nanmax(np.abs(got - want)) < 1e-7
        usual = np.isfinite(want) & (np.arange(n) > 5)
        assert np.abs(got - want)[usual].max() < 1e-9
    assert np.isnan(att.falls(s, mu, lv, base, own, other[:0])[1]).all()


def test_points_are_looked_up_and_not_computed(monkeypatch):
    rnd = np.random.default_rng(2)
    s, zero, own, other = np.exp(rnd.normal(0, 1, 50)), np.zeros(50), rnd.normal(0, 0.1, (50, 2)), rnd.normal(0, 0.1, (600, 2))
    att.falls(s, zero, zero, zero, own, other)
    monkeypatch.setattr(att, "_np_intensity", lambda *a: pytest.fail("computed for every point"))
    att.falls(s, zero, zero, zero, own, other)


def test_few_points_are_compared_with_many_rows_at_a_time(spark, monkeypatch):
    rnd = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rnd.normal(0, 1, 3)], float(rnd.uniform(1, 9))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, f array<double>, s double").coalesce(1)
    sizes, falls = [], att.falls
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, task, schema: list(task(iter([self.toPandas()]))))
    monkeypatch.setattr(att, "falls", lambda *a: sizes.append(len(a[0])) or falls(*a))
    parts = att.attribute_intensity(df, "f", [1.0, 0.1, 0.2, 0.3], [-1.0, 0.1, 0.1, 0.1], np.zeros((10, 3)), {"a": [0], "b": [1, 2]}, ["id"])
    assert sum(map(len, parts)) == 3000 and len(sizes) == 4  # two blocks of rows and two factors


def _rows_and_points(n=6000):
    rnd = np.random.default_rng(4)
    s, mu, lv = np.exp(rnd.normal(0.8, 0.6, n)), rnd.normal(1, 0.1, n), rnd.normal(-1, 0.2, n)
    own = rnd.normal(0, 0.02, (n, 2))
    return s, mu, lv, own, np.concatenate([rnd.normal(0.1, 0.03, (200, 2)), np.repeat([[0.3, 0.1]], 56, axis=0)])


def _grid(s, mu, lv, own, other):
    a, left = att._row_terms(s, mu, lv, own)
    grid = att.Grid.over(a, left, other)
    cells = grid.worth(a, left, 1000)
    grid.places[cells] = np.arange(len(cells))
    grid.table, grid.least = grid.fill(cells, other)
    return grid


def test_a_grid_gives_what_all_points_give():
    s, mu, lv, own, other = _rows_and_points()
    grid = _grid(s, mu, lv, own, other)
    s[:4], mu[4], lv[5:9] = (0.0, np.inf, 1e-9, 1e9), np.nan, (-5000.0, 5000.0, 9.0, -9.0)  # outside, or not finite
    base = att._np_intensity(s, mu, lv)
    want, got = att.falls(s, mu, lv, base, own, other), att.falls(s, mu, lv, base, own, other, grid)
    for w, g in zip(want, got):
        assert (np.isnan(g) == np.isnan(w)).all() and np.nanmax(np.abs(g - w)) < 1e-8
    assert grid.moments(*att._row_terms(s, mu, lv, own))[2].mean() > 0.9


def test_cells_off_the_values_are_not_known(monkeypatch):
    s, mu, lv, own, other = _rows_and_points()
    monkeypatch.setattr(att, "CLOSE", 1e-18)
    known = _grid(s, mu, lv, own, other).moments(*att._row_terms(s, mu, lv, own))[2]
    assert (known <= (np.log(s) - mu + own[:, 0] >= 0.29)).all()  # those above the last corner alone


def test_few_rows_of_many_are_compared_with_every_point(spark, monkeypatch):
    rnd = np.random.default_rng(9)
    x = rnd.normal(0, 0.1, (20_000, 3))
    rows = [(i, [float(c) for c in v], float(s)) for i, (v, s) in enumerate(zip(x, np.exp(rnd.normal(0.8, 0.6, len(x)))))]
    df = spark.createDataFrame(rows, "id long, f array<double>, s double").repartition(3)
    model = [1.0, 0.3, 0.2, 0.1], [-1.0, 0.1, 0.2, 0.3], rnd.normal(0, 0.03, (300, 3)), {"a": [0], "b": [1, 2]}
    grids = att.factor_grids(df, "f", *model)
    assert set(grids) == {"a", "b"}
    want, got = (att.attribute_intensity(df, "f", *model, ["id"], grids=g).orderBy("id").toPandas().to_numpy() for g in (None, grids))
    assert len(got) == 20_000 and np.abs(want - got).max() < 1e-8
    compared, moments = [], att._moments
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, task, schema: list(task(iter([self.toPandas()]))))
    monkeypatch.setattr(att, "_moments", lambda a, *rest: compared.append(len(a)) or moments(a, *rest))
    att.attribute_intensity(df, "f", *model, ["id"], grids=grids)
    assert sum(compared) < 0.2 * 2 * 20_000
    assert att.factor_grids(df.limit(100), "f", *model) == {}


def test_weights_are_those_of_the_regression(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F
    from nearmiss.operators import stats as stt
    rnd = np.random.default_rng(7)
    rows = []
    for i in range(3000):
        v = [*rnd.normal(0, 1, 3), *(1.0 if i * 7 % 5 == j else 0.0 for j in range(5)), 0.0]  # labels that sum to 1, a constant
        rows.append(([float(c) for c in v], float(np.exp(0.3 * v[0] - 0.1 * v[4] + rnd.normal(0, 0.4)))))
    df = spark.createDataFrame(rows, "f array<double>, s double").repartition(3)
    want = stt._two_regressions(df.select("s", array_to_vector(F.col("f")).alias("f")))
    asked, ask = [], stt._two_regressions
    monkeypatch.setattr(stt, "_two_regressions", lambda rows: asked.append(1) or ask(rows))
    got = stt.fit_vector_lognormal(df, "f")
    x = np.array([[1.0, *v] for v, _ in rows])
    for w, g in zip(want, got):
        assert w == pytest.approx(g, abs=1e-6) and x @ w == pytest.approx(x @ g, abs=1e-9)
    assert not asked
    even = df.withColumn("s", F.lit(2.0))  # a label that does not vary is left to the regression
    assert stt.fit_vector_lognormal(even, "f")[0] == pytest.approx([np.log(2.0), *[0.0] * 9]) and asked


def test_first_rows_have_the_smallest_hashes(spark):
    from pyspark.sql import functions as F
    rows = [(i, [float(i % 700), 1.0]) for i in range(1000)] + [(1000, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    hashed = df.where("v IS NOT NULL").select("v", F.xxhash64(F.lit(att.SEED), "v").alias("h")).orderBy("h").limit(50).collect()
    dealt = att.deal_batches(df, "v", 4, att.SEED)
    assert att.first_rows(dealt, 50).tolist() == [list(r["v"]) for r in hashed]
    assert dealt.count() == 1000 and dealt.select("batch").distinct().count() == 4
    assert dict(dealt.dtypes)["v"] == "binary"


def test_vectors_of_different_length_are_not_taken_apart():
    import pyarrow as pa
    from nearmiss.operators.stats import matrix_of
    assert matrix_of(pa.array([[1.0, None], [2.0, 3.0]]))[:, 0].tolist() == [1.0, 2.0]
    with pytest.raises(ValueError):
        matrix_of(pa.array([[1.0], [2.0, 3.0, 4.0]]))
