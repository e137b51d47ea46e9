"""Filters recover simple tracks, and filtering many tracks together equals filtering each alone."""

import numpy as np
import pytest

from nearmiss.functions import fixed_values as fv
from nearmiss.operators import filters as fl
from nearmiss.operators import search as se


def ego_rows(event, n, speed, rate):
    return [(event, k, float(speed), float(rate), 0.0) for k in range(n)]


EGO = "event_id long, k long, speed_comp double, yaw_rate double, acc_lon double"


def test_straight_and_circle(spark):
    df = spark.createDataFrame(ego_rows(1, 200, 10, 0) + ego_rows(2, 200, 10, 0.2), EGO)
    out = {(r["event_id"], r["k"]): r for r in fl.filter_ego_tracks(df).collect()}
    last = out[1, 199]
    assert last["x_ekf"] == pytest.approx(199.0, abs=0.01) and last["y_ekf"] == pytest.approx(0, abs=1e-9)
    # the circle has radius v / omega = 50 m and starts at the origin heading east
    for k in (50, 120, 199):
        r = out[2, k]
        assert np.hypot(r["x_ekf"], r["y_ekf"] - 50) == pytest.approx(50, abs=0.05)
        assert r["psi_ekf"] == pytest.approx((0.02 * k + np.pi) % (2 * np.pi) - np.pi, abs=1e-6)


def test_together_equals_alone_in_small_batches(spark):
    rnd = np.random.default_rng(4)
    rows = [(e, k, float(abs(10 + rnd.normal())), float(rnd.normal(0, 0.05)), float(rnd.normal())) for e, n in ((1, 50), (2, 80), (3, 3)) for k in range(n)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        whole = fl.filter_ego_tracks(spark.createDataFrame(rows, EGO)).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    alone = fl.filter_ego_tracks(spark.createDataFrame([r for r in rows if r[0] == 2], EGO)).toPandas().sort_values("k")
    part = whole[whole.event_id == 2].sort_values("k")
    assert len(whole) == len(rows)
    for c in fl.EGO_STATE:
        assert list(part[c]) == pytest.approx(list(alone[c]), abs=1e-12)


def test_jacobian_matches_differences():
    x = np.array([[1.0, 2.0, 0.3, 8.0, 0.4, 0.5], [0.0, 0.0, -1.0, 5.0, 0.0, -0.7]])
    _, jac = fl.predict_turning(x, 0.1)
    for i in (0, 1, 2, 3, 5):
        step = np.zeros(6)
        step[i] = 1e-6
        up, down = (fl.predict_turning(x + s * step, 0.1)[0] for s in (1, -1))
        assert jac[..., i] == pytest.approx((up - down) / 2e-6, abs=1e-5)
    step = np.eye(6)[4] * 1e-6
    up, down = (fl.predict_turning(x[:1] + s * step, 0.1)[0] for s in (1, -1))
    assert jac[:1, :, 4] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_direction(spark):
    steady = ego_rows(1, 60, 10, 0.1)
    bad_start = [(2, k, -1.0 if k < 5 else 10.0, 0.0, 0.0) for k in range(60)]
    bad_both = [(3, k, -1.0 if k < 5 or k > 50 else 10.0, 0.0, 0.0) for k in range(60)]
    out = fl.choose_direction(spark.createDataFrame(steady + bad_start + bad_both, EGO))
    got = {r["event_id"]: r["reverse"] for r in out.select("event_id", "reverse").distinct().collect()}
    assert got == {1: False, 2: True}


def test_objects(spark):
    rows = [(1, t, k, 3.0 * t + k, 2.0, 10.0) for t, n in ((1, 60), (2, 5)) for k in range(n)]
    df = spark.createDataFrame(rows, "event_id long, target_id long, k long, x double, y double, speed_comp double")
    out = fl.filter_surrounding_tracks(fl.long_enough(df)).toPandas().sort_values("k")
    assert set(out.target_id) == {1} and len(out) == 60
    assert out.x_ekf.iloc[-1] == pytest.approx(62, abs=0.5) and out.v_ekf.iloc[-1] == pytest.approx(10, abs=0.1)


def test_drone_track_stands_still(spark):
    rows = [(1, k, float(max(k - 20, 0)), 0.0, 10.0 if k > 20 else 0.0, 0.0) for k in range(60)]
    rows += [(2, k, 5.0, 5.0, 0.0, 0.0) for k in range(30)]
    df = spark.createDataFrame(rows, "track_id long, frame_id long, x double, y double, vx double, vy double")
    out = fl.filter_drone_tracks(df).toPandas().sort_values(["track_id", "frame_id"])
    one = out[out.track_id == 1]
    assert one.psi_ekf.iloc[0] == pytest.approx(0) and one.x_ekf.iloc[-1] == pytest.approx(39, abs=0.2)
    assert out[out.track_id == 2].x_ekf.isna().all()


def test_search_agrees_with_single_runs(spark):
    rnd = np.random.default_rng(8)
    rows = [(e, k, float(abs(10 + rnd.normal())), float(rnd.normal(0, 0.05)), float(rnd.normal())) for e in (1, 2) for k in range(60)]
    df = spark.createDataFrame(rows, EGO)
    space = {**{k: (v[0],) for k, v in fv.EGO_SEARCH.items()}, "uncertainty_speed": (2.0, 32.0), "uncertainty_acc": (2.0, 32.0)}
    scores = se.search_ego_params(df, space).collect()
    assert len(scores) == 4
    for row in scores:
        params = {k: row[k] for k in fv.EGO_DEFAULTS}
        single = fl.score_ego(fl.choose_direction(df, params)).first()["score"]
        assert row["score"] == pytest.approx(single, rel=1e-9)
    best = se.best_params(se.search_ego_params(df, space)).first()
    assert round(best["score"], 4) == round(min(r["score"] for r in scores), 4)


def test_search_of_an_exact_turn(spark):
    turn = [(1, k, 10.0, 0.1, 0.0) for k in range(300)]
    scores = se.search_ego_params(spark.createDataFrame(turn, EGO)).toPandas()
    assert len(scores) == 51_200 and scores.score.abs().max() < 1e-12
    best = se.best_params(se.search_ego_params(spark.createDataFrame(turn, EGO))).first()
    assert best["combo"] == 0 and best["max_yaw_rate"] == pytest.approx(np.pi / 15)


def test_search_takes_the_valid_direction(spark):
    rnd = np.random.default_rng(5)
    rows = [(1, k, -1.0 if k < 3 else 10 + float(rnd.normal()), 0.01 * k, 0.1) for k in range(60)]
    rows += [(2, k, -1.0 if k > 57 else 12 + float(rnd.normal()), 0.0, float(rnd.normal())) for k in range(70)]
    gone = [(3, k, -1.0 if k in (0, 39) else 10.0, 5.0 * (k % 2), 0.0) for k in range(40)]
    space = {**{k: (v[0],) for k, v in fv.EGO_SEARCH.items()}, "max_jerk": (2.0, 16.0), "max_yaw_acc_pi": (0.2, 2.0)}
    df = spark.createDataFrame(rows + gone, EGO)
    for row in se.search_ego_params(df, space).collect():
        chosen = fl.choose_direction(df, {k: row[k] for k in fv.EGO_DEFAULTS})
        assert row["score"] == pytest.approx(fl.score_ego(chosen).first()["score"], rel=1e-9)
    assert se.search_ego_params(df.where("event_id = 3"), space).count() == 0
    assert se.search_ego_params(df.limit(0), space).count() == 0


def test_object_search_agrees_with_single_runs(spark):
    rnd = np.random.default_rng(9)
    rows = [(e, t, k, k + float(rnd.normal()), t + float(rnd.normal()), 10 + float(rnd.normal()))
            for e in (1, 2) for t in (1, 2) for k in range(20 + 15 * t)]
    df = spark.createDataFrame(rows, "event_id long, target_id long, k long, x double, y double, speed_comp double")
    space = {**{k: (v[0],) for k, v in fv.SUR_SEARCH.items()}, "uncertainty_pos": (2.0, 32.0), "max_yaw_rate_pi": (0.2, 2.0)}
    for row in se.search_sur_params(df, space).collect():
        one = fl.filter_surrounding_tracks(df, {k: row[k] for k in fv.SUR_DEFAULTS}).toPandas()
        want = (np.hypot(one.x - one.x_ekf, one.y - one.y_ekf).mean() / 5 + np.sqrt(((one.speed_comp - one.v_ekf) ** 2).mean()) / 10)
        assert row["score"] == pytest.approx(want, rel=1e-9)


def test_search_moves_frames_once(spark):
    df = spark.createDataFrame([(e, k, 10.0, 0.0, 0.0) for e in range(200) for k in range(5)], EGO).repartition(4)
    sums = se.error_sums(df.withColumn("raw_speed", df.speed_comp), ["event_id"], ["raw_speed", "speed_comp", "yaw_rate", "acc_lon"],
                         fv.EGO_SEARCH, se.ego_error_sums, ["n", "speed", "yaw_rate", "acc"])
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning(event_id") == 1
    assert {r["n"] for r in sums.select("n").distinct().collect()} == {1000.0}


def test_blocks_hold_whole_tracks(monkeypatch):
    import pandas as pd
    monkeypatch.setattr(se, "BLOCK_ROWS", 30)
    pdf = pd.DataFrame([(i // 7, "a", float(i)) for i in range(100)] + [(99, "a", float(i)) for i in range(40)], columns=["e", "t", "x"])
    parts = [pdf[i:i + 11] for i in range(0, len(pdf), 11)]
    found = list(se.blocks(se.whole_tracks(iter(parts), ["e", "t"], ["x"])))
    assert sum(len(t) for b in found for t in b) == 140 and [len(b[0]) for b in found if len(b[0]) > 7] == [40]
    assert all(len(b) == 1 or sum(map(len, b)) < 30 + 7 for b in found)


def test_alias_chain(spark):
    edges = spark.createDataFrame([(1, i, i - 1) for i in range(2, 40)] + [(2, 9, 4)], "event_id long, target_id long, parent long")
    got = {(r["event_id"], r["target_id"]): r["parent"] for r in fl.resolve_aliases(edges).collect()}
    assert all(got[1, i] == 1 for i in range(2, 40)) and got[2, 9] == 4


def test_length_gate_counts_measured_rows(spark):
    rows = [(1, 1, k) for k in range(10)] + [(1, 2, 4 * k) for k in range(5)]
    got = fl.long_enough(spark.createDataFrame(rows, "event_id long, target_id long, k long"))
    assert {r["target_id"] for r in got.collect()} == {1}


def test_registered_jobs_take_the_full_spaces(spark, monkeypatch):
    import math

    from nearmiss.catalog import q_filters, q_stats
    from nearmiss.catalog.registry import load_all

    class Stop(Exception):
        pass

    def size(frames, space=None, *, default):
        raise Stop(math.prod(map(len, (space or default).values())))

    def centres(vectors, column, k=1024):
        raise Stop(k)

    sf, jobs = "/root/testdata/sf0.001", load_all()
    ego, sur = (f.__defaults__[0] for f in (q_filters.se.search_ego_params, q_filters.se.search_sur_params))
    monkeypatch.setattr(q_filters.se, "search_ego_params", lambda f, s=None: size(f, s, default=ego))
    monkeypatch.setattr(q_filters.se, "search_sur_params", lambda f, s=None: size(f, s, default=sur))
    monkeypatch.setattr(q_stats.att, "mini_batch_centres", centres)
    for name, want in {"search_ego_params": 51_200, "search_sur_params": 800, "reference_points": 1024, "attribute_intensity": 1024}.items():
        try:
            jobs[name].job(spark, sf)
        except Stop as said:
            assert said.args == (want,), name
        else:
            raise AssertionError(name)


def test_binned_scores_keep_every_frame(spark):
    from nearmiss.operators import stats as stt
    rows = [(i, 0.5, 0.5, float(5 + i % 7)) for i in range(20)] + [(100 + i, 0.5, 1.5, 8.0) for i in range(3)]  # narrow
    feats = spark.createDataFrame(rows, "k long, a double, b double, s double")
    new = spark.createDataFrame([(1, 0.5, 0.5, 6.0), (2, 0.5, 1.5, 8.0), (3, 0.5, 9.0, 8.0), (4, 9.0, 9.0, 8.0), (5, None, 0.5, 8.0)],
                                feats.schema)
    model = stt.fit_binned_lognormal(feats, {"a": 1.0, "b": 1.0})
    got = {r["k"]: r for r in stt.apply_binned(new, model, {"a": 1.0, "b": 1.0}, narrow=0.01).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and set(got[1].asDict()) == {"k", "a", "b", "s", "mu", "sigma"}
    logs, every = np.log([r[3] for r in rows[:20]]), np.log([r[3] for r in rows])
    assert got[1]["mu"] == pytest.approx(logs.mean()) and got[1]["sigma"] == pytest.approx(logs.std())
    for k in (2, 3, 4, 5):
        assert got[k]["mu"] == pytest.approx(every.mean()) and got[k]["sigma"] == pytest.approx(every.std())


def test_object_search_steps_like_the_filter():
    rnd = np.random.default_rng(12)
    block = [np.cumsum(rnd.normal(1, 2, (n, 3)), axis=0) for n in (60, 41, 3)]
    params = se.parameters_of(fv.SUR_SEARCH, np.arange(0, 800, 37))
    model, path = fl.ObjectFilter(params), None
    z, reach = se.stacked(block)
    for t in range(len(z)):
        n = reach[t]
        seen = np.concatenate([z[t, :n], np.zeros((n, 1)), np.ones((n, 1))], axis=1)
        seen = np.broadcast_to(seen[:, None, :], (n, len(params["max_acc"]), 5))
        if t == 0:
            x, p = model.start(seen)
            path = se.PathFilter(params, z[0], 0.1)
        x, p = model.step(x[:n], p[:n], seen, 0.1, np.zeros(n, bool))
        path.step(z[t, :n])
        assert np.stack(path.state[:3], axis=-1) == pytest.approx(x[..., :3], rel=1e-8, abs=1e-8)
        assert all(path.p[i, j] == pytest.approx(p[..., i, j], rel=1e-7, abs=1e-8) for i, j in path.p)


def test_object_search_is_spread_over_many_tasks(spark):
    df = spark.createDataFrame([(e, 1, k, 1.0, 1.0, 1.0) for e in range(40) for k in range(3)], "event_id long, target_id long, k long, x double, y double, speed_comp double")
    plan = se.search_sur_params(df)._jdf.queryExecution().executedPlan().toString()
    tasks = 4 * spark.sparkContext.defaultParallelism
    assert f"hashpartitioning(event_id#" in plan and f", {tasks}), REPARTITION_BY_NUM" in plan
