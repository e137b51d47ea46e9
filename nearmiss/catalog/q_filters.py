"""Track filters, reconnection and parameter search."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearmiss.catalog.fixture_sql import EDGES, FRAMES, ROOTS
from nearmiss.catalog.registry import register
from nearmiss.functions.numeric import with_exprs
from nearmiss.operators import clean, filters as fl
from nearmiss.operators import frames as op
from nearmiss.operators import reports as rp
from nearmiss.operators import search as se
from nearmiss.plans import derived, fixture
from nearmiss.session import cut_lineage


def rounded(df, columns, digits=6):
    return with_exprs(df, {c: f"round({c}, {digits}) + 0D" for c in columns})


def ego_frames(spark, sf_dir):
    """Telemetry signals on the gap-free grid, for events with usable speed."""
    ego = cut_lineage(clean.trim_leading_incomplete(clean.ego_signals(derived.telemetry(spark, sf_dir))), "signals")
    return op.regrid_interpolate(ego, ["event_id"], ["speed_comp", "yaw_rate", "acc_lat", "acc_lon"]).where(
        "speed_comp IS NOT NULL AND yaw_rate IS NOT NULL AND acc_lon IS NOT NULL")


def radar(spark, sf_dir):
    return cut_lineage(clean.global_target_ids(clean.radar_to_rows(derived.telemetry(spark, sf_dir))), "radar")


register("filter_ego_tracks", "K1", lambda s, d: rounded(
    fl.filter_ego_tracks(ego_frames(s, d)).select("event_id", "k", *fl.EGO_STATE), fl.EGO_STATE))
register("choose_direction", "K2", lambda s, d: rounded(
    fl.choose_direction(ego_frames(s, d)).select("event_id", "k", "reverse", *fl.EGO_STATE), fl.EGO_STATE))


def object_frames(spark, sf_dir):
    ego = cut_lineage(fl.choose_direction(ego_frames(spark, sf_dir)), "ego")
    sur = fl.attach_ego_pose(fl.reconnect_tracks(radar(spark, sf_dir)), ego, derived.ego_lengths(spark, sf_dir).where("ego_length IS NOT NULL"))
    return op.regrid_interpolate(fl.long_enough(cut_lineage(sur, "objects")), ["event_id", "target_id"], ["x", "y", "speed_comp"])


register("filter_surrounding_tracks", "K3 J5 W1", lambda s, d: rounded(
    fl.filter_surrounding_tracks(object_frames(s, d)).select("event_id", "target_id", "k", *fl.OBJECT_STATE), fl.OBJECT_STATE))


def drone_tracks(spark, sf_dir):
    return fixture.frames(spark, sf_dir).selectExpr("track_id", "k AS frame_id", "round(x / 10D, 0) AS x", "round(y / 10D, 0) AS y", "vx", "vy")


register("filter_drone_tracks", "K4", lambda s, d: rounded(
    fl.filter_drone_tracks(drone_tracks(s, d)).select("track_id", "frame_id", *fl.OBJECT_STATE), fl.OBJECT_STATE))
register("search_ego_params", "K5 J9", lambda s, d: rounded(se.best_params(se.search_ego_params(ego_frames(s, d))), ["score"], 4))


def sur_search_job(spark, sf_dir):
    fr = fixture.pairs(spark, sf_dir).selectExpr("event_id", "target_id", "k", "x_sur AS x", "y_sur AS y", "v_sur AS speed_comp")
    return rounded(se.search_sur_params(fr), ["score"], 4)


register("search_sur_params", "K5", sur_search_job)

# --- joins and qualities with a check ------------------------------------------------------------


def pose_job(spark, sf_dir):
    fr = fixture.frames(spark, sf_dir)
    ego = fr.selectExpr("track_id AS event_id", "k", "x AS x_ekf", "y AS y_ekf", "psi AS psi_ekf", "v AS v_ekf")
    sur = fr.selectExpr("track_id - 1 AS event_id", "track_id AS target_id", "k", "hx * 5D AS local_dx", "v AS local_dy", "acc AS delta_vx", "acc * 2D AS delta_vy")
    lengths = fixture.event_meta(spark, sf_dir).select("event_id", F.lit(4.5).alias("ego_length"))
    return rounded(fl.attach_ego_pose(sur, ego, lengths).select("event_id", "target_id", "k", "x", "y", "speed_comp"), ["x", "y", "speed_comp"])


register("attach_ego_pose", "J5", pose_job, f"""WITH {FRAMES}
SELECT e.track_id AS event_id, s.track_id AS target_id, e.k,
  round(e.x + 2.25 * e.hx + e.hy * s.hx * 5 + e.hx * s.v, 6) + 0 AS x, round(e.y + 2.25 * e.hy - e.hx * s.hx * 5 + e.hy * s.v, 6) + 0 AS y,
  round(sqrt(s.acc * s.acc + power(e.v + s.acc * 2, 2)), 6) AS speed_comp
FROM fr e JOIN fr s ON s.track_id = e.track_id + 1 AND s.k = e.k""")

RADAR = f"""{FRAMES},
rd AS (
  SELECT track_id AS event_id, k, i + 8 * (k // 60) AS raw_id, -(i - 2 + CAST(0.005 AS DOUBLE) * (k % 60)) AS local_dx,
         10 * i + CAST(0.02 AS DOUBLE) * k + CASE WHEN i = 3 THEN 5 * (k // 60) ELSE 0 END AS local_dy
  FROM fr, (VALUES (1), (2), (3)) t(i) WHERE track_id % 13 <> 10 AND (kk + i) % 5 > 0),
ra AS (SELECT *, dense_rank() OVER (ORDER BY event_id, raw_id) - 1 AS target_id FROM rd)"""
register("reconnect_edges", "W3", lambda s, d: fl.reconnect_edges(radar(s, d)), f"WITH {RADAR}, {EDGES} SELECT event_id, target_id, parent FROM ed")
register("reconnect_closure", "W3", lambda s, d: fl.resolve_aliases(fl.reconnect_edges(radar(s, d))), f"""WITH RECURSIVE {RADAR}, {EDGES},
walk AS (SELECT event_id, target_id, parent FROM ed UNION ALL SELECT w.event_id, w.target_id, ed.parent FROM walk w JOIN ed ON ed.event_id = w.event_id AND ed.target_id = w.parent)
SELECT event_id, target_id, min(parent) AS parent FROM walk GROUP BY 1, 2""")
register("reconnect_tracks", "W3 P3", lambda s, d: fl.reconnect_tracks(radar(s, d)).select("event_id", "target_id", "timestamp"), f"""
WITH RECURSIVE {RADAR}, {EDGES},
{ROOTS}
SELECT DISTINCT event_id, coalesce(root, target_id) AS target_id, k * 100 AS timestamp FROM ra LEFT JOIN root USING (event_id, target_id)""")


def estimated(spark, sf_dir):
    """Frames with simulated estimates beside the measured columns."""
    return fixture.frames(spark, sf_dir).selectExpr(
        "track_id AS event_id", "k", "v AS speed_comp", "v + 0.1D * hx AS v_ekf", "acc AS acc_lon", "acc * 0.9D AS acc_ekf",
        "psi / 10D AS yaw_rate", "psi / 10D + 0.01D * hy AS omega_ekf", "x", "y", "x + hx AS x_ekf", "y + 2D * hy AS y_ekf")


PAIRS_OF = {"speed": ("v_ekf", "speed_comp"), "yaw_rate": ("omega_ekf", "yaw_rate"), "acc": ("acc_ekf", "acc_lon")}
EST = f"""{FRAMES},
es AS (SELECT track_id AS event_id, k, v AS speed_comp, v + 0.1 * hx AS v_ekf, acc AS acc_lon, acc * 0.9 AS acc_ekf, psi / 10 AS yaw_rate,
              psi / 10 + 0.01 * hy AS omega_ekf, x, y, x + hx AS x_ekf, y + 2 * hy AS y_ekf FROM fr)"""


def rmse_job(spark, sf_dir):
    fr = estimated(spark, sf_dir)
    return rounded(rp.rmse_by_event(fr, PAIRS_OF).join(rp.mean_displacement(fr), "event_id"), [*PAIRS_OF, "displacement"])


RMSE = "SELECT event_id, " + ", ".join(f"round(sqrt(avg(power({a} - {b}, 2))), 6) AS {n}" for n, (a, b) in PAIRS_OF.items()) + \
    ", round(avg(sqrt(power(x_ekf - x, 2) + power(y_ekf - y, 2))), 6) AS displacement FROM es GROUP BY 1"
register("rmse_by_event", "A10 K6", rmse_job, f"WITH {EST} {RMSE}")


def error_job(spark, sf_dir):
    return rounded(rp.mean_std(rmse_job(spark, sf_dir), list(PAIRS_OF)), [f"{c}_{n}" for c in PAIRS_OF for n in ("mean", "std")])


register("error_mean_std", "A10", error_job, f"WITH {EST}, e AS ({RMSE}) SELECT " + ", ".join(
    f"round({f}({c}), 6) AS {c}_{n}" for c in PAIRS_OF for n, f in (("mean", "avg"), ("std", "stddev_samp"))) + " FROM e")
register("filter_score", "K6 A10", lambda s, d: rounded(fl.score_ego(estimated(s, d)), ["score"]), f"""WITH {EST}
SELECT round(sqrt(avg(power(v_ekf - speed_comp, 2))) / 10 + sqrt(avg(power(omega_ekf - yaw_rate, 2))) / (pi() / 6)
             + sqrt(avg(power(acc_ekf - acc_lon, 2))) / 6, 6) AS score FROM es""")


def drone_quality_job(spark, sf_dir):
    fr = estimated(spark, sf_dir).withColumnsRenamed({"event_id": "track_id", "k": "frame_id"})
    return rounded(fl.drone_quality(fr), ["pos_rmse", "speed_rmse", "loss"])


register("drone_quality", "K6", drone_quality_job, f"""WITH {EST},
q AS (SELECT event_id AS track_id, sqrt(avg(power(x - x_ekf, 2) + power(y - y_ekf, 2))) AS pos_rmse, sqrt(avg(power(speed_comp - v_ekf, 2))) AS speed_rmse FROM es WHERE k % 2 = 0 GROUP BY 1)
SELECT track_id, round(pos_rmse, 6) AS pos_rmse, round(speed_rmse, 6) AS speed_rmse, round(0.2 * pos_rmse + 0.8 * speed_rmse, 6) AS loss FROM q""")
