"""Pairing, views, context features, ordered-series operators and scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearmiss.catalog.fixture_sql import FRAMES, pairs as pairs_sql
from nearmiss.catalog.registry import register
from nearmiss.functions.numeric import with_exprs
from nearmiss.operators import frames as op
from nearmiss.plans import fixture

P = "WITH " + pairs_sql()
PV = "WITH " + pairs_sql(varied_dims=True)
FR = "WITH " + FRAMES


def rounded(df, columns, digits=6):
    return with_exprs(df, {c: f"round({c}, {digits}) + 0D" for c in columns})


def r(expr: str, alias: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0 AS {alias}"


# --- pairs, lane changes -------------------------------------------------------------------------

def pair_job(spark, sf_dir):
    fr = fixture.frames(spark, sf_dir).selectExpr("track_id AS event_id", "k", "x", "y", "v", "psi")
    sur = fr.selectExpr("event_id - 1 AS event_id", "(event_id - 1) * 10 + 1 AS target_id", "k", "x", "y", "v", "psi")
    return rounded(op.pair_frames(fr, sur), ["x_ego", "y_ego", "v_ego", "psi_ego", "x_sur", "y_sur", "v_sur", "psi_sur"])


register("pair_frames", "J2", pair_job, FR + """
SELECT e.track_id AS event_id, e.track_id * 10 + 1 AS target_id, e.k, """ + ", ".join(
    r(f"{t}.{c}", f"{c}_{n}") for t, n in (("e", "ego"), ("s", "sur")) for c in ("x", "y", "v", "psi")) + """
FROM fr e JOIN fr s ON s.track_id = e.track_id + 1 AND s.k = e.k""")


def lanes(spark, sf_dir):
    return fixture.frames(spark, sf_dir).selectExpr(
        "track_id", "k", "CASE WHEN track_id % 3 = 0 THEN 1 ELSE kk % 3 + 1 END AS lane_id",
        "CASE WHEN kk % 4 = 0 THEN track_id + 1 ELSE 0 END AS preceding_id",
        "CASE WHEN kk % 9 = 1 THEN track_id + 1 WHEN kk % 5 = 0 AND track_id % 4 <> 0 THEN track_id + 2 ELSE 0 END AS following_id",
        "round(x, 3) AS x", "v")


LANES = """lanes AS (
  SELECT track_id, k, CASE WHEN track_id % 3 = 0 THEN 1 ELSE kk % 3 + 1 END AS lane_id,
         CASE WHEN kk % 4 = 0 THEN track_id + 1 ELSE 0 END AS preceding_id,
         CASE WHEN kk % 9 = 1 THEN track_id + 1 WHEN kk % 5 = 0 AND track_id % 4 <> 0 THEN track_id + 2 ELSE 0 END AS following_id,
         round(x, 3) AS x, v FROM fr)"""

register("multi_lane_tracks", "A1", lambda s, d: op.lane_changers(lanes(s, d)), f"""{FR}, {LANES}
SELECT track_id, count(DISTINCT lane_id) AS lanes FROM lanes GROUP BY 1 HAVING count(DISTINCT lane_id) > 1""")

register("interaction_pairs", "J3 W17", lambda s, d: op.interaction_pairs(lanes(s, d), first_id=100), f"""{FR}, {LANES},
ch AS (SELECT track_id FROM lanes GROUP BY 1 HAVING count(DISTINCT lane_id) > 1),
pt AS (
  SELECT track_id, 0 AS role, preceding_id AS pid, min(k) AS fk FROM lanes JOIN ch USING (track_id) WHERE preceding_id > 0 GROUP BY ALL
  UNION ALL
  SELECT track_id, 1, following_id, min(k) FROM lanes JOIN ch USING (track_id) WHERE following_id > 0 GROUP BY ALL),
ok AS (SELECT * FROM pt WHERE track_id IN (SELECT track_id FROM pt GROUP BY 1 HAVING count(DISTINCT role) = 2)),
common AS (SELECT ok.*, (SELECT count(*) FROM lanes a JOIN lanes b USING (k) WHERE a.track_id = ok.track_id AND b.track_id = ok.pid) AS n FROM ok),
num AS (SELECT *, 100 + row_number() OVER (ORDER BY track_id, role, fk, pid) - 1 AS lc_id FROM common WHERE n >= 25),
ids AS (SELECT track_id, pid, min(lc_id) AS lc_id FROM num GROUP BY ALL)
SELECT ids.lc_id, a.track_id AS track_id_ego, b.track_id AS track_id_sur, a.k, a.x AS x_ego, a.v AS v_ego, b.x AS x_sur, b.v AS v_sur
FROM ids JOIN lanes a ON a.track_id = ids.track_id JOIN lanes b ON b.track_id = ids.pid AND b.k = a.k""")

# --- views and features --------------------------------------------------------------------------

VIEW_COLS = ["x_sur", "y_sur", "hx_ego", "hy_ego", "hx_sur", "hy_sur", "vx_ego", "vy_ego", "vx_sur", "vy_sur"]


def view_job(view):
    def run(spark, sf_dir):
        out = op.to_view(fixture.pairs(spark, sf_dir), view)
        return rounded(out.select("event_id", "target_id", "k", *VIEW_COLS), VIEW_COLS)
    return run


def view_sql(view):
    e, s = ("sur", "ego") if view == "sur" else ("ego", "sur")
    if view == "relative":
        ax, ay = (f"CASE WHEN vx_ego = vx_sur AND vy_ego = vy_sur THEN h{c}_ego ELSE v{c}_ego - v{c}_sur END" for c in "xy")
    else:
        ax, ay = f"hx_{e}", f"hy_{e}"

    def rot(x, y):
        return f"(by_ * ({x}) - bx_ * ({y}))", f"(bx_ * ({x}) + by_ * ({y}))"
    vals = dict(zip(("x_sur", "y_sur"), rot(f"x_{s} - x_{e}", f"y_{s} - y_{e}")))
    for o, src in (("ego", e), ("sur", s)):
        for v in "hv":
            vals |= dict(zip((f"{v}x_{o}", f"{v}y_{o}"), rot(f"{v}x_{src}", f"{v}y_{src}")))
    vals["vy_ego"] = f"abs({vals['vy_ego']})"
    cols = ", ".join(r(vals[c], c) for c in VIEW_COLS)
    return f"""{P}, a AS (SELECT *, {ax} AS ax_, {ay} AS ay_ FROM pairs),
b AS (SELECT *, ax_ / sqrt(ax_ * ax_ + ay_ * ay_) AS bx_, ay_ / sqrt(ax_ * ax_ + ay_ * ay_) AS by_ FROM a)
SELECT event_id, target_id, k, {cols} FROM b"""


for _v in ("ego", "relative", "sur"):
    register(f"view_{_v}", "G1 G2", view_job(_v), view_sql(_v))


def view_objects_job(spark, sf_dir):
    pairs = fixture.pairs(spark, sf_dir)
    others = pairs.selectExpr("event_id", "target_id", "k", "target_id + 1 AS object_id",
                              "x_sur + 1D AS x", "y_sur - 2D AS y", "hx_sur AS hx", "hy_sur AS hy")
    out = op.to_view(pairs, "ego", others)
    return rounded(out.select("event_id", "target_id", "k", "object_id", "x", "y", "hx", "hy"), ["x", "y", "hx", "hy"])


register("view_other_objects", "G3", view_objects_job, f"""{P}
SELECT event_id, target_id, k, target_id + 1 AS object_id,
  {r('(hy_ego * (x_sur + 1 - x_ego) - hx_ego * (y_sur - 2 - y_ego))', 'x')},
  {r('(hx_ego * (x_sur + 1 - x_ego) + hy_ego * (y_sur - 2 - y_ego))', 'y')},
  {r('hy_ego * hx_sur - hx_ego * hy_sur', 'hx')}, {r('hx_ego * hx_sur + hy_ego * hy_sur', 'hy')}
FROM pairs""")

FEATURES = [*op.CURRENT, "s"]
FEATURE_SQL = """
f0 AS (
  SELECT *, CASE WHEN vx_ego = vx_sur AND vy_ego = vy_sur THEN hx_ego ELSE vx_ego - vx_sur END AS ax,
         CASE WHEN vx_ego = vx_sur AND vy_ego = vy_sur THEN hy_ego ELSE vy_ego - vy_sur END AS ay,
         x_sur - x_ego AS dx, y_sur - y_ego AS dy FROM {src}),
feat AS (
  SELECT * EXCLUDE (vx_ego, vy_ego, vx_sur, vy_sur, psi_sur), length_ego AS l_ego, length_sur AS l_sur,
         (width_ego + width_sur) / 2 AS combined_width,
         abs(hx_ego * vx_ego + hy_ego * vy_ego) AS vy_ego, hy_ego * vx_sur - hx_ego * vy_sur AS vx_sur,
         hx_ego * vx_sur + hy_ego * vy_sur AS vy_sur, vx_ego * vx_ego + vy_ego * vy_ego AS v_ego2,
         vx_sur * vx_sur + vy_sur * vy_sur AS v_sur2,
         power(vx_ego - vx_sur, 2) + power(vy_ego - vy_sur, 2) AS delta_v2,
         sqrt(power(vx_ego - vx_sur, 2) + power(vy_ego - vy_sur, 2))
           * CASE WHEN abs(v_ego - v_sur) < 1e-11 THEN 0 ELSE sign(v_ego - v_sur) END AS delta_v,
         atan2(-(hy_ego * hx_sur - hx_ego * hy_sur), hx_ego * hx_sur + hy_ego * hy_sur) AS psi_sur,
         atan2((ax * dx + ay * dy) / sqrt(ax * ax + ay * ay), (ay * dx - ax * dy) / sqrt(ax * ax + ay * ay)) AS rho,
         greatest(sqrt(dx * dx + dy * dy), 1e-6) AS s
  FROM f0)"""


def features_job(spark, sf_dir):
    out = op.current_features(fixture.pairs(spark, sf_dir, varied_dims=True))
    return rounded(out.select("event_id", "target_id", "k", *FEATURES), FEATURES, 5)


register("current_features", "G4 G17 P18", features_job, f"""{PV}, {FEATURE_SQL.format(src='pairs')}
SELECT event_id, target_id, k, {', '.join(r(c, c, 5) for c in FEATURES)} FROM feat""")


def feature_set_job(spark, sf_dir):
    feats = op.current_features(fixture.pairs(spark, sf_dir))
    out = op.feature_set(feats, "current", log_spacing=True)
    cols = [c for c in out.columns if c in FEATURES]
    return rounded(out.select("event_id", "target_id", "k", *cols), cols, 5)


register("feature_set_log_spacing", "P28", feature_set_job, f"""{P}, {FEATURE_SQL.format(src='pairs')}
SELECT event_id, target_id, k, {', '.join(r(c, c, 5) for c in FEATURES if c not in ('acc_ego', 's'))}, {r('ln(s)', 's', 5)} FROM feat""")

# --- histories and scenes ------------------------------------------------------------------------

WRAP = "(({0}) - 2 * pi() * floor((({0}) + pi()) / (2 * pi())))"
PROFILE_SQL = f"""
num AS (SELECT *, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY event_id, target_id) AS n,
               atan2(-hx_ego, hy_ego) AS head,
               lead(atan2(-hx_ego, hy_ego)) OVER w - atan2(-hx_ego, hy_ego) AS dn,
               atan2(-hx_ego, hy_ego) - lag(atan2(-hx_ego, hy_ego)) OVER w AS dp,
               lead(time) OVER w - time AS tn, time - lag(time) OVER w AS tp
        FROM pairs WINDOW w AS (PARTITION BY event_id, target_id ORDER BY k)),
yaw AS (SELECT *, CASE WHEN tp IS NULL THEN {WRAP.format('dn')} / tn WHEN tn IS NULL THEN {WRAP.format('dp')} / tp
               ELSE (tp * tp * {WRAP.format('dn')} + tn * tn * {WRAP.format('dp')}) / (tp * tn * (tp + tn)) END AS yaw_ego,
               hy_ego * vx_sur - hx_ego * vy_sur AS pvx, hx_ego * vx_sur + hy_ego * vy_sur AS pvy FROM num),
prof AS (SELECT *, count(*) OVER h AS profile_rows, first_value(yaw_ego) OVER h AS first_yaw, last_value(yaw_ego) OVER h AS last_yaw,
                sum(abs(v_ego)) OVER h AS sum_v, sum(pvx) OVER h AS sum_vx, sum(pvy) OVER h AS sum_vy
         FROM yaw WINDOW h AS (PARTITION BY event_id, target_id ORDER BY k ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING))"""
PROFILE_COLS = ["first_yaw", "last_yaw", "sum_v", "sum_vx", "sum_vy"]


def profile_summary(df):
    total = "aggregate(profiles, 0D, (acc, p) -> acc + p.{0})"
    return with_exprs(df, {
        "profile_rows": "CAST(size(profiles) AS BIGINT)", "first_yaw": "profiles[0].yaw_ego",
        "last_yaw": "element_at(profiles, -1).yaw_ego", "sum_v": total.format("v_ego"),
        "sum_vx": total.format("vx_sur"), "sum_vy": total.format("vy_sur")})


def history_job(spark, sf_dir):
    prof = profile_summary(op.history_profile(op.numbered_pairs(fixture.pairs(spark, sf_dir))).where("idx > 0"))
    return rounded(prof.select("event_id", "target_id", "k", "idx", "n", "profile_rows", *PROFILE_COLS), PROFILE_COLS, 5)


register("history_profile", "W6", history_job, f"""{P}, {PROFILE_SQL}
SELECT event_id, target_id, k, idx, n, profile_rows, {', '.join(r(c, c, 5) for c in PROFILE_COLS)} FROM prof WHERE idx > 0""")


def every_frame_job(spark, sf_dir):
    out = profile_summary(op.every_frame_scenes(fixture.pairs(spark, sf_dir, varied_dims=True)))
    cols = [*FEATURES, *PROFILE_COLS]
    return rounded(out.select("event_id", "target_id", "k", *cols), cols, 5)


register("every_frame_scenes", "W8", every_frame_job, f"""{PV}, {PROFILE_SQL}, {FEATURE_SQL.format(src='prof')}
SELECT event_id, target_id, k, {', '.join(r(c, c, 5) for c in [*FEATURES, *PROFILE_COLS])}
FROM feat WHERE n >= 30 AND idx >= 26""")


def sampled_job(spark, sf_dir):
    # surrounding speed is missing now and then, so some scenes have gaps and drop out
    pairs = fixture.pairs(spark, sf_dir).withColumn(
        "v_sur", F.expr("CASE WHEN (k + target_id) % 97 = 0 THEN NULL ELSE v_sur END"))
    out = profile_summary(op.sample_scenes(pairs, op.STRIDES["SafeBaseline"]))
    cols = [*FEATURES, *PROFILE_COLS]
    return rounded(out.select("scene_id", "event_id", "target_id", "k", *cols), cols, 5)


register("sample_scenes", "W7 W17", sampled_job, f"""{P.replace('pairs AS (', 'pairs_full AS (')},
pairs AS (SELECT * REPLACE (CASE WHEN (k + target_id) % 97 = 0 THEN NULL ELSE v_sur END AS v_sur,
                            CASE WHEN (k + target_id) % 97 = 0 THEN NULL ELSE vx_sur END AS vx_sur,
                            CASE WHEN (k + target_id) % 97 = 0 THEN NULL ELSE vy_sur END AS vy_sur) FROM pairs_full),
{PROFILE_SQL},
ends AS (SELECT *, n - (CAST('0x' || substr(md5(target_id || '-131'), 1, 6) AS BIGINT) % 5 + 1) AS e,
                count(vx_sur) OVER (PARTITION BY event_id, target_id ORDER BY k ROWS BETWEEN 25 PRECEDING AND CURRENT ROW) AS seen FROM prof),
{FEATURE_SQL.format(src='ends')}
SELECT row_number() OVER (ORDER BY event_id, target_id, idx DESC) - 1 AS scene_id, event_id, target_id, k,
       {', '.join(r(c, c, 5) for c in [*FEATURES, *PROFILE_COLS])}
FROM feat WHERE n >= 35 AND idx > 25 AND idx <= e AND (e - idx) % 10 = 0 AND seen = 26""")

# --- ordered-series operators --------------------------------------------------------------------


def unwrap_job(spark, sf_dir):
    out = op.unwrap_angle(fixture.frames(spark, sf_dir).select("track_id", "k", "psi"), ["track_id"], "psi", "unwrapped")
    return rounded(out.select("track_id", "k", "unwrapped"), ["unwrapped"])


register("unwrap_angle", "W4", unwrap_job, f"""{FR},
d AS (SELECT track_id, k, psi, psi - lag(psi) OVER (PARTITION BY track_id ORDER BY k) AS dd FROM fr),
c AS (SELECT *, CASE WHEN dd IS NULL OR abs(dd) < pi() THEN 0 WHEN dd > 0 THEN -2 * pi() ELSE 2 * pi() END AS fix FROM d)
SELECT track_id, k, {r('psi + sum(fix) OVER (PARTITION BY track_id ORDER BY k)', 'unwrapped')} FROM c""")


def uneven(spark, sf_dir):
    """Tracks with missing moments, so the spacing in time is uneven."""
    return fixture.frames(spark, sf_dir).where("kk % 7 <> 0").withColumn("time", F.expr("CAST(k AS DOUBLE) / 10D"))


UNEVEN = "u AS (SELECT *, CAST(k AS DOUBLE) / 10 AS time FROM fr WHERE kk % 7 <> 0)"


def gradient_job(spark, sf_dir):
    out = op.gradient(uneven(spark, sf_dir).select("track_id", "k", "time", "v"), ["track_id"], "v", "time", "dv")
    return rounded(out.select("track_id", "k", "dv"), ["dv"], 5)


register("gradient", "W5", gradient_job, f"""{FR}, {UNEVEN},
g AS (SELECT track_id, k, v, time, lead(v) OVER w AS vn, lag(v) OVER w AS vp, lead(time) OVER w - time AS hd, time - lag(time) OVER w AS hs
      FROM u WINDOW w AS (PARTITION BY track_id ORDER BY k))
SELECT track_id, k, round(CASE WHEN hs IS NULL THEN (vn - v) / hd WHEN hd IS NULL THEN (v - vp) / hs
  ELSE (hs * hs * vn + (hd * hd - hs * hs) * v - hd * hd * vp) / (hs * hd * (hs + hd)) END, 5) + 0 AS dv FROM g""")


def yaw_job(spark, sf_dir):
    src = uneven(spark, sf_dir).select("track_id", "k", "time", (F.col("acc") / 3).alias("rate"))
    a = op.yaw_integral(src, ["track_id"], "rate", "time", "yaw")
    b = op.yaw_integral(src, ["track_id"], "rate", "time", "yaw_back", reverse=True)
    return rounded(a.select("track_id", "k", "yaw").join(b.select("track_id", "k", "yaw_back"), ["track_id", "k"]),
                   ["yaw", "yaw_back"], 8)


register("yaw_integral", "W11", yaw_job, f"""{FR}, {UNEVEN},
g AS (SELECT track_id, k, acc / 3 AS rate, lead(time) OVER w - time AS hd, time - lag(time) OVER w AS hs
      FROM u WINDOW w AS (PARTITION BY track_id ORDER BY k)),
s AS (SELECT *, sum(rate * CASE WHEN hs IS NULL THEN hd WHEN hd IS NULL THEN hs ELSE (hs + hd) / 2 END)
        OVER (PARTITION BY track_id ORDER BY k) AS a FROM g),
y AS (SELECT *, {WRAP.format('a')} AS yaw FROM s)
SELECT track_id, k, {r('yaw', 'yaw', 8)},
       {r('yaw - last_value(yaw) OVER (PARTITION BY track_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)', 'yaw_back', 8)}
FROM y""")


def grid(spark, sf_dir):
    """Positions on a coarse grid, so tracks stand still at times."""
    return fixture.frames(spark, sf_dir).selectExpr("track_id", "k", "round(x / 40D, 0) AS x", "round(y / 40D, 0) AS y")


GRID = "gr AS (SELECT track_id, k, round(x / 40, 0) AS x, round(y / 40, 0) AS y FROM fr)"
register("moving_flag", "W13", lambda s, d: op.moving_flag(grid(s, d), ["track_id"]).select("track_id", "k", "moving"), f"""
{FR}, {GRID} SELECT track_id, k, coalesce(x <> lag(x) OVER w OR y <> lag(y) OVER w, false) AS moving FROM gr
WINDOW w AS (PARTITION BY track_id ORDER BY k)""")
register("initial_heading", "W12", lambda s, d: rounded(op.initial_heading(grid(s, d), ["track_id"]), ["psi0"]), f"""
{FR}, {GRID}, d AS (SELECT track_id, k, x - lag(x, 2) OVER w AS dx, y - lag(y, 2) OVER w AS dy FROM gr WINDOW w AS (PARTITION BY track_id ORDER BY k))
SELECT track_id, {r('atan2(arg_min(dy, k), arg_min(dx, k))', 'psi0')} FROM d WHERE dx <> 0 OR dy <> 0 GROUP BY 1""")


def regrid_job(spark, sf_dir):
    src = fixture.frames(spark, sf_dir).where("kk % 7 <> 0").selectExpr(
        "track_id", "k", "k * 100 AS timestamp", "CASE WHEN kk % 11 <> 0 THEN v END AS v",
        "CASE WHEN kk % 13 <> 0 AND k > 4 THEN acc END AS acc")
    return rounded(op.regrid_interpolate(src, ["track_id"], ["v", "acc"]), ["v", "acc"])


def _fill(c):
    return f"""CASE WHEN k = {c}k1 OR {c}k2 IS NULL THEN {c}y1 WHEN {c}k1 IS NULL THEN {c}y2
  ELSE {c}y1 + ({c}y2 - {c}y1) / ({c}k2 - {c}k1) * (k - {c}k1) END"""


def _around(c):
    prev = "OVER (PARTITION BY track_id ORDER BY k ROWS UNBOUNDED PRECEDING)"
    nxt = "OVER (PARTITION BY track_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return (f"max(CASE WHEN {c} IS NOT NULL THEN k END) {prev} AS {c}k1, last_value({c} IGNORE NULLS) {prev} AS {c}y1, "
            f"min(CASE WHEN {c} IS NOT NULL THEN k END) {nxt} AS {c}k2, first_value({c} IGNORE NULLS) {nxt} AS {c}y2")


register("regrid_interpolate", "W1", regrid_job, f"""{FR},
src AS (SELECT track_id, k, k * 100 AS timestamp, CASE WHEN kk % 11 <> 0 THEN v END AS v,
               CASE WHEN kk % 13 <> 0 AND k > 4 THEN acc END AS acc FROM fr WHERE kk % 7 <> 0),
g AS (SELECT track_id, unnest(range(min(k), max(k))) AS k FROM src GROUP BY 1),
u AS (SELECT track_id, k, timestamp, v, acc, k < max(k) OVER (PARTITION BY track_id) AS inside
      FROM g FULL JOIN src USING (track_id, k)),
n AS (SELECT track_id, k, timestamp, inside, {_around('v')}, {_around('acc')} FROM u)
SELECT track_id, k, coalesce(timestamp, -1) AS timestamp, {r(_fill('v'), 'v')}, {r(_fill('acc'), 'acc')} FROM n WHERE inside""")


def drone(spark, sf_dir):
    return fixture.frames(spark, sf_dir).selectExpr(
        "track_id", "k AS frame_id", "x", "y", "vx", "vy", "kk % 3 + 1 AS lane_id",
        "CASE WHEN k % 40 < 13 THEN track_id + 1 WHEN k % 40 < 29 THEN 0 ELSE track_id + 7 END AS preceding_id")


DRONE = """dr AS (SELECT track_id, k AS frame_id, x, y, vx, vy, kk % 3 + 1 AS lane_id,
  CASE WHEN k % 40 < 13 THEN track_id + 1 WHEN k % 40 < 29 THEN 0 ELSE track_id + 7 END AS preceding_id FROM fr)"""


def resample_job(spark, sf_dir):
    out = op.resample_25_to_10(drone(spark, sf_dir), ["x", "y", "vx", "vy"], ["lane_id"], ["preceding_id"])
    return rounded(out, ["x", "y", "vx", "vy"], 8)


register("resample_25_to_10", "W2", resample_job, f"""{FR}, {DRONE},
h AS (SELECT track_id, frame_id * 2 AS h, x, y, vx, vy, CAST(lane_id AS DOUBLE) AS lane, CAST(preceding_id AS DOUBLE) AS prec FROM dr
      UNION ALL
      SELECT track_id, frame_id * 2 + 1, {', '.join(f'coalesce(({c} + lead({c}) OVER w) / 2, {c})' for c in ('x', 'y', 'vx', 'vy', 'lane_id', 'preceding_id'))}
      FROM dr WINDOW w AS (PARTITION BY track_id ORDER BY frame_id)),
f AS (SELECT track_id, h // 5 AS frame_id, x, y, vx, vy, lane, prec FROM h WHERE h % 5 = 0),
seen AS (SELECT track_id, preceding_id AS id, min(frame_id) AS first FROM dr GROUP BY ALL)
SELECT f.track_id, f.frame_id, {', '.join(r(c, c, 8) for c in ('x', 'y', 'vx', 'vy'))}, CAST(trunc(lane) AS INT) AS lane_id,
       (SELECT id FROM seen WHERE seen.track_id = f.track_id ORDER BY abs(f.prec - id), first LIMIT 1) AS preceding_id
FROM f""")

register("dense_ids", "W17", lambda s, d: op.dense_ids(
    fixture.table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "dense_id", 10),
    """SELECT o_orderkey, o_custkey, 9 + dense_rank() OVER (ORDER BY o_custkey) AS dense_id FROM orders""")
register("topn_per_group", "W18", lambda s, d: op.topn_per_group(
    fixture.table(s, d, "events").select("event_id", "event_type"), "event_type", "event_id", 100, {"view": 500}),
    """SELECT event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= CASE WHEN event_type = 'view' THEN 500 ELSE 100 END""")


def settle_job(spark, sf_dir):
    src = fixture.pairs(spark, sf_dir).where("v_sur > 2").select("event_id", "target_id", "k")
    return op.settle_slice(src)


register("settle_slice", "W9", settle_job, f"""{P},
s AS (SELECT event_id, target_id, k, row_number() OVER (PARTITION BY event_id, target_id ORDER BY k) - 1 AS i,
             count(*) OVER (PARTITION BY event_id, target_id) AS n FROM pairs WHERE v_sur > 2)
SELECT event_id, target_id, k FROM s WHERE n >= 35 AND i BETWEEN 15 AND 64""")
