"""Geometry and risk indicators. The checks use corner-by-edge relations instead of closed forms."""

from __future__ import annotations

from nearmiss.catalog.fixture_sql import clean, pairs as pairs_sql
from nearmiss.catalog.registry import register
from nearmiss.functions.numeric import clean_output
from nearmiss.operators import indicators as ind
from nearmiss.plans import fixture

DIGITS = {"PSD": 9}

CORNERS = """
ci AS (
  SELECT event_id, target_id, k, c, x_ego + sl * length_ego / 2 * hx_ego - sw * width_ego / 2 * hy_ego AS px,
         y_ego + sl * length_ego / 2 * hy_ego + sw * width_ego / 2 * hx_ego AS py
  FROM pairs, (VALUES (1, 1, 1), (2, 1, -1), (3, -1, 1), (4, -1, -1)) t(c, sl, sw)),
cj AS (
  SELECT event_id, target_id, k, c, x_sur + sl * length_sur / 2 * hx_sur - sw * width_sur / 2 * hy_sur AS px,
         y_sur + sl * length_sur / 2 * hy_sur + sw * width_sur / 2 * hx_sur AS py
  FROM pairs, (VALUES (1, 1, 1), (2, 1, -1), (3, -1, 1), (4, -1, -1)) t(c, sl, sw)),
outline(a, b, o) AS (VALUES (1, 2, 0), (4, 3, 1), (3, 1, 2), (2, 4, 3)),
ei AS (
  SELECT s.event_id, s.target_id, s.k, o, s.px AS sx, s.py AS sy, e.px - s.px AS ex, e.py - s.py AS ey
  FROM outline JOIN ci s ON s.c = a JOIN ci e ON e.c = b
       AND e.event_id = s.event_id AND e.target_id = s.target_id AND e.k = s.k),
ej AS (
  SELECT s.event_id, s.target_id, s.k, o, s.px AS sx, s.py AS sy, e.px - s.px AS ex, e.py - s.py AS ey
  FROM outline JOIN cj s ON s.c = a JOIN cj e ON e.c = b
       AND e.event_id = s.event_id AND e.target_id = s.target_id AND e.k = s.k)"""


def _hits(corner: str, edge: str, sign: int, name: str) -> str:
    return f"""
{name}0 AS (
  SELECT event_id, target_id, k, rvx, rvy, sqrt(rvx * rvx + rvy * rvy) AS rv, sqrt(ex * ex + ey * ey) AS len,
         rvx * ey - rvy * ex AS d,
         (sx - px) * ey - (sy - py) * ex AS tn, (sx - px) * rvy - (sy - py) * rvx AS sn
  FROM {corner} JOIN {edge} USING (event_id, target_id, k)
       JOIN (SELECT event_id, target_id, k, {sign} * (vx_ego - vx_sur) AS rvx, {sign} * (vy_ego - vy_sur) AS rvy
             FROM pairs) USING (event_id, target_id, k)),
{name} AS (
  SELECT event_id, target_id, k, count(*) FILTER (hit AND tn / d >= 0) AS ahead,
         count(*) FILTER (hit AND tn / d < 0) AS behind, min(abs(tn / d) * rv) FILTER (hit) AS dtc
  FROM (SELECT *, abs(d) >= 1e-9 * len AND sn / nullif(d, 0) * len BETWEEN -1e-9 AND len + 1e-9 AS hit FROM {name}0)
  GROUP BY ALL)"""


HITS = _hits("ci", "ej", 1, "hf") + "," + _hits("cj", "ei", -1, "hr")
BOTH = """
both_ways AS (
  SELECT p.*, sqrt(power(vx_ego - vx_sur, 2) + power(vy_ego - vy_sur, 2)) AS dv,
         hf.ahead AS fa, hf.behind AS fb, hf.dtc AS fd, hr.ahead AS ra, hr.behind AS rb, hr.dtc AS rd
  FROM pairs p JOIN hf USING (event_id, target_id, k) JOIN hr USING (event_id, target_id, k))"""
INF = "'inf'::DOUBLE"
TTC = (f"least(CASE WHEN fa = 0 THEN {INF} WHEN fb > 0 THEN -1 ELSE fd / dv END, "
       f"CASE WHEN ra = 0 THEN {INF} WHEN rb > 0 THEN -1 ELSE rd / dv END)")

DISTANCE = """
feet AS (
  SELECT event_id, target_id, k, min(sqrt(power(sx + t * ex - px, 2) + power(sy + t * ey - py, 2))) AS d
  FROM (SELECT *, ((px - sx) * ex + (py - sy) * ey) / (ex * ex + ey * ey) AS t, sqrt(ex * ex + ey * ey) AS len
        FROM ci JOIN ej USING (event_id, target_id, k))
  WHERE t * len BETWEEN -1e-9 AND len + 1e-9 GROUP BY ALL),
cc AS (
  SELECT event_id, target_id, k, min(sqrt(power(ci.px - cj.px, 2) + power(ci.py - cj.py, 2))) AS d
  FROM ci JOIN cj USING (event_id, target_id, k) GROUP BY ALL),
crossing AS (
  SELECT event_id, target_id, k, bool_or(abs(d) > 1e-12 AND tn / nullif(d, 0) BETWEEN -1e-9 AND 1 + 1e-9
                                         AND sn / nullif(d, 0) BETWEEN -1e-9 AND 1 + 1e-9) AS x
  FROM (SELECT event_id, target_id, k, a.ex * b.ey - a.ey * b.ex AS d,
               (b.sx - a.sx) * b.ey - (b.sy - a.sy) * b.ex AS tn, (b.sx - a.sx) * a.ey - (b.sy - a.sy) * a.ex AS sn
        FROM ei a JOIN ej b USING (event_id, target_id, k)) GROUP BY ALL),
dist AS (
  SELECT event_id, target_id, k, CASE WHEN x THEN 0 ELSE least(feet.d, cc.d) END AS gap
  FROM cc JOIN crossing USING (event_id, target_id, k) LEFT JOIN feet USING (event_id, target_id, k))"""


def _floor(x: str) -> str:
    return (f"CASE WHEN {x} > -1e-9 AND {x} < 1e-6 THEN 1e-6 "
            f"WHEN {x} < 0 AND {x} > -1e-6 THEN -1e-6 ELSE {x} END")


def _final(name: str, expr: str, source: str) -> str:
    return (f"SELECT event_id, target_id, k, {clean([name], DIGITS.get(name, 4))} "
            f"FROM (SELECT event_id, target_id, k, {expr} AS {name} FROM {source})")


P = "WITH " + pairs_sql(varied_dims=True)
CHECKS = {
    "TTC": f"{P}, {CORNERS}, {HITS}, {BOTH} {_final('TTC', TTC, 'both_ways')}",
    "DRAC": f"{P}, {CORNERS}, {HITS}, {BOTH} " + _final("DRAC", f"""greatest(
        CASE WHEN fa = 0 THEN 0 WHEN fb > 0 OR fd = 0 THEN {INF} ELSE dv * dv / fd / 2 END,
        CASE WHEN ra = 0 THEN 0 WHEN rb > 0 OR rd = 0 THEN {INF} ELSE dv * dv / rd / 2 END)""", "both_ways"),
    "PSD": f"{P}, {CORNERS}, {HITS}, {BOTH} " + _final("PSD", f"""
        CASE WHEN fa = 0 THEN 10 WHEN fb > 0 THEN -1 WHEN v_ego = 0 THEN {INF}
             ELSE fd / (v_ego * v_ego / 2 / 5.5) END""", "both_ways"),
    "MTTC": f"""{P}, {CORNERS}, {HITS}, {BOTH},
m0 AS (SELECT *, {TTC} AS ttc, least(fd, rd) AS dtc, CASE WHEN fa > 0 OR ra > 0 THEN dv ELSE -dv END AS cv,
              CASE WHEN acc_ego > 0 AND acc_ego < 1e-6 THEN 1e-6 WHEN acc_ego < 0 AND acc_ego > -1e-6 THEN -1e-6
                   ELSE acc_ego END AS da FROM both_ways),
m1 AS (SELECT *, CASE WHEN cv * cv + 2 * da * dtc >= 0 THEN sqrt(cv * cv + 2 * da * dtc) END AS rt FROM m0),
m2 AS (SELECT *, (-cv - rt) / nullif(da, 0) AS lo, (-cv + rt) / nullif(da, 0) AS hi FROM m1)
""" + _final("MTTC", f"""CASE WHEN (fa > 0 AND fb > 0) OR (ra > 0 AND rb > 0) THEN -1 WHEN da = 0 THEN ttc
        WHEN dtc IS NULL OR lo IS NULL THEN {INF} WHEN lo > 0 THEN lo WHEN hi > 0 THEN hi ELSE {INF} END""", "m2"),
    "CurrentD": f"{P}, {CORNERS}, {DISTANCE} {_final('CurrentD', 'gap', 'dist')}",
    "TAdv": f"""{P}, {CORNERS}, {DISTANCE},
t0 AS (SELECT p.*, gap, hx_ego * (x_sur - x_ego) + hy_ego * (y_sur - y_ego) AS ahead,
              hx_ego * vx_sur + hy_ego * vy_sur AS along,
              sqrt(vx_ego * vx_ego + vy_ego * vy_ego) AS si, sqrt(vx_sur * vx_sur + vy_sur * vy_sur) AS sj,
              atan2(vx_ego * vy_sur - vx_sur * vy_ego, vx_ego * vx_sur + vy_ego * vy_sur) AS turn
       FROM pairs p JOIN dist USING (event_id, target_id, k)),
t1 AS (SELECT *, CASE WHEN along < 0 THEN si + sj WHEN ahead < 0 THEN sj - si ELSE si - sj END AS rel,
              abs(turn) < pi() / 60 OR abs(turn) > pi() * 59 / 60 OR vx_ego * vy_sur = vy_ego * vx_sur AS par FROM t0),
t2 AS (SELECT *, gap / ({_floor('rel')}) AS lin FROM t1),
cross16 AS (
  SELECT t2.event_id, t2.target_id, t2.k, t2.si, t2.sj, t2.vx_ego, t2.vy_ego, t2.vx_sur, t2.vy_sur,
         ci.px AS ix, ci.py AS iy, cj.px AS jx, cj.py AS jy,
         ((cj.px - ci.px) * vy_sur - (cj.py - ci.py) * vx_sur) / (vx_ego * vy_sur - vy_ego * vx_sur) AS a
  FROM t2 JOIN ci USING (event_id, target_id, k) JOIN cj USING (event_id, target_id, k) WHERE NOT par),
meet AS (SELECT *, ix + a * vx_ego AS mx, iy + a * vy_ego AS my FROM cross16),
adv AS (
  SELECT event_id, target_id, k, min(abs(sqrt(power(mx - ix, 2) + power(my - iy, 2)) / si
                                       - sqrt(power(mx - jx, 2) + power(my - jy, 2)) / sj)) AS d
  FROM meet WHERE (mx - ix) * vx_ego + (my - iy) * vy_ego >= 0 AND (mx - jx) * vx_sur + (my - jy) * vy_sur >= 0
  GROUP BY ALL)
""" + _final("TAdv", f"CASE WHEN par THEN (CASE WHEN lin < 0 THEN {INF} ELSE lin END) ELSE coalesce(d, {INF}) END",
             "t2 LEFT JOIN adv USING (event_id, target_id, k)"),
    "TTC2D": f"""{P},
u0 AS (SELECT *, hx_ego * (x_sur - x_ego) + hy_ego * (y_sur - y_ego) < 0 AS back,
              x_ego + length_ego / 2 * hx_ego AS fxi, y_ego + length_ego / 2 * hy_ego AS fyi,
              x_sur + length_sur / 2 * hx_sur AS fxj, y_sur + length_sur / 2 * hy_sur AS fyj FROM pairs),
u1 AS (
  SELECT event_id, target_id, k, hx_ego AS hx, hy_ego AS hy, fxj - fxi AS dx, fyj - fyi AS dy, length_sur AS ll,
         (width_ego + width_sur) / 2 AS w, vx_ego - vx_sur AS rx, vy_ego - vy_sur AS ry FROM u0 WHERE NOT back
  UNION ALL
  SELECT event_id, target_id, k, hx_sur, hy_sur, fxi - fxj, fyi - fyj, length_ego,
         (width_ego + width_sur) / 2, vx_sur - vx_ego, vy_sur - vy_ego FROM u0 WHERE back),
u2 AS (SELECT event_id, target_id, k, ll, w, hy * dx - hx * dy AS slat, hx * dx + hy * dy AS slon,
              hy * rx - hx * ry AS vlat, hx * rx + hy * ry AS vlon FROM u1),
u3 AS (SELECT *, CASE WHEN slon > ll AND vlon > 1e-9 THEN (slon - ll) / greatest(vlon, 1e-6) END AS tlon,
              CASE WHEN slat > w AND vlat > 1e-9 THEN (slat - w) / greatest(vlat, 1e-6) END AS tlat FROM u2)
""" + _final("TTC2D", f"""least(CASE WHEN slat - vlat * tlon < w THEN tlon ELSE {INF} END,
                            CASE WHEN slon - vlon * tlat < ll THEN tlat ELSE {INF} END)""", "u3"),
    "ACT": f"""{P}, {CORNERS},
cand0 AS (
  SELECT event_id, target_id, k, 1 AS owner, px, py, sx, sy, ex, ey FROM ci JOIN ej USING (event_id, target_id, k)
  UNION ALL
  SELECT event_id, target_id, k, -1, px, py, sx, sy, ex, ey FROM cj JOIN ei USING (event_id, target_id, k)),
cand AS (
  SELECT *, sx + least(greatest(t, 0), 1) * ex - px AS gx, sy + least(greatest(t, 0), 1) * ey - py AS gy
  FROM (SELECT *, ((px - sx) * ex + (py - sy) * ey) / (ex * ex + ey * ey) AS t FROM cand0)),
best AS (
  SELECT event_id, target_id, k, arg_min(struct_pack(owner := owner, gx := gx, gy := gy), sqrt(gx * gx + gy * gy)) AS b
  FROM cand GROUP BY ALL),
a0 AS (
  SELECT event_id, target_id, k, sqrt(b.gx * b.gx + b.gy * b.gy) AS d,
         b.owner * ((vx_ego - vx_sur) * b.gx + (vy_ego - vy_sur) * b.gy) / nullif(sqrt(b.gx * b.gx + b.gy * b.gy), 0) AS c
  FROM best JOIN pairs USING (event_id, target_id, k)),
a1 AS (SELECT *, d / ({_floor('c')}) AS r FROM a0)
""" + _final("ACT", f"CASE WHEN d < 1e-9 THEN NULL WHEN r < 0 THEN {INF} ELSE r END", "a1"),
    "EI": f"""{P},
e0 AS (SELECT *, x_sur - x_ego AS dx, y_sur - y_ego AS dy, cos(psi_ego) AS ca, sin(psi_ego) AS sa,
              cos(psi_sur) AS cb, sin(psi_sur) AS sb FROM pairs),
e1 AS (SELECT *, v_sur * cb - v_ego * ca AS rx, v_sur * sb - v_ego * sa AS ry, sin(psi_sur - psi_ego) AS sd,
              ca * cb + sa * sb AS cd, psi_sur - psi_ego AS dh FROM e0),
e2 AS (SELECT *, round(-(dx * rx + dy * ry) / sqrt(dx * dx + dy * dy), 2) AS closing,
              rx / nullif(sqrt(rx * rx + ry * ry), 0) AS tx, ry / nullif(sqrt(rx * rx + ry * ry), 0) AS ty,
              width_ego / sqrt(1 - least(cd * cd, 1)) AS dac, width_sur / sqrt(1 - least(cd * cd, 1)) AS dbc,
              (dx * sb - dy * cb) / sd AS pa FROM e1),
corner4(s1, s2) AS (VALUES (-1, 1), (1, 1), (-1, -1), (1, -1)),
reach AS (
  SELECT event_id, target_id, k,
         bool_or(ca * (x_ego + pa * ca + s1 * dbc / 2 * ca + s2 * dac / 2 * cb - x_ego + length_ego / 2 * ca)
               + sa * (y_ego + pa * sa + s1 * dbc / 2 * sa + s2 * dac / 2 * sb - y_ego + length_ego / 2 * sa) > 0) AS ra,
         bool_or(cb * (x_ego + pa * ca + s1 * dbc / 2 * ca + s2 * dac / 2 * cb - x_sur + length_sur / 2 * cb)
               + sb * (y_ego + pa * sa + s1 * dbc / 2 * sa + s2 * dac / 2 * sb - y_sur + length_sur / 2 * sb) > 0) AS rb
  FROM e2, corner4 WHERE abs(sd) >= 1e-9 GROUP BY ALL),
half AS (
  SELECT event_id, target_id, k,
         max(abs((s1 * length_ego / 2 * ca - s2 * width_ego / 2 * sa) * ty - (s1 * length_ego / 2 * sa + s2 * width_ego / 2 * ca) * tx)) AS da,
         max(abs((s1 * length_sur / 2 * cb - s2 * width_sur / 2 * sb) * ty - (s1 * length_sur / 2 * sb + s2 * width_sur / 2 * cb) * tx)) AS db
  FROM e2, corner4 GROUP BY ALL),
e3 AS (
  SELECT e2.*, coalesce(ra AND rb, false) AS meet, da, db,
         (abs(dh) <= 0.01396 OR abs(dh + pi()) <= 0.01396 OR abs(dh - pi()) <= 0.01396 OR abs(abs(dh) - pi()) <= 0.01396)
         AND (dx * ca + dy * sa >= 0 OR -dx * cb - dy * sb >= 0 OR abs(dx * ca - dy * sa) <= (length_ego + length_sur) / 2)
         AND abs(dx * sa - dy * ca) <= (width_ego + width_sur) / 2 AS lane
  FROM e2 LEFT JOIN reach USING (event_id, target_id, k) JOIN half USING (event_id, target_id, k))
""" + _final("EI", """CASE WHEN closing > 0 AND (meet OR lane)
        THEN -(abs(dx * ty - dy * tx) - da - db) / (-(dx * tx + dy * ty) / sqrt(rx * rx + ry * ry))
        ELSE '-inf'::DOUBLE END""", "e3"),
}

COVERS = {"TTC": "G1 G5 G6 G8 G9", "DRAC": "G10", "MTTC": "G11", "PSD": "G12", "CurrentD": "G7",
          "TAdv": "G13", "TTC2D": "G14", "ACT": "G15", "EI": "G16"}


def _job(name):
    def run(spark, sf_dir):
        scored = ind.INDICATORS[name](fixture.pairs(spark, sf_dir, varied_dims=True))
        return clean_output(scored.select("event_id", "target_id", "k", name), [name], DIGITS.get(name, 4))
    return run


for _name, _check in CHECKS.items():
    register(f"indicator_{_name.lower()}", COVERS[_name], _job(_name), _check)
