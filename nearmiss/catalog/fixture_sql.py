"""Common table expressions the check queries start from."""

FRAMES = """
ev AS (
  SELECT event_id, ts, event_type, value, user_id, user_id // 5 AS track_id,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS kk
  FROM events),
rows0 AS (
  SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY ts, event_id) - 1 AS k,
         least(value, CAST(40 AS DOUBLE)) AS v,
         CAST((kk - 50) * 0.06 AS DOUBLE) AS psi,
         CAST((kk - 50) * 0.0305 AS DOUBLE) AS acc
  FROM ev),
fr AS (
  SELECT track_id, k, event_type, value, kk, v, psi, acc,
         cos(psi) AS hx, sin(psi) AS hy, v * cos(psi) AS vx, v * sin(psi) AS vy,
         round(sum(v * cos(psi) * CAST(0.1 AS DOUBLE)) OVER w, 6) AS x,
         round(sum(v * sin(psi) * CAST(0.1 AS DOUBLE)) OVER w, 6) AS y
  FROM rows0
  WINDOW w AS (PARTITION BY track_id ORDER BY k ROWS UNBOUNDED PRECEDING))"""

META = """
meta AS (
  SELECT event_id, impact_timestamp,
         impact_timestamp - 2000 - 100 * (event_id % 7) AS start_timestamp,
         impact_timestamp + 1000 AS end_timestamp
  FROM (SELECT DISTINCT user_id // 5 AS event_id,
               CAST(25000 + 100 * ((user_id // 5) % 20) AS DOUBLE) AS impact_timestamp
        FROM events))"""

_LEN = ("CASE {0} WHEN 'view' THEN CAST(4.5 AS DOUBLE) WHEN 'click' THEN 6 WHEN 'signup' THEN 1.5 "
        "WHEN 'error' THEN 12 ELSE 2 END")
_WID = ("CASE {0} WHEN 'view' THEN CAST(1.75 AS DOUBLE) WHEN 'click' THEN 2 WHEN 'signup' THEN 0.5 "
        "WHEN 'error' THEN 2.55 ELSE 0.8 END")


def pairs(varied_dims: bool = False) -> str:
    le, we = (_LEN.format("e.event_type"), _WID.format("e.event_type")) if varied_dims else ("CAST(4.5 AS DOUBLE)", "CAST(1.75 AS DOUBLE)")
    ls, ws = (_LEN.format("s.event_type"), _WID.format("s.event_type")) if varied_dims else ("CAST(4.5 AS DOUBLE)", "CAST(1.75 AS DOUBLE)")
    return FRAMES + f""",
pairs0 AS (
  SELECT e.track_id AS event_id, e.track_id * 10 + j.j AS target_id, e.k, CAST(e.k AS DOUBLE) / 10 AS time,
         e.x AS x_ego, e.y AS y_ego, e.v AS v_ego, e.psi AS psi_ego, e.hx AS hx_ego, e.hy AS hy_ego, e.acc AS acc_ego,
         s.v AS v_sur, s.psi AS psi_sur, s.hx AS hx_sur, s.hy AS hy_sur,
         CAST(3 + 2 * j.j AS DOUBLE) + CAST(0.08 AS DOUBLE)
           * abs(e.k - CAST(25000 + 100 * (e.track_id % 20) AS DOUBLE) / 100) AS gap,
         e.psi + CAST(0.3 AS DOUBLE) * (j.j - 2) AS bearing,
         {le} AS length_ego, {we} AS width_ego, {ls} AS length_sur, {ws} AS width_sur
  FROM fr e, (VALUES (1), (2), (3)) j(j), fr s
  WHERE s.track_id = e.track_id + j.j AND s.k = e.k),
pairs AS (
  SELECT * EXCLUDE (gap, bearing), x_ego + gap * cos(bearing) AS x_sur, y_ego + gap * sin(bearing) AS y_sur,
         v_ego * hx_ego AS vx_ego, v_ego * hy_ego AS vy_ego, v_sur * hx_sur AS vx_sur, v_sur * hy_sur AS vy_sur
  FROM pairs0)"""


def clean(columns: list[str], digits: int = 6) -> str:
    """Output form of computed doubles: rounded, NULL for NaN and infinities, and a sign-of-infinity flag."""
    parts = []
    for c in columns:
        parts.append(f"CASE WHEN isfinite({c}) THEN round({c}, {digits}) + 0 END AS {c}")
        parts.append(f"CASE WHEN {c} = 'inf'::DOUBLE THEN 1 WHEN {c} = '-inf'::DOUBLE THEN -1 ELSE 0 END AS {c}_inf")
    return ", ".join(parts)

# reconnection of radar targets; needs ra (event_id, target_id, k, local_dx, local_dy)
EDGES = """
fst AS (SELECT event_id, target_id, count(*) AS n, min(k) AS k, arg_min(local_dx, k) AS dx, arg_min(local_dy, k) AS dy FROM ra GROUP BY ALL HAVING count(*) >= 2),
st AS (SELECT * FROM fst WHERE target_id > (SELECT min(target_id) FROM fst f WHERE f.event_id = fst.event_id)),
cd AS (SELECT st.event_id, st.target_id, ra.target_id AS parent, sqrt(power(ra.local_dx - dx, 2) + power(ra.local_dy - dy, 2)) AS d
       FROM st JOIN ra ON ra.event_id = st.event_id AND ra.k BETWEEN st.k - 2 AND st.k + 2 AND ra.target_id < st.target_id),
ed AS (SELECT event_id, target_id, arg_min(parent, struct_pack(d := d, p := parent)) AS parent FROM cd GROUP BY ALL HAVING min(d) <= 0.5)"""
ROOTS = """walk AS (SELECT event_id, target_id, parent FROM ed UNION ALL SELECT w.event_id, w.target_id, ed.parent FROM walk w JOIN ed ON ed.event_id = w.event_id AND ed.target_id = w.parent),
root AS (SELECT event_id, target_id, min(parent) AS root FROM walk GROUP BY 1, 2)"""
