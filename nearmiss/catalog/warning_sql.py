"""Check queries for the warning analytics: every frame is compared with every threshold."""

from __future__ import annotations

from collections.abc import Sequence

from nearmiss.catalog.fixture_sql import META, pairs as pairs_sql
from nearmiss.plans.scored import CONFLICTS

ANNOTATED = META + f""",
m AS (
  SELECT *, impact_timestamp - 1200 - 50 * (event_id % 9) AS reaction_timestamp,
         list_extract([{', '.join(f"'{c}'" for c in CONFLICTS)}], event_id % {len(CONFLICTS)} + 1) AS conflict,
         event_id % 11 <> 10 AS duration_enough,
         least(impact_timestamp - 4500, start_timestamp) AS danger_start,
         least(impact_timestamp + 500, end_timestamp) AS danger_end
  FROM meta),
el AS (SELECT * FROM m WHERE duration_enough AND conflict <> 'none')"""


def scores(kind: str, model: int = 0, name: str = "sc", label: str | None = None) -> str:
    value = ("CASE WHEN (k + 2 * target_id) % 61 = 0 THEN NULL WHEN (k + target_id) % 50 = 0 AND k < 200 THEN '{inf}'::DOUBLE "
             "ELSE {x} END")
    value = value.format(inf="inf", x="near") if kind == "small" else value.format(inf="-inf", x="round(60 / (near + 1), 4)")
    extra = f", '{label}' AS model" if label else ""
    return f"""
{name}0 AS (
  SELECT event_id, target_id, k, time, acc_ego,
         round((sqrt(power(x_sur - x_ego, 2) + power(y_sur - y_ego, 2)) + CAST(1.5 AS DOUBLE) * ((target_id * 7 + event_id + {model}) % 5))
               * CASE WHEN event_id % 6 = 0 AND k < 150 THEN CAST(0.1 AS DOUBLE) ELSE 1 END
               + CAST(0.05 AS DOUBLE) * ((k * 7 + target_id + {model}) % 23), 4) AS near FROM pairs),
{name} AS (SELECT event_id, target_id, k, time, acc_ego, {value} AS score{extra} FROM {name}0)"""


def targets(small: bool, sc: str = "sc", meta: str = "el") -> str:
    """ph: frames with phases; mean_by: mean per target; tg: accepted conflicting objects."""
    order, bad = ("ASC", "<=") if small else ("DESC", ">=")
    rep = "CASE WHEN score = 'inf'::DOUBLE THEN 1e6 WHEN score = '-inf'::DOUBLE THEN -1e6 ELSE score END"
    return f"""
ph AS (
  SELECT s.*, time >= danger_start / 1000 AND time <= danger_end / 1000 AS dg, time < danger_start / 1000 AS pre,
         time < start_timestamp / 1000 - 3 AS early, time <= impact_timestamp / 1000 AS upto
  FROM {sc} s JOIN {meta} USING (event_id)),
mean_by AS (SELECT event_id, target_id, avg(score) FILTER (dg) AS mean, count(*) FILTER (dg) AS n_danger, count(*) FILTER (pre) AS n_pre
            FROM ph GROUP BY ALL),
both_seen AS (SELECT event_id FROM ph GROUP BY 1 HAVING count(score) FILTER (dg) > 0 AND count(score) FILTER (pre) > 0),
chosen AS (SELECT * FROM mean_by SEMI JOIN both_seen USING (event_id) WHERE mean IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY mean {order}, target_id) = 1),
quart AS (
  SELECT event_id, target_id, n_danger, {', '.join(f"quantile_cont({rep}, {p}) FILTER ({f}) AS {n}_{t}"
    for t, f in (('pre_danger', 'pre'), ('danger', 'dg')) for n, p in (('q25', .25), ('q50', .5), ('q75', .75)))}
  FROM chosen JOIN ph USING (event_id, target_id) WHERE n_pre >= 1 GROUP BY ALL),
tg AS (SELECT * FROM quart WHERE NOT ({' OR '.join(f"coalesce({n}_pre_danger {bad} {n}_danger, false)" for n in ('q25', 'q50', 'q75'))}))"""


def records(small: bool, thresholds: Sequence[float], meta: str = "el", voted: bool = False, onset: bool = False) -> str:
    """rec: the records; needs ph and tg (event_id, target_id[, n_danger, quartiles])."""
    op = "<" if small else ">"
    ths = ", ".join(repr(float(t)) for t in thresholds)
    minimum = "" if voted else "WHERE n_danger >= 20"
    out = f"""
th AS (SELECT unnest([{ths}]::DOUBLE[]) AS threshold),
use AS (SELECT * FROM tg {minimum}),
hit AS (SELECT event_id, threshold, count(*) FILTER (dg AND coalesce(score {op} threshold, false)) AS hits, count(*) FILTER (dg) AS frames
        FROM ph JOIN use USING (event_id, target_id), th GROUP BY ALL),
per AS (
  SELECT ph.*, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_id, ph.target_id) AS n
  FROM ph JOIN use USING (event_id) WHERE ph.target_id <> use.target_id AND early
  WINDOW w AS (PARTITION BY event_id, ph.target_id ORDER BY k)),
slice AS (SELECT * FROM per WHERE n >= 35 AND i BETWEEN 15 AND 64),
calm AS (SELECT event_id, target_id FROM slice GROUP BY ALL HAVING min(acc_ego) > -1.5),
alarm AS (SELECT event_id, target_id, threshold, bool_or(coalesce(score {op} threshold, false)) AS a FROM slice SEMI JOIN calm USING (event_id, target_id), th GROUP BY ALL),
alarms AS (SELECT event_id, threshold, count(*) FILTER (a) AS alarms, count(*) AS safe FROM alarm GROUP BY ALL)"""
    extra, join = "", ""
    if onset:
        out += f""",
tr AS (SELECT event_id, threshold, k, time, upto, coalesce(score {op} threshold, false) AS f FROM ph JOIN use USING (event_id, target_id), th),
tl AS (SELECT *, lag(f) OVER (PARTITION BY event_id, threshold ORDER BY k) AS pf FROM tr WHERE upto),
ft AS (SELECT event_id, threshold, min(time) AS t0 FROM tr GROUP BY ALL),
ons AS (
  SELECT event_id, threshold, t0, bool_and(f) AS every, bool_or(f) AS anyf, max(time) FILTER (f AND NOT pf) AS rise, arg_min(f, k) AS f0
  FROM ft LEFT JOIN tl USING (event_id, threshold) GROUP BY ALL)"""
        extra = """, impact_timestamp / 1000 AS impact_time, reaction_timestamp / 1000 AS reaction_time,
  1000 * CASE WHEN t0 IS NULL THEN NULL WHEN coalesce(every, true) THEN t0 WHEN NOT anyf THEN NULL WHEN rise IS NOT NULL THEN rise WHEN f0 THEN t0 END AS warning_timestamp,
  hits / nullif(frames, 0) AS true_warning_period"""
        join = "LEFT JOIN ons USING (event_id, threshold)"
    quart = "" if voted else "," + ", ".join(f"{n}_{t}" for t in ("pre_danger", "danger") for n in ("q25", "q50", "q75"))
    out += f""",
rec AS (
  SELECT event_id, threshold, danger_start, danger_end, {'CASE WHEN hits IS NOT NULL THEN true END' if voted else 'hits IS NOT NULL'} AS danger_recorded,
         {'CASE WHEN hits IS NOT NULL THEN coalesce(safe > 0, false) END' if voted else 'coalesce(safe > 0, false)'} AS safety_recorded, use.target_id,
         CASE WHEN hits IS NOT NULL THEN CAST(hits > 5 AS INT) END AS true_warning,
         CASE WHEN safe > 0 THEN alarms END AS num_false_warning, CASE WHEN safe > 0 THEN safe - alarms END AS num_true_non_warning,
         CASE WHEN safe > 0 THEN CAST(alarms > 0 AS INT) END AS false_warning {quart} {extra}
  FROM {meta} CROSS JOIN th LEFT JOIN use USING (event_id) LEFT JOIN hit USING (event_id, threshold)
       LEFT JOIN alarms USING (event_id, threshold) {join})"""
    return out


def base(kind: str) -> str:
    return f"WITH {pairs_sql()}, {ANNOTATED}, {scores(kind)}"
