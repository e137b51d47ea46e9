"""Cleaning, annotation and source operators on derived telemetry and event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearmiss.catalog.fixture_sql import EDGES, FRAMES, ROOTS, pairs as pairs_sql
from nearmiss.catalog.registry import register
from nearmiss.functions import fixed_values as fv
from nearmiss.functions.numeric import with_exprs
from nearmiss.operators import clean as cl
from nearmiss.operators import frames as op
from nearmiss.plans import derived, fixture
from nearmiss.session import cut_lineage, scratch_path
from nearmiss.sources import statistics as st
from nearmiss.sources import telemetry as tl


def rounded(df, columns, digits=6):
    return with_exprs(df, {c: f"round({c}, {digits}) + 0D" for c in columns})


# --- telemetry -----------------------------------------------------------------------------------

TEL = f"""{FRAMES},
tel AS (
  SELECT track_id AS event_id, k, kk, k * 100 AS timestamp,
         CASE WHEN track_id % 13 = 5 OR (k < 3 AND track_id % 4 = 0) OR kk % 17 = 0 THEN NULL WHEN track_id % 13 = 7 THEN 0
              WHEN track_id % 13 = 9 AND (k < 8 OR kk > 1) THEN -1 ELSE v * 3.6::DOUBLE END AS speed,
         CASE WHEN track_id % 13 = 6 THEN NULL ELSE round(acc * 4, 4) END AS gyro,
         CASE WHEN track_id % 13 = 8 THEN NULL ELSE round(acc / 9.81::DOUBLE, 6) END AS ax,
         CASE WHEN kk % 19 = 0 THEN NULL ELSE round(psi / 30, 6) END AS ay, kk % 4 AS brake, kk % 3 AS turn_signal, psi * 10 AS steer, acc, psi FROM fr),
ego AS (SELECT event_id, k, timestamp, round(timestamp / 1000, 1) AS time, speed / 3.6::DOUBLE AS speed_comp, radians(-gyro) AS yaw_rate,
               ay * 9.81::DOUBLE AS acc_lat, ax * 9.81::DOUBLE AS acc_lon, brake, steer AS wheel_steering, turn_signal FROM tel),
radar AS (
  SELECT event_id, CAST(i + 8 * (k // 60) AS BIGINT) AS raw_id, timestamp, -(i - 2 + CAST(0.005 AS DOUBLE) * (k % 60)) AS local_dx,
         10 * i + CAST(0.02 AS DOUBLE) * k + CASE WHEN i = 3 THEN 5 * (k // 60) ELSE 0 END AS local_dy,
         -round(psi / 4, 6) AS delta_vx, round(acc / 2, 6) AS delta_vy, round(timestamp / 1000, 1) AS time, k
  FROM tel, (VALUES (1), (2), (3)) t(i) WHERE event_id % 13 <> 10 AND (kk + i) % 5 > 0)"""
EGO_NUM = ["speed_comp", "yaw_rate", "acc_lat", "acc_lon", "wheel_steering"]


def rs(columns, digits=6):
    return ", ".join(f"round({c}, {digits}) + 0 AS {c}" for c in columns)


register("ego_signals", "P1", lambda s, d: rounded(cl.ego_signals(derived.telemetry(s, d)), EGO_NUM),
         f"WITH {TEL} SELECT * REPLACE ({rs(EGO_NUM)}) FROM ego")
RADAR_NUM = ["local_dx", "local_dy", "delta_vx", "delta_vy"]
register("radar_to_rows", "P2 P3", lambda s, d: rounded(cl.radar_to_rows(derived.telemetry(s, d)), RADAR_NUM),
         f"WITH {TEL} SELECT * REPLACE ({rs(RADAR_NUM)}) FROM radar")
register("global_target_ids", "P2 W17", lambda s, d: cl.global_target_ids(
    cl.radar_to_rows(derived.telemetry(s, d)), 7).select("event_id", "raw_id", "target_id", "k"),
    f"WITH {TEL} SELECT event_id, raw_id, 6 + dense_rank() OVER (ORDER BY event_id, raw_id) AS target_id, k FROM radar")
register("trim_leading_incomplete", "P4", lambda s, d: cl.trim_leading_incomplete(
    cl.ego_signals(derived.telemetry(s, d))).select("event_id", "k"), f"""WITH {TEL},
f AS (SELECT event_id, min(k) AS k0 FROM ego WHERE speed_comp IS NOT NULL AND acc_lat IS NOT NULL AND acc_lon IS NOT NULL GROUP BY 1)
SELECT event_id, k FROM ego JOIN f USING (event_id) WHERE k >= k0""")

LENGTHS = """ids AS (SELECT DISTINCT user_id // 5 AS event_id FROM events),
lens AS (SELECT event_id, CASE WHEN event_id % 11 = 4 THEN NULL ELSE 4.5 END AS ego_length
         FROM (SELECT event_id FROM ids UNION ALL SELECT event_id + 1000000 FROM ids WHERE event_id % 7 = 0))"""


TARGETS = f"""ra AS (SELECT *, dense_rank() OVER (ORDER BY event_id, raw_id) - 1 AS target_id FROM radar), {EDGES}, {ROOTS},
rt AS (SELECT DISTINCT event_id, coalesce(root, target_id) AS target_id, k FROM ra LEFT JOIN root USING (event_id, target_id))"""


def targets(telemetry):
    return cut_lineage(cl.global_target_ids(cl.radar_to_rows(telemetry)), "radar")


def gate_job(spark, sf_dir):
    tel = cut_lineage(derived.telemetry(spark, sf_dir), "telemetry")
    return cl.signal_gate(tel, derived.ego_lengths(spark, sf_dir), targets(tel))


register("signal_gate", "P5 P7", gate_job, f"""WITH RECURSIVE {TEL}, {LENGTHS}, {TARGETS},
f AS (SELECT event_id, min(k) AS k0 FROM ego WHERE speed_comp IS NOT NULL AND acc_lat IS NOT NULL AND acc_lon IS NOT NULL GROUP BY 1),
tr AS (SELECT ego.* FROM ego JOIN f USING (event_id) WHERE k >= k0),
ends AS (SELECT event_id, min(k) AS a, max(k) AS b FROM tr GROUP BY 1),
g AS (SELECT event_id, unnest(range(a, b)) AS k FROM ends),
gs AS (SELECT g.event_id, g.k, arg_max(p.speed_comp, p.k) FILTER (p.k <= g.k) AS y0, max(p.k) FILTER (p.k <= g.k) AS x0,
              arg_min(p.speed_comp, p.k) FILTER (p.k > g.k) AS y1, min(p.k) FILTER (p.k > g.k) AS x1
       FROM g JOIN tr p ON p.event_id = g.event_id AND p.speed_comp IS NOT NULL GROUP BY ALL),
gi AS (SELECT event_id, k, CASE WHEN y0 IS NULL THEN y1 WHEN y1 IS NULL THEN y0 ELSE y0 + (y1 - y0) / (x1 - x0) * (k - x0) END AS sp,
              row_number() OVER (PARTITION BY event_id ORDER BY k) AS r1, row_number() OVER (PARTITION BY event_id ORDER BY k DESC) AS r2 FROM gs),
ev2 AS (SELECT event_id, bool_and(sp >= 0) FILTER (r1 <= 5) AS vs, bool_and(sp >= 0) FILTER (r2 <= 5) AS ve FROM gi GROUP BY 1),
sn AS (SELECT event_id, count(speed) AS ns, count(ax) AS nx, count(ay) AS ny, count(gyro) AS ng FROM tel GROUP BY 1),
mv AS (SELECT event_id, count(*) FILTER (NOT coalesce(speed_comp <= 1e-6, false)) AS nm FROM tr GROUP BY 1),
lg AS (SELECT event_id, max(n) AS longest FROM (SELECT event_id, target_id, count(*) AS n FROM rt JOIN ends USING (event_id) WHERE k >= a AND k < b GROUP BY ALL) GROUP BY 1),
rn AS (SELECT event_id, count(*) AS n_radar FROM radar GROUP BY 1),
rc AS (SELECT event_id, 'Targets dict_keys([' || string_agg(target_id, ', ' ORDER BY target_id) || ']) are reconnected to dict_values(['
              || string_agg(parent, ', ' ORDER BY target_id) || '])' AS reconnected FROM ed GROUP BY 1),
al AS (SELECT * FROM lens LEFT JOIN sn USING (event_id) LEFT JOIN mv USING (event_id) LEFT JOIN ev2 USING (event_id) LEFT JOIN lg USING (event_id)
       LEFT JOIN rn USING (event_id) LEFT JOIN rc USING (event_id)),
nt AS (SELECT event_id, reconnected, CASE WHEN ns IS NULL THEN 'file reading error' WHEN ns = 0 THEN 'all nan ego speed' WHEN nx = 0 OR ny = 0 THEN 'all nan acceleration'
  WHEN ng = 0 THEN 'all nan yaw rate' WHEN nm = 0 THEN 'all zero ego speed' WHEN NOT coalesce(vs OR ve, false) THEN 'start&end speed not available'
  WHEN n_radar IS NULL THEN 'no available surrounding trajectories' WHEN ego_length IS NULL THEN 'no ego width or length'
  WHEN coalesce(longest, 0) < 10 THEN 'no long enough surrounding trajectories' END AS note FROM al)
SELECT event_id, CAST(note IS NULL OR note LIKE 'no %' AS INT) AS ego_reconstructed, CAST(note IS NULL AS INT) AS surrounding_reconstructed,
  coalesce(note, reconnected) AS note FROM nt""")


def search_gate_job(spark, sf_dir):
    tel = cut_lineage(derived.telemetry(spark, sf_dir), "telemetry")
    return cl.nan_fraction_gate(tel, targets(tel), derived.ego_lengths(spark, sf_dir))


register("nan_fraction_gate", "P6 A4", search_gate_job, f"""WITH RECURSIVE {TEL}, {LENGTHS}, {TARGETS},
f AS (SELECT event_id, min(k) AS k0 FROM ego WHERE speed_comp IS NOT NULL AND acc_lat IS NOT NULL AND acc_lon IS NOT NULL GROUP BY 1),
tr AS (SELECT event_id, speed_comp, row_number() OVER (PARTITION BY event_id ORDER BY k) AS r1, row_number() OVER (PARTITION BY event_id ORDER BY k DESC) AS r2
       FROM ego JOIN f USING (event_id) WHERE k >= k0),
e AS (SELECT event_id FROM tel GROUP BY 1 HAVING avg((speed IS NULL)::INT) <= 0.2 AND avg((ax IS NULL)::INT) <= 0.2 AND avg((ay IS NULL)::INT) <= 0.2
      AND avg((gyro IS NULL)::INT) <= 0.2),
mo AS (SELECT event_id FROM tr GROUP BY 1 HAVING bool_or(coalesce(speed_comp > 1e-6, true))
       AND (bool_and(coalesce(speed_comp >= 0, false)) FILTER (r1 <= 5) OR bool_and(coalesce(speed_comp >= 0, false)) FILTER (r2 <= 5))),
l AS (SELECT event_id, max(n) AS longest FROM (SELECT event_id, target_id, count(*) AS n FROM rt GROUP BY ALL) GROUP BY 1)
SELECT event_id, longest FROM e JOIN mo USING (event_id) JOIN l USING (event_id) JOIN lens USING (event_id) WHERE ego_length IS NOT NULL AND longest >= 20""")

register("edge_speed_valid", "P7", lambda s, d: cl.edge_speed_valid(cl.ego_signals(derived.telemetry(s, d))), f"""WITH {TEL},
r AS (SELECT event_id, coalesce(speed_comp >= 0, false) AS ok, row_number() OVER (PARTITION BY event_id ORDER BY k) AS a, row_number() OVER (PARTITION BY event_id ORDER BY k DESC) AS b FROM ego)
SELECT event_id, bool_and(ok) FILTER (a <= 5) AS valid_start, bool_and(ok) FILTER (b <= 5) AS valid_end FROM r GROUP BY 1""")


def window_job(spark, sf_dir):
    ego = cl.ego_signals(derived.telemetry(spark, sf_dir)).select("event_id", "timestamp")
    marks = fixture.event_meta(spark, sf_dir).selectExpr(
        "event_id", "CAST(event_id * 100 AS STRING) AS eventStart",
        "CASE WHEN event_id % 5 = 0 THEN '(null)' ELSE CAST(event_id * 100 + 9000 AS STRING) END AS eventEnd")
    return cl.mark_event_window(ego, marks)


register("mark_event_window", "P8", window_job, f"""WITH {TEL}
SELECT event_id, timestamp, CASE WHEN event_id % 5 = 0 THEN 0 ELSE CAST(timestamp BETWEEN event_id * 100 AND event_id * 100 + 9000 AS INT) END AS event FROM ego""")

# --- event table ---------------------------------------------------------------------------------


def duck_pick(values, index):
    return f"list_extract([{derived.sql_list(values)}], ({index}) % {len(values)} + 1)"


_NATURES = [n for n in fv.CONFLICT_PARTNERS if n != "nan"] + [None]
_TYPES = list(fv.VEHICLE_SIZES) + [None]
EVT = f"""evt AS (
  SELECT o_orderkey AS event_id, {duck_pick(derived.SEVERITIES, 'o_orderkey')} AS eventSeverity1, {duck_pick(derived.SECOND, 'o_orderkey // 7')} AS eventSeverity2,
    {duck_pick(_NATURES, 'o_orderkey')} AS eventNature1, {duck_pick(_NATURES, 'o_orderkey // 3')} AS eventNature2,
    {duck_pick(_TYPES, 'o_orderkey // 2')} AS motorist2Type, {duck_pick(_TYPES, 'o_orderkey * 5 + 3')} AS motorist3Type, {duck_pick(_TYPES, 'o_custkey')} AS classification,
    CASE WHEN o_orderkey % 9 = 0 THEN '(null)' WHEN o_orderkey % 9 = 1 THEN '-1' ELSE CAST(o_orderkey % 500 * 100 AS VARCHAR) END AS eventStart,
    CASE WHEN o_orderkey % 10 = 0 THEN '(null)' WHEN o_orderkey % 10 = 1 THEN '-99' ELSE CAST(o_orderkey % 500 * 100 + 5000 AS VARCHAR) END AS eventEnd,
    CAST(o_orderkey % 500 * 100 + 2500 AS VARCHAR) AS impactProximity,
    {duck_pick((*fv.LIGHT_ORDER, 'Unknown', None), 'o_orderkey')} AS lighting, {duck_pick((*fv.WEATHER_ORDER, 'Unknown'), 'o_orderkey // 5')} AS weather,
    {duck_pick((*fv.SURFACE_ORDER, 'Other', None), 'o_custkey')} AS surfaceCondition, {duck_pick((*fv.TRAFFIC_ORDER, None), 'o_orderkey // 11')} AS trafficDensity,
    o_orderkey % 8 <> 0 AS reconstructed_flag, o_orderkey % 3 = 0 AS test_flag, o_totalprice
  FROM orders)"""
CAT = "CASE WHEN eventSeverity1 IN ('Balanced-Sample Baseline', 'Additional Baseline') THEN 'SafeBaseline' " + " ".join(
    f"WHEN eventSeverity1 = '{a}' AND eventSeverity2 = '{b}' THEN '{n}'" for (a, b), n in fv.EVENT_CATEGORIES.items()) + " END"


def _partner(col):
    return f"CASE coalesce({col}, 'nan') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.CONFLICT_PARTNERS.items()) + " END"


ANN = f"""{EVT}, ann AS (SELECT *, {CAT} AS event_category, {_partner('eventNature1')} AS first, {_partner('eventNature2')} AS second FROM evt)"""


def annotated(spark, sf_dir):
    return derived.event_table(spark, sf_dir).withColumns({
        "event_category": cl.event_category(), "first": cl.conflict_partner("eventNature1"), "second": cl.conflict_partner("eventNature2")})


register("event_category", "P10 P11", lambda s, d: annotated(s, d).select("event_id", "event_category", "first", "second"),
         f"WITH {ANN} SELECT event_id, event_category, first, second FROM ann")
MARKS = {"eventStart": "start_timestamp", "eventEnd": "end_timestamp"}
register("clean_timestamps", "P9", lambda s, d: cl.clean_timestamps(derived.event_table(s, d), MARKS).select("event_id", *MARKS.values()),
         f"WITH {EVT} SELECT event_id, " + ", ".join(f"CASE WHEN {a} NOT IN ('(null)', '-99', '-1') THEN CAST({a} AS DOUBLE) END AS {b}" for a, b in MARKS.items()) + " FROM evt")
SIZES = "sizes(vtype, w, l) AS (VALUES " + ", ".join(
    f"('{k}', {'NULL' if w is None else f'{w}::DOUBLE'}, {'NULL' if le is None else f'{le}::DOUBLE'})" for k, (w, le) in fv.VEHICLE_SIZES.items()) + ")"
DIMS = ["ego_width", "ego_length", "target_width", "target_length", "other_width", "other_length"]
NV = ", ".join(f"'{x}'" for x in fv.NON_VEHICLES)
DIM_SQL = f"""{ANN}, {SIZES},
d0 AS (SELECT ann.*, e.w AS ego_width, e.l AS ego_length, t.w AS tw, t.l AS tl, o.w AS ow, o.l AS ol FROM ann LEFT JOIN sizes e ON e.vtype = classification
       LEFT JOIN sizes t ON t.vtype = motorist2Type LEFT JOIN sizes o ON o.vtype = motorist3Type),
d1 AS (SELECT *, coalesce(event_category IN ('SecondaryNearCrash', 'SecondaryCrash'), false) AS sec FROM d0),
d2 AS (SELECT *, sec <> (sec AND (coalesce(first IN ({NV}) AND ow > 1, false) OR coalesce(second IN ({NV}) AND tw > 1, false))) AS swapped FROM d1),
dims AS (SELECT *, CASE WHEN swapped THEN ow ELSE tw END AS target_width, CASE WHEN swapped THEN ol ELSE tl END AS target_length,
                CASE WHEN swapped THEN tw ELSE ow END AS other_width, CASE WHEN swapped THEN tl ELSE ol END AS other_length FROM d2)"""
ROLES = {"ego": "classification", "target": "motorist2Type", "other": "motorist3Type"}
register("vehicle_dims", "P12 J4", lambda s, d: cl.vehicle_dims(annotated(s, d), ROLES).select("event_id", *DIMS),
         f"WITH {DIM_SQL} SELECT event_id, {', '.join(DIMS)} FROM dims")
register("impute_dims", "P13", lambda s, d: rounded(cl.impute_dims(cl.vehicle_dims(annotated(s, d), ROLES).select("event_id", *DIMS)), DIMS[:4]), f"""WITH {DIM_SQL},
mn AS (SELECT avg(ego_width) AS mw, avg(ego_length) AS ml FROM dims)
SELECT event_id, other_width, other_length, round(coalesce(ego_width, mw), 6) AS ego_width, round(coalesce(ego_length, ml), 6) AS ego_length,
  round(coalesce(CASE WHEN target_width IS NULL OR target_length IS NULL THEN other_width ELSE target_width END, mw), 6) AS target_width,
  round(coalesce(CASE WHEN target_width IS NULL OR target_length IS NULL THEN other_length ELSE target_length END, ml), 6) AS target_length FROM dims, mn""")
register("scenario_dims", "P14", lambda s, d: cl.scenario_dims(fixture.table(s, d, "events").selectExpr(
    "event_id", "CAST(event_id % 12 AS INT) AS veh_type_sur")), """SELECT event_id, CAST(event_id % 12 AS INT) AS veh_type_sur,
  CASE event_id % 12 WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 2.0 WHEN 3 THEN 1.5 WHEN 4 THEN 11.95 ELSE 4.5 END AS length_sur,
  CASE event_id % 12 WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.8 WHEN 3 THEN 0.5 WHEN 4 THEN 2.55 ELSE 1.75 END AS width_sur,
  4.5::DOUBLE AS length_ego, 1.75::DOUBLE AS width_ego FROM events""")
SEV = """sev0 AS (SELECT *, CASE WHEN event_category = 'Crash' THEN 3 WHEN event_category = 'NearCrash' THEN 2 WHEN event_category LIKE 'Secondary%' THEN 0
    WHEN event_category LIKE '%-%' THEN CASE split_part(event_category, '-', 1) WHEN 'Crash' THEN 3 WHEN 'NearCrash' THEN 2 ELSE 1 END END AS s1,
  CASE WHEN event_category IN ('Crash', 'NearCrash') THEN 0 WHEN event_category = 'SecondaryCrash' THEN 3 WHEN event_category = 'SecondaryNearCrash' THEN 2
    WHEN event_category LIKE '%-%' THEN CASE split_part(event_category, '-', 2) WHEN 'Crash' THEN 3 WHEN 'NearCrash' THEN 2 ELSE 1 END END AS s2 FROM ann),
sev AS (SELECT * EXCLUDE (s1, s2), CASE WHEN {a} first IN ('following', 'obstacle', 'single') THEN 0 ELSE s1 END AS severity_first,
               CASE WHEN {a} second IN ('following', 'obstacle', 'single') THEN 0 ELSE s2 END AS severity_second FROM sev0),
con AS (SELECT *, CASE WHEN event_category = 'SafeBaseline' OR (severity_first = 0 AND severity_second = 0) THEN 'none' WHEN severity_second > severity_first THEN second ELSE first END AS conflict FROM sev)"""
for _n, _ignore in (("severity_conflict", True), ("severity_conflict_report", False)):
    register(_n, "P19", lambda s, d, i=_ignore: cl.severity_conflict(annotated(s, d), i).select("event_id", "severity_first", "severity_second", "conflict"),
             f"WITH {ANN}, {SEV.format(a='' if _ignore else 'false AND')} SELECT event_id, severity_first, severity_second, conflict FROM con")


def eligible_job(spark, sf_dir):
    meta = cl.severity_conflict(annotated(spark, sf_dir)).withColumns({
        "ego_reconstructed": F.col("reconstructed_flag").cast("int"), "surrounding_reconstructed": F.lit(1), "duration_enough": F.col("test_flag")})
    meta = cl.clean_timestamps(meta, {**MARKS, "impactProximity": "impact_timestamp"})
    return cl.eligible_events(meta).select("event_id", "conflict")


register("eligible_events", "P20", eligible_job, f"""WITH {ANN}, {SEV.format(a='')}
SELECT event_id, conflict FROM con WHERE event_category <> 'SafeBaseline' AND reconstructed_flag AND test_flag AND conflict <> 'none'
  AND eventStart NOT IN ('(null)', '-99', '-1') AND eventEnd NOT IN ('(null)', '-99', '-1')""")
ENV = ("lighting", "weather", "surfaceCondition", "trafficDensity")
register("environment_clean", "P24", lambda s, d: cl.environment_clean(derived.event_table(s, d), ENV).select("event_id", *ENV), f"""WITH {EVT}
SELECT event_id, coalesce(lighting, 'Unknown') AS lighting, weather, CASE WHEN surfaceCondition = 'Other' THEN 'Unknown' ELSE coalesce(surfaceCondition, 'Unknown') END AS surfaceCondition,
  coalesce(trafficDensity, 'Unknown') AS trafficDensity FROM evt""")
register("track_length_gate", "A4", lambda s, d: cl.track_length_gate(
    fixture.pairs(s, d).where("v_sur > target_id % 40"), 250).select("event_id", "longest", "duration_enough"), f"""WITH {pairs_sql()}
SELECT event_id, max(n) AS longest, max(n) >= 250 AS duration_enough FROM (SELECT event_id, target_id, count(*) AS n FROM pairs WHERE v_sur > target_id % 40 GROUP BY ALL) GROUP BY 1""")
register("fill_flags", "P23", lambda s, d: cl.fill_flags(fixture.table(s, d, "events").selectExpr(
    "event_id", "CASE WHEN event_id % 3 > 0 THEN event_id % 2 = 0 END AS danger_recorded", "CASE WHEN event_id % 5 > 0 THEN true END AS safety_recorded")),
    """SELECT event_id, coalesce(CASE WHEN event_id % 3 > 0 THEN event_id % 2 = 0 END, false) AS danger_recorded, event_id % 5 > 0 AS safety_recorded FROM events""")

# Model names of the report
MODELS = ("SafeBaseline_current", "SafeBaseline_current+acc_environment_profiles", "highD_current", "SafeBaseline_ArgoverseHV_current_mixed0.1",
          "SafeBaseline_ArgoverseHV_current_mixed0.5", "SafeBaseline_highD_current_mixed1.0", "SafeBaseline_highD_current_mixed0.4",
          "SafeBaseline_current_environment", "SafeBaseline_UCD_current")


def named(spark, sf_dir):
    return fixture.table(spark, sf_dir, "events").selectExpr("event_id", f"{derived.pick(MODELS, 'event_id')} AS model")


register("parse_model_name", "P22", lambda s, d: cl.parse_model_name(named(s, d)), f"""
SELECT event_id, model, split_part(model, '_current', 1) AS dataset,
  CASE WHEN contains(model, 'acc') THEN 'current+acc' || split_part(model, 'current+acc', 2) ELSE 'current' || split_part(model, 'current', 2) END AS encoder,
  CASE WHEN contains(model, '_mixed') THEN CAST(split_part(model, '_mixed', 2) AS DOUBLE) ELSE 0 END AS mixrate
FROM (SELECT event_id, {duck_pick(MODELS, 'event_id')} AS model FROM events)""")
register("voting_models", "P22 R5", lambda s, d: cl.voting_models(named(s, d)), f"""
SELECT event_id, model FROM (SELECT event_id, {duck_pick(MODELS, 'event_id')} AS model FROM events)
WHERE model NOT LIKE '%UCD%' AND NOT (model LIKE '%mixed%' AND model LIKE '%ArgoverseHV%' AND model NOT LIKE '%0.1%')
  AND NOT (model LIKE '%mixed%' AND model NOT LIKE '%ArgoverseHV%' AND model LIKE '%highD%' AND model NOT LIKE '%1.0%')""")


def sample_job(spark, sf_dir):
    feats = op.current_features(fixture.pairs(spark, sf_dir)).select("event_id", "target_id", "k", "s")
    wanted = fixture.event_meta(spark, sf_dir).selectExpr("event_id", "event_id * 10 + 1 + event_id % 3 AS target_id")
    return rounded(cl.event_sample(feats, wanted), ["s"])


register("event_sample", "P26 J11", sample_job, f"""WITH {pairs_sql()} SELECT event_id, target_id, k, round(sqrt(power(x_sur - x_ego, 2) + power(y_sur - y_ego, 2)), 6) AS s
FROM pairs WHERE target_id = event_id * 10 + 1 + event_id % 3""")
register("restrict_to_scored", "J6", lambda s, d: cl.restrict_to_scored(
    fixture.pairs(s, d).select("event_id", "target_id", "k"), fixture.pairs(s, d).where("v_sur > 20")),
    f"WITH {pairs_sql()} SELECT event_id, target_id, k FROM pairs WHERE v_sur > 20")

# --- drone recordings and scenarios --------------------------------------------------------------


def recordings(spark, sf_dir):
    return fixture.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "c_nationkey AS locationId", "CAST(c_custkey * 7 % 1300 AS INT) AS numCars", "CAST(c_custkey % 90 AS INT) AS numTrucks",
        "25D AS frameRate", "round(abs(c_acctbal), 2) AS duration", "substring('21.00;24.96;28.80;32.60', 1, CAST(5 + c_custkey % 19 AS INT)) AS lowerLaneMarkings")


REC = """rec AS (SELECT c_custkey AS id, c_nationkey AS locationId, CAST(c_custkey * 7 % 1300 AS INT) AS numCars, CAST(c_custkey % 90 AS INT) AS numTrucks,
  25::DOUBLE AS frameRate, round(abs(c_acctbal), 2) AS duration, substring('21.00;24.96;28.80;32.60', 1, CAST(5 + c_custkey % 19 AS INT)) AS lowerLaneMarkings FROM customer),
rm AS (SELECT *, length(lowerLaneMarkings) // 5 AS lane_num, CAST(floor(frameRate * duration) AS BIGINT) AS numFrames FROM rec)"""
register("recording_meta", "P15", lambda s, d: cl.recording_meta(recordings(s, d)), f"""WITH {REC}
SELECT *, CAST(power(10, length(CAST((SELECT max(numCars) FROM rm) AS VARCHAR))) AS BIGINT) AS trackid_base,
  CAST(power(10, length(CAST((SELECT max(numFrames) FROM rm) AS VARCHAR))) AS BIGINT) AS frameid_base FROM rm""")
register("location_totals", "A28", lambda s, d: cl.location_totals(recordings(s, d)),
         f"WITH {REC} SELECT locationId, sum(numCars)::BIGINT AS numCars, sum(numTrucks)::BIGINT AS numTrucks FROM rec GROUP BY 1")
register("rebase_ids", "P16", lambda s, d: cl.rebase_ids(fixture.table(s, d, "lineitem").selectExpr(
    "l_linenumber AS file_id", "10000 AS trackid_base", "100000 AS frameid_base", "l_partkey AS track_id", "l_suppkey % 3 AS preceding_id", "l_orderkey % 2 AS following_id", "l_orderkey AS frame_id")),
    """SELECT l_linenumber AS file_id, 10000 AS trackid_base, 100000 AS frameid_base, CASE WHEN l_partkey > 0 THEN l_linenumber * 10000 + l_partkey ELSE l_partkey END AS track_id,
  CASE WHEN l_suppkey % 3 > 0 THEN l_linenumber * 10000 + l_suppkey % 3 ELSE 0 END AS preceding_id, CASE WHEN l_orderkey % 2 > 0 THEN l_linenumber * 10000 + l_orderkey % 2 ELSE 0 END AS following_id,
  l_linenumber * 100000 + l_orderkey AS frame_id FROM lineitem""")


def centre_job(spark, sf_dir):
    src = fixture.frames(spark, sf_dir).selectExpr("track_id", "k", "x", "y", "4.5D AS width", "1.75D AS height")
    boxed = cl.bbox_centre(src).selectExpr("track_id", "k", "x AS x_ego", "y AS y_ego", "length", "width")
    return rounded(cl.swap_axes(boxed), ["x_ego", "y_ego"])


register("bbox_centre_swap_axes", "P17", centre_job, f"""WITH {FRAMES} SELECT track_id, k, round(y + 0.875, 6) + 0 AS x_ego, round(x + 2.25, 6) + 0 AS y_ego, 4.5::DOUBLE AS length, 1.75::DOUBLE AS width FROM fr""")


def polar_job(spark, sf_dir):
    src = fixture.frames(spark, sf_dir).selectExpr("track_id", "k", "psi", "vx", "vy", "acc AS ax", "v / 10D AS ay")
    return rounded(cl.polar_kinematics(src).select("track_id", "k", "hx", "hy", "v", "acc"), ["hx", "hy", "v", "acc"])


register("polar_kinematics", "P18", polar_job, f"""WITH {FRAMES} SELECT track_id, k, round(cos(psi), 6) + 0 AS hx, round(sin(psi), 6) + 0 AS hy, round(sqrt(vx * vx + vy * vy), 6) AS v,
  round(acc * cos(psi) + v / 10 * sin(psi), 6) + 0 AS acc FROM fr""")


def scenarios(spark, sf_dir):
    """One scenario per order of up to seven lines: object i holds 2 + i moments of its line."""
    lines = fixture.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS scenario", "l_linenumber AS line", "l_partkey", "l_suppkey", "CAST(l_quantity AS DOUBLE) AS q")
    # repeated line numbers are told apart by part, supplier and quantity; the row order is fixed by them
    packed = lines.groupBy("scenario").agg(F.sort_array(F.collect_list(F.struct("line", "l_partkey", "l_suppkey", "q"))).alias("o"))
    moment = "transform(sequence(0, i + 1), t -> CAST(t + i % 2 AS DOUBLE) / 10D)"
    motion = "transform(sequence(0, i + 1), t -> array(e.q + t, e.q - t, e.q / 10D, 1D, 0.5D, 0.25D, 0.1D * i))"
    return packed.selectExpr(
        "scenario", "transform(sequence(0, size(o)), i -> CAST(i * (i + 3) div 2 AS INT)) AS index",
        f"flatten(transform(o, (e, i) -> {moment})) AS timestep", f"flatten(transform(o, (e, i) -> {motion})) AS motion",
        "transform(o, (e, i) -> CAST(e.line % 4 AS INT)) AS category")


SCN = """li AS (SELECT l_orderkey AS scenario, l_linenumber AS line, l_quantity::DOUBLE AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i FROM lineitem),
ob AS (SELECT scenario, CAST(i AS INT) AS object_id, CAST(line % 4 AS INT) AS veh_type, CAST(t + i % 2 AS DOUBLE) / 10 AS time, q + t AS x, q - t AS y, q / 10 AS vx, 1::DOUBLE AS vy, 0.5::DOUBLE AS ax, 0.25::DOUBLE AS ay, 0.1::DOUBLE * i AS psi
       FROM li, LATERAL (SELECT unnest(range(i + 2)) AS t))"""
MOVE = ["x", "y", "vx", "vy", "ax", "ay", "psi"]
register("unnest_ragged", "S6", lambda s, d: rounded(tl.unnest_ragged(scenarios(s, d)), MOVE), f"WITH {SCN} SELECT * REPLACE ({rs(MOVE)}) FROM ob")
register("scenario_pairs", "S6 J2 W17", lambda s, d: tl.scenario_pairs(tl.unnest_ragged(cut_lineage(scenarios(s, d), "scenarios"))).selectExpr(
    "scenario", "target_id", "time", "round(x_ego, 6) AS x_ego", "round(x_sur, 6) AS x_sur", "veh_type_sur"), f"""WITH {SCN},
b AS (SELECT s.scenario, s.object_id, s.time, e.x AS xe, s.x AS xs, s.veh_type FROM ob e JOIN ob s USING (scenario, time) WHERE e.object_id = 0 AND s.object_id > 0)
SELECT scenario, dense_rank() OVER (ORDER BY scenario, object_id) - 1 AS target_id, time, round(xe, 6) AS x_ego, round(xs, 6) AS x_sur, veh_type AS veh_type_sur FROM b""")

# --- files, registries ---------------------------------------------------------------------------


def files(spark, sf_dir):
    i = "event_id"
    return fixture.table(spark, sf_dir, "events").selectExpr(
        f"{i} AS seq", f"CASE {i} % 6 WHEN 0 THEN concat('Event_ID_', {i} % 400, '.csv') WHEN 1 THEN concat('Clip_Index_', {i} % 400, '_Front.mp4') "
        f"WHEN 2 THEN concat('Clip_ID_', {i} % 400, '_Rear.avi') WHEN 3 THEN concat('Clip_ID_', {i} % 400, '_Hands.mp4') "
        f"WHEN 4 THEN concat('Fast_Event_ID_', {i} % 400, '.csv') ELSE concat('Again_', {i} % 7, '_', {i} % 400, '.csv') END AS name")


register("file_manifest", "S7", lambda s, d: tl.file_manifest(files(s, d)), """WITH f AS (
SELECT event_id AS seq, event_id % 400 AS id, event_id % 6 AS m, CASE event_id % 6 WHEN 0 THEN 'Event_ID_' || (event_id % 400) || '.csv' WHEN 1 THEN 'Clip_Index_' || (event_id % 400) || '_Front.mp4'
  WHEN 2 THEN 'Clip_ID_' || (event_id % 400) || '_Rear.avi' WHEN 3 THEN 'Clip_ID_' || (event_id % 400) || '_Hands.mp4' WHEN 5 THEN 'Again_' || (event_id % 7) || '_' || (event_id % 400) || '.csv' END AS name FROM events)
SELECT id AS event_id, arg_max(name, seq) FILTER (m IN (0, 5)) AS time_series, arg_max(name, seq) FILTER (m = 1) AS video_front, arg_max(name, seq) FILTER (m = 2) AS video_rear,
  arg_max(name, seq) FILTER (m = 3) AS video_hands FROM f WHERE m <> 4 GROUP BY 1""")


def upsert_job(spark, sf_dir):
    o = fixture.table(spark, sf_dir, "orders").selectExpr(
        "o_orderpriority AS dataset", "CAST(o_custkey AS STRING) AS encoder_selection", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 10 AS DOUBLE) / 10D END AS mixrate", "o_orderkey", "o_totalprice")
    keys = ["dataset", "encoder_selection", "mixrate"]
    pick = lambda cond: o.where(cond).groupBy(*keys).agg(F.max_by("o_totalprice", "o_orderkey").alias("val_loss"))
    return tl.upsert_registry(pick("o_orderkey % 4 <> 0"), pick("o_orderkey % 4 = 0"), keys)


register("upsert_registry", "S8 M13", upsert_job, """WITH o AS (SELECT o_orderpriority AS dataset, CAST(o_custkey AS VARCHAR) AS encoder_selection, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 10 AS DOUBLE) / 10 END AS mixrate, o_orderkey, o_totalprice FROM orders),
a AS (SELECT dataset, encoder_selection, mixrate, arg_max(o_totalprice, o_orderkey) AS val_loss FROM o WHERE o_orderkey % 4 <> 0 GROUP BY ALL),
b AS (SELECT dataset, encoder_selection, mixrate, arg_max(o_totalprice, o_orderkey) AS val_loss FROM o WHERE o_orderkey % 4 = 0 GROUP BY ALL)
SELECT * FROM b UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.dataset = a.dataset AND b.encoder_selection = a.encoder_selection AND b.mixrate IS NOT DISTINCT FROM a.mixrate)""")
register("resume_anti_join", "S9 J11", lambda s, d: tl.resume_anti_join(
    fixture.table(s, d, "lineitem").selectExpr("l_orderkey AS event_id", "l_partkey AS target_id").distinct(),
    fixture.table(s, d, "lineitem").where("l_quantity > 25").selectExpr("l_orderkey AS event_id", "l_partkey AS target_id"), ["event_id", "target_id"]),
    """SELECT DISTINCT l_orderkey AS event_id, l_partkey AS target_id FROM lineitem EXCEPT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 25""")


def merge_job(spark, sf_dir):
    ids = fixture.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"))
    return tl.merge_sources(ids.where("event_id % 3 > 0").selectExpr("event_id", "concat('a_', event_id, '.csv') AS time_series"),
                            ids.where("event_id % 4 > 0").selectExpr("event_id", "concat('b_', event_id, '.csv') AS time_series"), "A/", "B/")


register("merge_sources", "J1", merge_job, """SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 3 > 0 THEN 'a_' || o_orderkey || '.csv' END AS time_series_a, CASE WHEN o_orderkey % 4 > 0 THEN 'b_' || o_orderkey || '.csv' END AS time_series_b,
  CASE WHEN o_orderkey % 4 > 0 THEN 'B/' ELSE 'A/' END AS file_dir, CASE WHEN o_orderkey % 4 > 0 THEN 'b_' || o_orderkey || '.csv' ELSE 'a_' || o_orderkey || '.csv' END AS file2use
FROM orders WHERE o_orderkey % 3 > 0 OR o_orderkey % 4 > 0""")

# --- file round trips ----------------------------------------------------------------------------


def stats_csv_job(spark, sf_dir):
    """Yearly totals written with thousands separators and a byte-order mark, then read back."""
    path = scratch_path(spark, "stats")
    wide = derived.yearly(spark, sf_dir).groupBy("kind").pivot("year", list(range(1995, 2002))).agg(F.sum("n") * 12345)
    bom = "﻿"
    text = wide.select(F.col("kind").alias(f"{bom}Light condition"), *[F.format_number(str(y), 0).alias(str(y)) for y in range(1995, 2002)])
    text.write.option("header", True).csv(path)
    back = st.read_stats_csv(spark, path, ("Light condition",))
    return back.withColumnRenamed("Light condition", "kind").withColumnsRenamed({str(y): f"y{y}" for y in range(1995, 2002)})


register("read_stats_csv", "S1", stats_csv_job, "SELECT o_orderpriority AS kind, " + ", ".join(
    f"CAST(nullif(count(*) FILTER (year(o_orderdate) = {y}), 0) * 12345 AS DOUBLE) AS y{y}" for y in range(1995, 2002)) + " FROM orders GROUP BY 1")


def glob_job(spark, sf_dir):
    path = scratch_path(spark, "glob")
    fixture.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal").write.partitionBy("c_nationkey").option("header", True).csv(path)
    return st.read_glob_union(spark, f"{path}/c_nationkey=1*/*.csv", "c_custkey LONG, c_acctbal DOUBLE").select("c_custkey", "c_acctbal")


register("read_glob_union", "S3", glob_job, "SELECT c_custkey, c_acctbal FROM customer WHERE CAST(c_nationkey AS VARCHAR) LIKE '1%'")


def category_job(spark, sf_dir):
    path = scratch_path(spark, "categories")
    tl.write_partitioned(fixture.table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "event_category"), path)
    return tl.read_category_tables(spark, path, ["1-URGENT", "5-LOW"]).select("o_orderkey", "event_category", "o_totalprice")


register("category_tables", "S4", category_job, "SELECT o_orderkey, o_orderpriority AS event_category, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")


def bundle_job(spark, sf_dir):
    path = scratch_path(spark, "bundle")
    scenes = op.every_frame_scenes(fixture.pairs(spark, sf_dir))
    tl.write_feature_bundle(tl.feature_bundle(scenes, op.CURRENT), path)
    return tl.read_feature_bundle(spark, path).selectExpr(
        "event_id", "target_id", "k", "CAST(size(profiles) AS BIGINT) AS history", "CAST(size(current) AS BIGINT) AS width", "round(spacing, 6) AS spacing", "round(current[6], 5) AS v_ego2")


register("feature_bundle", "S5", bundle_job, f"""WITH {pairs_sql()}, n AS (SELECT *, row_number() OVER (PARTITION BY event_id, target_id ORDER BY k) - 1 AS idx FROM pairs)
SELECT event_id, target_id, k, 25::BIGINT AS history, 13::BIGINT AS width, round(sqrt(power(x_sur - x_ego, 2) + power(y_sur - y_ego, 2)), 6) AS spacing, round(v_ego * v_ego, 5) AS v_ego2 FROM n WHERE idx >= 26""")


def telemetry_job(spark, sf_dir):
    """Event files of all 48 fields under a header line with some broken lines, read back with the broken lines set aside."""
    path = scratch_path(spark, "telemetry")
    tel = derived.telemetry(spark, sf_dir)
    fields = [f.split()[0] for f in tl.TELEMETRY_SCHEMA.split(", ")]
    text = F.concat(
        F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]),
        F.when(F.col("timestamp") % 4700 == 0, ",1,2,3").otherwise(""))
    head = tel.select("event_id").distinct().withColumns({"timestamp": F.lit(-1).cast("long"), "value": F.lit(",".join(fields))})
    lines = head.unionByName(tel.select("event_id", "timestamp", text.alias("value")))
    # in the order the files are written in, so that rows are sorted once; tasks put their own files in place
    lines = lines.repartition("event_id").withColumn("file", F.concat(F.lit("event_"), F.col("event_id"))).sortWithinPartitions("file", "timestamp")
    lines.select("file", "value").write.partitionBy("file").options(**{
        "compression": "gzip", "mapreduce.fileoutputcommitter.algorithm.version": "2"}).text(path)
    good, bad, unread = tl.read_telemetry(spark, path, id_pattern=r"file=event_(\d+)/")
    part = lambda df, name: df.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("rows"), *[F.lit(None).cast("double").alias(f"sum_{c}") for c in SUMMED]).withColumn("part", F.lit(name))
    sums = good.groupBy("event_id").agg(F.count(F.lit(1)).alias("rows"), *[
        F.round(F.sum(F.col(c).cast("double")), 4).alias(f"sum_{c}") for c in SUMMED]).withColumn("part", F.lit("good"))
    return rounded(sums.unionByName(part(bad, "malformed")).unionByName(part(unread, "unread")), [f"sum_{c}" for c in SUMMED], 4)


SUMMED = [f.split()[0] for f in tl.TELEMETRY_SCHEMA.split(", ")]
SLOT_SQL = ", ".join(
    f"CASE WHEN u{i} THEN {i} + 8 * (k // 60) ELSE 0 END AS TRACK{i}_TARGET_ID, CASE WHEN s{i} THEN {10 * i} + CAST(0.02 AS DOUBLE) * k + {'5 * (k // 60)' if i == 3 else '0'} END "
    f"AS TRACK{i}_X_POS_PROCESSED, CASE WHEN s{i} THEN {i - 2} + CAST(0.005 AS DOUBLE) * (k % 60) END AS TRACK{i}_Y_POS_PROCESSED, "
    f"CASE WHEN s{i} THEN round(acc / 2, 6) END AS TRACK{i}_X_VEL_PROCESSED, CASE WHEN s{i} THEN round(psi / 4, 6) END AS TRACK{i}_Y_VEL_PROCESSED"
    for i in range(1, 9))
USED_SQL = ", ".join(f"{i <= 3} AND event_id % 13 <> 10 AND (kk + {i}) % 5 > 0 AS u{i}, {i <= 3} AS s{i}" for i in range(1, 9))
register("read_telemetry", "S2", telemetry_job, f"""WITH {TEL},
us AS (SELECT *, {USED_SQL} FROM tel),
al AS (SELECT event_id, timestamp, speed AS speed_network, gyro AS gyro_z, ax AS accel_x, ay AS accel_y, brake AS pedal_brake_state, turn_signal,
              steer AS steering_wheel_position, {SLOT_SQL} FROM us)
SELECT event_id, count(*) AS rows, CASE WHEN timestamp % 4700 = 0 THEN 'malformed' ELSE 'good' END AS part,
  {', '.join(f"round(sum(CAST({c} AS DOUBLE)) FILTER (timestamp % 4700 <> 0), 4) + 0 AS sum_{c}" for c in SUMMED)} FROM al GROUP BY 1, 3""")


def chunk_job(spark, sf_dir):
    """Line items as frames of their orders: what each category and chunk of the files holds."""
    path = scratch_path(spark, "chunks")
    frames = fixture.table(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS event_category", "l_orderkey AS event_id", "l_extendedprice")
    tl.write_chunks(frames, path)
    back = tl.read_category_tables(spark, path).groupBy("event_category", F.col("chunk").cast("long").alias("chunk"))
    return back.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("event_id").alias("events"), F.min("event_id").alias("first_event"),
                    F.max("event_id").alias("last_event"), F.sum(F.expr("CAST(round(l_extendedprice * 100) AS BIGINT)")).alias("cents"))


register("category_chunks", "S4", chunk_job, f"""WITH e AS (
  SELECT l_returnflag, l_orderkey, (row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey) - 1) // {tl.EVENTS_PER_CHUNK} AS chunk
  FROM (SELECT DISTINCT l_returnflag, l_orderkey FROM lineitem))
SELECT l_returnflag AS event_category, CAST(chunk AS BIGINT) AS chunk, count(*) AS rows, count(DISTINCT l_orderkey) AS events, min(l_orderkey) AS first_event,
  max(l_orderkey) AS last_event, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem JOIN e USING (l_returnflag, l_orderkey) GROUP BY ALL""")
