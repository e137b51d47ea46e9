"""Telemetry, event tables, drone recordings, statistics and attributions derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmiss.functions import fixed_values as fv
from nearmiss.functions.numeric import with_exprs
from nearmiss.plans import fixture
from nearmiss.plans.fixture import table


def sql_list(values) -> str:
    return ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)


def pick(values, index: str) -> str:
    """Element of a constant list, chosen by a row's number."""
    return f"element_at(array({sql_list(values)}), CAST(pmod({index}, {len(values)}) + 1 AS INT))"


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide telemetry per track: some signals missing, some events without speed, three radar slots in use."""
    fr = fixture.frames(spark, sf_dir).selectExpr("track_id AS event_id", "k", "kk", "v", "psi", "acc")
    fr = with_exprs(fr, {
        "timestamp": "k * 100",
        "speed_network": "CASE WHEN event_id % 13 = 5 OR (k < 3 AND event_id % 4 = 0) OR kk % 17 = 0 THEN NULL "
                         "WHEN event_id % 13 = 7 THEN 0D WHEN event_id % 13 = 9 AND (k < 8 OR kk > 1) THEN -1D ELSE v * 3.6D END",
        "gyro_z": "CASE WHEN event_id % 13 = 6 THEN NULL ELSE round(acc * 4D, 4) END",
        "accel_x": "CASE WHEN event_id % 13 = 8 THEN NULL ELSE round(acc / 9.81D, 6) END",
        "accel_y": "CASE WHEN kk % 19 = 0 THEN NULL ELSE round(psi / 30D, 6) END",
        "pedal_brake_state": "kk % 4", "turn_signal": "kk % 3", "steering_wheel_position": "psi * 10D"})
    out = {}
    for i in range(1, 9):
        used = i <= 3 and "event_id % 13 <> 10"
        jump = "5D * (k div 60)" if i == 3 else "0D"
        hole = f"(kk + {i}) % 5 > 0"
        out[f"TRACK{i}_TARGET_ID"] = f"CASE WHEN {used} AND {hole} THEN CAST({i} + 8 * (k div 60) AS INT) ELSE 0 END" if used else "0"
        out[f"TRACK{i}_X_POS_PROCESSED"] = f"{10 * i}D + 0.02D * k + {jump}" if used else "CAST(NULL AS DOUBLE)"
        out[f"TRACK{i}_Y_POS_PROCESSED"] = f"{i - 2}D + 0.005D * (k % 60)" if used else "CAST(NULL AS DOUBLE)"
        out[f"TRACK{i}_X_VEL_PROCESSED"] = "round(acc / 2D, 6)" if used else "CAST(NULL AS DOUBLE)"
        out[f"TRACK{i}_Y_VEL_PROCESSED"] = "round(psi / 4D, 6)" if used else "CAST(NULL AS DOUBLE)"
    return with_exprs(fr, out).drop("k", "kk", "v", "psi", "acc")


def ego_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every track and a few events without telemetry; some lengths unknown."""
    ids = fixture.event_meta(spark, sf_dir).select("event_id")
    missing = ids.where("event_id % 7 = 0").select((F.col("event_id") + 1000000).alias("event_id"))
    return ids.unionByName(missing).withColumn(
        "ego_length", F.expr("CASE WHEN event_id % 11 = 4 THEN NULL ELSE 4.5D END"))


SEVERITIES = ("Crash", "Near-Crash", "Non-Subject Conflict", "Crash-Relevant", "Balanced-Sample Baseline", "Additional Baseline")
SECOND = ("Not Applicable", "Near-Crash", "Crash", "Crash-Relevant", "Non-Subject Conflict")


def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order table read as annotated events: one event per order."""
    natures = [n for n in fv.CONFLICT_PARTNERS if n != "nan"] + [None]
    types = list(fv.VEHICLE_SIZES) + [None]
    i = "o_orderkey"
    return table(spark, sf_dir, "orders").selectExpr(
        f"{i} AS event_id", f"{pick(SEVERITIES, i)} AS eventSeverity1", f"{pick(SECOND, f'{i} div 7')} AS eventSeverity2",
        f"{pick(natures, i)} AS eventNature1", f"{pick(natures, f'{i} div 3')} AS eventNature2",
        f"{pick(types, f'{i} div 2')} AS motorist2Type", f"{pick(types, f'{i} * 5 + 3')} AS motorist3Type",
        f"{pick(types, f'o_custkey')} AS classification",
        f"CASE WHEN {i} % 9 = 0 THEN '(null)' WHEN {i} % 9 = 1 THEN '-1' ELSE CAST({i} % 500 * 100 AS STRING) END AS eventStart",
        f"CASE WHEN {i} % 10 = 0 THEN '(null)' WHEN {i} % 10 = 1 THEN '-99' ELSE CAST({i} % 500 * 100 + 5000 AS STRING) END AS eventEnd",
        f"CAST({i} % 500 * 100 + 2500 AS STRING) AS impactProximity",
        f"{pick((*fv.LIGHT_ORDER, 'Unknown', None), i)} AS lighting", f"{pick((*fv.WEATHER_ORDER, 'Unknown'), f'{i} div 5')} AS weather",
        f"{pick((*fv.SURFACE_ORDER, 'Other', None), f'o_custkey')} AS surfaceCondition",
        f"{pick((*fv.TRAFFIC_ORDER, None), f'{i} div 11')} AS trafficDensity",
        f"{i} % 8 <> 0 AS reconstructed_flag", f"{i} % 3 = 0 AS test_flag", "o_totalprice")


FACTORS = ("speed", "width", "heading", "spacing", "weather")


def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fixture.pairs(spark, sf_dir)
    return pairs.selectExpr(
        "event_id", "target_id", "k", "time", "round(60D / (1D + abs(x_sur - x_ego)), 4) AS intensity",
        "round(hx_ego, 4) AS eg_speed", "round(hy_ego - 0.2D, 4) AS eg_width", "round(hx_sur, 4) AS eg_heading",
        "round(hy_sur + 0.1D, 4) AS eg_spacing", "round(hx_ego * hy_sur, 4) AS eg_weather")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warning records at one threshold, half of the events warned."""
    from nearmiss.operators.warnings import danger_window
    return danger_window(fixture.event_meta(spark, sf_dir)).selectExpr(
        "event_id", "danger_start", "danger_end", "CAST(event_id % 2 AS INT) AS true_warning",
        "event_id % 3 AS num_true_non_warning")


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per year, priority and status, as accident counts."""
    return table(spark, sf_dir, "orders").groupBy(
        F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("place")
    ).agg(F.count(F.lit(1)).alias("n"))
