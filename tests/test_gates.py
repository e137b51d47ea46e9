"""Gates count reconnected targets on moments of the ego; voted events without scores stay unmarked."""

from pyspark.sql import functions as F

from nearmiss.operators import clean as cl
from nearmiss.operators import filters as fl
from nearmiss.operators import warnings as wn

SIGNALS = ("event_id long, timestamp long, speed_network double, gyro_z double, accel_x double, accel_y double, "
           "pedal_brake_state int, steering_wheel_position double, turn_signal int")
RADAR = ("event_id long, raw_id long, target_id long, timestamp long, time double, k long, local_dx double, local_dy double, "
         "delta_vx double, delta_vy double")


def telemetry(spark, events, n=40, missing_until=None, negative=()):
    missing_until = missing_until or {}
    rows = []
    for e in events:
        for k in range(n):
            speed = None if k < missing_until.get(e, 0) else -1.0 if e in negative else 36.0
            rows.append((e, k * 100, speed, 0.5, 0.1, 0.1, 0, 0.0, 0))
    return spark.createDataFrame(rows, SIGNALS)


def seen(event, target, moments, dy=10.0, dx=0.0):
    return [(event, target, target, k * 100, k / 10, k, dx, dy, 0.0, 0.0) for k in moments]


def radar(spark):
    rows = seen(1, 5, range(10, 18)) + seen(1, 6, range(18, 26), 10.2)       # one object under two ids
    rows += seen(2, 7, range(10, 18)) + seen(2, 8, range(18, 26), 15.0)      # two objects
    rows += seen(3, 9, range(0, 12)) + seen(3, 10, range(30, 39), 40.0)      # most rows before the ego's signals
    rows += seen(4, 11, range(0, 30))
    rows += seen(6, 12, range(31, 40))                                      # 9 rows, the last moment is no grid moment
    rows += seen(7, 13, range(10, 22)) + seen(7, 14, range(22, 34), 10.2) + seen(7, 15, range(34, 38), 10.4)
    return spark.createDataFrame(rows, RADAR)


def test_signal_gate_counts_reconnected_targets_on_ego_moments(spark):
    tel = telemetry(spark, (1, 2, 3, 4, 5, 6, 7), missing_until={3: 12}, negative=(4,))
    lengths = spark.createDataFrame([(e, 4.5) for e in (1, 2, 3, 4, 5, 6, 7, 8)], "event_id long, ego_length double")
    got = {r["event_id"]: (r["ego_reconstructed"], r["surrounding_reconstructed"], r["note"])
           for r in cl.signal_gate(tel, lengths, radar(spark)).collect()}
    assert got == {
        1: (1, 1, "Targets dict_keys([6]) are reconnected to dict_values([5])"),
        2: (1, 0, "no long enough surrounding trajectories"),
        3: (1, 0, "no long enough surrounding trajectories"),
        4: (0, 0, "all zero ego speed"),
        5: (1, 0, "no available surrounding trajectories"),
        6: (1, 0, "no long enough surrounding trajectories"),
        7: (1, 1, "Targets dict_keys([14, 15]) are reconnected to dict_values([13, 14])"),
        8: (0, 0, "file reading error"),
    }


def test_search_gate(spark):
    tel = telemetry(spark, (1, 2, 3, 4, 7), missing_until={3: 12}, negative=(4,))
    lengths = spark.createDataFrame([(e, 4.5) for e in (1, 2, 3, 4, 7)], "event_id long, ego_length double")
    # 3 misses over a fifth of its speeds, 4 stands, 1 and 2 have no object of 20 rows; 7 only as one object
    assert {r["event_id"]: r["longest"] for r in cl.nan_fraction_gate(tel, radar(spark), lengths).collect()} == {7: 28}
    gone = radar(spark).withColumn("delta_vx", F.when(F.col("k") % 3 > 0, F.col("delta_vx")))
    assert cl.nan_fraction_gate(tel, gone, lengths).isEmpty()


def test_search_gate_needs_a_known_edge_speed(spark):
    tel = telemetry(spark, (7,))
    bad = tel.withColumn("speed_network", F.expr("CASE WHEN timestamp IN (200, 3800) THEN NULL ELSE speed_network END"))
    lengths = spark.createDataFrame([(7, 4.5)], "event_id long, ego_length double")
    assert cl.nan_fraction_gate(tel, radar(spark), lengths).count() == 1
    assert cl.nan_fraction_gate(bad, radar(spark), lengths).isEmpty()


def test_reconnected_target_is_one_track_of_the_filter(spark):
    one = fl.long_enough(fl.reconnect_tracks(radar(spark).where("event_id = 1")))
    assert [(r["target_id"], r["n"]) for r in one.groupBy("target_id").agg(F.count("*").alias("n")).collect()] == [(5, 16)]


def test_voted_events_without_scores_stay_unmarked(spark):
    meta = wn.danger_window(spark.createDataFrame(
        [(e, 10000.0, 16000.0, 14000.0, 13000.0) for e in (1, 2)],
        "event_id long, start_timestamp double, end_timestamp double, impact_timestamp double, reaction_timestamp double"))
    scores = spark.createDataFrame([(1, 10, k, k / 10, 9.0, 0.0) for k in range(200)],
                                   "event_id long, target_id long, k long, time double, score double, acc_ego double")
    voted = spark.createDataFrame([(1, 10), (2, 20)], "event_id long, target_id long")
    got = {r["event_id"]: r for r in wn.warning_records(scores, meta, [3.0], False, targets=voted).collect()}
    assert got[1]["danger_recorded"] is True and got[1]["safety_recorded"] is False and got[1]["true_warning"] == 1
    assert [got[2][c] for c in ("danger_recorded", "safety_recorded", "target_id", "true_warning")] == [None] * 4
    filled = {r["event_id"]: r["danger_recorded"] for r in cl.fill_flags(spark.createDataFrame(list(got.values()), wn.warning_records(
        scores, meta, [3.0], False, targets=voted).schema)).collect()}
    assert filled == {1: True, 2: False}
