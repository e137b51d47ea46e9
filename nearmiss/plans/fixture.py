"""The given event table mapped onto trajectories, events and ego-surrounding pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearmiss.operators.tracks import number_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 Hz frames per track: index k, speed, heading, acceleration and integrated position."""
    ev = table(spark, sf_dir, "events").select(
        "event_id", "ts", "event_type", "value",
        F.expr("user_id div 5").alias("track_id"),
        F.expr("CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)").alias("kk"),
    )
    ev = ev.selectExpr(
        "event_id AS _id", "ts AS _ts", "track_id", "event_type", "value", "kk",
        "least(value, 40.0D) AS v",
        "CAST((kk - 50) * 0.06 AS DOUBLE) AS psi",
        "CAST((kk - 50) * 0.0305 AS DOUBLE) AS acc",
    ).selectExpr("*", "cos(psi) AS hx", "sin(psi) AS hy")
    rows = number_rows(
        ev, ["track_id"], ["_ts", "_id"], F.to_date("_ts"), idx="k",
        sums={"x": F.expr("v * hx * 0.1D"), "y": F.expr("v * hy * 0.1D")})
    return rows.selectExpr(
        "track_id", "k", "event_type", "value", "kk", "v", "psi", "acc", "hx", "hy",
        "v * hx AS vx", "v * hy AS vy", "round(x, 6) AS x", "round(y, 6) AS y")


def event_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per track, impact and start times in ms."""
    tracks = table(spark, sf_dir, "events").select(
        F.expr("user_id div 5").alias("event_id")).distinct()
    return tracks.selectExpr(
        "event_id",
        "CAST(25000 + 100 * (event_id % 20) AS DOUBLE) AS impact_timestamp",
    ).selectExpr(
        "event_id", "impact_timestamp",
        "impact_timestamp - 2000D - 100D * (event_id % 7) AS start_timestamp",
        "impact_timestamp + 1000D AS end_timestamp",
    )


MOTION = ("x", "y", "v", "psi", "hx", "hy")


def pairs(spark: SparkSession, sf_dir: str, varied_dims: bool = False) -> DataFrame:
    """Ego track e with the tracks e+1, e+2, e+3 placed around it at the same k."""
    # each frame serves as ego of its own event and as surrounding object of the three before it;
    # meeting on (event, k) keeps the groups at four rows however long the tracks are
    roles = frames(spark, sf_dir).withColumn("j", F.explode(F.array(*[F.lit(n) for n in range(4)])))
    roles = roles.withColumn("event_id", F.expr("track_id - j"))
    ego = F.struct(*[F.col(c).alias(f"{c}_ego") for c in (*MOTION, "acc", "event_type")])
    both = roles.withColumn(
        "_ego", F.max(F.when(F.col("j") == 0, ego)).over(Window.partitionBy("event_id", "k"))
    ).where("j > 0 AND _ego IS NOT NULL").selectExpr(
        "event_id", "event_id * 10 + j AS target_id", "j", "k", "_ego.*",
        "v AS v_sur", "psi AS psi_sur", "hx AS hx_sur", "hy AS hy_sur", "event_type AS event_type_sur",
    ).selectExpr(
        "*",
        "CAST(3 + 2 * j AS DOUBLE) + 0.08D * abs(k - (25000D + 100D * (event_id % 20)) / 100D) AS gap",
        "psi_ego + 0.3D * (j - 2) AS bearing",
    )
    if varied_dims:
        length = ("CASE {0} WHEN 'view' THEN 4.5D WHEN 'click' THEN 6D WHEN 'signup' THEN 1.5D "
                  "WHEN 'error' THEN 12D ELSE 2D END")
        width = ("CASE {0} WHEN 'view' THEN 1.75D WHEN 'click' THEN 2D WHEN 'signup' THEN 0.5D "
                 "WHEN 'error' THEN 2.55D ELSE 0.8D END")
    else:
        length, width = "4.5D", "1.75D"
    return both.selectExpr(
        "event_id", "target_id", "k", "CAST(k AS DOUBLE) / 10D AS time",
        *[f"{c}_ego" for c in MOTION], "acc_ego",
        "x_ego + gap * cos(bearing) AS x_sur", "y_ego + gap * sin(bearing) AS y_sur",
        "v_sur", "psi_sur", "hx_sur", "hy_sur",
        f"{length.format('event_type_ego')} AS length_ego",
        f"{width.format('event_type_ego')} AS width_ego",
        f"{length.format('event_type_sur')} AS length_sur",
        f"{width.format('event_type_sur')} AS width_sur",
    )
