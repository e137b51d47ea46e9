"""Score tables, event annotations and votes derived from the given event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmiss.operators.warnings import danger_window
from nearmiss.plans import fixture

MODELS_LARGE = ("intensity_a", "intensity_b")
# Conflict kinds dealt out to the events in turn
CONFLICTS = ("leading", "adjacent_lane", "merging", "turning_into_parallel", "pedestrian", "none",
             "intersection_crossing", "oncoming")


def annotated_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ", ".join(f"'{c}'" for c in CONFLICTS)
    meta = fixture.event_meta(spark, sf_dir).selectExpr(
        "*", "impact_timestamp - 1200D - 50D * (event_id % 9) AS reaction_timestamp",
        f"element_at(array({kinds}), CAST(pmod(event_id, {len(CONFLICTS)}) + 1 AS INT)) AS conflict",
        "event_id % 11 <> 10 AS duration_enough")
    return danger_window(meta)


def score_frames(spark: SparkSession, sf_dir: str, model: int = 0) -> DataFrame:
    """A risk score that falls with the gap. Some frames have no score, some an infinite one, and some
    events are riskier before the danger window than inside it."""
    pairs = fixture.pairs(spark, sf_dir).selectExpr(
        "event_id", "target_id", "k", "time", "acc_ego",
        f"sqrt(pow(x_sur - x_ego, 2) + pow(y_sur - y_ego, 2)) + 1.5D * ((target_id * 7 + event_id + {model}) % 5) AS gap")
    return pairs.selectExpr(
        "event_id", "target_id", "k", "time", "acc_ego",
        "round(gap * CASE WHEN event_id % 6 = 0 AND k < 150 THEN 0.1D ELSE 1D END"
        f" + 0.05D * ((k * 7 + target_id + {model}) % 23), 4) AS near")


def small_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_frames(spark, sf_dir).selectExpr(
        "event_id", "target_id", "k", "time", "acc_ego",
        "CASE WHEN (k + 2 * target_id) % 61 = 0 THEN NULL WHEN (k + target_id) % 50 = 0 AND k < 200 "
        "THEN CAST('Infinity' AS DOUBLE) ELSE near END AS score")


def large_scores(spark: SparkSession, sf_dir: str, model: int = 0) -> DataFrame:
    return score_frames(spark, sf_dir, model).selectExpr(
        "event_id", "target_id", "k", "time", "acc_ego",
        "CASE WHEN (k + 2 * target_id) % 61 = 0 THEN NULL WHEN (k + target_id) % 50 = 0 AND k < 200 "
        "THEN CAST('-Infinity' AS DOUBLE) ELSE round(60D / (near + 1D), 4) END AS score")


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (large_scores(spark, sf_dir, m).withColumn("model", F.lit(name)) for m, name in enumerate(MODELS_LARGE))
    return a.unionByName(b)


def votes(spark: SparkSession, sf_dir: str, n_models: int = 16) -> DataFrame:
    """Votes of n models on every event: agreement varies, some abstain."""
    return fixture.event_meta(spark, sf_dir).select(
        "event_id", F.explode(F.sequence(F.lit(0), F.lit(n_models - 1))).alias("m")
    ).selectExpr(
        "event_id", "concat('model_', m) AS model",
        "CASE WHEN event_id % 10 = 3 OR (m + event_id) % 9 = 0 THEN NULL "
        "WHEN m % 16 < 4 + event_id % 12 THEN event_id * 10 + 1 WHEN event_id % 2 = 0 THEN event_id * 10 + 2 "
        "ELSE event_id * 10 + 1 + m % 3 END AS target_id")
