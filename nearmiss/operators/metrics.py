"""Confusion counts over a threshold sweep and the metrics read from them.

`by` names the groups, by default the model; add e.g. an event subset to get metrics per subset.
Beyond the first aggregation every table here has at most groups x thresholds rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearmiss.functions.numeric import SMALL
from nearmiss.operators.tracks import order_statistics
from nearmiss.session import cut_lineage

GRID = 1000          # points of the curves' common grid
FLOORS = (0.80, 0.90)
TTI_LIMIT = 10.0     # s, warnings earlier than this before impact are not timed
TTI_CUTOFF = 1.5     # s
RECALL_FLOOR = 0.85


def confusion_by_threshold(records: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """TP and FN count events; FP and TN add up the other objects of events with a safe period."""
    danger, safe = F.col("danger_recorded"), F.col("safety_recorded")
    warned = F.col("true_warning")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return records.groupBy(*by, "threshold").agg(
        F.count(F.when(danger & (warned > 0.5), 1)).alias("TP"),
        total(F.when(safe, F.col("num_false_warning"))).alias("FP"),
        total(F.when(safe, F.col("num_true_non_warning"))).alias("TN"),
        F.count(F.when(danger & (warned < 0.5), 1)).alias("FN"))


def rates(confusion: DataFrame, floored: bool = True) -> DataFrame:
    """False-negative and false-positive rate, precision, recall and F1. Floored: denominators are
    at least 1e-6, so an empty one gives 0; otherwise it gives NULL."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("TP", "FP", "TN", "FN"))

    def ratio(a: Column, b: Column) -> Column:
        return a / F.greatest(b, F.lit(SMALL)) if floored else a / F.nullif(b, F.lit(0.0))

    return confusion.withColumns({
        "fnr": ratio(fn, tp + fn), "fpr": ratio(fp, fp + tn), "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn), "f1": ratio(tp, tp + 0.5 * (fp + fn))})


def optimal_threshold(
    confusion: DataFrame, small: bool, by: Sequence[str] = ("model",), floor: float = RECALL_FLOOR
) -> DataFrame:
    """Per group the row with the best precision reachable at the recall floor; among rows of that
    precision the lowest false-positive rate, then false-negative rate, then threshold (highest
    threshold where large scores are risky). No row where the floor is never reached."""
    by = list(by)
    r = rates(confusion, floored=False)
    best = r.where(F.col("recall") >= floor).groupBy(*by).agg(F.max("precision").alias("_best"))
    last = F.lit(float("inf"))
    order = F.struct(
        F.coalesce("fpr", last), F.coalesce("fnr", last),
        F.col("threshold") if small else -F.col("threshold"))
    cols = ["threshold", "TP", "FP", "TN", "FN", "fnr", "fpr", "precision", "recall"]
    return (
        r.join(best, by, "inner").where(F.col("precision") == F.col("_best"))
        .groupBy(*by).agg(F.min_by(F.struct(*cols), order).alias("o")).select(*by, "o.*"))


def curve_points(points: DataFrame, x: str, y: str, by: Sequence[str], size: int = GRID) -> DataFrame:
    """The curve y(x) on `size` even points of [1e-6, 1 - 1e-6], linear between points and flat
    beyond them. Points sharing an x are taken in order of y."""
    by = list(by)
    lo, step = SMALL, (1 - 2 * SMALL) / (size - 1)
    per_x = points.groupBy(*by, F.col(x).alias("_x")).agg(F.min(y).alias("_first"), F.max(y).alias("_last"))
    w = Window.partitionBy(*by).orderBy("_x")
    seg = per_x.withColumns({
        "_x2": F.lead("_x").over(w), "_y2": F.lead("_first").over(w), "_lead_in": F.row_number().over(w) == 1})
    clip = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(size - 1)).cast("long")
    start = F.when(F.col("_lead_in"), F.lit(0).cast("long")).otherwise(clip(F.floor((F.col("_x") - lo) / step) - 1))
    stop = F.when(F.col("_x2").isNotNull(), clip(F.ceil((F.col("_x2") - lo) / step) + 1)).otherwise(
        F.lit(size - 1).cast("long"))
    g = seg.withColumn("g", F.explode(F.sequence(start, stop))).withColumn("x", F.lit(lo) + F.col("g") * F.lit(step))
    mine = ((F.col("x") >= F.col("_x")) | F.col("_lead_in")) & (F.col("_x2").isNull() | (F.col("x") < F.col("_x2")))
    slope = (F.col("_y2") - F.col("_last")) / (F.col("_x2") - F.col("_x"))
    value = (F.when(F.col("x") < F.col("_x"), F.col("_first")).when(F.col("_x2").isNull(), F.col("_last"))
             .otherwise(F.col("_last") + slope * (F.col("x") - F.col("_x"))))
    return g.where(mine).select(*by, "g", "x", value.alias("y"))


def area(curve: DataFrame, by: Sequence[str], floor: float = 0.0) -> DataFrame:
    """Trapezoid area of the part of the curve at or above the floor, over what a full part could have."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy("g")
    above = curve.withColumn("_h", F.when(F.col("y") >= floor, F.col("y") - floor))
    kept = above.where("_h IS NOT NULL").withColumn(
        "_part", (F.col("x") - F.lag("x").over(w)) * (F.col("_h") + F.lag("_h").over(w)) / 2)
    sums = kept.groupBy(*by).agg(F.coalesce(F.sum("_part"), F.lit(0.0)).alias("_a"))
    return curve.select(*by).distinct().join(sums, by, "left").select(
        *by, (F.coalesce("_a", F.lit(0.0)) / (1.0 - floor)).alias("area"))


def partial_auc(rated: DataFrame, by: Sequence[str] = ("model",), floor: float = 0.80) -> DataFrame:
    curve = curve_points(rated.where("fpr IS NOT NULL"), "fpr", "recall", by)
    return area(curve, by, floor).withColumnRenamed("area", f"aroc_{round(floor * 100)}")


def auprc(rated: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return area(curve_points(rated, "recall", "precision", by), by).withColumnRenamed("area", "auprc")


def max_precision_at_recall(rated: DataFrame, by: Sequence[str] = ("model",), floor: float = 0.80) -> DataFrame:
    """NULL where the recall floor is never reached."""
    return rated.groupBy(*by).agg(
        F.max(F.when(F.col("recall") >= floor, F.col("precision"))).alias(f"pprc_{round(floor * 100)}"))


def half_binomial_quantile(n: str, p: float) -> str:
    """Smallest k whose binomial(n, 1/2) distribution function reaches p, as SQL text.

    Adds probabilities upward, from 0 for small n and from ten standard deviations below the mean
    for large n, where the first probability comes from the Stirling series.
    """
    def lgamma1(v: str) -> str:  # ln(v!)
        return (f"(({v} + 0.5D) * ln({v} + 0D) - {v} + 0.5D * ln(2D * pi()) + 1D / (12D * {v}) "
                f"- 1D / (360D * pow({v}, 3)) + 1D / (1260D * pow({v}, 5)))")

    big = f"({n} >= 1000)"
    k0 = f"(CASE WHEN {big} THEN CAST(floor({n} / 2D - 5D * sqrt({n})) AS BIGINT) ELSE 0L END)"
    first = (f"exp(-{n} * ln(2D) + CASE WHEN {big} THEN {lgamma1(f'CAST({n} AS DOUBLE)')} "
             f"- {lgamma1(f'CAST({k0} AS DOUBLE)')} - {lgamma1(f'CAST({n} - {k0} AS DOUBLE)')} ELSE 0D END)")
    # the state holds the probability of k, the sum up to k, and the answer once found
    return (
        f"aggregate(sequence({k0}, CAST({n} AS BIGINT) - {k0}), "
        f"named_struct('p', {first}, 'c', 0D, 'k', CAST(NULL AS BIGINT)), "
        f"(a, k) -> named_struct('p', a.p * CAST({n} - k AS DOUBLE) / CAST(k + 1 AS DOUBLE), 'c', a.c + a.p, "
        f"'k', CASE WHEN a.k IS NULL AND a.c + a.p >= {p!r}D - 1e-12D THEN k ELSE a.k END), a -> a.k)")


def median_ranks(n: str, alpha: float) -> tuple[Column, Column]:
    """0-based ranks of the order statistics that bound the median with confidence 1 - alpha."""
    top = F.expr(f"CAST({n} AS BIGINT) - 1")
    low = F.expr(half_binomial_quantile(n, alpha / 2))
    up = F.expr(half_binomial_quantile(n, 1 - alpha / 2)) - 1
    clip = lambda c: F.greatest(F.lit(0).cast("long"), F.least(c, top))
    return clip(low), clip(up)


def median_summary(df: DataFrame, value: str, by: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Median, quartiles and the order-statistic confidence bounds of the median per group."""
    low, up = median_ranks("n", alpha)
    place = {name: (F.col("n") - 1) * F.lit(p) for name, p in (("q25", .25), ("median", .5), ("q75", .75))}
    ranks = {"low_ci": low, "up_ci": up}
    for name, c in place.items():
        ranks |= {f"_lo_{name}": F.floor(c).cast("long"), f"_hi_{name}": F.ceil(c).cast("long")}
    stats = order_statistics(df, by, value, ranks)
    lerp = {name: F.col(f"_lo_{name}") + (c - F.floor(c)) * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))
            for name, c in place.items()}
    return stats.select(*by, "n", *[c.alias(name) for name, c in lerp.items()], "low_ci", "up_ci")


def with_tti(records: DataFrame) -> DataFrame:
    return records.withColumn("tti", F.col("impact_time") - F.col("warning_timestamp") / 1000)


def best_f1_threshold(rated: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """First threshold of the largest F1 score."""
    order = F.struct(F.col("f1"), -F.col("threshold"))
    return rated.groupBy(*by).agg(F.max_by("threshold", order).alias("threshold"))


def tti_stats(records: DataFrame, rated: DataFrame, by: Sequence[str] = ("model",),
              cutoff: float = TTI_CUTOFF, alpha: float = 0.05) -> DataFrame:
    """Time to impact at the threshold of the best F1: median, quartiles, bounds of the median, and the
    share of warned events with at least `cutoff` seconds left."""
    by = list(by)
    at = with_tti(records).join(best_f1_threshold(rated, by), [*by, "threshold"], "left_semi").where("tti IS NOT NULL")
    share = at.groupBy(*by).agg((F.count(F.when(F.col("tti") >= cutoff, 1)) / F.count("tti")).alias("PTTI_star"))
    stats = median_summary(at.where(F.col("tti") < TTI_LIMIT), "tti", by, alpha)
    return share.join(stats, by, "left").select(
        *by, "PTTI_star", F.col("median").alias("mTTI_star"), F.col("q25").alias("TTI_star_q25"),
        F.col("q75").alias("TTI_star_q75"), F.col("low_ci").alias("TTI_star_lowCI"),
        F.col("up_ci").alias("TTI_star_upCI"))


def eval_metrics(records: DataFrame, by: Sequence[str] = ("model",), with_time: bool = False) -> DataFrame:
    """Area under the precision-recall curve, partial ROC areas and precision at the recall floors;
    with_time adds the time-to-impact summary."""
    by = list(by)
    # read once, then every metric starts from these few rows
    rated = cut_lineage(rates(confusion_by_threshold(records, by)), "rates")
    out = auprc(rated, by)
    for floor in FLOORS:
        out = out.join(partial_auc(rated, by, floor), by, "left")
    out = out.join(rated.groupBy(*by).agg(*[
        F.max(F.when(F.col("recall") >= f, F.col("precision"))).alias(f"pprc_{round(f * 100)}")
        for f in FLOORS]), by, "left")
    return out.join(tti_stats(records, rated, by), by, "left") if with_time else out


# Event subsets of the report tables, by kind of conflict
SUBSETS = {
    "Rear-end": ("leading",),
    "Adjacent lane": ("adjacent_lane",),
    "Crossing/turning": ("turning_into_parallel", "turning_across_opposite", "turning_across_parallel",
                         "turning_into_opposite", "intersection_crossing"),
    "Merging": ("merging",),
    "With pedestrian/cyclist/animal": ("pedestrian", "cyclist", "animal"),
    "Lateral": ("adjacent_lane", "merging", "turning_into_parallel", "turning_into_opposite",
                "turning_across_parallel", "turning_across_opposite", "intersection_crossing",
                "pedestrian", "cyclist"),
}
NOT_OTHERS = ("leading", "adjacent_lane", "merging", "turning_into_parallel", "turning_into_opposite",
              "turning_across_parallel", "turning_across_opposite", "intersection_crossing")


def with_subsets(records: DataFrame, meta: DataFrame) -> DataFrame:
    """Each record once per event subset its conflict belongs to, 'All' included."""
    conflict = F.col("conflict")
    names = [F.lit("All")] + [F.when(conflict.isin(*kinds), F.lit(name)) for name, kinds in SUBSETS.items()]
    names.append(F.when(~conflict.isin(*NOT_OTHERS), F.lit("Others")))
    kinds = meta.where("conflict <> 'none'").select(
        "event_id", F.explode(F.array_compact(F.array(*names))).alias("subset"))
    return records.join(kinds, "event_id", "inner")


def event_curves(records: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Per threshold: false- and true-positive rate, precision and recall in percent, and F1."""
    r = rates(confusion_by_threshold(records, by), floored=False)
    return r.select(*by, "threshold", (F.col("fpr") * 100).alias("fpr"), (100 - F.col("fnr") * 100).alias("tpr"),
                    (F.col("precision") * 100).alias("precision"), (F.col("recall") * 100).alias("recall"), "f1")


def timeliness_curve(records: DataFrame, by: Sequence[str] = ("model",), alpha: float = 0.05) -> DataFrame:
    """Per threshold the median time to impact with its bounds, against F1."""
    keys = [*by, "threshold"]
    timed = median_summary(with_tti(records).where(F.col("tti") < TTI_LIMIT), "tti", keys, alpha)
    f1 = rates(confusion_by_threshold(records, by), floored=False).select(*keys, "f1")
    return timed.join(f1, keys, "inner").select(*keys, "median", "low_ci", "up_ci", "f1")


def false_alarm_report(records: DataFrame, small: bool, by: Sequence[str]) -> DataFrame:
    """False alarms among warnings and missed events at the optimal threshold of each group."""
    best = optimal_threshold(confusion_by_threshold(records, by), small, by)
    return best.select(*by, "threshold", "FP", (F.col("TP") + F.col("FP")).alias("warnings"), "FN")
