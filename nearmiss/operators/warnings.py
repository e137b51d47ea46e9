"""Warning analytics: danger windows, choice and voting of the conflicting object, threshold sweeps.

A sweep never pairs frames with thresholds. Each score is turned once into the number of thresholds
it passes (its slot); counts per slot, summed along the slots, give the answer for every threshold.

Scores: [by...], event_id, target_id, k, time, score, and acc_ego where safe periods are wanted.
Event table: event_id with start, end, impact (and reaction) timestamps in ms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearmiss.functions.numeric import INF, NEG_INF, null_nan, slot_of
from nearmiss.operators.frames import settle_slice
from nearmiss.session import cut_lineage
from nearmiss.operators.tracks import block_window, exact_quantiles, number_rows, own_rows, spread_blocks, time_chunk

MIN_DANGER_ROWS = 20     # 2 s of danger before a target counts as recorded
MIN_FLAGGED = 5          # a true warning needs more flagged frames than this
SAFE_LEAD = 3.0          # s between the safe period and the start of the event
HARD_BRAKING = -1.5      # m/s2
LARGE = 1e6              # stands in for infinities in quartiles
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def danger_window(meta: DataFrame) -> DataFrame:
    """From 4.5 s before impact (or the marked start, if earlier) to 0.5 s after it (or the marked end)."""
    return meta.withColumns({
        "danger_start": F.least(F.col("impact_timestamp") - 4500, F.col("start_timestamp")),
        "danger_end": F.least(F.col("impact_timestamp") + 500, F.col("end_timestamp")),
    })


def eligible(meta: DataFrame) -> DataFrame:
    for column, cond in (("duration_enough", "duration_enough"), ("conflict", "conflict <> 'none'")):
        if column in meta.columns:
            meta = meta.where(cond)
    return meta


def flag_conflict(score: Column, threshold: Column | float, small: bool) -> Column:
    """Does the score warn at the threshold? Missing scores never do."""
    clean = null_nan(score)
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.coalesce(clean < limit if small else clean > limit, F.lit(False))


def _phases(scores: DataFrame, meta: DataFrame) -> DataFrame:
    """Frames of known events, with flags for the danger window and the time before it.

    The join is on the event alone; a large event is split by adaptive execution, and the event
    table is broadcast only where its measured size allows.
    """
    marks = meta.select(
        "event_id", (F.col("danger_start") / 1000).alias("_ds"), (F.col("danger_end") / 1000).alias("_de"),
        (F.col("start_timestamp") / 1000 - SAFE_LEAD).alias("_safe"),
        (F.col("impact_timestamp") / 1000).alias("_impact"))
    t = F.col("time")
    return scores.join(marks, "event_id", "inner").withColumns({
        "score": null_nan(F.col("score")),
        "_danger": (t >= F.col("_ds")) & (t <= F.col("_de")), "_pre": t < F.col("_ds")})


def riskiest_target(scores: DataFrame, meta: DataFrame, small: bool, by: Sequence[str] = ()) -> DataFrame:
    """Per event the target with the riskiest mean score in the danger window, lowest id on a tie."""
    return _candidates(_phases(scores, meta), small, [*by, "event_id"]).select(
        *by, "event_id", "target_id", F.col("_mean").alias("mean_score"))


def _candidates(frames: DataFrame, small: bool, ev: list[str]) -> DataFrame:
    d, p, x = F.col("_danger"), F.col("_pre"), F.col("score")
    stats = frames.groupBy(*ev, "target_id").agg(
        F.count(F.when(d, 1)).alias("n_danger"), F.count(F.when(p, 1)).alias("n_pre"),
        F.count(F.when(d, x)).alias("_nn_d"), F.count(F.when(p, x)).alias("_nn_p"),
        null_nan(F.avg(F.when(d, x))).alias("_mean"),
        *[agg(F.when(cond & (F.abs(x) < F.expr(INF)), x)).alias(f"_{name}_{tag}")
          for tag, cond in (("danger", d), ("pre", p)) for name, agg in (("max", F.max), ("min", F.min))],
    )
    risk = F.col("_mean") if small else -F.col("_mean")
    payload = ["n_danger", "n_pre", "_mean", "_max_danger", "_min_danger", "_max_pre", "_min_pre"]
    best = F.min(F.when(F.col("_mean").isNotNull(), F.struct(risk.alias("_risk"), "target_id", *payload)))
    return (
        stats.groupBy(*ev)
        .agg(best.alias("b"), F.sum("_nn_d").alias("_d"), F.sum("_nn_p").alias("_p"))
        .where("b IS NOT NULL AND _d > 0 AND _p > 0").select(*ev, "b.*")
    )


def bound_infinite(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Infinities replaced per key: +inf by the largest of 1e6 and the other values, -inf by the smallest of -1e6 and
    the others, so that quantiles stay finite."""
    top, low = F.expr(INF), F.expr(NEG_INF)
    v = F.nanvl(F.col(value), F.lit(None).cast("double"))
    ends = rows.groupBy(*keys).agg(F.max(F.when(v != top, v)).alias("_top"), F.min(F.when(v != low, v)).alias("_low"))
    out = rows.join(ends, list(keys), "inner")
    return out.withColumn(value, F.when(v == top, F.greatest(F.lit(LARGE), "_top")).when(
        v == low, F.least(F.lit(-LARGE), "_low")).otherwise(F.col(value))).drop("_top", "_low")


def determine_target(scores: DataFrame, meta: DataFrame, small: bool, by: Sequence[str] = ()) -> DataFrame:
    """The conflicting object of each event, with score quartiles before and in the danger window.

    An object is accepted only if it was seen before the danger window and all three quartiles are
    strictly riskier inside it.
    """
    ev = [*by, "event_id"]
    frames = _phases(scores, meta)
    chosen = _candidates(frames, small, ev).where("n_pre >= 1")
    own = frames.where("_danger OR _pre").join(chosen, [*ev, "target_id"], "inner")

    def bounded(tag: str) -> Column:
        top = F.greatest(F.lit(LARGE), F.coalesce(F.col(f"_max_{tag}"), F.lit(LARGE)))
        low = F.least(F.lit(-LARGE), F.coalesce(F.col(f"_min_{tag}"), F.lit(-LARGE)))
        x = F.col("score")
        return F.when(x == F.expr(INF), top).when(x == F.expr(NEG_INF), low).otherwise(x)

    own = own.select(
        *ev, F.when(F.col("_danger"), "danger").otherwise("pre_danger").alias("phase"),
        F.when(F.col("_danger"), bounded("danger")).otherwise(bounded("pre")).alias("x"))
    q = exact_quantiles(own, [*ev, "phase"], "x", QUARTILES)
    q = q.groupBy(*ev).agg(*[
        F.max(F.when(F.col("phase") == phase, F.col(name))).alias(f"{name}_{phase}")
        for phase in ("pre_danger", "danger") for name in QUARTILES])
    out = chosen.select(*ev, "target_id", "n_danger").join(q, ev, "left")
    for name in QUARTILES:
        before, inside = F.col(f"{name}_pre_danger"), F.col(f"{name}_danger")
        not_riskier = before <= inside if small else before >= inside
        out = out.where(~F.coalesce(not_riskier, F.lit(False)))
    return out


def _slots(score: str, thresholds: Sequence[float], small: bool) -> Column:
    """Small-is-risky: thresholds at or below the score, warned from that index on. Large-is-risky:
    thresholds below the score, warned before that index."""
    slot = F.expr(slot_of(score, thresholds, inclusive=small))
    return F.when(F.col(score).isNull(), len(thresholds) if small else 0).otherwise(slot)


def safe_targets(
    scores: DataFrame, meta: DataFrame, targets: DataFrame, thresholds: Sequence[float], small: bool,
    by: Sequence[str] = (),
) -> DataFrame:
    """Other objects with a settled period well before the event and no hard braking of the ego,
    with the slot of their riskiest score in that period."""
    ev = [*by, "event_id"]
    frames = _phases(scores, meta).where("time < _safe")
    chosen = targets.select(*ev, F.col("target_id").alias("_chosen"))
    others = frames.join(chosen, ev, "inner").where("target_id <> _chosen")
    period = settle_slice(others.withColumn("_slot", _slots("score", thresholds, small)),
                          keys=[*ev, "target_id"])
    riskiest = F.min("_slot") if small else F.max("_slot")
    return (
        period.groupBy(*ev, "target_id").agg(F.min("acc_ego").alias("_acc"), riskiest.alias("slot"))
        .where(F.col("_acc") > HARD_BRAKING).drop("_acc")
    )


def _onset(target_frames: DataFrame, thresholds: Sequence[float], small: bool, ev: list[str]):
    """Last change from safe to warning up to the impact, per event and threshold index, and the
    per-event facts that settle the thresholds without any change."""
    n = len(thresholds)
    facts = target_frames.groupBy(*ev).agg(
        F.min("time").alias("_first_time"),
        F.count(F.when(F.col("_upto"), 1)).alias("_seen"),
        F.min(F.when(F.col("_upto"), F.col("_slot"))).alias("_min_slot"),
        F.max(F.when(F.col("_upto"), F.col("_slot"))).alias("_max_slot"),
        F.min_by(F.when(F.col("_upto"), F.col("_slot")), F.col("k")).alias("_first_slot"))
    numbered = number_rows(target_frames.where("_upto").select(*ev, "k", "time", "_slot"),
                           ev, ["k"], time_chunk(), idx="_i")
    pairs = own_rows(spread_blocks(numbered, "_i", before=1).withColumn(
        "_prev", F.lag("_slot").over(block_window(ev, "_i"))))
    # thresholds at which this frame warns and the one before does not
    lo, hi = ("_slot", "_prev") if small else ("_prev", "_slot")
    rises = pairs.where(F.col(lo) < F.col(hi)).withColumn(
        "i", F.explode(F.sequence(F.col(lo), F.least(F.col(hi), F.lit(n)) - 1)))
    return facts, rises.groupBy(*ev, "i").agg(F.max("time").alias("_rise"))


def warning_records(
    scores: DataFrame,
    meta: DataFrame,
    thresholds: Sequence[float],
    small: bool,
    by: Sequence[str] = (),
    models: Sequence[str] | None = None,
    targets: DataFrame | None = None,
    with_onset: bool = False,
) -> DataFrame:
    """One row per [model,] event and threshold.

    Without `targets` the conflicting object is determined per event and needs 2 s of danger; with
    them (the voted objects) it is taken as given, and both marks stay NULL for events without scores
    (`fill_flags` turns them into false). `with_onset` adds the warning moment, the impact
    and reaction times and the share of the danger window under warning.
    """
    by = list(by)
    ev = [*by, "event_id"]
    thresholds = sorted(float(t) for t in thresholds)
    n = len(thresholds)
    voted = targets is not None
    if voted:
        meta = meta.join(targets.select("event_id").distinct(), "event_id", "left_semi")
        present = scores.select(*ev).distinct()
        targets = present.join(targets.select("event_id", "target_id"), "event_id", "inner")
    else:
        meta = eligible(meta)
        targets = determine_target(scores, meta, small, by).where(F.col("n_danger") >= MIN_DANGER_ROWS)
    targets = cut_lineage(targets, "targets")  # one row per event, needed by every part below
    frames = _phases(scores, meta)
    own = frames.join(targets.select(*ev, "target_id"), [*ev, "target_id"], "left_semi").select(
        *ev, "target_id", "k", "time", "_danger", (F.col("time") <= F.col("_impact")).alias("_upto"),
        _slots("score", thresholds, small).alias("_slot"))
    if with_onset:
        own = cut_lineage(own, "target-frames")  # numbering reads the frames more than once
    hits = own.where("_danger").groupBy(*ev, F.col("_slot").alias("i")).agg(F.count(F.lit(1)).alias("_hits"))
    safe = safe_targets(scores, meta, targets, thresholds, small, by)
    alarms = safe.groupBy(*ev, F.col("slot").alias("i")).agg(F.count(F.lit(1)).alias("_alarms"))

    grid = targets.select(*ev, F.explode(F.sequence(F.lit(0), F.lit(n))).alias("i"))
    zero = F.lit(0).cast("long")
    cells = (
        grid.withColumns({"_hits": zero, "_alarms": zero})
        .unionByName(hits.withColumn("_alarms", zero))
        .unionByName(alarms.withColumn("_hits", zero))
        .groupBy(*ev, "i").agg(F.sum("_hits").alias("_hits"), F.sum("_alarms").alias("_alarms"))
    )
    # at most one row per threshold and event
    upto = Window.partitionBy(*ev).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*ev)
    cells = cells.withColumns({
        c: F.sum(f"_{c}").over(upto) if small else F.sum(f"_{c}").over(whole) - F.sum(f"_{c}").over(upto)
        for c in ("hits", "alarms")
    } | {"_frames": F.sum("_hits").over(whole), "_safe": F.sum("_alarms").over(whole)}).where(F.col("i") < n)

    facts_cols = []
    out = cells.join(targets, ev, "inner")
    if with_onset:
        facts, rises = _onset(own, thresholds, small, ev)
        out = out.join(facts, ev, "left").join(rises, [*ev, "i"], "left")
        i, lo, hi = F.col("i"), F.col("_min_slot"), F.col("_max_slot")
        always, never = (i >= hi, i < lo) if small else (i < lo, i >= hi)
        starts = i >= F.col("_first_slot") if small else i < F.col("_first_slot")
        first, rise = F.col("_first_time"), F.col("_rise")
        moment = (F.when((F.col("_seen") == 0) | always, first).when(never, F.lit(None))
                  .when(rise.isNotNull(), rise).when(starts, first))
        out = out.withColumns({
            "warning_timestamp": moment * 1000,
            "true_warning_period": F.col("hits") / F.nullif(F.col("_frames"), F.lit(0))})
        facts_cols = ["warning_timestamp", "true_warning_period"]

    limits = F.array(*[F.lit(t) for t in thresholds])
    base = meta.select(
        "event_id", "danger_start", "danger_end",
        *([(F.col("impact_timestamp") / 1000).alias("impact_time"),
           (F.col("reaction_timestamp") / 1000).alias("reaction_time")] if with_onset else []))
    if by:
        base = base.withColumn(by[0], F.explode(F.array(*[F.lit(m) for m in models or ()])))
    base = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    quartiles = [c for c in out.columns if c.startswith("q") and c.endswith("danger")]
    out = out.select(*ev, "i", "target_id", "hits", "alarms", "_safe", *quartiles, *facts_cols)
    joined = base.join(out, [*ev, "i"], "left")
    recorded, has_safe = F.col("hits").isNotNull(), F.coalesce(F.col("_safe") > 0, F.lit(False))
    return joined.select(
        *ev, limits[F.col("i")].alias("threshold"), "danger_start", "danger_end",
        (F.when(recorded, True) if voted else recorded).alias("danger_recorded"),
        (F.when(recorded, has_safe) if voted else has_safe).alias("safety_recorded"), "target_id",
        F.when(recorded, (F.col("hits") > MIN_FLAGGED).cast("int")).alias("true_warning"),
        F.when(has_safe, F.col("alarms")).alias("num_false_warning"),
        F.when(has_safe, F.col("_safe") - F.col("alarms")).alias("num_true_non_warning"),
        F.when(has_safe, (F.col("alarms") > 0).cast("int")).alias("false_warning"),
        *quartiles, *(["impact_time", "reaction_time"] if with_onset else []), *facts_cols)


def issue_warning(scores: DataFrame, meta: DataFrame, threshold: float, small: bool) -> DataFrame:
    """Warning moment and share at one threshold, for the determined targets."""
    out = warning_records(scores, meta, [threshold], small, with_onset=True)
    return out.withColumnRenamed("threshold", "optimal_threshold").drop(
        "safety_recorded", "true_warning", "num_false_warning", "num_true_non_warning", "false_warning")


def attach_safe_ids(records: DataFrame, safe: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds safe_target_ids, the sorted ids of each event's safe targets, 'none' where there are none."""
    ev = [*by, "event_id"]
    ids = safe.groupBy(*ev).agg(
        F.array_join(F.sort_array(F.collect_list("target_id")), ",").alias("safe_target_ids"))
    return records.join(ids, ev, "left").withColumn(
        "safe_target_ids", F.coalesce("safe_target_ids", F.lit("none")))


def first_votes(records: DataFrame) -> DataFrame:
    """Each model's vote per event: its target at the lowest threshold that has one, NULL if none."""
    order = F.when(F.col("target_id").isNotNull(), F.col("threshold"))
    return records.groupBy("model", "event_id").agg(F.min_by("target_id", order).alias("target_id"))


def vote_target(votes: DataFrame, n_models: int, min_models: int = 15) -> DataFrame:
    """One object per event from the models' votes; -1 with a note where no clear majority exists.

    The winner needs a third of all models, and fewer than a third may vote for other objects.
    """
    if n_models < min_models:
        raise ValueError(f"{n_models} models cannot vote, {min_models} are needed")
    tally = votes.groupBy("event_id", F.coalesce("target_id", F.lit(-1)).alias("target_id")).agg(
        F.count(F.lit(1)).alias("votes"))
    cast = F.when(F.col("target_id") >= 0, F.col("votes"))
    top = F.max(F.when(F.col("target_id") >= 0, F.struct("votes", (-F.col("target_id")).alias("neg"))))
    per_event = tally.groupBy("event_id").agg(top.alias("top"), F.coalesce(F.sum(cast), F.lit(0)).alias("given"))
    best, against = F.col("top.votes"), F.col("given") - F.col("top.votes")
    third = n_models / 3
    won = F.col("top").isNotNull() & (best >= third) & (against < third)
    note = (
        F.when(F.col("top").isNull(), "No target is identified by any SSMs")
        .when(best < third, "The most votes are less than 1/3 of total")
        .when(against >= third, "More than 1/3 votes are not for the most voted target")
        .otherwise(F.concat(F.lit("For: "), best.cast("string"), F.lit(", against: "), against.cast("string"),
                            F.lit(", abstentions: "), (F.lit(n_models) - F.col("given")).cast("string"))))
    return per_event.select(
        "event_id", F.when(won, -F.col("top.neg")).otherwise(F.lit(-1)).cast("long").alias("target_id"),
        note.alias("target_note"))


def threshold_grid(indicator: str) -> list[float]:
    """Ascending thresholds swept for an indicator; a constant list of a few hundred numbers."""
    def steps(stop: float, step: float) -> list[float]:
        count = -int(-stop / step // 1)
        return [i * step for i in range(count)]

    if indicator == "TAdv":
        values = [round(x ** 7, 2) for x in steps(1.75, 0.0115)]
    elif indicator in ("TTC2D", "ACT"):
        values = [round(x ** 7, 2) for x in steps(1.94, 0.0135)]
    elif indicator == "EI":
        up = [round((8 ** x - 1) / 50, 2) for x in steps(2.31, 0.0265)]
        values = up + [-3 * x for x in up[::2]]
    elif indicator == "UCD":
        values = [round(10 ** x) - 2.0 for x in steps(5.95, 0.055)]
    else:
        values = [round(x - 0.06, 2) for x in steps(6, 0.06)]
    return sorted({float(v) + 0.0 for v in values})


def sweep_counts(scores: DataFrame, thresholds: Sequence[float], small: bool, by: Sequence[str] = ()) -> DataFrame:
    """Number of frames that warn at each threshold. Frames are counted per slot before any shuffle of
    rows, and only (groups x thresholds) counts are summed along the slots."""
    thresholds = sorted(float(t) for t in thresholds)
    n = len(thresholds)
    slots = scores.select(*by, null_nan(F.col("score")).alias("score")).groupBy(
        *by, _slots("score", thresholds, small).alias("i")).agg(F.count(F.lit(1)).alias("c"))
    groups = slots.select(*by).distinct() if by else slots.agg(F.max("i").alias("_any")).drop("_any")
    grid = groups.select(*by, F.explode(F.sequence(F.lit(0), F.lit(n))).alias("i"))
    cells = grid.withColumn("c", F.lit(0).cast("long")).unionByName(slots).groupBy(*by, "i").agg(F.sum("c").alias("c"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = F.sum("c").over(whole.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    flagged = upto if small else F.sum("c").over(whole) - upto
    limits = F.array(*[F.lit(t) for t in thresholds])
    return cells.withColumn("flagged", flagged).where(F.col("i") < n).select(
        *by, limits[F.col("i")].alias("threshold"), "flagged")
