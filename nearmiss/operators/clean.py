"""Projections, filters and joins that clean raw tables and annotate events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearmiss.functions import fixed_values as fv
from nearmiss.functions.numeric import with_exprs
from nearmiss.operators.frames import dedupe_keep_first
from nearmiss.session import cut_lineage

G = 9.81


def mapping(column: Column, table: Mapping[str, str]) -> Column:
    """Lookup in a constant table; NULL for labels it does not list."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.create_map(*pairs)[column]


# --- telemetry -----------------------------------------------------------------------------------

def ego_signals(telemetry: DataFrame) -> DataFrame:
    """Raw signals in SI units on the time axis: speed m/s, turn rate rad/s (left positive),
    acceleration m/s2, time in s and its 0.1 s index k."""
    return telemetry.selectExpr(
        "event_id", "timestamp", "round(timestamp / 1000D, 1) AS time",
        "CAST(round(timestamp / 100D) AS BIGINT) AS k", "speed_network / 3.6D AS speed_comp",
        "radians(-gyro_z) AS yaw_rate", f"accel_y * {G}D AS acc_lat", f"accel_x * {G}D AS acc_lon",
        "pedal_brake_state AS brake", "steering_wheel_position AS wheel_steering", "turn_signal")


def radar_to_rows(telemetry: DataFrame, slots: int = 8) -> DataFrame:
    """One row per filled radar slot: raw target id, lateral (right positive) and longitudinal
    position and relative velocity. A target keeps the first row per timestamp, in slot order."""
    boxes = F.array(*[F.struct(
        F.lit(i).alias("slot"), F.col(f"TRACK{i}_TARGET_ID").cast("long").alias("raw_id"),
        (-F.col(f"TRACK{i}_Y_POS_PROCESSED")).alias("local_dx"), F.col(f"TRACK{i}_X_POS_PROCESSED").alias("local_dy"),
        (-F.col(f"TRACK{i}_Y_VEL_PROCESSED")).alias("delta_vx"), F.col(f"TRACK{i}_X_VEL_PROCESSED").alias("delta_vy"),
    ) for i in range(1, slots + 1)])
    rows = telemetry.select("event_id", "timestamp", F.inline(boxes)).where("raw_id > 0")
    rows = dedupe_keep_first(rows, ["event_id", "raw_id", "timestamp"], ["slot"]).drop("slot")
    return with_exprs(rows, {"time": "round(timestamp / 1000D, 1)", "k": "CAST(round(timestamp / 100D) AS BIGINT)"})


def global_target_ids(radar: DataFrame, first_id: int = 0) -> DataFrame:
    """Running target id over all events, by event and raw id."""
    from nearmiss.operators.tracks import number_ranges
    ids = number_ranges(radar.select("event_id", "raw_id").distinct(), ["event_id", "raw_id"], idx="_id")
    return radar.join(ids.withColumn("target_id", F.col("_id") + first_id).drop("_id"), ["event_id", "raw_id"], "inner")


def trim_leading_incomplete(ego: DataFrame, needed: Sequence[str] = ("speed_comp", "acc_lat", "acc_lon")) -> DataFrame:
    """Drops rows before the first one that has every needed signal; events without one vanish."""
    full = F.lit(True)
    for c in needed:
        full = full & F.col(c).isNotNull() & ~F.isnan(c)
    first = ego.groupBy("event_id").agg(F.min(F.when(full, F.col("k"))).alias("_k0")).where("_k0 IS NOT NULL")
    return ego.join(first, "event_id", "inner").where("k >= _k0").drop("_k0")


def _present(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))


def _ego_moments(telemetry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ego rows from the first complete one on, one per moment, and per event: the rows in motion (a missing speed
    counts as motion) and the first and last moment."""
    trimmed = trim_leading_incomplete(ego_signals(telemetry))
    standing = F.coalesce(F.col("speed_comp") <= 1e-6, F.lit(False))
    span = trimmed.groupBy("event_id").agg(
        F.count(F.when(~standing, 1)).alias("n_moving"), F.min("k").alias("_k0"), F.max("k").alias("_kn"))
    return dedupe_keep_first(trimmed, ["event_id", "k"], ["timestamp"]), span


def signal_gate(telemetry: DataFrame, lengths: DataFrame, radar: DataFrame, min_rows: int = 10) -> DataFrame:
    """Per event of `lengths` (event_id, ego_length): can the ego and the objects around it be
    reconstructed, and the first reason if not. Events without telemetry count as unreadable.

    `radar` carries target ids (`global_target_ids`). Continued targets count as one, and only on moments of the
    ego's grid, whose last moment is excluded. The note of a usable event names its reconnected targets.
    """
    from nearmiss.operators.filters import reconnect_edges, reconnect_tracks
    from nearmiss.operators.frames import regrid_interpolate
    moments, span = _ego_moments(telemetry)
    edges = edge_speed_valid(regrid_interpolate(moments, ["event_id"], ["speed_comp"]))
    seen = telemetry.groupBy("event_id").agg(
        F.count(F.when(_present("speed_network"), 1)).alias("n_speed"),
        F.count(F.when(_present("accel_x"), 1)).alias("n_ax"), F.count(F.when(_present("accel_y"), 1)).alias("n_ay"),
        F.count(F.when(_present("gyro_z"), 1)).alias("n_gyro")).join(span, "event_id", "left")
    links = cut_lineage(reconnect_edges(radar), "links")
    listed = [F.array_join(F.col(f"_l.{c}").cast("array<string>"), ", ") for c in ("target_id", "parent")]
    joined = links.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("target_id", "parent"))).alias("_l")).select(
        "event_id", F.concat(F.lit("Targets dict_keys(["), listed[0], F.lit("]) are reconnected to dict_values(["), listed[1],
                             F.lit("])")).alias("reconnected"))
    detected = radar.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_radar"))
    on_grid = reconnect_tracks(radar, links).join(span, "event_id", "inner").where("k >= _k0 AND k < _kn")
    objects = on_grid.groupBy("event_id", "target_id").agg(F.count(F.lit(1)).alias("n")).groupBy("event_id").agg(
        F.max("n").alias("longest"))
    df = lengths
    for part in (seen, edges, detected, objects, joined):
        df = df.join(part, "event_id", "left")
    fails = [
        ("file reading error", F.col("n_speed").isNull()),
        ("all nan ego speed", F.col("n_speed") == 0),
        ("all nan acceleration", (F.col("n_ax") == 0) | (F.col("n_ay") == 0)),
        ("all nan yaw rate", F.col("n_gyro") == 0),
        ("all zero ego speed", F.col("n_moving") == 0),
        ("start&end speed not available", ~F.coalesce(F.col("valid_start") | F.col("valid_end"), F.lit(False))),
    ]
    later = [
        ("no available surrounding trajectories", F.col("n_radar").isNull()),
        ("no ego width or length", F.col("ego_length").isNull()),
        ("no long enough surrounding trajectories", F.coalesce("longest", F.lit(0)) < min_rows),
    ]
    note = ego_bad = None
    for text, cond in fails + later:
        note = F.when(cond, text) if note is None else note.when(cond, text)
    for _, cond in fails:
        ego_bad = cond if ego_bad is None else ego_bad | cond
    df = df.withColumns({"_fail": note, "ego_reconstructed": (~F.coalesce(ego_bad, F.lit(False))).cast("int")})
    return df.select("event_id", "ego_reconstructed", F.col("_fail").isNull().cast("int").alias("surrounding_reconstructed"),
                     F.coalesce("_fail", "reconnected").alias("note"))


def nan_fraction_gate(telemetry: DataFrame, radar: DataFrame, lengths: DataFrame, limit: float = 0.2, min_rows: int = 20) -> DataFrame:
    """Events usable for the parameter search: at most a fifth of any signal missing, a moving ego of known length
    whose first or last five speeds are known, and one object, after reconnection, seen for at least min_rows rows.
    `radar` carries target ids (`global_target_ids`)."""
    from nearmiss.operators.filters import reconnect_tracks
    signals = ("speed_network", "accel_x", "accel_y", "gyro_z")
    ego = telemetry.groupBy("event_id").agg(*[F.avg((~_present(c)).cast("double")).alias(f"miss_{c}") for c in signals])
    for c in signals:
        ego = ego.where(F.col(f"miss_{c}") <= limit)
    moments, span = _ego_moments(telemetry)
    ego = (ego.join(span.where("n_moving > 0"), "event_id", "inner")
           .join(edge_speed_valid(moments).where("valid_start OR valid_end"), "event_id", "inner"))
    local = ("local_dx", "local_dy", "delta_vx", "delta_vy")
    sur = reconnect_tracks(radar).groupBy("event_id", "target_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.count(F.when(~_present(c), 1)).alias(c) for c in local])
    sur = sur.groupBy("event_id").agg(F.max("n").alias("longest"), F.sum("n").alias("rows"), *[F.sum(c).alias(c) for c in local])
    for c in local:
        sur = sur.where(F.col(c) <= limit * F.col("rows"))
    return (
        ego.join(sur.where(F.col("longest") >= min_rows), "event_id", "inner")
        .join(lengths.where("ego_length IS NOT NULL"), "event_id", "inner").select("event_id", "longest"))


def edge_speed_valid(ego: DataFrame, n: int = 5) -> DataFrame:
    """Are the first and the last n speeds all known and not negative?"""
    def edge(direction: Column, name: str) -> DataFrame:
        # a bounded rank: each task keeps n rows per event before the shuffle
        w = Window.partitionBy("event_id").orderBy(direction)
        rows = ego.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
        return rows.groupBy("event_id").agg(F.bool_and(F.coalesce(F.col("speed_comp") >= 0, F.lit(False))).alias(name))
    return edge(F.asc("k"), "valid_start").join(edge(F.desc("k"), "valid_end"), "event_id", "inner")


def mark_event_window(ego: DataFrame, events: DataFrame) -> DataFrame:
    """event = 1 on rows between the marked start and end; 0 where the end is not marked."""
    marks = events.select("event_id", F.expr("try_cast(eventStart AS BIGINT)").alias("_s"),
                          F.expr("CASE WHEN eventEnd <> '(null)' THEN try_cast(eventEnd AS BIGINT) END").alias("_e"))
    return ego.join(marks, "event_id", "left").withColumn(
        "event", F.coalesce(F.col("timestamp").between(F.col("_s"), F.col("_e")).cast("int"), F.lit(0))).drop("_s", "_e")


# --- event annotations ---------------------------------------------------------------------------

def clean_timestamps(events: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Text marks as numbers under new names; '(null)', -99 and -1 mean missing."""
    return with_exprs(events, {
        new: f"CASE WHEN {old} NOT IN ('(null)', '-99', '-1') THEN CAST({old} AS DOUBLE) END" for old, new in columns.items()})


def event_category(severity1: str = "eventSeverity1", severity2: str = "eventSeverity2") -> Column:
    out = F.when(F.col(severity1).isin(*fv.SAFE_SEVERITIES), "SafeBaseline")
    for (a, b), name in fv.EVENT_CATEGORIES.items():
        out = out.when((F.col(severity1) == a) & (F.col(severity2) == b), name)
    return out


def conflict_partner(nature: str) -> Column:
    return mapping(F.coalesce(F.col(nature), F.lit("nan")), fv.CONFLICT_PARTNERS)


def size_table(spark: SparkSession) -> DataFrame:
    """The constant size list as a table: a few dozen rows."""
    return spark.createDataFrame([(k, w, le) for k, (w, le) in fv.VEHICLE_SIZES.items()], "vtype string, width double, length double")


def vehicle_dims(events: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Adds {role}_width and {role}_length from the type column of each role; then exchanges target
    and other object in secondary events, and back where a non-vehicle partner came out wider than 1 m."""
    sizes = size_table(events.sparkSession)
    for role, column in types.items():
        named = F.broadcast(sizes.selectExpr("vtype", f"width AS {role}_width", f"length AS {role}_length"))
        events = events.join(named, events[column] == named["vtype"], "left").drop("vtype")
    if "target" not in types or "other" not in types:
        return events

    def swap(df: DataFrame, cond: str) -> DataFrame:
        return with_exprs(df, {
            f"{a}_{d}": f"CASE WHEN {cond} THEN {b}_{d} ELSE {a}_{d} END"
            for a, b in (("target", "other"), ("other", "target")) for d in ("width", "length")})

    secondary = "event_category IN ('SecondaryNearCrash', 'SecondaryCrash')"
    kinds = ", ".join(f"'{k}'" for k in fv.NON_VEHICLES)
    events = swap(events, secondary)
    return swap(events, f"{secondary} AND ((first IN ({kinds}) AND target_width > 1) OR (second IN ({kinds}) AND other_width > 1))")


def impute_dims(meta: DataFrame) -> DataFrame:
    """Target size taken from the other object when incomplete; anything still missing gets the mean
    size of the ego vehicles."""
    short = "(target_width IS NULL OR target_length IS NULL)"
    df = meta.withColumns({
        "_w": meta.agg(F.avg("ego_width")).scalar(), "_l": meta.agg(F.avg("ego_length")).scalar()})
    df = with_exprs(df, {f"target_{d}": f"CASE WHEN {short} THEN other_{d} ELSE target_{d} END" for d in ("width", "length")})
    return with_exprs(df, {
        f"{o}_{d}": f"coalesce({o}_{d}, _{d[0]})" for o in ("ego", "target") for d in ("width", "length")}).drop("_w", "_l")


def scenario_dims(df: DataFrame, code: str = "veh_type_sur") -> DataFrame:
    """Sizes by object type code; the ego is a standard car."""
    cases = {}
    for i, d in enumerate(("length", "width")):
        whens = " ".join(f"WHEN {c} THEN {size[i]}D" for c, size in fv.SCENARIO_SIZES.items())
        cases[f"{d}_sur"] = f"CASE {code} {whens} ELSE {fv.DEFAULT_SIZE[i]}D END"
        cases[f"{d}_ego"] = f"{fv.DEFAULT_SIZE[i]}D"
    return with_exprs(df, cases)


def severity_conflict(meta: DataFrame, ignore_unseen: bool = True) -> DataFrame:
    """Severity of both parts of an event (crash 3, near-crash 2, other 1, absent 0) and the kind of
    conflict of the more severe part, the first on a tie. Kinds the radar cannot see count 0."""
    part = "CASE {0} WHEN 'Crash' THEN 3 WHEN 'NearCrash' THEN 2 ELSE 1 END"
    df = with_exprs(meta, {
        "severity_first": f"CASE WHEN event_category = 'Crash' THEN 3 WHEN event_category = 'NearCrash' THEN 2 "
                          f"WHEN event_category LIKE 'Secondary%' THEN 0 WHEN event_category LIKE '%-%' THEN "
                          f"{part.format('''substring_index(event_category, '-', 1)''')} END",
        "severity_second": f"CASE WHEN event_category IN ('Crash', 'NearCrash') THEN 0 WHEN event_category = 'SecondaryCrash' THEN 3 "
                           f"WHEN event_category = 'SecondaryNearCrash' THEN 2 WHEN event_category LIKE '%-%' THEN "
                           f"{part.format('''substring_index(event_category, '-', -1)''')} END"})
    if ignore_unseen:
        kinds = ", ".join(f"'{k}'" for k in fv.UNSEEN_PARTNERS)
        df = with_exprs(df, {f"severity_{o}": f"CASE WHEN {o} IN ({kinds}) THEN 0 ELSE severity_{o} END" for o in ("first", "second")})
    return with_exprs(df, {
        "conflict": "CASE WHEN event_category = 'SafeBaseline' OR (severity_first = 0 AND severity_second = 0) THEN 'none' "
                    "WHEN severity_second > severity_first THEN second ELSE first END"})


def eligible_events(meta: DataFrame) -> DataFrame:
    """Reconstructed events other than baselines, with start, end and impact times, a long enough
    target and a kind of conflict."""
    return meta.where(
        "event_category <> 'SafeBaseline' AND ego_reconstructed = 1 AND surrounding_reconstructed = 1 "
        "AND start_timestamp IS NOT NULL AND end_timestamp IS NOT NULL AND impact_timestamp IS NOT NULL "
        "AND duration_enough AND conflict <> 'none'")


def track_length_gate(frames: DataFrame, min_rows: int = 50) -> DataFrame:
    """Per event the longest target in rows, and whether it is long enough."""
    return (frames.groupBy("event_id", "target_id").agg(F.count(F.lit(1)).alias("n")).groupBy("event_id")
            .agg(F.max("n").alias("longest")).withColumn("duration_enough", F.col("longest") >= min_rows))


def environment_clean(events: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing conditions, and road surface 'Other', read 'Unknown'."""
    out = {c: f"coalesce({c}, 'Unknown')" for c in columns}
    if "surfaceCondition" in columns:
        out["surfaceCondition"] = "CASE WHEN surfaceCondition = 'Other' THEN 'Unknown' ELSE coalesce(surfaceCondition, 'Unknown') END"
    return with_exprs(events, out)


def restrict_to_scored(frames: DataFrame, scores: DataFrame, keys: Sequence[str] = ("event_id", "target_id", "k")) -> DataFrame:
    """Frames that have a score, each once whatever the number of its scores."""
    return frames.join(scores.select(*keys), list(keys), "left_semi")


def fill_flags(records: DataFrame, columns: Sequence[str] = ("danger_recorded", "safety_recorded")) -> DataFrame:
    return records.na.fill(False, subset=list(columns))


def parse_model_name(df: DataFrame, column: str = "model") -> DataFrame:
    """Training data, feature encoder and mix rate read from a model name."""
    acc = f"contains({column}, 'acc')"
    return with_exprs(df, {
        "dataset": f"substring_index({column}, '_current', 1)",
        "encoder": f"CASE WHEN {acc} THEN concat('current+acc', substring_index({column}, 'current+acc', -1)) "
                   f"ELSE concat('current', substring_index({column}, 'current', -1)) END",
        "mixrate": f"CASE WHEN contains({column}, '_mixed') THEN CAST(substring_index({column}, '_mixed', -1) AS DOUBLE) ELSE 0D END"})


def voting_models(df: DataFrame, column: str = "model") -> DataFrame:
    """Models that may vote: no UCD; mixtures only at 0.1 with ArgoverseHV and 1.0 with highD."""
    mixed = f"contains({column}, 'mixed')"
    return df.where(
        f"NOT contains({column}, 'UCD') AND NOT ({mixed} AND contains({column}, 'ArgoverseHV') AND NOT contains({column}, '0.1')) "
        f"AND NOT ({mixed} AND NOT contains({column}, 'ArgoverseHV') AND contains({column}, 'highD') AND NOT contains({column}, '1.0'))")


def event_sample(features: DataFrame, wanted: DataFrame) -> DataFrame:
    """Feature rows of the wanted pairs (event_id, target_id), or of single moments if k is given."""
    on = [c for c in ("event_id", "target_id", "k") if c in wanted.columns]
    return features.join(wanted.select(*on).distinct(), on, "left_semi")


# --- drone recordings ----------------------------------------------------------------------------

def recording_meta(meta: DataFrame) -> DataFrame:
    """Lane count from the marking text and the frame count of each recording; id bases as the next
    power of ten above the largest car and frame counts."""
    df = with_exprs(meta, {"lane_num": "CAST(length(lowerLaneMarkings) AS BIGINT) div 5", "numFrames": "CAST(frameRate * duration AS BIGINT)"})

    def base(column: str) -> Column:
        top = df.agg(F.max(column).cast("string").alias("_m"))
        return top.select(F.expr("CAST(pow(10, length(_m)) AS BIGINT)")).scalar()

    return df.withColumns({"trackid_base": base("numCars"), "frameid_base": base("numFrames")})


def rebase_ids(tracks: DataFrame, ids: Sequence[str] = ("track_id", "preceding_id", "following_id")) -> DataFrame:
    """Ids unique over all recordings; 0 (nobody) stays 0. Needs file_id and the two id bases."""
    out = {c: f"CASE WHEN {c} > 0 THEN file_id * trackid_base + {c} ELSE {c} END" for c in ids}
    return with_exprs(tracks, out | {"frame_id": "file_id * frameid_base + frame_id"})


def bbox_centre(tracks: DataFrame) -> DataFrame:
    """Corner positions moved to the centre of the box; the drone's width and height are our length and width."""
    return with_exprs(
        tracks.withColumnsRenamed({"width": "length", "height": "width"}), {"x": "x + length / 2D", "y": "y + width / 2D"})


def swap_axes(pairs: DataFrame) -> DataFrame:
    """x and y exchanged in positions, velocities, accelerations and headings of both road users."""
    names = {c: c for c in pairs.columns}
    for o in ("ego", "sur"):
        for v in ("", "v", "a", "h"):
            a, b = f"{v}x_{o}", f"{v}y_{o}"
            if a in names and b in names:
                names[a], names[b] = b, a
    return pairs.select(*[F.col(c).alias(names[c]) for c in pairs.columns]).select(*pairs.columns)


def polar_kinematics(df: DataFrame) -> DataFrame:
    """Speed, heading vector and acceleration along the heading, from velocity, acceleration and psi."""
    df = with_exprs(df, {"hx": "cos(psi)", "hy": "sin(psi)", "v": "sqrt(vx * vx + vy * vy)"})
    return with_exprs(df, {"acc": "ax * hx + ay * hy"})


def location_totals(meta: DataFrame) -> DataFrame:
    return meta.groupBy("locationId").agg(F.sum("numCars").alias("numCars"), F.sum("numTrucks").alias("numTrucks"))


def attribution_window(attribution: DataFrame, records: DataFrame) -> DataFrame:
    """Attribution rows inside the danger window of warned events ('warning') and more than 3 s before
    it for events with quiet objects ('safe')."""
    marks = records.select("event_id", (F.col("danger_start") / 1000).alias("_s"), (F.col("danger_end") / 1000).alias("_e"),
                           (F.col("true_warning") > 0.5).alias("_w"), (F.col("num_true_non_warning") > 0.5).alias("_n"))
    t = F.col("time")
    side = (F.when(F.col("_w") & t.between(F.col("_s"), F.col("_e")), "warning")
            .when(F.col("_n") & (t < F.col("_s") - 3), "safe"))
    return attribution.join(marks, "event_id", "inner").withColumn("side", side).where("side IS NOT NULL").drop("_s", "_e", "_w", "_n")
