"""Time-ordered tracks: alignment, pairing, views, context features and scenes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearmiss.functions.numeric import SMALL, angle, rotate, with_exprs, wrap
from nearmiss.session import cut_lineage
from nearmiss.operators.tracks import (
    block_window, number_ranges, number_rows, own_rows, spread_blocks, time_chunk,
)

HISTORY = 25          # rows of history per scene: 2.5 s at 10 Hz
MIN_EVENT_TRACK = 30  # rows a target needs before it is scored
MIN_SCENE_TRACK = 35  # rows a target needs before scenes are sampled
STRIDES = {"highD": 8, "SafeBaseline": 10, "ArgoverseHV": 25}
SEED = 131
PAIR = ("event_id", "target_id")

CURRENT = ("l_ego", "l_sur", "combined_width", "vy_ego", "vx_sur", "vy_sur", "v_ego2", "v_sur2",
           "delta_v2", "delta_v", "psi_sur", "acc_ego", "rho")


# --- pairing -----------------------------------------------------------------------------------

def pair_frames(ego: DataFrame, sur: DataFrame) -> DataFrame:
    """Ego and surrounding rows of the same event and moment side by side.

    The join key includes the moment, so a long event spreads over all tasks.
    """
    on = ["event_id", "k"]
    named_ego = ego.select(*on, *[F.col(c).alias(f"{c}_ego") for c in ego.columns if c not in on])
    kept = [c for c in sur.columns if c not in (*on, "target_id")]
    named_sur = sur.select(*on, "target_id", *[F.col(c).alias(f"{c}_sur") for c in kept])
    return named_ego.join(named_sur, on, "inner")


def lane_changers(tracks: DataFrame) -> DataFrame:
    """Tracks seen on more than one lane."""
    return tracks.groupBy("track_id").agg(F.count_distinct("lane_id").alias("lanes")).where("lanes > 1")


def interaction_pairs(tracks: DataFrame, min_common: int = HISTORY, first_id: int = 0) -> DataFrame:
    """Lane-changing tracks paired with every vehicle they followed or led, on common moments.

    Columns expected: track_id, k, lane_id, preceding_id, following_id and the motion columns.
    """
    changers = lane_changers(tracks).select("track_id")
    roles = F.array(
        F.struct(F.lit(0).alias("role"), F.col("preceding_id").alias("partner_id")),
        F.struct(F.lit(1).alias("role"), F.col("following_id").alias("partner_id")))
    partners = (
        tracks.join(changers, "track_id", "left_semi")
        .select("track_id", "k", F.explode(roles).alias("p")).select("track_id", "k", "p.*")
        .where("partner_id > 0")
        .groupBy("track_id", "role", "partner_id").agg(F.min("k").alias("first_k"))
    )
    # a track qualifies only with at least one vehicle in front and one behind
    both = partners.groupBy("track_id").agg(F.count_distinct("role").alias("r")).where("r = 2")
    partners = partners.join(both.select("track_id"), "track_id", "left_semi")

    motion = [c for c in tracks.columns
              if c not in ("track_id", "k", "lane_id", "preceding_id", "following_id")]
    links = partners.select("track_id", "partner_id").distinct()
    here = links.join(tracks.select("track_id", "k"), "track_id", "inner")
    there = tracks.select(F.col("track_id").alias("partner_id"), "k")
    long_enough = (
        here.join(there, ["partner_id", "k"], "inner")
        .groupBy("track_id", "partner_id").agg(F.count(F.lit(1)).alias("common"))
        .where(F.col("common") >= min_common)
    )
    numbered = number_ranges(
        partners.join(long_enough, ["track_id", "partner_id"], "inner"),
        ["track_id", "role", "first_k", "partner_id"], idx="lc_id")
    # a vehicle that is both ahead and behind at times keeps its first number
    pair_ids = numbered.groupBy("track_id", "partner_id").agg((F.min("lc_id") + first_id).alias("lc_id"))

    ego = pair_ids.join(
        tracks.select("track_id", "k", *[F.col(c).alias(f"{c}_ego") for c in motion]), "track_id")
    sur = tracks.select(
        F.col("track_id").alias("partner_id"), "k", *[F.col(c).alias(f"{c}_sur") for c in motion])
    return ego.join(sur, ["partner_id", "k"], "inner").withColumnsRenamed(
        {"track_id": "track_id_ego", "partner_id": "track_id_sur"})


# --- views and features ------------------------------------------------------------------------

def to_view(pairs: DataFrame, view: str, objects: DataFrame | None = None) -> DataFrame:
    """Pair frames in the frame of the ego, of the relative velocity, or of the surrounding object.

    With `objects` (event_id, target_id, k, object_id, x, y, hx, hy[, vx, vy]) the same move is
    applied to other objects present at that moment, returned in place of the pairs.
    """
    if view not in ("ego", "relative", "sur"):
        raise ValueError(f"unknown view {view}")
    df = pairs
    if view == "sur":
        swap = {c: c[:-4] + ("_sur" if c.endswith("_ego") else "_ego")
                for c in df.columns if c.endswith(("_ego", "_sur"))}
        df = df.select(*[F.col(c).alias(swap.get(c, c)) for c in df.columns])
    if "vx_ego" not in df.columns:
        df = with_exprs(df, {f"v{c}_{o}": f"v_{o} * h{c}_{o}" for o in ("ego", "sur") for c in "xy"})
    if view == "relative":
        still = "vx_ego = vx_sur AND vy_ego = vy_sur"
        axis = {"_ax": f"CASE WHEN {still} THEN hx_ego ELSE vx_ego - vx_sur END",
                "_ay": f"CASE WHEN {still} THEN hy_ego ELSE vy_ego - vy_sur END"}
    else:
        axis = {"_ax": "hx_ego", "_ay": "hy_ego"}
    df = with_exprs(df, axis)
    if objects is not None:
        origin = df.select(*PAIR, "k", "_ax", "_ay", F.col("x_ego").alias("_ox"), F.col("y_ego").alias("_oy"))
        moved = objects.join(origin, [*PAIR, "k"], "inner")
        out = dict(zip(("x", "y"), rotate("_ax", "_ay", "(x - _ox)", "(y - _oy)")))
        out |= dict(zip(("hx", "hy"), rotate("_ax", "_ay", "hx", "hy")))
        if "vx" in objects.columns:
            out |= dict(zip(("vx", "vy"), rotate("_ax", "_ay", "vx", "vy")))
        return with_exprs(moved, out).drop("_ax", "_ay", "_ox", "_oy")
    out = {"x_ego": "0D", "y_ego": "0D"}
    out |= dict(zip(("x_sur", "y_sur"), rotate("_ax", "_ay", "(x_sur - x_ego)", "(y_sur - y_ego)")))
    for o in ("ego", "sur"):
        for v in ("h", "v", "a"):
            if f"{v}x_{o}" in df.columns:
                out |= dict(zip((f"{v}x_{o}", f"{v}y_{o}"),
                                rotate("_ax", "_ay", f"{v}x_{o}", f"{v}y_{o}")))
    out["vy_ego"] = f"abs({out['vy_ego']})"
    return with_exprs(df, out).drop("_ax", "_ay")


def current_features(pairs: DataFrame) -> DataFrame:
    """Thirteen context features and the spacing s of each pair frame, added to the frame."""
    vx = {o: f"(v_{o} * hx_{o})" for o in ("ego", "sur")}
    vy = {o: f"(v_{o} * hy_{o})" for o in ("ego", "sur")}
    df = with_exprs(pairs, {
        "_vxe": vx["ego"], "_vye": vy["ego"], "_vxs": vx["sur"], "_vys": vy["sur"]})
    still = "_vxe = _vxs AND _vye = _vys"
    df = with_exprs(df, {
        "_rx": f"CASE WHEN {still} THEN hx_ego ELSE _vxe - _vxs END",
        "_ry": f"CASE WHEN {still} THEN hy_ego ELSE _vye - _vys END"})
    ego_v = rotate("hx_ego", "hy_ego", "_vxe", "_vye")
    sur_v = rotate("hx_ego", "hy_ego", "_vxs", "_vys")
    sur_h = rotate("hx_ego", "hy_ego", "hx_sur", "hy_sur")
    sur_p = rotate("_rx", "_ry", "(x_sur - x_ego)", "(y_sur - y_ego)")
    df = with_exprs(df, {
        "l_ego": "length_ego", "l_sur": "length_sur", "combined_width": "0.5D * (width_ego + width_sur)",
        "vy_ego": f"abs({ego_v[1]})", "vx_sur": sur_v[0], "vy_sur": sur_v[1],
        "v_ego2": "_vxe * _vxe + _vye * _vye", "v_sur2": "_vxs * _vxs + _vys * _vys",
        "delta_v2": "pow(_vxe - _vxs, 2) + pow(_vye - _vys, 2)",
        "_hx": sur_h[0], "_hy": sur_h[1], "_px": sur_p[0], "_py": sur_p[1]})
    df = with_exprs(df, {
        # speeds of equal square up to rounding count as equal
        "delta_v": "sqrt(delta_v2) * CASE WHEN abs(v_ego2 - v_sur2) < 1e-9D THEN 0D "
                   "ELSE signum(v_ego2 - v_sur2) END",
        # _turn is kept under its own name: psi_sur of the input is the global heading
        "_turn": angle("0D", "1D", "_hx", "_hy"),
        "rho": angle("1D", "0D", "_px", "_py"),
        "s": f"greatest(sqrt(_px * _px + _py * _py), {SMALL}D)"})
    names = [c for c in pairs.columns if c not in (*CURRENT, "s")]
    return df.select(*names, *[F.col("_turn" if c == "psi_sur" else c).alias(c) for c in CURRENT], "s")


def feature_set(features: DataFrame, name: str, log_spacing: bool = False) -> DataFrame:
    """Key columns plus the chosen feature columns: 'current' or 'current+acc', optionally followed
    by '_environment' and '_profiles'."""
    parts = name.split("_")
    if parts[0] not in ("current", "current+acc"):
        raise ValueError(f"unknown feature set {name}")
    cols = [c for c in CURRENT if c != "acc_ego" or parts[0] == "current+acc"]
    cols += [p for p in ("environment", "profiles") if p in parts[1:]]
    floored = F.greatest(F.col("s"), F.lit(SMALL))
    keys = [c for c in ("event_id", "target_id", "k", "time", "scene_id") if c in features.columns]
    return features.select(*keys, *cols, (F.ln(floored) if log_spacing else floored).alias("s"))


# --- windows over numbered tracks ----------------------------------------------------------------

def unwrap_angle(df: DataFrame, keys: Sequence[str], column: str, out: str, order: str = "k") -> DataFrame:
    """Angle with jumps of more than half a turn removed, cumulated along the track."""
    keys = list(keys)
    numbered = number_rows(df, keys, [order], time_chunk(order), idx="_i")
    w = block_window(keys, "_i")
    step = own_rows(spread_blocks(numbered, "_i", before=1).withColumn(
        "_d", F.col(column) - F.lag(column).over(w)))
    wrapped = wrap("_d")
    step = with_exprs(step, {
        "_fix": f"CASE WHEN _d IS NULL OR abs(_d) < pi() THEN 0D "
                f"WHEN {wrapped} = -pi() AND _d > 0D THEN pi() - _d ELSE {wrapped} - _d END"})
    summed = number_rows(step, keys, ["_i"], time_chunk("_i"), idx="_again", sums={"_fixed": F.col("_fix")})
    return summed.withColumn(out, F.col(column) + F.col("_fixed")).select(*df.columns, out)


def _gradient(y_next: str, y_prev: str, t_next: str, t_prev: str) -> str:
    """Derivative from the steps to both neighbours (differences, not values); one-sided at the ends."""
    return (f"CASE WHEN {t_prev} IS NULL THEN {y_next} / {t_next} WHEN {t_next} IS NULL THEN {y_prev} / {t_prev} "
            f"ELSE ({t_prev} * {t_prev} * {y_next} + {t_next} * {t_next} * {y_prev}) "
            f"/ ({t_prev} * {t_next} * ({t_prev} + {t_next})) END")


def gradient(df: DataFrame, keys: Sequence[str], y: str, t: str, out: str, order: str = "k") -> DataFrame:
    """dy/dt along each track: second-order for uneven spacing inside, first-order at both ends."""
    keys = list(keys)
    numbered = number_rows(df, keys, [order], time_chunk(order), idx="_i")
    w = block_window(keys, "_i")
    near = own_rows(spread_blocks(numbered, "_i", before=1, after=1).withColumns({
        "_yn": F.lead(y).over(w) - F.col(y), "_yp": F.col(y) - F.lag(y).over(w),
        "_tn": F.lead(t).over(w) - F.col(t), "_tp": F.col(t) - F.lag(t).over(w)}))
    return with_exprs(near, {out: _gradient("_yn", "_yp", "_tn", "_tp")}).select(*df.columns, out)


def numbered_pairs(pairs: DataFrame) -> DataFrame:
    """Pair frames with their position idx in the pair's track and its length n."""
    return number_rows(pairs, PAIR, ["k"], time_chunk(), total="n")


def history_profile(numbered: DataFrame, steps: int = HISTORY) -> DataFrame:
    """Adds `profiles`: the `steps` rows before each row, oldest first, of turn rate, ego speed and
    the surrounding object's velocity as seen by the ego."""
    w = block_window(PAIR)
    sur_v = rotate("hx_ego", "hy_ego", "(v_sur * hx_sur)", "(v_sur * hy_sur)")
    df = with_exprs(spread_blocks(numbered, before=steps + 1), {
        "_psi": angle("0D", "1D", "hx_ego", "hy_ego"), "_vx": sur_v[0], "_vy": sur_v[1]})
    df = df.withColumns({
        "_yn": F.lead("_psi").over(w) - F.col("_psi"), "_yp": F.col("_psi") - F.lag("_psi").over(w),
        "_tn": F.lead("time").over(w) - F.col("time"), "_tp": F.col("time") - F.lag("time").over(w)})
    # the derivative of the unwrapped heading needs only the wrapped steps to both neighbours
    df = with_exprs(df, {"_yn": wrap("_yn"), "_yp": wrap("_yp")})
    df = with_exprs(df, {"_yaw": _gradient("_yn", "_yp", "_tn", "_tp")})
    row = F.struct(
        F.col("_yaw").alias("yaw_ego"), F.abs("v_ego").alias("v_ego"),
        F.col("_vx").alias("vx_sur"), F.col("_vy").alias("vy_sur"))
    df = df.withColumn("profiles", F.collect_list(row).over(w.rowsBetween(-steps, -1)))
    return own_rows(df).select(*numbered.columns, "profiles")


def _has_gap(columns: Sequence[str]) -> Column:
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.col(c).isNull() | F.isnan(c)
    return cond


def every_frame_scenes(pairs: DataFrame, min_rows: int = MIN_EVENT_TRACK) -> DataFrame:
    """A scene at every frame with a full history, for targets seen long enough."""
    numbered = numbered_pairs(pairs).where(F.col("n") >= min_rows)
    scenes = history_profile(numbered).where(F.col("idx") > HISTORY)
    return current_features(scenes)


def sample_scenes(pairs: DataFrame, stride: int, seed: int = SEED, min_rows: int = MIN_SCENE_TRACK) -> DataFrame:
    """Scenes every `stride` frames back from a seeded end of each track, numbered densely.

    Scenes with a missing value in the row, its features or its history are left out.
    """
    numbered = numbered_pairs(pairs).where(F.col("n") >= min_rows)
    scenes = history_profile(numbered)
    scenes = scenes.withColumn("_end", F.col("n") - random_end(seed))
    scenes = scenes.where(
        (F.col("idx") > HISTORY) & (F.col("idx") <= F.col("_end"))
        & (F.pmod(F.col("_end") - F.col("idx"), F.lit(stride)) == 0))
    scenes = current_features(scenes)
    bad_history = F.exists("profiles", lambda p: p["yaw_ego"].isNull() | p["v_ego"].isNull()
                           | p["vx_sur"].isNull() | p["vy_sur"].isNull())
    # the numbering samples the scenes first, so they are worked out once and stored
    scenes = cut_lineage(scenes.where(~_has_gap([*CURRENT, "s"]) & ~bad_history), "scenes")
    return number_ranges(scenes.drop("_end"), ["event_id", "target_id", F.desc("idx")], idx="scene_id")


def random_end(seed: int) -> Column:
    """1..5, fixed per target by a hash."""
    text = F.concat_ws("-", F.col("target_id").cast("string"), F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long") % 5 + 1)


def dense_ids(df: DataFrame, key: str, out: str, first_id: int = 0) -> DataFrame:
    """Running id of each distinct key value in key order, starting at first_id."""
    ids = number_ranges(df.select(key).distinct(), [key], idx="_id")
    return df.join(ids.select(key, (F.col("_id") + first_id).alias(out)), key, "inner")


def topn_per_group(df: DataFrame, group: str, order: str, n: int, special: dict[str, int] | None = None) -> DataFrame:
    """First n rows per group in id order; `special` gives other sizes to named groups."""
    limit = F.lit(n)
    for name, size in (special or {}).items():
        limit = F.when(F.col(group) == name, size).otherwise(limit)
    w = Window.partitionBy(group).orderBy(order)
    largest = max([n, *(special or {}).values()])
    # the constant bound lets each task drop surplus rows before the shuffle
    ranked = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= largest)
    return ranked.where(F.col("_rn") <= limit).drop("_rn")


def dedupe_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def settle_slice(df: DataFrame, first: int = 15, last: int = 64, min_rows: int = 35,
                 keys: Sequence[str] = PAIR) -> DataFrame:
    """Rows first..last of each target, for targets with at least min_rows rows."""
    keys = list(keys)
    enough = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    w = Window.partitionBy(*keys).orderBy("k")
    # bounded rank: every task keeps at most last+1 rows per target before the shuffle
    early = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= last + 1)
    return early.where(F.col("_rn") > first).join(enough.select(*keys), keys, "left_semi").drop("_rn")


def moving_flag(df: DataFrame, keys: Sequence[str], order: str = "k") -> DataFrame:
    """True where the position differs from the previous row; the first row counts as standing."""
    keys = list(keys)
    numbered = number_rows(df, keys, [order], time_chunk(order), idx="_i")
    w = block_window(keys, "_i")
    near = spread_blocks(numbered, "_i", before=1).withColumn("moving", F.coalesce(
        (F.col("x") != F.lag("x").over(w)) | (F.col("y") != F.lag("y").over(w)), F.lit(False)))
    return own_rows(near).select(*df.columns, "moving")


def initial_heading(df: DataFrame, keys: Sequence[str], order: str = "k") -> DataFrame:
    """Heading of the first non-zero displacement over two rows, one value per track."""
    keys = list(keys)
    numbered = number_rows(df, keys, [order], time_chunk(order), idx="_i")
    w = block_window(keys, "_i")
    near = own_rows(spread_blocks(numbered, "_i", before=2).withColumns({
        "_dx": F.col("x") - F.lag("x", 2).over(w), "_dy": F.col("y") - F.lag("y", 2).over(w)}))
    return (near.where("_dx <> 0 OR _dy <> 0").groupBy(*keys)
            .agg(F.min_by(F.atan2("_dy", "_dx"), F.col("_i")).alias("psi0")))


def yaw_integral(df: DataFrame, keys: Sequence[str], rate: str, t: str, out: str,
                 reverse: bool = False, order: str = "k") -> DataFrame:
    """Heading from the summed turn rate, wrapped; in reverse it is shifted to end at zero."""
    keys = list(keys)
    numbered = number_rows(df, keys, [order], time_chunk(order), idx="_i", total="_n")
    w = block_window(keys, "_i")
    near = own_rows(spread_blocks(numbered, "_i", before=1, after=1).withColumns({
        "_tn": F.lead(t).over(w) - F.col(t), "_tp": F.col(t) - F.lag(t).over(w)}))
    # spacing of the samples: mean of both neighbours' steps, one step at the ends
    near = with_exprs(near, {"_dt": "CASE WHEN _tp IS NULL THEN _tn WHEN _tn IS NULL THEN _tp ELSE 0.5D * (_tp + _tn) END"})
    summed = number_rows(near, keys, ["_i"], time_chunk("_i"), idx="_again",
                         sums={"_yaw": F.col(rate) * F.col("_dt")})
    summed = with_exprs(summed, {out: wrap("_yaw")})
    if not reverse:
        return summed.select(*df.columns, out)
    last = summed.where("_i = _n - 1").select(*keys, F.col(out).alias("_last"))
    return summed.join(last, keys, "inner").withColumn(out, F.col(out) - F.col("_last")).select(*df.columns, out)


# --- common time grid ----------------------------------------------------------------------------

def neighbours(df: DataFrame, keys: Sequence[str], columns: Sequence[str], k: str = "k", before: bool = True) -> DataFrame:
    """For each row and column c the next observed moment and value after the row (`_nk_c`, `_ny_c`) and, with `before`,
    the last ones up to and with the row (`_pk_c`, `_py_c`); also the moment of the next row (`_next`).

    Rows are scanned inside blocks of time. One summary row per block, found by partial aggregation, hands in what was
    last seen before the block and what comes first after it, so rows are shuffled once, for all columns together. A
    track has one row per moment; NULL and NaN are not observed.
    """
    keys, block = list(keys), "_block"
    at = {c: F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), F.col(k)) for c in columns}
    value = {c: F.when(at[c].isNotNull(), F.col(c).cast("double")) for c in columns}
    rows = df.withColumn(block, time_chunk(k))
    found = {"f": F.min_by, "l": F.max_by} if before else {"f": F.min_by}
    per = rows.groupBy(*keys, block).agg(
        F.min(k).alias("_start"),
        *[(F.min if e == "f" else F.max)(at[c]).alias(f"_{e}k_{c}") for c in columns for e in found],
        *[by(value[c], at[c]).alias(f"_{e}y_{c}") for c in columns for e, by in found.items()])
    # frames that only grow: later rows are met first in the reversed order
    past = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    coming = Window.partitionBy(*keys).orderBy(F.desc(block)).rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(
        *[F.col(c).alias(f"_c_{c}") for c in [*keys, block]], F.last("_start").over(coming).alias("_after"),
        *[F.last(f"_f{x}_{c}", ignorenulls=True).over(coming).alias(f"_out{x}_{c}") for c in columns for x in "ky"],
        *([F.last(f"_l{x}_{c}", ignorenulls=True).over(past).alias(f"_in{x}_{c}") for c in columns for x in "ky"] if before else []))
    same = [rows[c].eqNullSafe(carried[f"_c_{c}"]) for c in [*keys, block]]
    joined = rows.join(carried, same, "inner").drop(*[f"_c_{c}" for c in [*keys, block]])
    upto = Window.partitionBy(*keys, block).orderBy(k).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*keys, block).orderBy(F.desc(k)).rowsBetween(Window.unboundedPreceding, -1)
    scans = {"_next": F.coalesce(F.last(k).over(later), F.col("_after"))}
    for c in columns:
        for x, source in (("k", at[c]), ("y", value[c])):
            scans[f"_n{x}_{c}"] = F.coalesce(F.last(source, ignorenulls=True).over(later), F.col(f"_out{x}_{c}"))
            if before:
                scans[f"_p{x}_{c}"] = F.coalesce(F.last(source, ignorenulls=True).over(upto), F.col(f"_in{x}_{c}"))
    return joined.select(*df.columns, *[e.alias(n) for n, e in scans.items()])


def regrid_interpolate(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], kept: Sequence[str] = ("timestamp",), k: str = "k"
) -> DataFrame:
    """Tracks on the full 0.1 s grid from first to last moment, the last one excluded.

    Missing values are filled linearly from the neighbouring observations of the same column and
    held flat at both ends; moments that were not observed carry timestamp -1. A column without any
    observation stays NULL, and a track without any has no rows.
    """
    keys, kept = list(keys), [c for c in kept if c != "timestamp"] + [c for c in kept if c == "timestamp"]
    near = neighbours(df.select(*keys, k, *columns, *kept), keys, columns, k).where(F.col("_next") > F.col(k))
    grid = near.withColumn("_g", F.explode(F.sequence(F.col(k), F.col("_next") - 1)))
    filled = {c: F.expr(
        f"CASE WHEN `_pk_{c}` IS NULL THEN `_ny_{c}` WHEN `_nk_{c}` IS NULL OR _g <= `_pk_{c}` THEN `_py_{c}` "
        f"ELSE `_py_{c}` + (`_ny_{c}` - `_py_{c}`) / (`_nk_{c}` - `_pk_{c}`) * (_g - `_pk_{c}`) END") for c in columns}
    seen = {c: F.when(F.col("_g") == F.col(k), F.col(c)) for c in kept}
    if "timestamp" in seen:
        seen["timestamp"] = F.coalesce(seen["timestamp"], F.lit(-1).cast("long"))
    out = grid.select(*keys, F.col("_g").alias(k), *[e.alias(c) for c, e in (filled | seen).items()])
    return out.where(F.coalesce(*columns).isNotNull())


def resample_25_to_10(
    tracks: DataFrame, columns: Sequence[str], codes: Sequence[str], partners: Sequence[str]
) -> DataFrame:
    """25 Hz tracks (track_id, frame_id) at 10 Hz: values linear on half frames, every fifth kept.

    Codes are truncated to integers; partner ids snap to the closest id the track ever saw, the
    earliest seen on a tie.
    """
    every = [*columns, *codes, *partners]
    near = neighbours(tracks.select("track_id", "frame_id", *every), ["track_id"], every, "frame_id", before=False)
    # the grid holds each frame and the half frame after it, nothing inside a longer gap; of two such half-frame
    # numbers at most one is a multiple of five
    half = near.withColumn("_g", F.ceil(F.col("frame_id") * 2 / F.lit(5.0)).cast("long")).where("_g * 5 <= frame_id * 2 + 1")
    wide = half.select("track_id", F.col("_g").alias("frame_id"), *[F.expr(
        f"CASE WHEN isnan(CAST(`{c}` AS DOUBLE)) THEN NULL WHEN `_nk_{c}` IS NULL OR _g * 5 <= frame_id * 2 THEN CAST(`{c}` AS DOUBLE) "
        f"ELSE `{c}` + (`_ny_{c}` - `{c}`) / (`_nk_{c}` - frame_id) * (_g * 2.5D - frame_id) END").alias(c) for c in every])
    wide = wide.where(F.coalesce(*every).isNotNull())
    wide = wide.withColumns({c: F.col(c).cast("int") for c in codes})
    for p in partners:
        seen = tracks.groupBy("track_id", F.col(p).alias("_seen")).agg(F.min("frame_id").alias("_first"))
        # few distinct values per track: ids it saw, and midpoints where the id changed
        snapped = (
            wide.select("track_id", p).distinct().join(seen, "track_id", "inner")
            .groupBy("track_id", p)
            .agg(F.min_by("_seen", F.struct(F.abs(F.col(p) - F.col("_seen")), F.col("_first"))).alias("_id")))
        wide = wide.join(snapped, ["track_id", p], "inner").drop(p).withColumnRenamed("_id", p)
    return wide
