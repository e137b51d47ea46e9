"""Recursive track filters, object reconnection and the filter parameter search.

A filter is sequential in time but independent between tracks. Each task takes its tracks sorted by
position in the track, so all rows of one time step arrive together and are filtered as one array
operation. A task holds one small state per track and one Arrow batch, never a whole track.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearmiss.functions import fixed_values as fv
from nearmiss.functions.numeric import with_exprs
from nearmiss.operators.clean import edge_speed_valid
from nearmiss.operators.frames import initial_heading, moving_flag
from nearmiss.operators.tracks import number_rows, time_chunk
from nearmiss.session import cut_lineage

STRAIGHT = 1e-3     # rad/s, below this the path counts as straight
FORWARD_BONUS = 0.02
EGO_STATE = ("x_ekf", "y_ekf", "psi_ekf", "v_ekf", "omega_ekf", "acc_ekf")
OBJECT_STATE = ("x_ekf", "y_ekf", "v_ekf", "psi_ekf")


def _wrap(a):
    return (a + np.pi) % (2 * np.pi) - np.pi


def predict_turning(x, dt):
    """Next state and Jacobian at constant turn rate and acceleration; state x, y, heading, speed,
    turn rate, acceleration in the last axis."""
    psi, v, w, a = x[..., 2], x[..., 3], x[..., 4], x[..., 5]
    turning = np.abs(w) >= STRAIGHT
    ws = np.where(turning, w, 1.0)
    psi1, v1 = psi + w * dt, v + a * dt
    s0, c0, s1, c1 = np.sin(psi), np.cos(psi), np.sin(psi1), np.cos(psi1)
    run = v * dt + 0.5 * a * dt ** 2
    nx = v1 * ws * s1 + a * c1 - v * ws * s0 - a * c0
    ny = -v1 * ws * c1 + a * s1 + v * ws * c0 - a * s0
    dx = np.where(turning, nx / ws ** 2, c0 * run)
    dy = np.where(turning, ny / ws ** 2, s0 * run)
    nxt = np.stack([x[..., 0] + dx, x[..., 1] + dy, _wrap(psi1), v1, w, a], axis=-1)
    j = np.broadcast_to(np.eye(6), (*x.shape[:-1], 6, 6)).copy()
    j[..., 0, 2], j[..., 1, 2] = -dy, dx
    j[..., 0, 3] = np.where(turning, (s1 - s0) / ws, c0 * dt)
    j[..., 1, 3] = np.where(turning, (c0 - c1) / ws, s0 * dt)
    gx = v1 * s1 + v1 * ws * dt * c1 - a * dt * s1 - v * s0
    gy = -v1 * c1 + v1 * ws * dt * s1 + a * dt * c1 + v * c0
    j[..., 0, 4] = np.where(turning, gx / ws ** 2 - 2 * nx / ws ** 3, 0.0)
    j[..., 1, 4] = np.where(turning, gy / ws ** 2 - 2 * ny / ws ** 3, 0.0)
    j[..., 0, 5] = np.where(turning, (dt * ws * s1 + c1 - c0) / ws ** 2, 0.5 * c0 * dt ** 2)
    j[..., 1, 5] = np.where(turning, (-dt * ws * c1 + s1 - s0) / ws ** 2, 0.5 * s0 * dt ** 2)
    j[..., 2, 4] = j[..., 3, 5] = dt
    return nxt, j


def predict_straight(x, dt):
    """Next state and Jacobian at constant heading and speed; state x, y, speed, heading."""
    v, psi = x[..., 2], _wrap(x[..., 3])
    c, s = np.cos(x[..., 3]), np.sin(x[..., 3])
    nxt = np.stack([x[..., 0] + dt * v * c, x[..., 1] + dt * v * s, v, psi], axis=-1)
    j = np.broadcast_to(np.eye(4), (*x.shape[:-1], 4, 4)).copy()
    j[..., 0, 2], j[..., 0, 3] = dt * np.cos(psi), -dt * v * np.sin(psi)
    j[..., 1, 2], j[..., 1, 3] = dt * np.sin(psi), dt * v * np.cos(psi)
    return nxt, j


def correct(x, p, z, noise, seen):
    """Measurement update where the states `seen` (a slice) are measured directly."""
    s = p[..., seen, seen] + noise
    gain = np.swapaxes(np.linalg.solve(s, p[..., seen, :]), -1, -2)
    x = x + (gain @ (z - x[..., seen])[..., None])[..., 0]
    return x, p - gain @ p[..., seen, :]


def _diag(values):
    """Stack of diagonal matrices from the last axis."""
    values = np.asarray(values, dtype=float)
    return values[..., None] * np.eye(values.shape[-1])


class EgoFilter:
    columns = ("speed_comp", "yaw_rate", "acc_lon")
    size, seen = 6, slice(3, 6)

    def __init__(self, p: Mapping[str, np.ndarray]):
        self.p = {k: np.asarray(v, dtype=float) for k, v in p.items()}
        self.noise = _diag(np.stack([self.p["uncertainty_speed"], self.p["uncertainty_omega"], self.p["uncertainty_acc"]], -1))

    def start(self, z):
        x = np.concatenate([np.zeros((*z.shape[:-1], 3)), z], axis=-1)
        return x, self.p["uncertainty_init"][..., None, None] * np.broadcast_to(np.eye(6), (*z.shape[:-1], 6, 6))

    def step(self, x, p, z, dt, first):
        q = self.p
        nxt, j = predict_turning(x, dt)
        pos = 0.5 * q["max_acc"] * dt ** 2
        spread = np.stack(np.broadcast_arrays(pos, pos, q["max_yaw_rate"] * dt, q["max_acc"] * dt, q["max_yaw_acc"] * dt, q["max_jerk"] * dt), -1)
        pn = j @ p @ np.swapaxes(j, -1, -2) + _diag(spread ** 2)
        xn, pn = correct(nxt, pn, z, self.noise, self.seen)
        xn[..., 3] = np.maximum(xn[..., 3], 0.0)
        # the first row is the starting state itself
        keep = first.reshape(first.shape + (1,) * (xn.ndim - first.ndim))
        return np.where(keep, x, xn), np.where(keep[..., None], p, pn)


class ObjectFilter:
    columns = ("x", "y", "speed_comp", "psi0", "update")
    size, seen = 4, slice(0, 3)

    def __init__(self, p: Mapping[str, np.ndarray], clip: bool = True):
        self.p = {k: np.asarray(v, dtype=float) for k, v in p.items()}
        self.clip = clip
        u, s = self.p["uncertainty_pos"], self.p["uncertainty_speed"]
        self.noise = _diag(np.stack([u, u, s], -1))

    def start(self, z):
        return z[..., :4].copy(), self.p["uncertainty_init"][..., None, None] * np.broadcast_to(np.eye(4), (*z.shape[:-1], 4, 4))

    def step(self, x, p, z, dt, first):
        q = self.p
        nxt, j = predict_straight(x, dt)
        pos = 0.5 * q["max_acc"] * dt ** 2
        spread = np.stack(np.broadcast_arrays(pos, pos, q.get("noise_speed", q["max_acc"]) * dt, q["max_yaw_rate"] * dt), -1)
        pn = j @ p @ np.swapaxes(j, -1, -2) + _diag(spread ** 2)
        xn, pc = correct(nxt, pn, z[..., :3], self.noise, self.seen)
        if self.clip:
            xn[..., 2] = np.maximum(xn[..., 2], 0.0)
        use = z[..., 4] > 0.5
        return np.where(use[..., None], xn, nxt), np.where(use[..., None, None], pc, pn)


def _steps(batches: Iterator[pd.DataFrame], keys: Sequence[str], model, width: int = 0):
    """Feeds the sorted rows of a task through the filter, one time step at a time. Yields each batch
    with its estimates; with `width` parameter sets every row is filtered under all of them."""
    slots: dict[tuple, int] = {}
    x = p = None
    for pdf in batches:
        z_all = pdf[list(model.columns)].to_numpy(dtype=float)
        idx = pdf["idx"].to_numpy()
        dts = pdf["dt"].to_numpy(dtype=float)
        ids = list(zip(*[pdf[k].to_numpy() for k in keys]))
        slot = np.array([slots.setdefault(i, len(slots)) for i in ids], dtype=int)
        est = np.empty((len(pdf), *((width,) if width else ()), model.size))
        cuts = np.flatnonzero(np.diff(idx)) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(pdf)]):
            if lo == hi:
                continue
            z, dt, at = z_all[lo:hi], dts[lo:hi], slot[lo:hi]
            if width:
                z = np.broadcast_to(z[:, None, :], (len(z), width, z.shape[1]))
                dt = dt[:, None]
            x0, p0 = model.start(z)
            if x is None:
                x, p = np.zeros((0, *x0.shape[1:])), np.zeros((0, *p0.shape[1:]))
            if len(slots) > len(x):
                room = max(len(slots) - len(x), len(x))
                x = np.concatenate([x, np.zeros((room, *x.shape[1:]))])
                p = np.concatenate([p, np.zeros((room, *p.shape[1:]))])
            first = idx[lo:hi] == 0
            x[at[first]], p[at[first]] = x0[first], p0[first]
            x[at], p[at] = model.step(x[at], p[at], z, dt, first)
            est[lo:hi] = x[at]
        yield pdf, est


def _run(rows: DataFrame, keys: Sequence[str], make, outputs: Sequence[str]) -> DataFrame:
    keys = list(keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    schema += "".join(f", {c} double" for c in outputs)

    def task(batches):
        for pdf, est in _steps(batches, keys, make()):
            yield pdf.assign(**{c: est[:, i] for i, c in enumerate(outputs)})

    # one shuffle by track; the sort puts rows of the same step next to each other
    placed = rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions("idx", *keys)
    return placed.mapInPandas(task, schema)


def _ego_measurements(frames: DataFrame, reverse: bool) -> DataFrame:
    rows = number_rows(frames, ["event_id"], ["k"], time_chunk(), total="_n")
    rows = with_exprs(rows, {
        "idx": "_n - 1 - idx" if reverse else "idx", "dt": "-0.1D" if reverse else "0.1D",
        "raw_speed": "speed_comp", "speed_comp": "greatest(speed_comp, 0D)",
        "acc_lon": "CASE WHEN acc_lon > 0D AND speed_comp <= 0D THEN 0D ELSE acc_lon END"})
    return rows.drop("_n")


def filter_ego_tracks(frames: DataFrame, params: Mapping[str, float] | None = None, reverse: bool = False) -> DataFrame:
    """Constant turn-rate and acceleration filter over gap-free 10 Hz ego frames (event_id, k,
    speed_comp, yaw_rate, acc_lon). Adds position, heading, speed, turn rate and acceleration."""
    p = {**fv.EGO_DEFAULTS, **(params or {})}
    out = _run(_ego_measurements(frames, reverse), ["event_id"], lambda: EgoFilter(p), EGO_STATE)
    return out.drop("idx", "dt")


def choose_direction(frames: DataFrame, params: Mapping[str, float] | None = None) -> DataFrame:
    """Filters each event forward and backward and keeps the forward result unless the backward one
    fits better by 0.02 per row. With invalid speeds at one end only the other direction counts; with
    both ends invalid the event is dropped."""
    frames = cut_lineage(frames, "ego-frames")  # read by both runs and the check of the ends
    ends = edge_speed_valid(frames)
    runs = {rev: filter_ego_tracks(frames, params, rev).withColumn("reverse", F.lit(rev)) for rev in (False, True)}
    both = cut_lineage(runs[False].unionByName(runs[True]), "ego-runs")
    counted = F.coalesce(F.col("raw_speed") >= 0, F.lit(False))
    miss = F.abs(F.col("v_ekf") - F.col("speed_comp")) + F.abs(F.col("omega_ekf") - F.col("yaw_rate"))

    def err(rev: bool):
        return F.sum(F.when(counted & (F.col("reverse") == rev), miss))

    fit = both.groupBy("event_id").agg(
        err(False).alias("_f"), err(True).alias("_b"), F.count(F.when(counted & ~F.col("reverse"), 1)).alias("_n"))
    choice = fit.join(ends, "event_id", "inner").where("valid_start OR valid_end").select(
        "event_id", F.when(~F.col("valid_end"), F.lit(False)).when(~F.col("valid_start"), F.lit(True))
        .otherwise(~(F.col("_f") < F.col("_b") + F.col("_n") * FORWARD_BONUS)).alias("reverse"))
    return both.join(choice, ["event_id", "reverse"], "inner")


def attach_ego_pose(sur: DataFrame, ego: DataFrame, lengths: DataFrame) -> DataFrame:
    """Radar positions of the objects turned into global positions and speeds, measured from the
    front of the ego at the same moment. Moments without an ego row drop out."""
    pose = ego.select("event_id", "k", F.col("x_ekf").alias("_x"), F.col("y_ekf").alias("_y"),
                      F.col("psi_ekf").alias("_psi"), F.col("v_ekf").alias("_v"))
    df = sur.join(pose, ["event_id", "k"], "inner").join(lengths.select("event_id", "ego_length"), "event_id", "inner")
    return with_exprs(df, {
        "x": "_x + cos(_psi) * ego_length / 2D + sin(_psi) * local_dx + cos(_psi) * local_dy",
        "y": "_y + sin(_psi) * ego_length / 2D - cos(_psi) * local_dx + sin(_psi) * local_dy",
        "speed_comp": "sqrt(delta_vx * delta_vx + pow(_v + delta_vy, 2))"}).drop("_x", "_y", "_psi", "_v", "ego_length")


def long_enough(sur: DataFrame, min_rows: int = 10) -> DataFrame:
    """Rows of targets that were measured at least min_rows times. It counts measured rows, so it belongs before
    the grid, which drops rows and fills gaps."""
    keys = ["event_id", "target_id"]
    enough = sur.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    return sur.join(enough.select(*keys), keys, "left_semi")


def filter_surrounding_tracks(frames: DataFrame, params: Mapping[str, float] | None = None) -> DataFrame:
    """Constant heading and speed filter over gap-free object frames (event_id, target_id, k, x, y,
    speed_comp); `long_enough` takes out short targets before the grid."""
    p = {**fv.SUR_DEFAULTS, **(params or {})}
    keys = ["event_id", "target_id"]
    rows = number_rows(frames, keys, ["k"], time_chunk())
    rows = with_exprs(rows, {"dt": "0.1D", "psi0": "0D", "update": "1D"})
    return _run(rows, keys, lambda: ObjectFilter(p), OBJECT_STATE).drop("idx", "dt", "psi0", "update")


def filter_drone_tracks(tracks: DataFrame, params: Mapping[str, float] | None = None) -> DataFrame:
    """The same filter for drone tracks at 10 Hz (track_id, frame_id, x, y, vx, vy): it starts at the
    first direction of motion and takes no measurement while the vehicle stands. Tracks that never
    move have no estimate."""
    p = {**fv.DRONE_PARAMS, **(params or {})}
    keys = ["track_id"]
    heads = initial_heading(tracks, keys, order="frame_id")
    rows = moving_flag(tracks, keys, order="frame_id").join(heads, keys, "left")
    rows = number_rows(rows, keys, ["frame_id"], time_chunk("frame_id"))
    rows = with_exprs(rows, {
        "speed_comp": "sqrt(vx * vx + vy * vy)", "update": "CAST(moving AS DOUBLE)", "dt": "0.1D"})
    return _run(rows, keys, lambda: ObjectFilter(p, clip=False), OBJECT_STATE).drop("idx", "dt", "update", "moving")


# --- reconnecting objects ------------------------------------------------------------------------

def reconnect_edges(radar: DataFrame, reach: int = 2, distance: float = 0.5) -> DataFrame:
    """target -> earlier target of the same event it continues: the nearest row of any lower id within
    0.2 s and 0.5 m of the target's first row."""
    first = radar.groupBy("event_id", "target_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(F.struct("k", "local_dx", "local_dy"), F.col("k")).alias("f"))
    first = first.where("_n >= 2")
    lowest = first.groupBy("event_id").agg(F.min("target_id").alias("_low"))
    starts = first.join(lowest, "event_id", "inner").where("target_id > _low").select(
        "event_id", "target_id", F.col("f.local_dx").alias("_dx"), F.col("f.local_dy").alias("_dy"),
        F.explode(F.sequence(F.col("f.k") - reach, F.col("f.k") + reach)).alias("k"))
    near = starts.join(
        radar.select("event_id", "k", F.col("target_id").alias("parent"), "local_dx", "local_dy"), ["event_id", "k"], "inner"
    ).where("parent < target_id").withColumn(
        "_d", F.sqrt(F.pow(F.col("local_dx") - F.col("_dx"), 2) + F.pow(F.col("local_dy") - F.col("_dy"), 2)))
    best = near.where("_d IS NOT NULL").groupBy("event_id", "target_id").agg(
        F.min(F.struct("_d", "parent")).alias("b"))
    return best.where(F.col("b._d") <= distance).select("event_id", "target_id", F.col("b.parent").alias("parent"))


def resolve_aliases(edges: DataFrame) -> DataFrame:
    """Every target with the first target of its chain. Each round doubles the distance a pointer
    skips, so the number of rounds is the logarithm of the longest chain."""
    links = cut_lineage(edges, "links")
    while True:
        up = links.select("event_id", F.col("target_id").alias("parent"), F.col("parent").alias("_up"))
        longer = cut_lineage(links.join(up, ["event_id", "parent"], "left"), "links")
        links = longer.select("event_id", "target_id", F.coalesce("_up", "parent").alias("parent"))
        if longer.where("_up IS NOT NULL").isEmpty():
            return links


def reconnect_tracks(radar: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Radar rows with continued targets under one id; one row per id and timestamp, that of the
    lowest original id. `edges` are those of `reconnect_edges`, if they are at hand."""
    from nearmiss.operators.frames import dedupe_keep_first
    roots = resolve_aliases(reconnect_edges(radar) if edges is None else edges)
    joined = radar.join(roots, ["event_id", "target_id"], "left").withColumn("_old", F.col("target_id"))
    joined = joined.withColumn("target_id", F.coalesce("parent", "target_id")).drop("parent")
    return dedupe_keep_first(joined, ["event_id", "target_id", "timestamp"], ["_old"]).drop("_old")


# --- qualities -----------------------------------------------------------------------------------

def drone_quality(tracks: DataFrame) -> DataFrame:
    """Weighted position and speed error per track on the frames that hold original data."""
    even = tracks.where("frame_id % 2 = 0")
    return even.groupBy("track_id").agg(
        F.sqrt(F.avg(F.pow(F.col("x") - F.col("x_ekf"), 2) + F.pow(F.col("y") - F.col("y_ekf"), 2))).alias("pos_rmse"),
        F.sqrt(F.avg(F.pow(F.col("speed_comp") - F.col("v_ekf"), 2))).alias("speed_rmse"),
    ).withColumn("loss", 0.2 * F.col("pos_rmse") + 0.8 * F.col("speed_rmse"))


def score_ego(frames: DataFrame) -> DataFrame:
    """Pooled scaled errors of filtered ego frames."""
    def part(a: str, b: str, scale: str):
        return F.sqrt(F.avg(F.pow(F.col(a) - F.col(b), 2))) / fv.ERROR_SCALES[scale]
    return frames.agg((part("speed_comp", "v_ekf", "speed") + part("yaw_rate", "omega_ekf", "yaw_rate")
                       + part("acc_lon", "acc_ekf", "acc")).alias("score"))
