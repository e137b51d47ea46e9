"""Search of filter parameters over whole grids.

Frames shuffle once, by track. A task holds a block of whole tracks and tries every combination on it, so neither
rows nor tracks are copied per combination; it hands on one row of error sums per combination, and those are added up.

The errors of the ego filter concern speed, acceleration and turn rate alone. These are measured directly, the motion
model is linear in them, and no other state acts on them, so two small filters give exactly what the full one gives:
speed with acceleration (two states), and turn rate (one). Their gains depend on the parameters and the step only, so
all tracks of a block share them. 51,200 combinations hold 800 filters of the first kind and 64 of the second.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmiss.functions import fixed_values as fv
from nearmiss.functions.numeric import with_exprs
from nearmiss.operators.filters import FORWARD_BONUS

#: Tracks and rows filtered together; a longer track is a block of its own.
BLOCK_TRACKS, BLOCK_ROWS = 64, 50_000
#: Combinations tried together where every track needs covariances of its own: an array of them is 32 KB.
PER_SET = 64
EDGE = 5


def _size(space: Mapping[str, Sequence[float]]) -> int:
    return int(np.prod([len(v) for v in space.values()]))


def _values(name: str, values: Sequence[float]) -> np.ndarray:
    return np.asarray(values, dtype=float) * (np.pi if name.endswith("_pi") else 1.0)


def parameters_of(space: Mapping[str, Sequence[float]], combos: np.ndarray) -> dict[str, np.ndarray]:
    """Parameter values of numbered combinations: the number written in mixed radix, last name fastest."""
    out, rest = {}, combos
    for name, values in reversed(space.items()):
        out[name.removesuffix("_pi")] = _values(name, values)[rest % len(values)]
        rest = rest // len(values)
    return out


def parameter_grid(spark: SparkSession, space: Mapping[str, Sequence[float]]) -> DataFrame:
    """All combinations of the listed values, numbered. Names ending in _pi hold multiples of pi."""
    exprs, rest = {}, "combo"
    for name, values in reversed(space.items()):
        listed = ", ".join(f"{float(v)!r}D" for v in _values(name, values))
        exprs[name.removesuffix("_pi")] = f"array({listed})[CAST({rest} % {len(values)} AS INT)]"
        rest = f"({rest} div {len(values)})"
    return with_exprs(spark.range(_size(space)).withColumnRenamed("id", "combo"), exprs)


def whole_tracks(batches: Iterator[pd.DataFrame], keys: Sequence[str], columns: Sequence[str]) -> Iterator[np.ndarray]:
    """Rows x columns of one track after the other, from batches sorted by track."""
    held, parts = None, []
    for pdf in batches:
        if not len(pdf):
            continue
        ids = pdf[list(keys)].to_numpy()
        values = pdf[list(columns)].to_numpy(dtype=float)
        cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(pdf)]):
            if held is not None and tuple(ids[lo]) != held:
                yield np.concatenate(parts)
                parts = []
            held = tuple(ids[lo])
            parts.append(values[lo:hi])
    if parts:
        yield np.concatenate(parts)


def blocks(tracks: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Tracks in blocks, the longest first in each."""
    block, rows = [], 0
    for track in tracks:
        if len(track) >= BLOCK_ROWS:
            yield [track]
            continue
        block.append(track)
        rows += len(track)
        if len(block) == BLOCK_TRACKS or rows >= BLOCK_ROWS:
            yield sorted(block, key=len, reverse=True)
            block, rows = [], 0
    if block:
        yield sorted(block, key=len, reverse=True)


def stacked(block: list[np.ndarray], backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Steps x tracks x columns, and the number of tracks that reach each step."""
    z = np.zeros((len(block[0]), len(block), block[0].shape[1]))
    for i, track in enumerate(block):
        z[:len(track), i] = track[::-1] if backward else track
    lengths = np.array([len(t) for t in block])
    return z, (lengths[None, :] > np.arange(len(z))[:, None]).sum(axis=1)


class SpeedFilter:
    """Speed and acceleration of the ego filter, for arrays of parameters."""

    names = ("uncertainty_init", "uncertainty_speed", "uncertainty_acc", "max_acc", "max_jerk")

    def __init__(self, params: Mapping[str, np.ndarray], dt: float):
        init, speed, acc, max_acc, max_jerk = (params[n] for n in self.names)
        self.dt, self.rv, self.ra = dt, speed, acc
        self.qv, self.qa = (max_acc * dt) ** 2, (max_jerk * dt) ** 2
        self.vv, self.va, self.aa = init.copy(), np.zeros_like(init), init.copy()

    def gains(self):
        """The gains of the next step; covariances move on by it."""
        dt = self.dt
        vv = self.vv + 2 * dt * self.va + dt * dt * self.aa + self.qv
        va, aa = self.va + dt * self.aa, self.aa + self.qa
        det = (vv + self.rv) * (aa + self.ra) - va * va
        vv_gain, aa_gain = (vv * (aa + self.ra) - va * va) / det, (aa * (vv + self.rv) - va * va) / det
        va_gain, av_gain = va * self.rv / det, va * self.ra / det
        self.vv, self.va = vv - vv_gain * vv - va_gain * va, va - vv_gain * va - va_gain * aa
        self.aa = aa - av_gain * va - aa_gain * aa
        return vv_gain, va_gain, av_gain, aa_gain

    def errors(self, z: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """fit, squared speed and squared acceleration errors (first axis) by track and parameters. z: raw speed, speed,
        turn rate, acceleration."""
        out = np.zeros((3, z.shape[1], len(self.rv)))
        v, a = (np.repeat(z[0, :, [c]].T, len(self.rv), axis=1) for c in (1, 3))
        for t in range(1, len(z)):
            n = reach[t]
            vv, va, av, aa = self.gains()
            v, a = v[:n], a[:n]
            ahead = v + a * self.dt
            off_v, off_a = z[t, :n, 1, None] - ahead, z[t, :n, 3, None] - a
            v = np.maximum(ahead + vv * off_v + va * off_a, 0.0)
            a = a + av * off_v + aa * off_a
            miss = v - z[t, :n, 1, None]
            out[0, :n] += np.abs(miss) * (z[t, :n, 0, None] >= 0)
            out[1, :n] += miss * miss
            out[2, :n] += (a - z[t, :n, 3, None]) ** 2
        return out


class TurnFilter:
    """Turn rate of the ego filter, for arrays of parameters."""

    names = ("uncertainty_init", "uncertainty_omega", "max_yaw_acc")

    def __init__(self, params: Mapping[str, np.ndarray], dt: float):
        self.p, self.r, yaw_acc = (params[n] for n in self.names)
        self.q = (yaw_acc * dt) ** 2

    def errors(self, z: np.ndarray, reach: np.ndarray) -> np.ndarray:
        out, p = np.zeros((2, z.shape[1], len(self.r))), self.p
        w = np.repeat(z[0, :, [2]].T, len(self.r), axis=1)
        for t in range(1, len(z)):
            n = reach[t]
            p = p + self.q
            gain = p / (p + self.r)
            p = p - gain * p
            w = w[:n] + gain * (z[t, :n, 2, None] - w[:n])
            miss = w - z[t, :n, 2, None]
            out[0, :n] += np.abs(miss) * (z[t, :n, 0, None] >= 0)
            out[1, :n] += miss * miss
        return out


def distinct_filters(params: Mapping[str, np.ndarray], names: Sequence[str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The different settings of some parameters, and which of them each combination has."""
    rows, place = np.unique(np.stack([params[n] for n in names], axis=1), axis=0, return_inverse=True)
    return {n: rows[:, i].copy() for i, n in enumerate(names)}, place.ravel()


def ego_error_sums(block: list[np.ndarray], params: Mapping[str, np.ndarray]) -> np.ndarray:
    """n and squared errors of speed, turn rate and acceleration per combination, summed over the block's tracks, each
    in its direction: the valid one, or the one that fits. Tracks with invalid speeds at both ends are left out."""
    speed, at_speed = distinct_filters(params, SpeedFilter.names)
    turn, at_turn = distinct_filters(params, TurnFilter.names)
    # combinations of the same two filters are summed once
    cells, place = np.unique(at_speed * (at_turn.max() + 1) + at_turn, return_inverse=True)
    at_speed, at_turn = cells // (at_turn.max() + 1), cells % (at_turn.max() + 1)
    runs = []
    for backward, dt in ((False, 0.1), (True, -0.1)):
        z, reach = stacked(block, backward)
        runs.append((SpeedFilter(speed, dt).errors(z, reach), TurnFilter(turn, dt).errors(z, reach)))
    total = np.zeros((4, len(cells)))
    for i, track in enumerate(block):
        raw = track[:, 0]
        starts, ends = (raw[:EDGE] >= 0).all(), (raw[-EDGE:] >= 0).all()
        if not (starts or ends):
            continue
        sums = [np.stack([s[0, i, at_speed] + w[0, i, at_turn], s[1, i, at_speed], w[1, i, at_turn], s[2, i, at_speed]])
                for s, w in runs]
        if starts and ends:
            forward = sums[0][0] < sums[1][0] + (raw >= 0).sum() * FORWARD_BONUS
        else:
            forward = np.full(len(cells), starts)
        total[0] += len(track)
        total[1:] += np.where(forward, sums[0][1:], sums[1][1:])
    return total[:, place]


class PathFilter:
    """The object filter for arrays of parameters: the ten different covariances of position, speed and heading, an
    array of tracks x parameters each. Noise of x, y and speed is independent, so they are taken in one after the other,
    which gives the same estimate as all at once. Headings are not wrapped; only their sine and cosine count."""

    def __init__(self, params: Mapping[str, np.ndarray], z: np.ndarray, dt: float):
        shape = (len(z), len(params["max_acc"]))
        self.dt, self.noise = dt, (params["uncertainty_pos"], params["uncertainty_pos"], params["uncertainty_speed"])
        self.q = [(q * dt) ** 2 for q in (0.5 * dt * params["max_acc"], params["max_acc"], params["max_yaw_rate"])]
        self.state = [np.repeat(z[:, [c]], shape[1], axis=1) for c in range(3)] + [np.zeros(shape)]
        init = np.broadcast_to(params["uncertainty_init"], shape)
        self.p = {(i, j): init.copy() if i == j else np.zeros(shape) for i in range(4) for j in range(i, 4)}

    def step(self, z: np.ndarray) -> None:
        """The next frame of the first len(z) tracks; the others have ended."""
        n, dt = len(z), self.dt
        self.state = x, y, v, psi = [a[:n] for a in self.state]
        self.p = p = {at: a[:n] for at, a in self.p.items()}
        east, north = dt * np.cos(psi), dt * np.sin(psi)
        along, across = v * east, v * north
        x += along
        y += across
        np.negative(across, out=across)
        was = {at: p[at] for at in ((0, 2), (0, 3), (1, 2), (1, 3))}
        for i, by_speed, by_heading in ((0, east, across), (1, north, along)):
            p[i, 2] = was[i, 2] + by_speed * p[2, 2] + by_heading * p[2, 3]
            p[i, 3] = was[i, 3] + by_speed * p[2, 3] + by_heading * p[3, 3]
            p[i, i] += by_speed * (was[i, 2] + p[i, 2]) + by_heading * (was[i, 3] + p[i, 3]) + self.q[0]
        p[0, 1] += east * was[1, 2] + across * was[1, 3] + north * p[0, 2] + along * p[0, 3]
        p[2, 2] += self.q[1]
        p[3, 3] += self.q[2]
        for c in range(3):
            self.correct(c, z[:, c, None])
        np.maximum(v, 0.0, out=v)

    def correct(self, c: int, seen: np.ndarray) -> None:
        p, own = self.p, [self.p[min(c, i), max(c, i)] for i in range(4)]
        part = 1.0 / (own[c] + self.noise[c])
        gain, off = [a * part for a in own], seen - self.state[c]
        for i in range(4):
            self.state[i] += gain[i] * off
            for j in range(i, 4):
                if c not in (i, j):
                    p[i, j] -= gain[i] * own[j]
        part *= self.noise[c]
        for a in own:
            a *= part


def object_error_sums(block: list[np.ndarray], params: Mapping[str, np.ndarray]) -> np.ndarray:
    """n, displacement and squared speed error per combination, summed over the block's tracks. Columns of a track: x, y, speed."""
    z, reach = stacked(block)
    total = np.zeros((3, len(params["max_acc"])))
    for lo in range(0, total.shape[1], PER_SET):
        some = slice(lo, lo + PER_SET)
        model = PathFilter({k: v[some] for k, v in params.items()}, z[0], 0.1)
        for t in range(len(z)):
            seen = z[t, :reach[t]]
            model.step(seen)
            x, y, v = (a - seen[:, c, None] for c, a in enumerate(model.state[:3]))
            x *= x
            y *= y
            x += y
            total[1, some] += np.sqrt(x, out=x).sum(axis=0)
            v *= v
            total[2, some] += v.sum(axis=0)
    total[0] = sum(map(len, block))
    return total


def error_sums(frames: DataFrame, keys: Sequence[str], columns: Sequence[str], space: Mapping[str, Sequence[float]],
               measure, names: Sequence[str]) -> DataFrame:
    """combo and its error sums over all tracks. Every task gives one row per combination."""
    keys, total = list(keys), _size(space)

    def task(batches):
        params, sums = parameters_of(space, np.arange(total)), None
        for block in blocks(whole_tracks(batches, keys, columns)):
            part = measure(block, params)
            sums = part if sums is None else sums + part
        if sums is not None:
            yield pd.DataFrame({"combo": np.arange(total), **dict(zip(names, sums))})

    # a number of parts of its own: a row moves few bytes but is filtered under every combination, so parts are not joined
    context = frames.sparkSession.sparkContext
    tasks = max(4 * context.defaultParallelism, int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = frames.select(*keys, "k", *columns).repartition(tasks, *[F.col(k) for k in keys]).sortWithinPartitions(*keys, "k")
    parts = placed.mapInPandas(task, "combo long, " + ", ".join(f"{n} double" for n in names))
    return parts.groupBy("combo").agg(*(F.sum(n).alias(n) for n in names)).where(f"{names[0]} > 0")


def search_ego_params(frames: DataFrame, space: Mapping[str, Sequence[float]] = fv.EGO_SEARCH) -> DataFrame:
    """Score of every parameter combination on gap-free 10 Hz ego frames: the scaled root mean square errors of speed,
    turn rate and acceleration, each track in its direction. No track, no rows."""
    rows = with_exprs(frames.select("event_id", "k", "speed_comp", "yaw_rate", "acc_lon"), {
        "raw_speed": "speed_comp", "speed_comp": "greatest(speed_comp, 0D)",
        "acc_lon": "CASE WHEN acc_lon > 0D AND speed_comp <= 0D THEN 0D ELSE acc_lon END"})
    sums = error_sums(rows, ["event_id"], ["raw_speed", "speed_comp", "yaw_rate", "acc_lon"], space, ego_error_sums,
                      ["n", "speed", "yaw_rate", "acc"])
    rmse = [F.sqrt(F.col(c) / F.col("n")) / fv.ERROR_SCALES[c] for c in ("speed", "yaw_rate", "acc")]
    scores = sums.select("combo", (rmse[0] + rmse[1] + rmse[2]).alias("score"))
    return parameter_grid(frames.sparkSession, space).join(scores, "combo", "inner")


def search_sur_params(frames: DataFrame, space: Mapping[str, Sequence[float]] = fv.SUR_SEARCH) -> DataFrame:
    """Score of every combination on object frames: scaled mean displacement plus scaled speed error."""
    sums = error_sums(frames, ["event_id", "target_id"], ["x", "y", "speed_comp"], space, object_error_sums,
                      ["n", "displacement", "speed"])
    score = (F.col("displacement") / F.col("n") / fv.ERROR_SCALES["displacement"]
             + F.sqrt(F.col("speed") / F.col("n")) / fv.ERROR_SCALES["speed"])
    return parameter_grid(frames.sparkSession, space).join(sums.select("combo", score.alias("score")), "combo", "inner")


def best_params(scores: DataFrame) -> DataFrame:
    """The combination of the lowest score, the first one on a tie."""
    cols = F.struct(*scores.columns)
    return scores.agg(F.min_by(cols, F.struct(F.round("score", 4), "combo")).alias("b")).select("b.*")
