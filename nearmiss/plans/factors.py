"""Scenes as one vector of 139 features in 21 factors: current context, surroundings, and 2.5 s of history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearmiss.functions.numeric import with_exprs
from nearmiss.operators import frames as op
from nearmiss.plans import fixture

#: Context features and what they are divided by.
CONTEXT = {"l_ego": 10.0, "l_sur": 10.0, "combined_width": 3.0, "vy_ego": 40.0, "vx_sur": 40.0, "vy_sur": 40.0,
           "v_ego2": 1600.0, "v_sur2": 1600.0, "delta_v2": 6400.0, "delta_v": 80.0, "psi_sur": 3.0, "rho": 3.0}
#: Labels of each surrounding factor, and by what the event's number is divided before its label is taken.
SURROUNDINGS = {"lighting": (5, 1), "weather": (8, 2), "surface": (6, 3), "traffic": (8, 5)}
PROFILE = {"yaw_ego": 10.0, "v_ego": 40.0, "vx_sur": 40.0, "vy_sur": 40.0}
PASSED = ("passed_0_5", "passed_1_0", "passed_1_5", "passed_2_0", "passed_2_5")


def positions() -> dict[str, list[int]]:
    """The elements of each factor; a history factor holds five of the 25 rows, the latest first."""
    out = {name: [i] for i, name in enumerate(CONTEXT)}
    at = len(out)
    for name, (labels, _) in SURROUNDINGS.items():
        out[name] = list(range(at, at + labels))
        at += labels
    rows = op.HISTORY // len(PASSED)
    for i, name in enumerate(PASSED):
        first = at + len(PROFILE) * (op.HISTORY - rows * (i + 1))
        out[name] = list(range(first, first + len(PROFILE) * rows))
    return out


SIZE = sum(map(len, positions().values()))
#: Weights and reference points by rule, for a model that is the same in every engine.
FIXED_MEAN = [1.5, *(((i * 37) % 101 - 50) / 400 for i in range(SIZE))]
FIXED_LOG_VAR = [-1.2, *(((i * 53) % 97 - 48) / 800 for i in range(SIZE))]
FIXED_POINTS = [[((c * 31 + i * 17) % 41) / 41 - 0.3 for i in range(SIZE)] for c in range(10)]


def scene_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, target_id, k, s and the vector f of every frame with a whole history."""
    scenes = op.every_frame_scenes(fixture.pairs(spark, sf_dir, varied_dims=True))
    context = ", ".join(f"{c} / {d!r}D" for c, d in CONTEXT.items())
    # element by element: the code of these is generated, that of functions over arrays is interpreted
    labels = ", ".join(f"IF(event_id div {by} % {n} = {i}, 1D, 0D)" for n, by in SURROUNDINGS.values() for i in range(n))
    history = ", ".join(f"get(profiles, {i}).{c} / {d!r}D" for i in range(op.HISTORY) for c, d in PROFILE.items())
    return with_exprs(scenes, {"f": f"array({context}, {labels}, {history})"}).select(
        "event_id", "target_id", "k", "s", "f")
