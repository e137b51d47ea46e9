"""Surrogate-safety indicators: pair frames in, the same frames plus one score column out.

Expected columns: x, y, v, hx, hy (and psi for the emergency index), length and width, each with
the suffix _ego or _sur; acc_ego (and acc_sur where known) for the acceleration-aware variant.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearmiss.functions import geometry as g
from nearmiss.functions.numeric import INF, NEG_INF, NOISE, SMALL, floor_speed, snap, with_exprs

BRAKING = 5.5            # m/s2, braking rate behind the stopping-distance ratio
PARALLEL = "pi() / 60D"  # 3 degrees: paths closer than this count as parallel
EI_PARALLEL = 0.01396    # rad, near-parallel limit of the emergency index


def _base(pairs: DataFrame) -> DataFrame:
    return with_exprs(pairs, g.unit_headings() | g.velocities())


def _done(out: DataFrame, pairs: DataFrame, scores: dict[str, str]) -> DataFrame:
    kept = [F.col(c) for c in pairs.columns if c not in scores]
    return out.select(*kept, *[F.expr(e).alias(n) for n, e in scores.items()])


def _hits(pairs: DataFrame, directions: Sequence[tuple[str, str, str]]) -> DataFrame:
    df = _base(pairs)
    pose, corner, times, summary = {}, {}, {}, {}
    for a, b, tag in directions:
        pose |= g.relative_pose(a, b, tag)
        corner |= g.corners(a, tag)
        times |= g.hit_times(b, tag)
        summary |= g.hit_summary(tag)
    pose["_dv"] = "sqrt(pow(_vx_ego - _vx_sur, 2) + pow(_vy_ego - _vy_sur, 2))"
    for step in (pose, corner, times, summary):
        df = with_exprs(df, step)
    return df


BOTH_WAYS = (("ego", "sur", "f"), ("sur", "ego", "r"))


def _ttc_one(tag: str) -> str:
    return (f"CASE WHEN _ahead_{tag} IS NULL THEN {INF} WHEN _behind_{tag} THEN -1D "
            f"ELSE _ahead_{tag} END")


def ttc(pairs: DataFrame) -> DataFrame:
    """Time to collision at constant velocity; -1 when the boxes overlap, +inf when they never meet."""
    return _done(_hits(pairs, BOTH_WAYS), pairs, {"TTC": f"least({_ttc_one('f')}, {_ttc_one('r')})"})


def drac(pairs: DataFrame) -> DataFrame:
    """Deceleration rate needed to avoid the crash; +inf when the boxes overlap, 0 when they never meet."""
    def one(tag: str) -> str:
        return (f"CASE WHEN _ahead_{tag} IS NULL THEN 0D WHEN _behind_{tag} THEN {INF} "
                f"ELSE coalesce(try_divide(_dv, 2D * _ahead_{tag}), {INF}) END")
    return _done(_hits(pairs, BOTH_WAYS), pairs, {"DRAC": f"greatest({one('f')}, {one('r')})"})


def mttc(pairs: DataFrame) -> DataFrame:
    """Time to collision with constant accelerations."""
    gain = "acc_ego - acc_sur" if "acc_sur" in pairs.columns else "acc_ego"
    df = with_exprs(_hits(pairs, BOTH_WAYS), {
        "_ttc": f"least({_ttc_one('f')}, {_ttc_one('r')})",
        "_over": "(_ahead_f IS NOT NULL AND _behind_f) OR (_ahead_r IS NOT NULL AND _behind_r)",
        "_dtc": "least(_nearest_f, _nearest_r) * _dv",
        "_close": "CASE WHEN _ahead_f IS NOT NULL OR _ahead_r IS NOT NULL THEN _dv ELSE -_dv END",
        "_da0": gain,
    })
    df = with_exprs(df, {
        "_da": f"CASE WHEN _da0 > 0D AND _da0 < {SMALL}D THEN {SMALL}D "
               f"WHEN _da0 < 0D AND _da0 > -{SMALL}D THEN -{SMALL}D ELSE _da0 END"})
    df = with_exprs(df, {"_disc": "_close * _close + 2D * _da * _dtc"})
    df = with_exprs(df, {"_root": "CASE WHEN _disc >= 0D THEN sqrt(_disc) END"})
    df = with_exprs(df, {
        "_minus": "try_divide(-_close - _root, _da)", "_plus": "try_divide(-_close + _root, _da)"})
    score = (f"CASE WHEN _over THEN -1D WHEN _da = 0D THEN _ttc "
             f"WHEN _dtc IS NULL OR _minus IS NULL THEN {INF} WHEN _minus > 0D THEN _minus "
             f"WHEN _plus > 0D THEN _plus ELSE {INF} END")
    return _done(df, pairs, {"MTTC": score})


def psd(pairs: DataFrame, braking: float = BRAKING) -> DataFrame:
    """Distance to collision over stopping distance of the ego; 10 when never meeting, -1 on overlap."""
    score = (f"CASE WHEN _ahead_f IS NULL THEN 10D WHEN _behind_f THEN -1D "
             f"ELSE coalesce(try_divide(_ahead_f * _dv * 2D * {braking}D, v_ego * v_ego), {INF}) END")
    return _done(_hits(pairs, BOTH_WAYS[:1]), pairs, {"PSD": score})


def _distance(pairs: DataFrame) -> DataFrame:
    """Adds _gap: distance of the two boxes, measured from the ego corners; 0 when outlines cross."""
    df = with_exprs(_base(pairs), g.relative_pose("ego", "sur", "f"))
    df = with_exprs(df, g.corners("ego", "f"))
    df = with_exprs(df, g.outline_crossings("sur", "f") | {
        "_feet": g.feet("sur", "f"), "_cc": g.corner_gaps("ego", "sur", "f")})
    return with_exprs(df, {
        "_gap": "CASE WHEN _x0_f OR _x1_f OR _x2_f OR _x3_f THEN 0D ELSE least(_feet, _cc) END"})


def current_distance(pairs: DataFrame) -> DataFrame:
    """Distance between the boxes. One box wholly inside the other is not reported as 0."""
    return _done(_distance(pairs), pairs, {"CurrentD": "_gap"})


def _sur_in_ego_frame(df: DataFrame) -> DataFrame:
    return with_exprs(df, {
        "_sur_ahead": "(x_sur - x_ego) * _ux_ego + (y_sur - y_ego) * _uy_ego",
        "_sur_along": "_vx_sur * _ux_ego + _vy_sur * _uy_ego",
    })


def tadv(pairs: DataFrame) -> DataFrame:
    """Time advantage: smallest arrival-time difference over the 16 crossing corner paths."""
    df = _sur_in_ego_frame(_distance(pairs))
    speed = {o: f"sqrt(_vx_{o} * _vx_{o} + _vy_{o} * _vy_{o})" for o in ("ego", "sur")}
    df = with_exprs(df, {
        "_approach": snap(
            f"(CASE WHEN _sur_along < 0D THEN {speed['ego']} + {speed['sur']} "
            f"WHEN _sur_ahead < 0D THEN {speed['sur']} - {speed['ego']} "
            f"ELSE {speed['ego']} - {speed['sur']} END)"),
        "_cross": "_vx_ego * _vy_sur - _vy_ego * _vx_sur",
        "_turn": "atan2(_vx_ego * _vy_sur - _vx_sur * _vy_ego, _vx_ego * _vx_sur + _vy_ego * _vy_sur)",
    })
    df = with_exprs(df, {
        "_line": f"_gap / ({floor_speed('_approach')})",
        "_par": f"_cross = 0D OR abs(_turn) < {PARALLEL} OR abs(_turn) > 59D * {PARALLEL}",
    })
    # a path meeting point splits into one term per corner: cross(corner, other velocity)
    terms = {}
    for o in ("ego", "sur"):
        for n, (sl, sw) in enumerate(g.CORNERS):
            px = f"(x_{o} - x_ego + {sl * 0.5}D * length_{o} * _ux_{o} - {sw * 0.5}D * width_{o} * _uy_{o})"
            py = f"(y_{o} - y_ego + {sl * 0.5}D * length_{o} * _uy_{o} + {sw * 0.5}D * width_{o} * _ux_{o})"
            terms[f"_by_sur_{o}{n}"] = f"{px} * _vy_sur - {py} * _vx_sur"
            terms[f"_by_ego_{o}{n}"] = f"{px} * _vy_ego - {py} * _vx_ego"
    df = with_exprs(df, terms)
    gaps = []
    for i in range(4):
        for j in range(4):
            ti = f"((_by_sur_sur{j} - _by_sur_ego{i}) / _cross)"
            tj = f"((_by_ego_sur{j} - _by_ego_ego{i}) / _cross)"
            gaps.append(f"CASE WHEN {ti} >= 0D AND {tj} >= 0D THEN abs({ti} - {tj}) END")
    score = (f"CASE WHEN _par THEN (CASE WHEN _line < 0D THEN {INF} ELSE _line END) "
             f"ELSE coalesce(least({', '.join(gaps)}), {INF}) END")
    return _done(df, pairs, {"TAdv": score})


def ttc2d(pairs: DataFrame) -> DataFrame:
    """Two-dimensional time to collision in the frame of whichever road user follows.

    The lateral test is one-sided, as in the published definition it matches.
    """
    df = _sur_in_ego_frame(_base(pairs))
    lead = "_sur_ahead >= 0D"

    def pick(text: str) -> str:
        """The expression for (follower=ego, leader=sur), or with the roles swapped."""
        swapped = text.replace("{f}", "sur").replace("{l}", "ego")
        return f"CASE WHEN {lead} THEN {text.replace('{f}', 'ego').replace('{l}', 'sur')} ELSE {swapped} END"

    fx = "(x_{o} + 0.5D * length_{o} * _ux_{o})"
    fy = "(y_{o} + 0.5D * length_{o} * _uy_{o})"
    dx = f"({fx.replace('{o}', '{l}')} - {fx.replace('{o}', '{f}')})"
    dy = f"({fy.replace('{o}', '{l}')} - {fy.replace('{o}', '{f}')})"
    rvx, rvy = "(_vx_{f} - _vx_{l})", "(_vy_{f} - _vy_{l})"
    df = with_exprs(df, {
        "_slat": pick(f"_uy_{{f}} * {dx} - _ux_{{f}} * {dy}"),
        "_slon": pick(f"_ux_{{f}} * {dx} + _uy_{{f}} * {dy}"),
        "_vlat": pick(f"_uy_{{f}} * {rvx} - _ux_{{f}} * {rvy}"),
        "_vlon": pick(f"_ux_{{f}} * {rvx} + _uy_{{f}} * {rvy}"),
        "_len": pick("length_{l}"),
        "_wid": "0.5D * (width_ego + width_sur)",
    })

    def part(s: str, size: str, v: str, other_s: str, other_size: str, other_v: str) -> str:
        t = f"(({s} - {size}) / greatest({v}, {SMALL}D))"
        return (f"CASE WHEN {s} > {size} AND {v} > {NOISE}D "
                f"AND {other_s} - {other_v} * {t} < {other_size} THEN {t} ELSE {INF} END")

    lon = part("_slon", "_len", "_vlon", "_slat", "_wid", "_vlat")
    lat = part("_slat", "_wid", "_vlat", "_slon", "_len", "_vlon")
    return _done(df, pairs, {"TTC2D": f"least({lon}, {lat})"})


def act(pairs: DataFrame) -> DataFrame:
    """Anticipated collision time: box distance over the closing speed along the shortest segment."""
    df = _base(pairs)
    pose, corner, near, gaps = {}, {}, {}, {}
    for a, b, tag in BOTH_WAYS:
        pose |= g.relative_pose(a, b, tag)
        corner |= g.corners(a, tag)
        for n in range(4):
            pu, pw = g.nearest_on_box(n, b, tag)
            near[f"_du{n}_{tag}"] = f"({pu}) - _u{n}_{tag}"
            near[f"_dw{n}_{tag}"] = f"({pw}) - _w{n}_{tag}"
            gaps[f"_d{n}_{tag}"] = f"sqrt(_du{n}_{tag} * _du{n}_{tag} + _dw{n}_{tag} * _dw{n}_{tag})"
    for step in (pose, corner, near, gaps):
        df = with_exprs(df, step)
    names = [(n, tag) for n in range(4) for tag in ("f", "r")]
    df = with_exprs(df, {"_dist": "least(" + ", ".join(f"_d{n}_{tag}" for n, tag in names) + ")"})
    # closing speed along the winning segment; the relative velocity is that of the corner's owner
    choice = " ".join(
        f"WHEN _d{n}_{tag} = _dist THEN (_du{n}_{tag} * _ru_{tag} + _dw{n}_{tag} * _rw_{tag}) / nullif(_dist, 0D)"
        for n, tag in names)
    df = with_exprs(df, {"_approach": f"CASE {choice} END"})
    df = with_exprs(df, {"_closing": snap("_approach")})
    score = f"_dist / ({floor_speed('_closing')})"
    return _done(df, pairs, {
        "ACT": f"CASE WHEN _dist < {NOISE}D THEN NULL WHEN {score} < 0D THEN {INF} ELSE {score} END"})


def ei(pairs: DataFrame, safe_distance: float = 0.0) -> DataFrame:
    """Emergency index: intrusion depth over time to the closest moment; -inf when not in conflict."""
    df = with_exprs(pairs, {
        "_dx": "x_sur - x_ego", "_dy": "y_sur - y_ego",
        "_ca": "cos(psi_ego)", "_sa": "sin(psi_ego)", "_cb": "cos(psi_sur)", "_sb": "sin(psi_sur)",
        "_dh": "psi_sur - psi_ego",
    })
    df = with_exprs(df, {
        "_rx": "v_sur * _cb - v_ego * _ca", "_ry": "v_sur * _sb - v_ego * _sa",
        "_d": "sqrt(_dx * _dx + _dy * _dy)", "_sd": "sin(_dh)", "_cd": "abs(cos(_dh))",
    })
    df = with_exprs(df, {
        "_r": "sqrt(_rx * _rx + _ry * _ry)",
        "_closing": "CASE WHEN _d <> 0D THEN round(-(_dx * _rx + _dy * _ry) / _d, 2) ELSE 0D END",
        # path lengths of the two centres to the crossing of their paths
        "_pa": f"CASE WHEN abs(_sd) >= {NOISE}D THEN (_dx * _sb - _dy * _cb) / _sd END",
        "_pb": f"CASE WHEN abs(_sd) >= {NOISE}D THEN (_dx * _sa - _dy * _ca) / _sd END",
        "_wa": f"CASE WHEN abs(_sd) >= {NOISE}D THEN width_ego / abs(_sd) END",
        "_wb": f"CASE WHEN abs(_sd) >= {NOISE}D THEN width_sur / abs(_sd) END",
        "_near": " OR ".join(f"{t} <= {EI_PARALLEL}D" for t in (
            "abs(_dh)", "abs(_dh + pi())", "abs(_dh - pi())", "abs(abs(_dh) - pi())")),
    })
    df = with_exprs(df, {
        "_meet": "_pa + 0.5D * length_ego + 0.5D * _wb + 0.5D * _wa * _cd > 0D "
                 "AND _pb + 0.5D * length_sur + 0.5D * _wb * _cd + 0.5D * _wa > 0D",
        "_lane": "_near AND (_dx * _ca + _dy * _sa >= 0D OR -_dx * _cb - _dy * _sb >= 0D "
                 "OR abs(_dx * _ca - _dy * _sa) <= 0.5D * (length_ego + length_sur)) "
                 "AND abs(_dx * _sa - _dy * _ca) <= 0.5D * (width_ego + width_sur)",
        "_tx": "_rx / nullif(_r, 0D)", "_ty": "_ry / nullif(_r, 0D)",
    })
    half = {
        o: (f"0.5D * length_{o} * abs({c} * _ty - {s} * _tx) + 0.5D * width_{o} * abs({c} * _tx + {s} * _ty)")
        for o, c, s in (("ego", "_ca", "_sa"), ("sur", "_cb", "_sb"))}
    df = with_exprs(df, {
        "_mfd": f"abs(_dx * _ty - _dy * _tx) - ({half['ego']} + {half['sur']})",
        "_tdm": "-(_dx * _tx + _dy * _ty) / nullif(_r, 0D)",
    })
    score = (f"CASE WHEN _closing > 0D AND (coalesce(_meet, false) OR _lane) "
             f"THEN ({safe_distance}D - _mfd) / _tdm ELSE {NEG_INF} END")
    return _done(df, pairs, {"EI": score})


INDICATORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "TAdv": tadv, "TTC2D": ttc2d, "ACT": act, "EI": ei,
    "TTC": ttc, "DRAC": drac, "MTTC": mttc, "PSD": psd, "CurrentD": current_distance,
}
# indicators whose small values mean danger; all others warn on large values
SMALL_IS_RISKY = frozenset({"TAdv", "TTC2D", "ACT"})


def register_indicator(name: str, job: Callable[[DataFrame], DataFrame]) -> None:
    """Add a user-defined indicator under a new name."""
    if name in INDICATORS:
        raise ValueError(f"indicator {name} exists already")
    INDICATORS[name] = job


def risk_scores(pairs: DataFrame, names: Sequence[str] = ("TAdv", "TTC2D", "ACT", "EI")) -> DataFrame:
    """Chosen indicators of every pair frame, keys kept."""
    out = pairs
    for name in names:
        out = INDICATORS[name](out)
    return out.select("event_id", "target_id", "k", "time", *names)


def scoring_log(scores: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows and distinct targets scored per indicator."""
    n = len(names)
    # targets are counted after reducing to distinct pairs, so one large event is no single group
    per_target = scores.groupBy("event_id", "target_id").agg(F.count(F.lit(1)).alias("rows"))
    total = per_target.agg(
        F.sum("rows").alias("num_moments"), F.count(F.lit(1)).alias("num_targets"))
    return total.select(
        F.explode(F.array(*[F.lit(x) for x in names])).alias("model_name"), "num_targets", "num_moments"
    ) if n else total
