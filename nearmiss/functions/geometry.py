"""Rectangle geometry as SQL text.

Everything is expressed in the frame of one rectangle (long axis u, left axis w), where the other
rectangle is four corner points and the box edges are axis-aligned. That turns the 16 corner-edge
cases of a pair into closed forms that unroll into generated code.
"""

from __future__ import annotations

from nearmiss.functions.numeric import INF, NOISE, snap

# corner signs along (heading, left): front-left, front-right, rear-left, rear-right
CORNERS = ((1, 1), (1, -1), (-1, 1), (-1, -1))
# corners in walking order round the box, as indexes into CORNERS
OUTLINE = (0, 1, 3, 2)


def unit_headings() -> dict[str, str]:
    """Heading of both road users scaled to length one."""
    out = {}
    for o in ("ego", "sur"):
        norm = f"sqrt(hx_{o} * hx_{o} + hy_{o} * hy_{o})"
        out[f"_ux_{o}"] = f"hx_{o} / {norm}"
        out[f"_uy_{o}"] = f"hy_{o} / {norm}"
    return out


def velocities() -> dict[str, str]:
    return {f"_v{c}_{o}": f"v_{o} * h{c}_{o}" for o in ("ego", "sur") for c in "xy"}


def relative_pose(a: str, b: str, tag: str) -> dict[str, str]:
    """Centre, heading (cos, sin) and velocity of `a` relative to `b`, in the frame of `b`."""
    dx, dy = f"(x_{a} - x_{b})", f"(y_{a} - y_{b})"
    rvx, rvy = f"(_vx_{a} - _vx_{b})", f"(_vy_{a} - _vy_{b})"
    bx, by = f"_ux_{b}", f"_uy_{b}"
    return {
        f"_u_{tag}": f"{dx} * {bx} + {dy} * {by}",
        f"_w_{tag}": f"{dy} * {bx} - {dx} * {by}",
        f"_c_{tag}": f"_ux_{a} * {bx} + _uy_{a} * {by}",
        f"_s_{tag}": f"{bx} * _uy_{a} - {by} * _ux_{a}",
        f"_ru_{tag}": snap(f"({rvx} * {bx} + {rvy} * {by})"),
        f"_rw_{tag}": snap(f"({rvy} * {bx} - {rvx} * {by})"),
    }


def corners(a: str, tag: str) -> dict[str, str]:
    """Corners of `a` in the frame of the other road user."""
    out = {}
    for n, (sl, sw) in enumerate(CORNERS):
        hl, hw = f"({sl * 0.5}D * length_{a})", f"({sw * 0.5}D * width_{a})"
        out[f"_u{n}_{tag}"] = f"_u_{tag} + {hl} * _c_{tag} - {hw} * _s_{tag}"
        out[f"_w{n}_{tag}"] = f"_w_{tag} + {hl} * _s_{tag} + {hw} * _c_{tag}"
    return out


def hit_times(b: str, tag: str) -> dict[str, str]:
    """Signed times at which each corner, moving with the relative velocity, meets each edge of `b`.

    A time is NULL when the motion is parallel to the edge or passes beside it.
    """
    out = {}
    for n in range(4):
        u, w = f"_u{n}_{tag}", f"_w{n}_{tag}"
        for side, sign in (("p", 0.5), ("m", -0.5)):
            tu = f"try_divide({sign}D * length_{b} - {u}, _ru_{tag})"
            out[f"_tu{side}{n}_{tag}"] = (
                f"CASE WHEN abs({w} + {tu} * _rw_{tag}) <= 0.5D * width_{b} + {NOISE}D THEN {tu} END")
            tw = f"try_divide({sign}D * width_{b} - {w}, _rw_{tag})"
            out[f"_tw{side}{n}_{tag}"] = (
                f"CASE WHEN abs({u} + {tw} * _ru_{tag}) <= 0.5D * length_{b} + {NOISE}D THEN {tw} END")
    return out


def hit_summary(tag: str) -> dict[str, str]:
    """Earliest approaching hit, nearest hit in either direction, and whether any hit lies behind."""
    times = [f"_t{axis}{side}{n}_{tag}" for n in range(4) for axis in "uw" for side in "pm"]
    ahead = ", ".join(f"CASE WHEN {t} >= 0D THEN {t} END" for t in times)
    nearest = ", ".join(f"abs({t})" for t in times)
    behind = " OR ".join(f"coalesce({t} < 0D, false)" for t in times)
    return {
        f"_ahead_{tag}": f"least({ahead})",
        f"_nearest_{tag}": f"least({nearest})",
        f"_behind_{tag}": behind,
    }


def feet(b: str, tag: str) -> str:
    """Distance from the corners to the edges of `b`, counting only feet that fall on the edge."""
    parts = []
    for n in range(4):
        u, w = f"abs(_u{n}_{tag})", f"abs(_w{n}_{tag})"
        parts.append(f"CASE WHEN {w} <= 0.5D * width_{b} + {NOISE}D THEN abs({u} - 0.5D * length_{b}) END")
        parts.append(f"CASE WHEN {u} <= 0.5D * length_{b} + {NOISE}D THEN abs({w} - 0.5D * width_{b}) END")
    return "least(" + ", ".join(parts) + ")"


def corner_gaps(a: str, b: str, tag: str) -> str:
    """Smallest corner-to-corner distance: per corner of `a`, the nearest box corner by symmetry."""
    parts = []
    for n in range(4):
        du = f"(abs(_u{n}_{tag}) - 0.5D * length_{b})"
        dw = f"(abs(_w{n}_{tag}) - 0.5D * width_{b})"
        parts.append(f"sqrt({du} * {du} + {dw} * {dw})")
    return "least(" + ", ".join(parts) + ")"


def outline_crossings(b: str, tag: str) -> dict[str, str]:
    """For each outline edge of the other box: does it meet the outline of `b`?

    An edge is clipped against the box; it crosses the outline when part of it is left and not both
    of its ends lie strictly inside.
    """
    out = {}
    for e in range(4):
        p, q = OUTLINE[e], OUTLINE[(e + 1) % 4]
        lo, hi = ["0D"], ["1D"]
        misses = []
        for axis, size in (("u", f"length_{b}"), ("w", f"width_{b}")):
            a0, a1 = f"_{axis}{p}_{tag}", f"_{axis}{q}_{tag}"
            d = f"(CASE WHEN abs({a1} - {a0}) < {NOISE}D THEN NULL ELSE {a1} - {a0} END)"
            half = f"(0.5D * {size} + {NOISE}D)"
            lo.append(f"least((-{half} - {a0}) / {d}, ({half} - {a0}) / {d})")
            hi.append(f"greatest((-{half} - {a0}) / {d}, ({half} - {a0}) / {d})")
            misses.append(f"(abs({a1} - {a0}) < {NOISE}D AND abs({a0}) > {half})")
        inside = " AND ".join(
            f"abs(_{axis}{n}_{tag}) < 0.5D * {size}_{b} - {NOISE}D"
            for n in (p, q) for axis, size in (("u", "length"), ("w", "width")))
        out[f"_x{e}_{tag}"] = (
            f"greatest({', '.join(lo)}) <= least({', '.join(hi)}) "
            f"AND NOT ({' OR '.join(misses)}) AND NOT ({inside})")
    return out


def nearest_on_box(n: int, b: str, tag: str) -> tuple[str, str]:
    """Point of the outline of `b` nearest to corner n, in the frame of `b`."""
    u, w = f"_u{n}_{tag}", f"_w{n}_{tag}"
    hl, hw = f"(0.5D * length_{b})", f"(0.5D * width_{b})"
    inside = f"(abs({u}) < {hl} AND abs({w}) < {hw})"
    to_end = f"({hl} - abs({u}) <= {hw} - abs({w}))"
    pu = (f"CASE WHEN {inside} AND {to_end} THEN (CASE WHEN {u} >= 0D THEN {hl} ELSE -{hl} END) "
          f"ELSE least(greatest({u}, -{hl}), {hl}) END")
    pw = (f"CASE WHEN {inside} AND NOT {to_end} THEN (CASE WHEN {w} >= 0D THEN {hw} ELSE -{hw} END) "
          f"ELSE least(greatest({w}, -{hw}), {hw}) END")
    return pu, pw


def or_inf(text: str) -> str:
    return f"coalesce({text}, {INF})"
