"""SQL-expression builders shared by the operators.

Every builder takes and returns Spark SQL text, so a whole indicator is parsed once per stage
and stays inside generated code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Complementary error function, coefficients of t^0 .. t^9 (Numerical Recipes)
ERFC_COEFFICIENTS = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)

SMALL = 1e-6
# speeds and offsets below this are rounding noise, not motion
NOISE = 1e-9

INF = "CAST('Infinity' AS DOUBLE)"
NEG_INF = "CAST('-Infinity' AS DOUBLE)"


def with_exprs(df: DataFrame, exprs: Mapping[str, str]) -> DataFrame:
    """One projection that adds or replaces the named columns."""
    return df.withColumns({name: F.expr(text) for name, text in exprs.items()})


def rounded_double(text: str, digits: int) -> str:
    """round(text, digits) of a double, the same to the last bit. Decimals, which round() goes through, are needed only
    next to a tie and for values whose digits the multiplication may lose; a whole number divided by a power of ten is
    the double nearest to that decimal."""
    scale = f"1e{digits}D"
    scaled = f"({text}) * {scale}"
    return (f"CASE WHEN abs({text}) < 1e{9 - digits}D AND abs(abs({scaled} - rint({scaled})) - 0.5D) > 1e-6D "
            f"THEN rint({scaled}) / {scale} ELSE round({text}, {digits}) END")


def snap(text: str) -> str:
    return f"CASE WHEN abs({text}) < {NOISE}D THEN 0D ELSE {text} END"


def floor_speed(text: str) -> str:
    """Keep a closing speed at least 1e-6 away from zero, sign kept, zero counted as positive."""
    return (
        f"CASE WHEN ({text}) > -{NOISE}D AND ({text}) < {SMALL}D THEN {SMALL}D "
        f"WHEN ({text}) < 0D AND ({text}) > -{SMALL}D THEN -{SMALL}D ELSE ({text}) END"
    )


def wrap(text: str) -> str:
    """Angle moved into [-pi, pi)."""
    return f"(({text}) - 2D * pi() * floor((({text}) + pi()) / (2D * pi())))"


def angle(ux: str, uy: str, wx: str, wy: str) -> str:
    """Signed angle from (ux, uy) to (wx, wy)."""
    return f"atan2(({ux}) * ({wy}) - ({wx}) * ({uy}), ({ux}) * ({wx}) + ({uy}) * ({wy}))"


def rotate(ax: str, ay: str, x: str, y: str) -> tuple[str, str]:
    """Coordinates of (x, y) in the frame whose y-axis points along (ax, ay)."""
    norm = f"sqrt(({ax}) * ({ax}) + ({ay}) * ({ay}))"
    return (
        f"((({ay}) * ({x}) - ({ax}) * ({y})) / {norm})",
        f"((({ax}) * ({x}) + ({ay}) * ({y})) / {norm})",
    )


def erfc(z: str) -> str:
    t = f"(1D / (1D + 0.5D * abs({z})))"
    poly = f"{ERFC_COEFFICIENTS[-1]}D"
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = f"({c}D + {t} * {poly})"
    tail = f"({t} * exp(-({z}) * ({z}) + {poly}))"
    return f"(CASE WHEN ({z}) >= 0D THEN {tail} ELSE 2D - {tail} END)"


def lognormal_cdf(x: str, mu: str, sigma: str) -> str:
    z = f"((ln(greatest({x}, {SMALL}D)) - ({mu})) / (({sigma}) * sqrt(2D)))"
    return f"(0.5D * {erfc(f'(-{z})')})"


def lognormal_sf(x: str, mu: str, sigma: str) -> str:
    """1 - CDF, kept accurate in its own tail."""
    z = f"((ln(greatest({x}, {SMALL}D)) - ({mu})) / (({sigma}) * sqrt(2D)))"
    return f"(0.5D * {erfc(z)})"


def lognormal_pdf(x: str, mu: str, sigma: str, rescale: bool = True) -> str:
    """Density, by default scaled by its value at the mode."""
    dev = f"((ln({x}) - ({mu})) / ({sigma}))"
    density = f"(exp(-0.5D * {dev} * {dev}) / (({x}) * sqrt(2D * pi()) * ({sigma})))"
    if not rescale:
        return density
    peak = (f"(exp(-0.5D * ({sigma}) * ({sigma})) / "
            f"({lognormal_mode(mu, sigma)} * sqrt(2D * pi()) * ({sigma})))")
    return f"({density} / {peak})"


def lognormal_mode(mu: str, sigma: str) -> str:
    return f"exp(({mu}) - ({sigma}) * ({sigma}))"


def extreme_cdf(x: str, mu: str, sigma: str, n: str = "10") -> str:
    return f"pow({lognormal_sf(x, mu, sigma)}, {n})"


def intensity_count(s: str, mu: str, sigma: str) -> str:
    """Number n of repetitions at which meeting spacing s becomes as likely as not."""
    sf = f"least(greatest({lognormal_sf(s, mu, sigma)}, {SMALL}D), 1D - {SMALL}D)"
    return f"(ln(0.5D) / ln({sf}))"


def intensity(s: str, mu: str, sigma: str) -> str:
    return f"log10(greatest({intensity_count(s, mu, sigma)}, 1D))"


def lognormal_nll(s: str, mu: str, log_var: str) -> str:
    ls = f"ln(greatest({s}, {SMALL}D))"
    return (f"(0.5D * (ln(2D * pi()) + ({log_var}) + pow({ls} - ({mu}), 2) / exp({log_var})) + {ls})")


def js_divergence(mu1: str, log_var1: str, mu2: str, log_var2: str) -> str:
    """Jensen-Shannon style divergence of two normal laws against their averaged normal."""
    mu = f"(0.5D * (({mu1}) + ({mu2})))"
    lv = f"ln(greatest(0.5D * (exp({log_var1}) + exp({log_var2})), {SMALL}D))"

    def kl(m: str, v: str) -> str:
        return f"(0.5D * ({lv} - ({v}) + (exp({v}) + pow(({m}) - {mu}, 2)) / exp({lv}) - 1D))"

    return f"(0.5D * ({kl(mu1, log_var1)} + {kl(mu2, log_var2)}))"


def slot_of(score: str, thresholds: Sequence[float], inclusive: bool) -> str:
    """Number of thresholds <= score (inclusive) or < score, as a balanced CASE over constants."""
    comparison = "<" if inclusive else "<="

    def build(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return (f"CASE WHEN {score} {comparison} {thresholds[mid]!r}D "
                f"THEN {build(lo, mid)} ELSE {build(mid + 1, hi)} END")

    return build(0, len(thresholds))


def null_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def clean_output(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Rounded value with NULL for NaN and infinities, plus a flag telling +inf / -inf apart."""
    out = {}
    for c in columns:
        finite = f"(isnotnull({c}) AND NOT isnan({c}) AND abs({c}) < {INF})"
        out[f"{c}_inf"] = f"CASE WHEN {c} = {INF} THEN 1 WHEN {c} = {NEG_INF} THEN -1 ELSE 0 END"
        out[c] = f"CASE WHEN {finite} THEN round({c}, {digits}) + 0D END"
    return with_exprs(df, out)
