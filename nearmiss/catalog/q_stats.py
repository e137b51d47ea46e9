"""Splits, encodings, the spacing model and attribution."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from nearmiss.catalog.fixture_sql import FRAMES, pairs as pairs_sql
from nearmiss.catalog.q_clean import EVT
from nearmiss.catalog.q_frames import FEATURE_SQL, PROFILE_SQL
from nearmiss.catalog.q_reports import STATS, _describe_sql
from nearmiss.catalog.registry import register
from nearmiss.functions.numeric import ERFC_COEFFICIENTS, rounded_double, with_exprs
from nearmiss.operators import attribution as att
from nearmiss.operators import frames as op
from nearmiss.operators import stats as stt
from nearmiss.plans import derived, fixture
from nearmiss.plans import factors as fc
from nearmiss.session import cut_lineage


def rounded(df, columns, digits=6):
    return with_exprs(df, {c: f"{rounded_double(c, digits)} + 0D" for c in columns})


def rs(columns, digits=6):
    return ", ".join(f"round({c}, {digits}) + 0 AS {c}" for c in columns)


SPLIT = "split AS (SELECT o_custkey, row_number() OVER (ORDER BY md5(o_custkey || '-131'), o_custkey) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders))"
register("split_by_event", "M1", lambda s, d: stt.split_by_event(fixture.table(s, d, "orders"), "o_custkey"),
         f"WITH {SPLIT} SELECT o_custkey, CASE WHEN r < floor(0.8::DOUBLE * n) THEN 'train' ELSE 'val' END AS part FROM split")


def dims_job(spark, sf_dir):
    donors = fixture.table(spark, sf_dir, "part").selectExpr("p_partkey AS event_id", "CASE WHEN p_size % 4 > 0 THEN CAST(p_size AS DOUBLE) / 4D END AS target_length", "p_retailprice AS target_width")
    return stt.random_dims(fixture.table(spark, sf_dir, "customer").selectExpr("c_custkey AS event_id"), donors)


register("random_dims", "M2", dims_job, """WITH d AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS m, CAST(p_size AS DOUBLE) / 4 AS random_length, p_retailprice AS random_width FROM part WHERE p_size % 4 > 0)
SELECT c_custkey AS event_id, random_length, random_width FROM customer JOIN d ON d.i = CAST('0x' || substr(md5(c_custkey || '-131'), 1, 15) AS BIGINT) % d.m""")


def mix_job(spark, sf_dir):
    a = fixture.table(spark, sf_dir, "customer").selectExpr("c_custkey AS scene_id", "c_acctbal AS s")
    b = fixture.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS scene_id", "s_acctbal AS s")
    return stt.mix_datasets(a, b, 0.3)


register("mix_datasets", "M3", mix_job, """WITH r AS (SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY md5(s_suppkey || '-131'), s_suppkey) - 1 AS r, count(*) OVER () AS n FROM supplier)
SELECT c_custkey AS scene_id, c_acctbal AS s FROM customer UNION ALL
SELECT s_suppkey + (SELECT max(c_custkey) + 1 FROM customer), s_acctbal FROM r WHERE r < floor(n * 0.3::DOUBLE)""")


THREE_SETS = ("SafeBaseline", "ArgoverseHV", "highD")


def mix_three_job(spark, sf_dir):
    sets = [fixture.table(spark, sf_dir, t).selectExpr(f"{i} AS scene_id", f"{v} AS s") for t, i, v in (
        ("customer", "c_custkey", "c_acctbal"), ("part", "p_partkey", "p_retailprice"), ("supplier", "s_suppkey", "s_acctbal"))]
    return stt.mix_sets(list(zip(sets, stt.mixing_rates(THREE_SETS))))


register("mix_three_sets", "M3", mix_three_job, """WITH a AS (SELECT max(c_custkey) + 1 AS o FROM customer),
p AS (SELECT p_partkey + o AS scene_id, p_retailprice AS s FROM part, a), b AS (SELECT max(scene_id) + 1 AS o FROM p),
r AS (SELECT *, row_number() OVER (ORDER BY md5(scene_id || '-131'), scene_id) - 1 AS r, count(*) OVER () AS n FROM p)
SELECT c_custkey AS scene_id, c_acctbal AS s FROM customer UNION ALL SELECT scene_id, s FROM r WHERE r < floor(n * 0.1::DOUBLE)
UNION ALL SELECT s_suppkey + o, s_acctbal FROM supplier, b""")


def one_hot_job(spark, sf_dir):
    events = derived.event_table(spark, sf_dir).withColumn("surfaceCondition", F.expr("CASE WHEN surfaceCondition = 'Other' THEN 'Unknown' ELSE surfaceCondition END"))
    out = stt.one_hot_environment(events, events)
    return with_exprs(out, {"width": "CAST(size(environment) AS BIGINT)", "code": "array_join(transform(environment, x -> CAST(x AS INT)), '')"}).select("event_id", "width", "code")


def _hot(col):
    return f"(SELECT string_agg(CASE WHEN l = {col} THEN '1' ELSE '0' END, '' ORDER BY l) FROM (SELECT DISTINCT {col}_ AS l FROM kn))"


register("one_hot_environment", "M4", one_hot_job, f"""WITH {EVT}, en AS (SELECT event_id, lighting, weather, CASE WHEN surfaceCondition = 'Other' THEN 'Unknown' ELSE surfaceCondition END AS surfaceCondition, trafficDensity FROM evt),
kn AS (SELECT lighting AS lighting_, weather AS weather_, surfaceCondition AS surfaceCondition_, trafficDensity AS trafficDensity_ FROM en
  WHERE coalesce(lighting, 'Unknown') <> 'Unknown' AND coalesce(weather, 'Unknown') <> 'Unknown' AND coalesce(surfaceCondition, 'Unknown') <> 'Unknown' AND coalesce(trafficDensity, 'Unknown') <> 'Unknown'),
ls AS (SELECT list_sort(list(DISTINCT lighting_)) AS a, list_sort(list(DISTINCT weather_)) AS b, list_sort(list(DISTINCT surfaceCondition_)) AS c, list_sort(list(DISTINCT trafficDensity_)) AS d FROM kn),
cd AS (SELECT event_id, list_concat(list_concat(list_transform(a, lambda x: coalesce(x = lighting, false)::INT), list_transform(b, lambda x: coalesce(x = weather, false)::INT)),
  list_concat(list_transform(c, lambda x: coalesce(x = surfaceCondition, false)::INT), list_transform(d, lambda x: coalesce(x = trafficDensity, false)::INT))) AS code FROM en, ls)
SELECT event_id, len(code) AS width, array_to_string(code, '') AS code FROM cd""")

FEATS = list(op.CURRENT)


def all_features(spark, sf_dir):
    return op.current_features(fixture.pairs(spark, sf_dir, varied_dims=True)).select("event_id", "target_id", "k", *FEATS)


register("feature_std", "A26", lambda s, d: rounded(stt.feature_std(all_features(s, d), FEATS), FEATS, 4),
         f"WITH {pairs_sql(varied_dims=True)}, {FEATURE_SQL.format(src='pairs')} SELECT " + ", ".join(f"round(stddev_samp({c}), 4) AS {c}" for c in FEATS) + " FROM feat")
register("perturb", "M5", lambda s, d: rounded(stt.perturb(all_features(s, d), FEATS), FEATS))


def perturb_bounds_job(spark, sf_dir):
    """Is every feature moved, by no more than 8 times its share of noise, with angles kept in range?"""
    feats = all_features(spark, sf_dir)
    was = feats.select("event_id", "target_id", "k", *(F.col(c).alias(f"was_{c}") for c in FEATS))
    spread = feats.agg(F.struct(*(F.stddev_samp(c).alias(c) for c in FEATS))).scalar()
    both = stt.perturb(feats, FEATS).join(was, ["event_id", "target_id", "k"]).withColumn("std", spread)
    inside, moved = F.lit(True), F.lit(False)
    for c in FEATS:
        off = F.abs(F.col(c) - F.col(f"was_{c}"))
        if c in ("psi_sur", "rho"):
            off = F.least(off, F.lit(2 * math.pi) - off)
            inside = inside & (F.col(c) >= -math.pi) & (F.col(c) < math.pi)
        inside, moved = inside & (off <= 0.08 * F.col(f"std.{c}") + 1e-9), moved | (off > 0)
    return both.select("event_id", "target_id", "k", inside.alias("inside"), moved.alias("moved"))


register("perturb_bounds", "M5", perturb_bounds_job, f"WITH {pairs_sql()} SELECT event_id, target_id, k, true AS inside, true AS moved FROM pairs")

# --- spacing model -------------------------------------------------------------------------------


def scored(spark, sf_dir):
    """Pair frames with a spacing and plausible log-normal parameters."""
    return fixture.pairs(spark, sf_dir).selectExpr(
        "event_id", "target_id", "k", "sqrt(pow(x_sur - x_ego, 2) + pow(y_sur - y_ego, 2)) / 2D AS s", "1.5D + 0.03D * v_ego + 0.1D * hx_sur AS mu", "0.25D + 0.01D * abs(acc_ego) AS sigma")


SC = """sco AS (SELECT event_id, target_id, k, sqrt(power(x_sur - x_ego, 2) + power(y_sur - y_ego, 2)) / 2 AS s, 1.5 + 0.03 * v_ego + 0.1 * hx_sur AS mu, 0.25 + 0.01 * abs(acc_ego) AS sigma FROM pairs)"""


def erfc_sql(z):
    t = f"(1 / (1 + 0.5 * abs({z})))"
    poly = " + ".join(f"({c}) * power({t}, {i})" for i, c in enumerate(ERFC_COEFFICIENTS))
    tail = f"({t} * exp(-({z}) * ({z}) + {poly}))"
    return f"(CASE WHEN {z} >= 0 THEN {tail} ELSE 2 - {tail} END)"


Z = "z AS (SELECT *, (ln(greatest(s, 1e-6)) - mu) / (sigma * sqrt(2)) AS z FROM sco)"
CNT = f"ln(0.5) / ln(least(greatest(0.5 * {erfc_sql('z')}, 1e-6), 1 - 1e-6))"
register("score_intensity", "M7", lambda s, d: rounded(stt.score_intensity(scored(s, d)).select("event_id", "target_id", "k", "intensity"), ["intensity"], 5),
         f"WITH {pairs_sql()}, {SC}, {Z} SELECT event_id, target_id, k, round(log10(greatest({CNT}, 1)), 5) + 0 AS intensity FROM z")
register("score_intensity_raw", "M7", lambda s, d: rounded(with_exprs(stt.score_intensity(scored(s, d), raw=True), {"ln_n": "ln(intensity)"}).select("event_id", "target_id", "k", "ln_n"), ["ln_n"], 5),
         f"WITH {pairs_sql()}, {SC}, {Z} SELECT event_id, target_id, k, round(ln({CNT}), 5) + 0 AS ln_n FROM z")
CURVES = ["pdf", "cdf", "mode", "extreme"]
register("lognormal_curves", "M8", lambda s, d: rounded(stt.lognormal_curves(scored(s, d)).select("event_id", "target_id", "k", *CURVES), CURVES), f"""WITH {pairs_sql()}, {SC}, {Z}
SELECT event_id, target_id, k, round(exp(-0.5 * power((ln(s) - mu) / sigma, 2)) / s * exp(mu - sigma * sigma) / exp(-0.5 * sigma * sigma), 6) + 0 AS pdf, round(0.5 * {erfc_sql('(-z)')}, 6) + 0 AS cdf,
  round(exp(mu - sigma * sigma), 6) AS mode, round(power(0.5 * {erfc_sql('z')}, 10), 6) + 0 AS extreme FROM z""")
NLL = "0.5 * (ln(2 * pi()) + 2 * ln(sigma) + power((ln(greatest(s, 1e-6)) - mu) / sigma, 2)) + ln(greatest(s, 1e-6))"
register("lognormal_nll", "A25", lambda s, d: rounded(stt.mean_nll(scored(s, d)), ["nll"]), f"WITH {pairs_sql()}, {SC} SELECT round(avg({NLL}), 6) AS nll FROM sco")


def _kl(m, s):
    return f"0.5 * (ln(va) - 2 * ln({s}) + ({s} * {s} + power({m} - (mu + mu2) / 2, 2)) / va - 1)"


register("js_divergence", "M9", lambda s, d: rounded(stt.smoothed_nll(with_exprs(scored(s, d), {"mu2": "mu + 0.05D * sigma", "sigma2": "sigma * 1.1D"})), ["nll", "divergence", "smooth_nll"]), f"""WITH {pairs_sql()}, {SC},
j AS (SELECT *, mu + 0.05 * sigma AS mu2, sigma * 1.1 AS sigma2, (sigma * sigma + power(sigma * 1.1, 2)) / 2 AS va FROM sco),
a AS (SELECT avg({NLL}) AS nll, avg(0.5 * ({_kl('mu', 'sigma')} + {_kl('mu2', 'sigma2')})) AS dv FROM j)
SELECT round(nll, 6) AS nll, round(dv, 6) AS divergence, round(nll + 5 * dv, 6) AS smooth_nll FROM a""")
register("model_inspection", "A29 A17", lambda s, d: rounded(stt.model_inspection(scored(s, d)), STATS, 4),
         f"WITH {pairs_sql()}, {SC} " + _describe_sql([("mu", "mu", "sco"), ("sigma", "sigma", "sco"), ("mode", "exp(mu - sigma * sigma)", "sco")]))
BINS = {"delta_v2": 400.0, "acc_ego": 0.8}


def binned_job(spark, sf_dir):
    return rounded(stt.fit_binned_lognormal(op.current_features(fixture.pairs(spark, sf_dir)), BINS), ["mu", "sigma"], 5)


BIN = f"""{FEATURE_SQL.format(src='pairs')},
bn AS (SELECT CAST(floor(delta_v2 / 400) AS BIGINT) AS delta_v2_bin, CAST(floor(acc_ego / 0.8::DOUBLE) AS BIGINT) AS acc_ego_bin, count(*) AS n, avg(ln(s)) AS mu, sqrt(var_pop(ln(s))) AS sigma FROM feat GROUP BY ALL)"""
register("fit_binned_lognormal", "M6", binned_job, f"WITH {pairs_sql()}, {BIN} SELECT * REPLACE ({rs(['mu', 'sigma'], 5)}) FROM bn")


def score_binned_job(spark, sf_dir):
    feats = cut_lineage(op.current_features(fixture.pairs(spark, sf_dir)).select("event_id", "target_id", "k", "s", *BINS), "features")
    model = cut_lineage(stt.fit_binned_lognormal(feats, BINS), "cells")
    out = stt.score_intensity(stt.apply_binned(feats, model, BINS, narrow=0.01))
    return rounded(out.select("event_id", "target_id", "k", "intensity"), ["intensity"], 4)


POOLED = "sum(n * mu) / sum(n) AS mu, sqrt(greatest(sum(n * (sigma * sigma + mu * mu)) / sum(n) - power(sum(n * mu) / sum(n), 2), 0)) AS sigma"
register("score_binned_model", "M6 M7", score_binned_job, f"""WITH {pairs_sql()}, {BIN},
pa AS (SELECT delta_v2_bin, {POOLED} FROM bn GROUP BY 1), al AS (SELECT {POOLED} FROM bn),
sco AS (SELECT event_id, target_id, k, s, CASE WHEN bn.sigma > 0.01 THEN bn.mu WHEN pa.sigma > 0.01 THEN pa.mu ELSE al.mu END AS mu,
               CASE WHEN bn.sigma > 0.01 THEN bn.sigma WHEN pa.sigma > 0.01 THEN pa.sigma ELSE al.sigma END AS sigma
        FROM feat LEFT JOIN bn ON bn.delta_v2_bin = CAST(floor(delta_v2 / 400) AS BIGINT) AND bn.acc_ego_bin = CAST(floor(acc_ego / 0.8::DOUBLE) AS BIGINT)
        LEFT JOIN pa ON pa.delta_v2_bin = CAST(floor(delta_v2 / 400) AS BIGINT), al), {Z}
SELECT event_id, target_id, k, round(log10(greatest({CNT}, 1)), 4) + 0 AS intensity FROM z""")
COLS = [c for c in op.CURRENT if c != "acc_ego"]


def linear_features(spark, sf_dir):
    return cut_lineage(op.current_features(fixture.pairs(spark, sf_dir, varied_dims=True)).select("event_id", "target_id", "k", "s", *COLS), "features")


def linear_job(spark, sf_dir):
    feats = linear_features(spark, sf_dir)
    mean, log_var = stt.fit_linear_lognormal(feats, COLS)
    out = stt.score_intensity(stt.apply_linear(feats, mean, log_var))
    return rounded(out.select("event_id", "target_id", "k", "mu", "sigma", "intensity"), ["mu", "sigma", "intensity"], 4)


register("fit_linear_lognormal", "M6 M7", linear_job)


def embedding_vectors(spark, sf_dir):
    return fixture.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def centres_job(spark, sf_dir):
    vectors = embedding_vectors(spark, sf_dir)
    return att.nearest_centre(vectors, "v", att.mini_batch_centres(vectors, "v"), ["vec_id"])


register("reference_points", "M10", centres_job)


def nearest_job(spark, sf_dir):
    """Is no centre nearer than the one a row is given? Distances summed up element by element."""
    vectors = embedding_vectors(spark, sf_dir)
    centres = att.mini_batch_centres(vectors, "v")
    every = spark.createDataFrame([([list(map(float, c)) for c in centres],)], "c array<array<double>>").select("c").scalar()
    given = att.nearest_centre(vectors, "v", centres, ["vec_id", "v"]).withColumn("c", every)
    away = "transform(c, p -> aggregate(zip_with(v, p, (a, b) -> (a - b) * (a - b)), 0D, (t, x) -> t + x))"
    return with_exprs(given, {"d": away}).selectExpr("vec_id", "element_at(d, centre + 1) <= array_min(d) + 1e-9D AS nearest")


register("reference_points_nearest", "M10", nearest_job, "SELECT DISTINCT vec_id, true AS nearest FROM embeddings")


def attribute_job(spark, sf_dir):
    """The 21 factors under a model fitted to the scenes, against 1,024 centres of the scenes."""
    scenes = cut_lineage(fc.scene_vectors(spark, sf_dir), "scenes")
    mean, log_var = stt.fit_vector_lognormal(scenes, "f")
    centres = att.mini_batch_centres(scenes, "f")
    grids = att.factor_grids(scenes, "f", mean, log_var, centres, fc.positions())
    out = att.attribute_intensity(att.enough_tasks(scenes), "f", mean, log_var, centres, fc.positions(), grids=grids)
    return rounded(out, ["intensity", *[f"{p}_{c}" for c in fc.positions() for p in ("eg", "std")]], 5)


register("attribute_intensity", "M11", attribute_job)


def attribute_fixed_job(spark, sf_dir):
    out = att.attribute_intensity(fc.scene_vectors(spark, sf_dir), "f", fc.FIXED_MEAN, fc.FIXED_LOG_VAR, fc.FIXED_POINTS, fc.positions())
    return rounded(out, ["intensity", *[f"{p}_{c}" for c in fc.positions() for p in ("eg", "std")]], 4)


def attribute_fixed_sql():
    """Shares of each factor as lists, then every scene against every reference point and factor."""
    n, rows = len(fc.CONTEXT), op.HISTORY // len(fc.PASSED)

    def share(weights):
        at, parts = n + 1, [f"{weights[i + 1]!r} * {c} / {d!r}" for i, (c, d) in enumerate(fc.CONTEXT.items())]
        for labels, by in fc.SURROUNDINGS.values():
            parts.append(f"[{', '.join(map(repr, weights[at:at + labels]))}][CAST(event_id // {by} % {labels} + 1 AS INT)]")
            at += labels
        for i in range(len(fc.PASSED)):
            lo = op.HISTORY - rows * (i + 1)
            parts.append("(" + " + ".join(f"list_dot_product(h_{c}[{lo + 1}:{lo + rows}], [{', '.join(repr(weights[at + len(fc.PROFILE) * r + j] / d) for r in range(lo, lo + rows))}])"
                                         for j, (c, d) in enumerate(fc.PROFILE.items())) + ")")
        return "[" + ", ".join(f"CAST({p} AS DOUBLE)" for p in parts) + "]"

    at = fc.positions()
    points = ", ".join(f"({c}, {g}, {sum(p[i] * fc.FIXED_MEAN[i + 1] for i in own)!r}, {sum(p[i] * fc.FIXED_LOG_VAR[i + 1] for i in own)!r})"
                       for c, p in enumerate(fc.FIXED_POINTS) for g, own in enumerate(at.values(), 1))
    num, yaw = (part.strip() for part in PROFILE_SQL.split("prof AS (")[0].rstrip().rstrip(",").split("yaw AS ("))
    count = CNT
    lists = ", ".join(f"list({x}) OVER h AS h_{c}" for c, x in (("yaw_ego", "yaw_ego"), ("v_ego", "abs(v_ego)"), ("vx_sur", "pvx"), ("vy_sur", "pvy")))
    z = "(ln(s) - {m}) / (exp(0.5::DOUBLE * {v}) * sqrt(2))"
    columns = ", ".join(f"round(max(eg) FILTER (g = {g}), 4) + 0 AS eg_{c}, round(max(sd) FILTER (g = {g}), 4) + 0 AS std_{c}" for g, c in enumerate(at, 1))
    return f"""WITH {pairs_sql(varied_dims=True)}, {num} yaw AS ({yaw},
prof AS (SELECT *, {lists} FROM yaw WINDOW h AS (PARTITION BY event_id, target_id ORDER BY k ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING)),
{FEATURE_SQL.format(src='prof')},
sh AS MATERIALIZED (SELECT event_id, target_id, k, s, {share(fc.FIXED_MEAN)} AS xm, {share(fc.FIXED_LOG_VAR)} AS xv FROM feat WHERE n >= 30 AND idx >= 26),
mo AS MATERIALIZED (SELECT *, {fc.FIXED_MEAN[0]} + list_sum(xm) AS mu, {fc.FIXED_LOG_VAR[0]} + list_sum(xv) AS lv FROM sh),
b0 AS (SELECT *, {z.format(m='mu', v='lv')} AS z FROM mo),
ba AS MATERIALIZED (SELECT * EXCLUDE (z), log10(greatest({count}, 1)) AS intensity FROM b0),
rp(c, g, rm, rv) AS (VALUES {points}),
g0 AS (SELECT event_id, target_id, k, g, intensity, {z.format(m='(mu + rm - xm[g])', v='(lv + rv - xv[g])')} AS z FROM ba, rp),
ga AS (SELECT event_id, target_id, k, g, any_value(intensity) AS intensity, avg(gain) AS eg, stddev_pop(gain) AS sd
       FROM (SELECT *, intensity - log10(greatest({count}, 1)) AS gain FROM g0) GROUP BY ALL)
SELECT event_id, target_id, k, round(any_value(intensity), 4) + 0 AS intensity, {columns} FROM ga GROUP BY ALL"""


register("attribute_fixed_model", "M11", attribute_fixed_job, attribute_fixed_sql())


def summary_job(spark, sf_dir):
    log = fixture.frames(spark, sf_dir).selectExpr("event_type AS dataset", "track_id % 3 AS run", "k * 1000 + track_id AS epoch", "abs(acc) + 0.001D * kk AS val_loss")
    samples = fixture.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("dataset"), F.expr("user_id div 5 % 3").alias("run")).agg(F.count(F.lit(1)).alias("num_samples"))
    return rounded(stt.dataset_summary(log, samples, ["dataset", "run"]), ["val_loss"])


register("dataset_summary", "M13 A21", summary_job, f"""WITH {FRAMES},
l AS (SELECT event_type AS dataset, track_id % 3 AS run, k * 1000 + track_id AS epoch, abs(acc) + 0.001 * kk AS val_loss FROM fr),
t AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY dataset, run ORDER BY epoch DESC) <= 5),
n AS (SELECT dataset, run, count(*) AS c FROM l GROUP BY ALL)
SELECT dataset, run, round((sum(val_loss) - min(val_loss) - max(val_loss)) / 3, 6) AS val_loss, any_value(c) AS num_epochs_trained, any_value(c) AS num_samples FROM t JOIN n USING (dataset, run) GROUP BY 1, 2""")


def set_ops_job(spark, sf_dir):
    """Validation ids as all minus train, and events both annotated and scored."""
    ids = stt.split_by_event(fixture.table(spark, sf_dir, "orders"), "o_custkey")
    val = ids.select("o_custkey").exceptAll(ids.where("part = 'train'").select("o_custkey"))
    priced = fixture.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return val.intersect(priced)


register("split_set_operations", "M1 J11", set_ops_job, f"""WITH {SPLIT} SELECT o_custkey FROM split WHERE r >= floor(0.8::DOUBLE * n) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
