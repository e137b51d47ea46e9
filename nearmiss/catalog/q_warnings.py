"""Danger windows, target choice and voting, warning records and their metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearmiss.catalog import warning_sql as sql
from nearmiss.catalog.fixture_sql import FRAMES, META, pairs as pairs_sql
from nearmiss.catalog.registry import register
from nearmiss.functions.numeric import with_exprs
from nearmiss.operators import indicators as ind
from nearmiss.operators import metrics as mt
from nearmiss.operators import warnings as wn
from nearmiss.plans import fixture, scored
from nearmiss.session import cut_lineage

SMALL_TH = wn.threshold_grid("TTC2D")
LARGE_TH = wn.threshold_grid("intensity")
QUART = [f"{n}_{t}" for t in ("pre_danger", "danger") for n in ("q25", "q50", "q75")]
TIMES = ["impact_time", "reaction_time", "warning_timestamp", "true_warning_period"]


def rounded(df, columns, digits=6):
    return with_exprs(df, {c: f"round({c}, {digits}) + 0D" for c in columns})


def rsql(columns, digits=6):
    return ", ".join(f"round({c}, {digits}) + 0 AS {c}" for c in columns)


# --- entry query: riskiest target by anticipated collision time ------------------------------------

def riskiest_job(spark, sf_dir):
    scores = ind.act(fixture.pairs(spark, sf_dir)).select(
        "event_id", "target_id", "k", "time", F.col("ACT").alias("score"))
    meta = wn.danger_window(fixture.event_meta(spark, sf_dir))
    return rounded(wn.riskiest_target(scores, meta, small=True), ["mean_score"], 4)


def _act_check():
    from nearmiss.catalog.q_indicators import CHECKS, P
    head = "WITH " + pairs_sql()
    body = CHECKS["ACT"][len(P):]
    body = body[:body.rindex("SELECT event_id, target_id, k, CASE WHEN isfinite")]
    return f"""{head}{body}, {META},
s AS (SELECT event_id, target_id, k, CASE WHEN d < 1e-9 THEN NULL WHEN r < 0 THEN 'inf'::DOUBLE ELSE r END AS score FROM a1),
g AS (SELECT event_id, target_id, avg(score) AS mean
      FROM s JOIN meta USING (event_id)
      WHERE CAST(k AS DOUBLE) / 10 BETWEEN least(impact_timestamp - 4500, start_timestamp) / 1000 AND least(impact_timestamp + 500, end_timestamp) / 1000
      GROUP BY ALL)
SELECT event_id, target_id, round(mean, 4) AS mean_score FROM g WHERE mean IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY mean, target_id) = 1"""


register("riskiest_target", "A5 J7 R1", riskiest_job, _act_check())

register("danger_window", "R1", lambda s, d: scored.annotated_meta(s, d).select(
    "event_id", "danger_start", "danger_end"), f"WITH {sql.ANNOTATED} SELECT event_id, danger_start, danger_end FROM m")


def phase_job(spark, sf_dir):
    meta = wn.eligible(scored.annotated_meta(spark, sf_dir))
    fr = wn._phases(scored.small_scores(spark, sf_dir), meta)
    flag = wn.flag_conflict(F.col("score"), 12.0, small=True)
    return fr.groupBy("event_id", "target_id").agg(
        F.count(F.when(F.col("_danger"), 1)).alias("n_danger"), F.count(F.when(F.col("_pre"), 1)).alias("n_pre"),
        F.count(F.when(flag, 1)).alias("n_flagged"))


register("danger_join", "J7 R2 J6", phase_job, f"""{sql.base('small')}, {sql.targets(True)}
SELECT event_id, target_id, count(*) FILTER (dg) AS n_danger, count(*) FILTER (pre) AS n_pre,
       count(*) FILTER (coalesce(score < 12, false)) AS n_flagged FROM ph GROUP BY ALL""")

for _kind, _small in (("small", True), ("large", False)):
    def _target_job(spark, sf_dir, kind=_kind, small=_small):
        scores = getattr(scored, f"{kind}_scores")(spark, sf_dir)
        out = wn.determine_target(cut_lineage(scores, "scores"), wn.eligible(scored.annotated_meta(spark, sf_dir)), small)
        return rounded(out, QUART)
    register(f"determine_target_{_kind}", "R3 A5 A6", _target_job, f"""{sql.base(_kind)}, {sql.targets(_small)}
SELECT event_id, target_id, n_danger, {rsql(QUART)} FROM tg""")

    def _records_job(spark, sf_dir, kind=_kind, small=_small):
        scores = cut_lineage(getattr(scored, f"{kind}_scores")(spark, sf_dir), "scores")
        th = SMALL_TH if small else LARGE_TH
        out = wn.warning_records(scores, scored.annotated_meta(spark, sf_dir), th, small)
        return rounded(out, QUART)
    register(f"warning_records_{_kind}", "R4 R2 J8 W9 P20", _records_job, f"""{sql.base(_kind)}, {sql.targets(_small)},
{sql.records(_small, SMALL_TH if _small else LARGE_TH)}
SELECT * REPLACE ({rsql(QUART)}) FROM rec""")

VOTES_SQL = """
vt AS (SELECT event_id, 'model_' || mm AS model,
              CASE WHEN event_id % 10 = 3 OR (mm + event_id) % 9 = 0 THEN NULL
                   WHEN mm % 16 < 4 + event_id % 12 THEN event_id * 10 + 1 WHEN event_id % 2 = 0 THEN event_id * 10 + 2
                   ELSE event_id * 10 + 1 + mm % 3 END AS target_id
       FROM meta, (SELECT unnest(range(16)) AS mm)),
tally AS (SELECT event_id, target_id, count(*) AS v FROM vt WHERE target_id IS NOT NULL GROUP BY ALL),
best AS (SELECT *, sum(v) OVER (PARTITION BY event_id) AS given FROM tally
         QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY v DESC, target_id) = 1),
voted AS (
  SELECT event_id, CASE WHEN v >= 16 / 3.0 AND given - v < 16 / 3.0 THEN target_id ELSE -1 END AS target_id,
         CASE WHEN v IS NULL THEN 'No target is identified by any SSMs' WHEN v < 16 / 3.0 THEN 'The most votes are less than 1/3 of total'
              WHEN given - v >= 16 / 3.0 THEN 'More than 1/3 votes are not for the most voted target'
              ELSE 'For: ' || v || ', against: ' || (given - v)::BIGINT || ', abstentions: ' || (16 - given)::BIGINT END AS target_note
  FROM (SELECT DISTINCT event_id FROM vt) LEFT JOIN best USING (event_id))"""


def vote_job(spark, sf_dir):
    return wn.vote_target(scored.votes(spark, sf_dir), 16)


register("vote_target", "R5 A18", vote_job, f"""WITH {META}, {VOTES_SQL} SELECT event_id, target_id, target_note FROM voted""")


def first_votes_job(spark, sf_dir):
    base = fixture.pairs(spark, sf_dir).selectExpr(
        "concat('m', target_id % 10) AS model", "event_id", "CAST(k AS DOUBLE) AS threshold",
        "CASE WHEN (k + event_id) % 60 = 0 THEN target_id + k END AS target_id")
    return wn.first_votes(base)


register("first_non_null", "A19", first_votes_job, f"""WITH {pairs_sql()}
SELECT 'm' || (target_id % 10) AS model, event_id, arg_min(CASE WHEN (k + event_id) % 60 = 0 THEN target_id + k END, k)
       FILTER ((k + event_id) % 60 = 0) AS target_id FROM pairs GROUP BY 1, 2""")


def voted_records(spark, sf_dir, kind="large"):
    targets = wn.vote_target(scored.votes(spark, sf_dir), 16).where("target_id >= 0")
    # the given tracks end at the last event numbers: a voted object may not exist, and a whole event may lack scores
    scores = cut_lineage(getattr(scored, f"{kind}_scores")(spark, sf_dir), "scores")
    seen = scores.select("event_id", "target_id").distinct()
    found = targets.join(seen, ["event_id", "target_id"], "left_semi")
    targets = found.unionByName(targets.join(seen, "event_id", "left_anti"))
    th = SMALL_TH if kind == "small" else LARGE_TH
    return wn.warning_records(scores, scored.annotated_meta(spark, sf_dir), th, kind == "small",
                              targets=targets, with_onset=True)


def voted_sql(kind):
    return f"""{sql.base(kind)}, {VOTES_SQL},
tg AS (SELECT event_id, target_id FROM voted WHERE target_id >= 0 AND (event_id, target_id) IN (SELECT event_id, target_id FROM sc)),
mv AS (SELECT * FROM m WHERE event_id IN (SELECT event_id FROM tg)
       OR event_id IN (SELECT event_id FROM voted WHERE target_id >= 0 AND event_id NOT IN (SELECT event_id FROM sc))),
ph AS (
  SELECT s.*, time >= danger_start / 1000 AND time <= danger_end / 1000 AS dg, time < danger_start / 1000 AS pre,
         time < start_timestamp / 1000 - 3 AS early, time <= impact_timestamp / 1000 AS upto FROM sc s JOIN mv USING (event_id)),
{sql.records(kind == 'small', SMALL_TH if kind == 'small' else LARGE_TH, meta='mv', voted=True, onset=True)}"""


for _kind in ("small", "large"):
    register(f"warning_records_voted_{_kind}", "R6 W10",
             lambda s, d, kind=_kind: rounded(voted_records(s, d, kind), TIMES, 4),
             f"{voted_sql(_kind)} SELECT * REPLACE ({rsql(TIMES, 4)}) FROM rec")


def issue_job(spark, sf_dir):
    out = wn.issue_warning(cut_lineage(scored.large_scores(spark, sf_dir), "scores"), scored.annotated_meta(spark, sf_dir), 3.0, small=False)
    return rounded(out, [*QUART, *TIMES])


register("issue_warning", "R7 W10", issue_job, f"""{sql.base('large')}, {sql.targets(False)}, {sql.records(False, [3.0], onset=True)}
SELECT event_id, threshold AS optimal_threshold, danger_start, danger_end, danger_recorded, target_id, {rsql([*QUART, *TIMES])} FROM rec""")


def safe_ids_job(spark, sf_dir):
    scores, meta = cut_lineage(scored.large_scores(spark, sf_dir), "scores"), wn.eligible(scored.annotated_meta(spark, sf_dir))
    targets = wn.determine_target(scores, meta, False).where("n_danger >= 20")
    safe = wn.safe_targets(scores, meta, targets, LARGE_TH, False)
    return wn.attach_safe_ids(meta.select("event_id"), safe)


register("safe_target_ids", "R4", safe_ids_job, f"""{sql.base('large')}, {sql.targets(False)}, {sql.records(False, [1.0])},
ids AS (SELECT event_id, string_agg(target_id, ',' ORDER BY target_id) AS ids FROM calm GROUP BY 1)
SELECT event_id, coalesce(ids, 'none') AS safe_target_ids FROM el LEFT JOIN ids USING (event_id)""")

# --- sweeps and metrics ----------------------------------------------------------------------------

GRIDS = {  # start, stop and step of each sweep, as the check computes them
    "TAdv": "SELECT round(power(i * 0.0115::DOUBLE, 7), 2) AS t FROM range(153) r(i)",
    "TTC2D": "SELECT round(power(i * 0.0135::DOUBLE, 7), 2) AS t FROM range(144) r(i)",
    "EI": """SELECT round((power(8, i * 0.0265::DOUBLE) - 1) / 50, 2) * f AS t FROM range(88) r(i), (VALUES (1), (-3)) v(f) WHERE f = 1 OR i % 2 = 0""",
    "UCD": "SELECT round(power(10, i * 0.055::DOUBLE)) - 2 AS t FROM range(109) r(i)",
    "intensity": "SELECT round(i * 0.06::DOUBLE - 0.06, 2) AS t FROM range(100) r(i)",
}


def sweep_job(spark, sf_dir, name):
    small = name in ("TAdv", "TTC2D")
    scores = (scored.small_scores if small else scored.large_scores)(spark, sf_dir)
    out = wn.sweep_counts(scores.selectExpr("target_id % 10 AS lane", "score"), wn.threshold_grid(name), small, ["lane"])
    return rounded(out, ["threshold"], 4)


for _name, _grid in GRIDS.items():
    _small = _name in ("TAdv", "TTC2D")
    register(f"threshold_sweep_{_name.lower()}", "P25 J8", lambda s, d, n=_name: sweep_job(s, d, n),
             f"""{sql.base('small' if _small else 'large')},
grid AS (SELECT DISTINCT round(t + 0, 4) AS threshold FROM ({_grid}))
SELECT target_id % 10 AS lane, threshold, count(*) FILTER (score {'<' if _small else '>'} threshold) AS flagged FROM sc, grid GROUP BY ALL""")

REC = voted_sql("large") + ", recs AS (SELECT 'intensity' AS model, * FROM rec)"
CONF = """
conf AS (
  SELECT model, threshold, count(*) FILTER (danger_recorded AND true_warning > 0.5) AS TP,
         coalesce(sum(num_false_warning) FILTER (safety_recorded), 0)::BIGINT AS FP,
         coalesce(sum(num_true_non_warning) FILTER (safety_recorded), 0)::BIGINT AS TN,
         count(*) FILTER (danger_recorded AND true_warning < 0.5) AS FN FROM recs GROUP BY ALL),
rated AS (
  SELECT *, FN / greatest(1e-6, TP + FN) AS fnr, FP / greatest(1e-6, FP + TN) AS fpr, TP / greatest(1e-6, TP + FP) AS precision,
         TP / greatest(1e-6, TP + FN) AS recall, TP / greatest(1e-6, TP + 0.5 * (FP + FN)) AS f1 FROM conf),
raw AS (
  SELECT model, threshold, TP, FP, TN, FN, FN / nullif(TP + FN, 0) AS fnr, FP / nullif(FP + TN, 0) AS fpr, TP / nullif(TP + FP, 0) AS precision,
         TP / nullif(TP + FN, 0) AS recall, TP / nullif(TP + 0.5 * (FP + FN), 0) AS f1 FROM conf)"""


def recs(spark, sf_dir):
    """Records as a stored table: the metrics read them more than once."""
    return cut_lineage(voted_records(spark, sf_dir).withColumn("model", F.lit("intensity")), "records")


register("confusion_by_threshold", "A7", lambda s, d: mt.confusion_by_threshold(recs(s, d)),
         f"{REC}, {CONF} SELECT * FROM conf")
RATES = ["fnr", "fpr", "precision", "recall", "f1"]
register("rates", "R8", lambda s, d: rounded(mt.rates(mt.confusion_by_threshold(recs(s, d))), RATES),
         f"{REC}, {CONF} SELECT * REPLACE ({rsql(RATES)}) FROM rated")
OPT = """
top AS (SELECT model, max(precision) AS best FROM raw WHERE recall >= 0.85 GROUP BY 1),
opt AS (SELECT raw.* FROM raw JOIN top USING (model) WHERE precision = best
        QUALIFY row_number() OVER (PARTITION BY model ORDER BY coalesce(fpr, 1e9), coalesce(fnr, 1e9), threshold {dir}) = 1)"""
register("optimal_threshold", "R9", lambda s, d: rounded(
    mt.optimal_threshold(mt.confusion_by_threshold(recs(s, d)), small=False), RATES[:-1]),
    f"{REC}, {CONF}, {OPT.format(dir='DESC')} SELECT * EXCLUDE (f1) REPLACE ({rsql(RATES[:-1])}) FROM opt")


def curve_sql(x: str, y: str, keys: str = "model", src: str = "rated", p: str = "c") -> str:
    return f"""
{p}1 AS (SELECT {keys}, {x} AS px, min({y}) AS first, max({y}) AS last FROM {src} GROUP BY ALL),
{p}2 AS (SELECT {keys}, g, 1e-6 + g * ((1 - 2e-6) / 999) AS gx FROM (SELECT DISTINCT {keys} FROM {p}1), range(1000) t(g)),
{p}3 AS (SELECT {p}2.*, arg_max(last, px) FILTER (px <= gx) AS ya, max(px) FILTER (px <= gx) AS xa,
                arg_min(first, px) FILTER (px > gx) AS yb, min(px) FILTER (px > gx) AS xb
         FROM {p}2 JOIN {p}1 USING ({keys}) GROUP BY ALL),
{p} AS (SELECT {keys}, g, gx, CASE WHEN xa IS NULL THEN yb WHEN xb IS NULL THEN ya ELSE ya + (yb - ya) / (xb - xa) * (gx - xa) END AS gy FROM {p}3)"""


def area_sql(curve: str, floor: float, name: str, keys: str = "model") -> str:
    return f"""
{name}_ AS (SELECT {keys}, (gx - lag(gx) OVER w) * (gy - {floor} + lag(gy) OVER w - {floor}) / 2 AS part
            FROM {curve} WHERE gy >= {floor} WINDOW w AS (PARTITION BY {keys} ORDER BY g)),
{name} AS (SELECT {keys}, coalesce(sum(part), 0) / (1 - {floor}) AS {name} FROM (SELECT DISTINCT {keys} FROM {curve}) LEFT JOIN {name}_ USING ({keys}) GROUP BY ALL)"""


def curve_job(spark, sf_dir):
    rated = mt.rates(mt.confusion_by_threshold(recs(spark, sf_dir)))
    return rounded(mt.curve_points(rated, "fpr", "recall", ["model"]), ["x", "y"])


register("curve_interp", "W16", curve_job, f"{REC}, {CONF}, {curve_sql('fpr', 'recall')} SELECT model, g, round(gx, 6) AS x, round(gy, 6) + 0 AS y FROM c")


def auc_job(spark, sf_dir):
    rated = mt.rates(mt.confusion_by_threshold(recs(spark, sf_dir)))
    out = mt.auprc(rated)
    for f in mt.FLOORS:
        out = out.join(mt.partial_auc(rated, floor=f), "model").join(mt.max_precision_at_recall(rated, floor=f), "model")
    return rounded(out, ["auprc", "aroc_80", "aroc_90", "pprc_80", "pprc_90"], 5)


def metric_ctes(keys: str = "model") -> str:
    return (curve_sql("fpr", "recall", keys, p="roc") + "," + curve_sql("recall", "precision", keys, p="prc") + ","
            + area_sql("prc", 0, "auprc", keys) + "," + area_sql("roc", 0.8, "aroc_80", keys) + "," + area_sql("roc", 0.9, "aroc_90", keys)
            + f""",
pp AS (SELECT {keys}, max(precision) FILTER (recall >= 0.8) AS pprc_80, max(precision) FILTER (recall >= 0.9) AS pprc_90 FROM rated GROUP BY ALL)""")


AUC_COLS = ["auprc", "aroc_80", "aroc_90", "pprc_80", "pprc_90"]
AUC_JOIN = "auprc JOIN aroc_80 USING ({0}) JOIN aroc_90 USING ({0}) JOIN pp USING ({0})"
register("partial_auc", "R10", auc_job, f"{REC}, {CONF}, {metric_ctes()} SELECT model, {rsql(AUC_COLS, 5)} FROM {AUC_JOIN.format('model')}")

BINOM = """
nn AS (SELECT DISTINCT n FROM {src}),
pmf AS (SELECT n, b, exp(lgamma(n + 1) - lgamma(b + 1) - lgamma(n - b + 1) - n * ln(2)) AS p FROM nn, LATERAL (SELECT unnest(range(n + 1)) AS b)),
cdf AS (SELECT n, b, sum(p) OVER (PARTITION BY n ORDER BY b) AS c FROM pmf),
ci AS (SELECT n, greatest(0, least(min(b) FILTER (c >= 0.025 - 1e-12), n - 1)) AS lo, greatest(0, least(min(b) FILTER (c >= 0.975 - 1e-12) - 1, n - 1)) AS hi FROM cdf GROUP BY 1)"""


def median_ci_job(spark, sf_dir):
    src = fixture.pairs(spark, sf_dir).selectExpr("event_id", "target_id", "round(v_sur, 3) AS v")
    return rounded(mt.median_summary(src, "v", ["event_id", "target_id"]), ["q25", "median", "q75", "low_ci", "up_ci"])


register("median_ci", "A9", median_ci_job, f"""WITH {pairs_sql()},
a AS (SELECT event_id, target_id, count(*) AS n, list_sort(list(round(v_sur, 3))) AS vs, {', '.join(f'quantile_cont(round(v_sur, 3), {p}) AS {n}' for n, p in (('q25', .25), ('median', .5), ('q75', .75)))} FROM pairs GROUP BY ALL),
{BINOM.format(src='a')}
SELECT event_id, target_id, n, {rsql(['q25', 'median', 'q75'])}, round(vs[lo + 1], 6) AS low_ci, round(vs[hi + 1], 6) AS up_ci FROM a JOIN ci USING (n)""")


def quantile_job(spark, sf_dir):
    """Quartiles of all scores of an event; infinite ones count as the bounds of their event."""
    from nearmiss.operators.tracks import exact_quantiles
    src = scored.small_scores(spark, sf_dir).select("event_id", F.expr("score - 20D").alias("score"))
    src = wn.bound_infinite(src, ["event_id"], "score")
    return rounded(exact_quantiles(src, ["event_id"], "score", wn.QUARTILES), ["q25", "q50", "q75"])


register("exact_quartiles", "A6", quantile_job, f"""{sql.base('small')},
en AS (SELECT event_id, max(score - 20) FILTER (score < 'inf'::DOUBLE) AS top, min(score - 20) FILTER (score > '-inf'::DOUBLE) AS low FROM sc GROUP BY 1),
bo AS (SELECT event_id, CASE WHEN score = 'inf'::DOUBLE THEN greatest(1e6::DOUBLE, top) WHEN score = '-inf'::DOUBLE THEN least(-1e6::DOUBLE, low) ELSE score - 20 END AS score
       FROM sc JOIN en USING (event_id))
SELECT event_id, count(*) AS n, {', '.join(f'round(quantile_cont(score, {p}), 6) + 0 AS {n}' for n, p in wn.QUARTILES.items())}
FROM bo WHERE score IS NOT NULL GROUP BY 1""")


def narrow_job(spark, sf_dir):
    """Quartiles where all values lie within a millionth, and where they spread over the whole range of doubles."""
    from nearmiss.operators.tracks import exact_quantiles
    src = fixture.frames(spark, sf_dir).selectExpr("track_id", "1e-9D * kk * k AS near", "(kk - 50) * pow(10D, k % 600 - 300) AS far")
    near = exact_quantiles(src, ["track_id"], "near", wn.QUARTILES)
    far = exact_quantiles(src, ["track_id"], "far", {f"far_{n}": p for n, p in wn.QUARTILES.items()}).drop("n")
    return near.join(far, "track_id").selectExpr("track_id", "n", *(f"round({n} * 1e9D, 4) AS {n}" for n in wn.QUARTILES), *(
        f"signum(far_{n}) * round(log10(abs(far_{n})), 4) + 0D AS far_{n}" for n in wn.QUARTILES))


register("quartiles_any_range", "A6 A17", narrow_job, f"""WITH {FRAMES},
q AS (SELECT track_id, count(*) AS n, {', '.join(f'quantile_cont(1e-9::DOUBLE * kk * k, {p}) AS {n}, quantile_cont((kk - 50) * power(10::DOUBLE, k % 600 - 300), {p}) AS far_{n}' for n, p in wn.QUARTILES.items())} FROM fr GROUP BY 1)
SELECT track_id, n, {', '.join(f'round({n} * 1e9, 4) AS {n}' for n in wn.QUARTILES)}, {', '.join(f"CASE WHEN far_{n} = 0 THEN NULL ELSE sign(far_{n}) * round(log10(abs(far_{n})), 4) + 0 END AS far_{n}" for n in wn.QUARTILES)} FROM q""")

TTI = f"""
tt AS (SELECT *, impact_time - warning_timestamp / 1000 AS tti FROM recs),
fbest AS (SELECT model, threshold FROM rated QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) = 1),
timed AS (SELECT tt.* FROM tt JOIN fbest USING (model, threshold) WHERE tti IS NOT NULL),
stat AS (SELECT model, count(*) AS n, list_sort(list(tti)) AS vs, quantile_cont(tti, 0.5) AS m, quantile_cont(tti, 0.25) AS q1, quantile_cont(tti, 0.75) AS q3 FROM timed WHERE tti < 10 GROUP BY 1),
{BINOM.format(src='stat')},
share AS (SELECT model, count(*) FILTER (tti >= 1.5) / count(*) AS PTTI_star FROM timed GROUP BY 1),
ttis AS (SELECT model, PTTI_star, m AS mTTI_star, q1 AS TTI_star_q25, q3 AS TTI_star_q75, vs[lo + 1] AS TTI_star_lowCI, vs[hi + 1] AS TTI_star_upCI
         FROM share LEFT JOIN stat USING (model) LEFT JOIN ci USING (n))"""
TTI_COLS = ["PTTI_star", "mTTI_star", "TTI_star_q25", "TTI_star_q75", "TTI_star_lowCI", "TTI_star_upCI"]


def tti_job(spark, sf_dir):
    r = recs(spark, sf_dir)
    return rounded(mt.tti_stats(r, mt.rates(mt.confusion_by_threshold(r))), TTI_COLS, 5)


register("tti_stats", "A8", tti_job, f"{REC}, {CONF}, {TTI} SELECT model, {rsql(TTI_COLS, 5)} FROM ttis")


def eval_job(spark, sf_dir):
    r = mt.with_subsets(recs(spark, sf_dir), scored.annotated_meta(spark, sf_dir))
    return rounded(mt.eval_metrics(r, by=["subset"]), AUC_COLS, 5)


SUBSET_SQL = "sub(subset, conflict) AS (VALUES " + ", ".join(
    f"('{n}', '{c}')" for n, cs in {**mt.SUBSETS, "All": tuple(c for c in scored.CONFLICTS if c != "none"),
                                    "Others": tuple(c for c in scored.CONFLICTS if c not in mt.NOT_OTHERS and c != "none")}.items() for c in cs) + ")"
CONF_SUB = CONF.replace("model", "subset")
REC_SUB = REC.replace("recs AS", "recs0 AS") + f", {SUBSET_SQL}, recs AS (SELECT subset, recs0.* FROM recs0 JOIN m USING (event_id) JOIN sub USING (conflict))"
register("eval_metrics_by_subset", "R11", eval_job, f"{REC_SUB}, {CONF_SUB}, {metric_ctes('subset')} SELECT subset, {rsql(AUC_COLS, 5)} FROM {AUC_JOIN.format('subset')}")


def eval_time_job(spark, sf_dir):
    return rounded(mt.eval_metrics(recs(spark, sf_dir), with_time=True), [*AUC_COLS, *TTI_COLS], 5)


register("eval_metrics", "R11 R10 A8", eval_time_job, f"""{REC}, {CONF}, {metric_ctes()}, {TTI}
SELECT model, {rsql([*AUC_COLS, *TTI_COLS], 5)} FROM {AUC_JOIN.format('model')} JOIN ttis USING (model)""")

CURVE = ["fpr", "tpr", "precision", "recall", "f1"]
register("roc_prc_curves", "R12", lambda s, d: rounded(mt.event_curves(recs(s, d)), CURVE), f"""{REC}, {CONF}
SELECT model, threshold, round(fpr * 100, 6) + 0 AS fpr, round(100 - fnr * 100, 6) + 0 AS tpr, round(precision * 100, 6) + 0 AS precision,
       round(recall * 100, 6) + 0 AS recall, round(f1, 6) + 0 AS f1 FROM raw""")
register("atc_curve", "R12 A9", lambda s, d: rounded(mt.timeliness_curve(recs(s, d)), ["median", "low_ci", "up_ci", "f1"], 5), f"""{REC}, {CONF},
tt AS (SELECT *, impact_time - warning_timestamp / 1000 AS tti FROM recs),
stat AS (SELECT model, threshold, count(*) AS n, list_sort(list(tti)) AS vs, quantile_cont(tti, 0.5) AS median FROM tt WHERE tti < 10 GROUP BY ALL),
{BINOM.format(src='stat')}
SELECT model, threshold, round(median, 5) AS median, round(vs[lo + 1], 5) AS low_ci, round(vs[hi + 1], 5) AS up_ci, round(f1, 5) + 0 AS f1
FROM stat JOIN ci USING (n) JOIN raw USING (model, threshold)""")


def false_alarm_job(spark, sf_dir):
    r = mt.with_subsets(recs(spark, sf_dir), scored.annotated_meta(spark, sf_dir))
    return mt.false_alarm_report(r, False, ["subset"])


register("false_alarm_report", "R16 R9", false_alarm_job, f"""{REC_SUB}, {CONF_SUB}, {OPT.format(dir='DESC').replace('model', 'subset')}
SELECT subset, threshold, FP, TP + FP AS warnings, FN FROM opt""")


def model_records_job(spark, sf_dir):
    out = wn.warning_records(cut_lineage(scored.model_scores(spark, sf_dir), "scores"), scored.annotated_meta(spark, sf_dir), LARGE_TH, False,
                             by=["model"], models=scored.MODELS_LARGE)
    return mt.confusion_by_threshold(out)


def _one_model(i, name):
    return f"""SELECT '{name}' AS model, * FROM ({sql.base('large').replace(sql.scores('large'), sql.scores('large', i))}, {sql.targets(False)},
{sql.records(False, LARGE_TH)} SELECT * FROM rec)"""


register("confusion_by_model", "A7 R4", model_records_job, "WITH recs AS (" + " UNION ALL ".join(
    _one_model(i, n) for i, n in enumerate(scored.MODELS_LARGE)) + f"), {CONF} SELECT * FROM conf")
