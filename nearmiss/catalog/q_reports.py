"""Report tables over events, records, attributions and yearly statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearmiss.catalog import q_warnings as qw
from nearmiss.catalog.fixture_sql import FRAMES, META, pairs as pairs_sql
from nearmiss.catalog.q_clean import ANN, EVT, SEV, annotated, duck_pick
from nearmiss.catalog.registry import register
from nearmiss.functions import fixed_values as fv
from nearmiss.functions.numeric import with_exprs
from nearmiss.operators import clean as cl
from nearmiss.operators import indicators as ind
from nearmiss.operators import reports as rp
from nearmiss.plans import derived, fixture, scored


def rounded(df, columns, digits=6):
    return with_exprs(df, {c: f"round({c}, {digits}) + 0D" for c in columns})


def rs(columns, digits=6):
    return ", ".join(f"round({c}, {digits}) + 0 AS {c}" for c in columns)


def cases(column, table):
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + " END"


# --- event counts --------------------------------------------------------------------------------

def counted(spark, sf_dir):
    return annotated(spark, sf_dir).where("event_category IS NOT NULL").selectExpr(
        "event_id", "event_category", "reconstructed_flag AS reconstructed", "reconstructed_flag AND test_flag AS in_test")


FUN = f"{ANN}, fu AS (SELECT event_id, event_category, {cases('event_category', fv.CATEGORY_GROUPS)} AS category, reconstructed_flag AS reconstructed, reconstructed_flag AND test_flag AS in_test FROM ann WHERE event_category IS NOT NULL)"
THREE = "count(*) AS recorded, count(*) FILTER (reconstructed) AS reconstructed, count(*) FILTER (in_test) AS in_test"
register("count_funnel", "A2 P21", lambda s, d: rp.count_funnel(rp.category_rollup(counted(s, d)), "category"), f"WITH {FUN} SELECT category, {THREE} FROM fu GROUP BY 1")
register("subtotal_rows", "A3", lambda s, d: rp.subtotal_rows(counted(s, d)), f"""WITH {FUN}
SELECT category, event_category, {THREE} FROM fu GROUP BY 1, 2
UNION ALL SELECT category || ' in total', '', {THREE} FROM fu WHERE category <> 'Safe interactions' GROUP BY 1
UNION ALL SELECT 'Events in total (excluding SafeBaseline)', '', {THREE} FROM fu WHERE event_category <> 'SafeBaseline'""")


def conflict_job(spark, sf_dir):
    meta = rp.conflict_rollup(cl.severity_conflict(annotated(spark, sf_dir), ignore_unseen=False)).where("event_category <> 'SafeBaseline'")
    return meta.groupBy("conflict_group").agg(F.count(F.lit(1)).alias("n"))


register("conflict_counts", "A2 P21", conflict_job, f"""WITH {ANN}, {SEV.format(a='false AND')}
SELECT {cases('conflict', fv.CONFLICT_GROUPS)} AS conflict_group, count(*) AS n FROM con WHERE event_category <> 'SafeBaseline' GROUP BY 1""")


def crosstab_job(spark, sf_dir):
    env = cl.environment_clean(derived.event_table(spark, sf_dir), ("weather", "surfaceCondition"))
    return rp.crosstab(env, "weather", fv.WEATHER_ORDER, "surfaceCondition", fv.SURFACE_ORDER)


register("crosstab", "A15", crosstab_job, f"""WITH {EVT},
en AS (SELECT weather, CASE WHEN surfaceCondition = 'Other' THEN 'Unknown' ELSE coalesce(surfaceCondition, 'Unknown') END AS surfaceCondition FROM evt),
w AS (SELECT unnest([{derived.sql_list(fv.WEATHER_ORDER)}]) AS weather), s AS (SELECT unnest([{derived.sql_list(fv.SURFACE_ORDER)}]) AS surfaceCondition)
SELECT w.weather, s.surfaceCondition, count(en.weather) AS n FROM w CROSS JOIN s LEFT JOIN en ON en.weather = w.weather AND en.surfaceCondition = s.surfaceCondition GROUP BY 1, 2""")


def traffic_job(spark, sf_dir):
    env = cl.environment_clean(derived.event_table(spark, sf_dir), ("trafficDensity",))
    return rp.value_counts_ordered(env, "trafficDensity", fv.TRAFFIC_ORDER, {"Unknown": fv.TRAFFIC_ORDER[6]})


register("value_counts_ordered", "A16", traffic_job, f"""WITH {EVT},
t AS (SELECT CASE WHEN coalesce(trafficDensity, 'Unknown') = 'Unknown' THEN '{fv.TRAFFIC_ORDER[6]}' ELSE trafficDensity END AS label FROM evt)
SELECT label, count(*) AS n, CAST(list_position([{derived.sql_list(fv.TRAFFIC_ORDER)}], label) - 1 AS INT) AS place FROM t GROUP BY 1""")


def mix_job(spark, sf_dir):
    meta = cl.severity_conflict(annotated(spark, sf_dir)).where("conflict <> 'none'")
    return rp.voted_event_mix(meta.selectExpr("event_id", "conflict", "CASE WHEN event_id % 5 = 0 THEN -1 ELSE event_id END AS target_id"))


register("voted_event_mix", "R15 A16", mix_job, f"""WITH {ANN}, {SEV.format(a='')}, v AS (SELECT conflict FROM con WHERE conflict <> 'none' AND event_id % 5 <> 0)
SELECT CASE conflict WHEN 'leading' THEN 'Rear-end' WHEN 'adjacent_lane' THEN 'Adjacent lane' ELSE 'Other lateral' END AS label, count(*) AS n, 'main' AS part FROM v GROUP BY 1
UNION ALL SELECT coalesce({cases('conflict', fv.VOTED_GROUPS)}, conflict), count(*), 'other' FROM v WHERE conflict NOT IN ('leading', 'adjacent_lane') GROUP BY 1""")

# --- yearly statistics ---------------------------------------------------------------------------

YEARS = [str(y) for y in range(1995, 2002)]
YR = "yr AS (SELECT year(o_orderdate)::INT AS year, o_orderpriority AS kind, o_orderstatus AS place, count(*) AS n FROM orders GROUP BY ALL)"


def share_job(spark, sf_dir):
    wide = derived.yearly(spark, sf_dir).groupBy("place", "kind").pivot("year", [int(y) for y in YEARS]).agg(F.sum("n").cast("double"))
    out = rp.sum_and_share(wide, "place", "kind", YEARS[2:5], "F", "O", ["1-URGENT", "2-HIGH", "5-LOW"])
    return rounded(out, ["share_at"])


register("sum_and_share", "A11", share_job, f"""WITH {YR}, c AS (SELECT * FROM yr WHERE kind IN ('1-URGENT', '2-HIGH', '5-LOW') AND place IN ('F', 'O') AND year BETWEEN 1997 AND 1999)
SELECT place, kind, sum(n)::DOUBLE AS n, round((SELECT sum(n) FILTER (place = 'F') / sum(n) FROM c), 6) AS share_at FROM c GROUP BY 1, 2""")


def regroup_job(spark, sf_dir):
    stats = derived.yearly(spark, sf_dir).select("kind", "n")
    groups = {"Adverse": ("1-URGENT", "2-HIGH"), "All": ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"), "Rainy": ("2-HIGH",)}
    return rp.regroup_rows(stats, "kind", groups, ["n"])


register("regroup_rows", "A12", regroup_job, f"""WITH {YR}, g(grp, kind) AS (VALUES ('Adverse', '1-URGENT'), ('Adverse', '2-HIGH'), ('All', '1-URGENT'), ('All', '2-HIGH'), ('All', '3-MEDIUM'), ('All', '5-LOW'), ('Rainy', '2-HIGH'))
SELECT grp AS "group", sum(n)::BIGINT AS n FROM yr JOIN g USING (kind) GROUP BY 1""")


WEATHERS = tuple(x for rows in fv.WEATHER_GROUPS.values() for x in rows)
LIGHTS = tuple(x for rows in fv.LIGHT_GROUPS.values() for x in rows) + ("Not stated",)


def accidents(spark, sf_dir):
    """Orders as crashes under the weather and light labels of the statistics; some counts are missing."""
    return fixture.table(spark, sf_dir, "orders").selectExpr(
        f"{derived.pick(WEATHERS, 'o_orderkey')} AS weather", f"{derived.pick(LIGHTS, 'o_custkey')} AS light",
        "CASE WHEN o_orderpriority = '1-URGENT' THEN 1L END AS fatal_crashes",
        "CASE WHEN o_orderpriority <> '1-URGENT' THEN CAST(year(o_orderdate) - 1990 AS BIGINT) END AS injury_only_crashes")


def accident_sql(labels, key, groups, totals, rows):
    sources = {r: groups.get(r, (r,)) for r in rows} | {t: [x for part in parts for x in groups[part]] for t, parts in totals.items()}
    values = ", ".join(f"('{r}', {rows.index(r) + 1}, '{x}')" for r in rows for x in sources[r])
    return f"""WITH acc AS (SELECT {duck_pick(labels, key)} AS label, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS f,
  CASE WHEN o_orderpriority <> '1-URGENT' THEN year(o_orderdate) - 1990 ELSE 0 END AS i FROM orders), g(grp, position, label) AS (VALUES {values})
SELECT grp AS "group", CAST(position AS BIGINT) AS position, CAST(sum(f) AS BIGINT) AS fatal_crashes, CAST(sum(i) AS BIGINT) AS injury_only_crashes,
  CAST(sum(f + i) AS BIGINT) AS accidents FROM acc JOIN g USING (label) GROUP BY ALL"""


register("accident_weather", "A12", lambda s, d: rp.weather_table(accidents(s, d)),
         accident_sql(WEATHERS, "o_orderkey", fv.WEATHER_GROUPS, fv.WEATHER_TOTALS, fv.WEATHER_ROWS))
register("accident_light", "A12", lambda s, d: rp.light_table(accidents(s, d)),
         accident_sql(LIGHTS, "o_custkey", fv.LIGHT_GROUPS, fv.LIGHT_TOTALS, fv.LIGHT_ROWS))


def panel(spark, sf_dir):
    """Orders per nation, priority and year; odd nations miss some years."""
    o = fixture.table(spark, sf_dir, "orders").join(fixture.table(spark, sf_dir, "customer").selectExpr("c_custkey AS o_custkey", "c_nationkey"), "o_custkey")
    return o.where("NOT (c_nationkey % 2 = 1 AND year(o_orderdate) = 1996 + c_nationkey % 3)").groupBy(
        F.col("c_nationkey").alias("country"), F.col("o_orderpriority").alias("location"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).cast("double").alias("n"))


PAN = """pan AS (SELECT c_nationkey AS country, o_orderpriority AS location, year(o_orderdate)::INT AS year, count(*)::DOUBLE AS n FROM orders JOIN customer ON c_custkey = o_custkey
  WHERE NOT (c_nationkey % 2 = 1 AND year(o_orderdate) = 1996 + c_nationkey % 3) GROUP BY ALL),
yc AS (SELECT country, location, count(*) AS y FROM pan GROUP BY ALL), full_ AS (SELECT DISTINCT country FROM yc WHERE y >= (SELECT max(y) FROM yc)),
cp AS (SELECT location, year, sum(n) AS n FROM pan SEMI JOIN full_ USING (country) GROUP BY ALL)"""
register("complete_panel", "A13", lambda s, d: rp.complete_panel(panel(s, d)), f"WITH {PAN} SELECT * FROM cp")
LOC = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
register("pivot_ratio", "A14", lambda s, d: rounded(rp.pivot_ratio(rp.complete_panel(panel(s, d)), LOC, LOC[0]), ["ratio"]), f"""WITH {PAN}
SELECT year, {', '.join(f'sum(n) FILTER (location = {chr(39)}{x}{chr(39)}) AS "{x}"' for x in LOC)}, round(sum(n) FILTER (location = '1-URGENT') / sum(n), 6) AS ratio FROM cp GROUP BY 1""")


def deaths_job(spark, sf_dir):
    d = fixture.table(spark, sf_dir, "orders").groupBy(F.expr("year(o_orderdate) + 3").alias("year")).agg(
        F.round(F.avg("o_totalprice"), 2).alias("val"), F.min("o_totalprice").alias("lower"), F.max("o_totalprice").alias("upper"))
    return rounded(rp.deaths_with_bounds(d.withColumn("measure", F.expr("CASE WHEN year % 4 = 0 THEN 'DALYs' ELSE 'Deaths' END"))), ["val", "below", "above"], 2)


register("deaths_with_bounds", "P27", deaths_job, """WITH d AS (SELECT (year(o_orderdate) + 3)::INT AS year, round(avg(o_totalprice), 2) AS val, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1)
SELECT year, round(val, 2) AS val, round(val - lo, 2) AS below, round(hi - val, 2) AS above FROM d WHERE year BETWEEN 2001 AND 2021 AND year % 4 <> 0""")

# --- numeric summaries ---------------------------------------------------------------------------

STATS = ["mean", "std", "min", "max", "q25", "q50", "q75"]


def _describe_sql(parts):
    return " UNION ALL ".join(f"""SELECT '{n}' AS "column", count({c}) AS count, round(avg({c}), 4) + 0 AS mean, round(stddev_samp({c}), 4) + 0 AS std, round(min({c}), 4) + 0 AS min, round(max({c}), 4) + 0 AS max,
  round(quantile_cont({c}, 0.25), 4) + 0 AS q25, round(quantile_cont({c}, 0.5), 4) + 0 AS q50, round(quantile_cont({c}, 0.75), 4) + 0 AS q75 FROM {src}""" for n, c, src in parts)


register("describe", "A17", lambda s, d: rounded(rp.describe(fixture.frames(s, d), ["v", "psi", "x"]), STATS, 4),
         f"WITH {FRAMES} " + _describe_sql([(c, c, "fr") for c in ("v", "psi", "x")]))


def hist_job(spark, sf_dir):
    return rounded(rp.histogram_density(fixture.frames(spark, sf_dir), "v", 0.0, 40.0, 29), ["density"], 9)


register("histogram_density", "A24", hist_job, f"""WITH {FRAMES}, b AS (SELECT least(CASE WHEN v = 40 THEN 28 ELSE CAST(floor(v / (40.0::DOUBLE / 29)) AS INT) END, 28) AS bin FROM fr WHERE v BETWEEN 0 AND 40)
SELECT bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER () * (40.0::DOUBLE / 29)), 9) AS density FROM b GROUP BY 1""")


def loss_log(spark, sf_dir):
    return fixture.frames(spark, sf_dir).selectExpr("track_id AS run", "k AS epoch", "abs(acc) + 0.001D * kk AS val_loss")


register("trimmed_mean_last", "A21 M13", lambda s, d: rounded(rp.trimmed_mean_last(loss_log(s, d), ["run"]), ["val_loss"]), f"""WITH {FRAMES},
t AS (SELECT track_id AS run, abs(acc) + 0.001 * kk AS val_loss FROM fr QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY k DESC) <= 5)
SELECT run, round((sum(val_loss) - min(val_loss) - max(val_loss)) / 3, 6) AS val_loss FROM t GROUP BY 1""")
register("lead_time_before_impact", "A23", lambda s, d: rounded(rp.lead_time_before_impact(
    fixture.pairs(s, d), fixture.event_meta(s, d)).agg(F.avg("lead_time").alias("mean_lead_time")), ["mean_lead_time"]), f"""WITH {pairs_sql()}, {META}
SELECT round(avg(impact_timestamp / 1000 - t0), 6) AS mean_lead_time FROM meta JOIN (SELECT event_id, min(time) AS t0 FROM pairs GROUP BY 1) USING (event_id)""")


def scoring_job(spark, sf_dir):
    scores = ind.risk_scores(fixture.pairs(spark, sf_dir), ["TTC2D", "EI"])
    return ind.scoring_log(scores, ["TTC2D", "EI"])


register("risk_scores_log", "G18 A22", scoring_job, f"""WITH {pairs_sql()}
SELECT m AS model_name, count(DISTINCT (event_id, target_id)) AS num_targets, count(*) AS num_moments FROM pairs, (VALUES ('TTC2D'), ('EI')) t(m) GROUP BY 1""")
register("efficiency_mean", "A22", lambda s, d: rounded(rp.efficiency_mean(fixture.frames(s, d).selectExpr(
    "event_type AS model_name", "v AS time", "CAST(k AS DOUBLE) AS num_targets", "CAST(kk AS DOUBLE) AS num_moments")), ["time", "num_targets", "num_moments"], 5), f"""WITH {FRAMES}
SELECT event_type AS model_name, round(avg(v), 5) AS time, round(avg(k), 5) AS num_targets, round(avg(kk), 5) AS num_moments FROM fr GROUP BY 1""")


def consistency_job(spark, sf_dir):
    fr = fixture.frames(spark, sf_dir)
    a = fr.selectExpr("track_id * 10000 + k AS scene_id", "abs(x) + 1D AS s")
    b = fr.selectExpr("track_id * 10000 + k div 2 * 2 AS scene_id")
    return rounded(rp.consistency_report(a, b), ["min_spacing"])


register("consistency_report", "A27", consistency_job, f"""WITH {FRAMES}
SELECT count(DISTINCT track_id * 10000 + k) AS scenes, round(min(abs(x) + 1), 6) AS min_spacing, count(DISTINCT track_id * 10000 + k // 2 * 2) AS profile_scenes,
  count(DISTINCT track_id * 10000 + k) = count(DISTINCT track_id * 10000 + k // 2 * 2) AS agree FROM fr""")


def flag_job(spark, sf_dir):
    t = fixture.frames(spark, sf_dir).groupBy("event_type").agg(F.avg("v").alias("a"), (F.avg("psi") / 100).alias("b"), F.round(F.avg("kk"), 0).alias("c"))
    return rounded(rp.best_second_flag(t, ["a", "b", "c"]), ["a", "b", "c"])


register("best_second_flag", "W15", flag_job, f"""WITH {FRAMES},
t AS (SELECT event_type, avg(v) AS a, avg(psi) / 100 AS b, round(avg(kk), 0) AS c FROM fr GROUP BY 1),
r AS (SELECT event_type, {', '.join(f'CASE WHEN avg({c}) OVER () > 0.01 THEN round({c}, 3) ELSE {c} END AS {c}' for c in 'abc')} FROM t),
o AS (SELECT {', '.join(f'list_reverse_sort(list({c})) AS s{c}' for c in 'abc')} FROM r)
SELECT event_type, {rs('abc')}, {', '.join(f'CASE WHEN {c} = s{c}[1] THEN 1 WHEN {c} = s{c}[2] THEN 2 ELSE 0 END AS {c}_mark' for c in 'abc')} FROM r, o""")

# --- model tables --------------------------------------------------------------------------------

MIX = ("SafeBaseline_current", "SafeBaseline_ArgoverseHV_current_mixed0.1", "SafeBaseline_ArgoverseHV_current_mixed0.5", "SafeBaseline_highD_current_mixed1.0")
LATERAL = ["adjacent_lane", "merging", "turning_into_parallel", "pedestrian", "intersection_crossing"]


def model_records(spark, sf_dir):
    """The voted records under several model names, some events left out per model."""
    rec = qw.recs(spark, sf_dir).drop("model")
    named = rec.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(len(MIX) - 1))))
    return named.where("(event_id + m) % 7 > 0").withColumn("model", F.expr(derived.pick(MIX, "m"))).drop("m")


MREC = qw.REC.replace("recs AS", "one AS") + f""", recs0 AS (SELECT {duck_pick(MIX, 'mm')} AS model, one.* EXCLUDE (model) FROM one, range({len(MIX)}) t(mm) WHERE (event_id + mm) % 7 > 0)"""


def mix_rate_job(spark, sf_dir):
    out = rp.mix_rate_table(model_records(spark, sf_dir), scored.annotated_meta(spark, sf_dir), "ArgoverseHV", LATERAL, "SafeBaseline_current")
    return rounded(out, qw.AUC_COLS, 5)


register("mix_rate_table", "R13 P22", mix_rate_job, f"""{MREC},
recs AS (SELECT * FROM recs0 WHERE (model LIKE '%mixed%' AND model LIKE '%ArgoverseHV%' OR model = 'SafeBaseline_current')
         AND event_id IN (SELECT event_id FROM m WHERE conflict IN ({derived.sql_list(LATERAL)}))), {qw.CONF}, {qw.metric_ctes()}
SELECT model, {rs(qw.AUC_COLS, 5)}, CASE WHEN model LIKE '%_mixed%' THEN CAST(split_part(model, '_mixed', 2) AS DOUBLE) ELSE 0 END AS mixrate FROM {qw.AUC_JOIN.format('model')}""")
LABELS = {MIX[0]: "S-C", MIX[1]: "SA-C", MIX[3]: "Sh-C"}
register("model_table", "R13", lambda s, d: rounded(rp.model_table(model_records(s, d), LABELS), qw.AUC_COLS, 5), f"""{MREC},
recs AS (SELECT * FROM recs0 WHERE model IN ({derived.sql_list(LABELS)})), {qw.CONF}, {qw.metric_ctes()}
SELECT model, {rs(qw.AUC_COLS, 5)}, {cases('model', LABELS)} AS label, CAST({cases('model', {m: str(i) for i, m in enumerate(LABELS)})} AS INT) AS place FROM {qw.AUC_JOIN.format('model')}""")

# --- attribution ---------------------------------------------------------------------------------

FAC = derived.FACTORS
ATT = f"""{pairs_sql()}, {META},
att AS (SELECT event_id, target_id, k, time, round(60 / (1 + abs(x_sur - x_ego)), 4) AS intensity, round(hx_ego, 4) AS eg_speed, round(hy_ego - 0.2::DOUBLE, 4) AS eg_width, round(hx_sur, 4) AS eg_heading,
  round(hy_sur + 0.1::DOUBLE, 4) AS eg_spacing, round(hx_ego * hy_sur, 4) AS eg_weather FROM pairs),
rc AS (SELECT event_id, least(impact_timestamp - 4500, start_timestamp) AS danger_start, least(impact_timestamp + 500, end_timestamp) AS danger_end, event_id % 2 AS tw, event_id % 3 AS nn FROM meta),
win AS (SELECT att.*, CASE WHEN tw > 0.5 AND time BETWEEN danger_start / 1000 AND danger_end / 1000 THEN 'warning' WHEN nn > 0.5 AND time < danger_start / 1000 - 3 THEN 'safe' END AS side FROM att JOIN rc USING (event_id))"""
register("attribution_window_join", "J10", lambda s, d: cl.attribution_window(derived.attribution(s, d), derived.records(s, d)).select(
    "event_id", "target_id", "k", "side"), f"WITH {ATT} SELECT event_id, target_id, k, side FROM win WHERE side IS NOT NULL")
LONG = "lng AS (SELECT event_id, target_id, k, side, CASE WHEN side = 'warning' THEN -v ELSE v END AS v, i, factor FROM (" + " UNION ALL ".join(
    f"SELECT event_id, target_id, k, side, intensity, eg_{f} AS v, {i} AS i, '{f}' AS factor FROM win" for i, f in enumerate(FAC)) + """) WHERE (side = 'warning' AND intensity > 4) OR (side = 'safe' AND intensity <= 4)),
top3 AS (SELECT * FROM lng WHERE v < 0 QUALIFY row_number() OVER (PARTITION BY event_id, target_id, k, side ORDER BY v, i) <= 3)"""
register("top_factor_frequency", "A20 J10", lambda s, d: rp.top_factor_frequency(
    cl.attribution_window(derived.attribution(s, d), derived.records(s, d)), FAC, 4.0), f"WITH {ATT}, {LONG} SELECT side, factor, count(*) AS n FROM top3 GROUP BY 1, 2")


def conditions(spark, sf_dir):
    env = fixture.event_meta(spark, sf_dir).selectExpr(
        "event_id", f"{derived.pick(fv.WEATHER_ORDER, 'event_id')} AS weather", f"{derived.pick(fv.SURFACE_ORDER, 'event_id div 2')} AS surfaceCondition",
        f"{derived.pick(fv.LIGHT_ORDER, 'event_id')} AS lighting", f"{derived.pick(fv.TRAFFIC_ORDER, 'event_id')} AS trafficDensity")
    return rp.event_conditions(scored.annotated_meta(spark, sf_dir), env)


COND = f"""cx AS (SELECT event_id, list_extract([{derived.sql_list(scored.CONFLICTS)}], event_id % {len(scored.CONFLICTS)} + 1) AS conflict, {duck_pick(fv.WEATHER_ORDER, 'event_id')} AS weather,
  {duck_pick(fv.SURFACE_ORDER, 'event_id // 2')} AS surf, {duck_pick(fv.LIGHT_ORDER, 'event_id')} AS lighting, {duck_pick(fv.TRAFFIC_ORDER, 'event_id')} AS traffic FROM meta),
cond AS (SELECT event_id, 'Adjacent lane' AS condition FROM cx WHERE conflict = 'adjacent_lane' UNION ALL SELECT event_id, 'Crossing/turning' FROM cx WHERE conflict IN ('turning_into_parallel', 'intersection_crossing')
  UNION ALL SELECT event_id, 'Raining weather' FROM cx WHERE weather IN ('Raining', 'Mist/Light Rain') UNION ALL SELECT event_id, 'Not dry road' FROM cx WHERE surf <> 'Dry'
  UNION ALL SELECT event_id, 'Not in daylight' FROM cx WHERE lighting <> 'Daylight' UNION ALL SELECT event_id, 'Unstable traffic flow' FROM cx WHERE traffic = '{fv.TRAFFIC_ORDER[4]}')"""


def by_condition_job(spark, sf_dir):
    out = rp.attribution_by_condition(derived.attribution(spark, sf_dir), derived.records(spark, sf_dir), conditions(spark, sf_dir), FAC, 4.0, number=3)
    return rounded(out, ["share"])


register("attribution_by_condition", "R14 W14", by_condition_job, f"""WITH {ATT}, {LONG}, {COND},
c AS (SELECT condition, side, factor, count(*) AS n FROM top3 JOIN cond USING (event_id) GROUP BY ALL),
sh AS (SELECT *, n / sum(n) OVER (PARTITION BY condition, side) AS share FROM c)
SELECT condition, side, factor, n, round(share, 6) AS share, row_number() OVER (PARTITION BY condition, side ORDER BY share DESC, factor)::INT AS place FROM sh
QUALIFY row_number() OVER (PARTITION BY condition, side ORDER BY share DESC, factor) <= 3""")
register("cum_share_cut", "W14", lambda s, d: rounded(rp.cum_share_cut(
    fixture.table(s, d, "part").groupBy(F.col("p_brand").alias("factor")).agg(F.count(F.lit(1)).alias("n"))), ["share"]), """
WITH c AS (SELECT p_brand AS factor, count(*) AS n FROM part GROUP BY 1), s AS (SELECT *, n / sum(n) OVER () AS share FROM c),
o AS (SELECT *, sum(share) OVER (ORDER BY share DESC, factor ROWS UNBOUNDED PRECEDING) AS a, row_number() OVER (ORDER BY share DESC, factor)::INT AS place FROM s)
SELECT factor, n, round(share, 6) AS share, place FROM o WHERE round(a, 12) < 0.9""")
SUMS = ["eg_sum", "positive_sum", "negative_sum"]
register("attribution_sums", "M12", lambda s, d: rounded(rp.attribution_sums(derived.attribution(s, d), FAC).select("event_id", "target_id", "k", *SUMS), SUMS, 5), f"""WITH {ATT}
SELECT event_id, target_id, k, round({' + '.join(f'eg_{f}' for f in FAC)}, 5) + 0 AS eg_sum, round({' + '.join(f'greatest(eg_{f}, 0)' for f in FAC)}, 5) + 0 AS positive_sum,
  round({' + '.join(f'least(eg_{f}, 0)' for f in FAC)}, 5) + 0 AS negative_sum FROM att""")
