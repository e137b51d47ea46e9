"""Grouped report tables over events, records, attributions and accident statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearmiss.functions import fixed_values as fv
from nearmiss.operators import metrics as mt
from nearmiss.operators.clean import mapping, parse_model_name

# --- event counts --------------------------------------------------------------------------------


def count_funnel(meta: DataFrame, group: str = "event_category") -> DataFrame:
    """Events recorded, reconstructed and in the test set, per group. Needs the flags reconstructed
    and in_test."""
    return meta.groupBy(group).agg(
        F.count(F.lit(1)).alias("recorded"), F.count(F.when(F.col("reconstructed"), 1)).alias("reconstructed"),
        F.count(F.when(F.col("in_test"), 1)).alias("in_test"))


def category_rollup(meta: DataFrame) -> DataFrame:
    return meta.withColumn("category", mapping(F.col("event_category"), fv.CATEGORY_GROUPS))


def conflict_rollup(meta: DataFrame) -> DataFrame:
    return meta.withColumn("conflict_group", mapping(F.col("conflict"), fv.CONFLICT_GROUPS))


def subtotal_rows(meta: DataFrame) -> DataFrame:
    """Counts per sub-category, with totals per category and over all but the baseline."""
    df = category_rollup(meta)
    counts = [F.count(F.lit(1)).alias("recorded"), F.count(F.when(F.col("reconstructed"), 1)).alias("reconstructed"),
              F.count(F.when(F.col("in_test"), 1)).alias("in_test")]
    rolled = df.rollup("category", "event_category").agg(*counts, F.grouping_id().alias("_g"))
    total = df.where("event_category <> 'SafeBaseline'").agg(*counts).select(
        F.lit("Events in total (excluding SafeBaseline)").alias("category"), F.lit("").alias("event_category"),
        "recorded", "reconstructed", "in_test").where("recorded > 0")
    named = rolled.where("_g = 0 OR (_g = 1 AND category <> 'Safe interactions')").select(
        F.when(F.col("_g") == 1, F.concat("category", F.lit(" in total"))).otherwise(F.col("category")).alias("category"),
        F.when(F.col("_g") == 1, "").otherwise(F.col("event_category")).alias("event_category"),
        "recorded", "reconstructed", "in_test")
    return named.unionByName(total)


def crosstab(environment: DataFrame, rows: str, row_order: Sequence[str], cols: str, col_order: Sequence[str]) -> DataFrame:
    """Counts for every listed row and column label, zeros included."""
    seen = environment.where(F.col(rows).isin(*row_order) & F.col(cols).isin(*col_order)).groupBy(rows, cols).agg(
        F.count(F.lit(1)).alias("n"))
    cells = [(r, c, 0) for r in row_order for c in col_order]  # a constant list of labels
    zeros = environment.sparkSession.createDataFrame(cells, f"`{rows}` string, `{cols}` string, n long")
    return zeros.unionByName(seen).groupBy(rows, cols).agg(F.sum("n").alias("n"))


def value_counts_ordered(df: DataFrame, column: str, order: Sequence[str], fold: Mapping[str, str] | None = None) -> DataFrame:
    """Counts of the listed labels with their place in the list; folded labels count as another one."""
    label = F.col(column)
    for a, b in (fold or {}).items():
        label = F.when(F.col(column) == a, b).otherwise(label)
    kept = [o for o in order if o not in (fold or {})]
    place = mapping(F.col("label"), {o: str(i) for i, o in enumerate(kept)}).cast("int")
    return (df.select(label.alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("place", place).where("place IS NOT NULL"))


def voted_event_mix(voted: DataFrame) -> DataFrame:
    """Voted events: rear-end, adjacent lane and all other, then the others by kind, turning kinds together."""
    main = (F.when(F.col("conflict") == "leading", "Rear-end").when(F.col("conflict") == "adjacent_lane", "Adjacent lane")
            .otherwise("Other lateral"))
    events = voted.where("target_id >= 0")
    bar = events.groupBy(main.alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("main"))
    pie = events.where(~F.col("conflict").isin("leading", "adjacent_lane")).groupBy(
        F.coalesce(mapping(F.col("conflict"), fv.VOTED_GROUPS), F.col("conflict")).alias("label")
    ).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("other"))
    return bar.unionByName(pie)


# --- accident statistics -------------------------------------------------------------------------

def sum_and_share(wide: DataFrame, location: str, kind: str, years: Sequence[str], at: str, away: str, kinds: Sequence[str]) -> DataFrame:
    """Accidents per place and kind over the years, and the share that happened at the place `at`."""
    total = sum((F.coalesce(F.col(f"`{y}`"), F.lit(0)) for y in years), F.lit(0.0))
    chosen = wide.where(F.col(kind).isin(*kinds) & F.col(location).isin(at, away))
    sums = chosen.groupBy(location, kind).agg(F.sum(total).alias("n"))
    share = chosen.agg(F.sum(F.when(F.col(location) == at, total)) / F.sum(total)).scalar()
    return sums.withColumn("share_at", share)


def regroup_rows(stats: DataFrame, label: str, groups: Mapping[str, Sequence[str]], values: Sequence[str]) -> DataFrame:
    """Sums per report row; a source row may count in several report rows."""
    member = F.array_compact(F.array(*[F.when(F.col(label).isin(*rows), F.lit(name)) for name, rows in groups.items()]))
    return (stats.withColumn("group", F.explode(member)).groupBy("group")
            .agg(*[F.sum(v).alias(v) for v in values]))


def accident_table(stats: DataFrame, label: str, groups: Mapping[str, Sequence[str]], totals: Mapping[str, Sequence[str]],
                   rows: Sequence[str]) -> DataFrame:
    """Fatal, injury-only and all crashes per report row, in the order of the report (`position` from 1).

    A report row is a group of source rows, a total of other report rows, or a source row of that very name. Rows that
    have no source row at all do not appear; a missing count is zero.
    """
    sources = {name: tuple(groups.get(name, (name,))) for name in rows}
    for name, parts in totals.items():
        sources[name] = tuple(x for part in parts for x in groups[part])
    counts = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("fatal_crashes", "injury_only_crashes")}
    stats = stats.withColumns(counts).withColumn("accidents", F.col("fatal_crashes") + F.col("injury_only_crashes"))
    place = F.array_position(F.array(*[F.lit(r) for r in rows]), F.col("group"))
    return regroup_rows(stats, label, {r: sources[r] for r in rows}, [*counts, "accidents"]).withColumn("position", place)


def weather_table(stats: DataFrame, label: str = "weather") -> DataFrame:
    return accident_table(stats, label, fv.WEATHER_GROUPS, fv.WEATHER_TOTALS, fv.WEATHER_ROWS)


def light_table(stats: DataFrame, label: str = "light") -> DataFrame:
    return accident_table(stats, label, fv.LIGHT_GROUPS, fv.LIGHT_TOTALS, fv.LIGHT_ROWS)


def complete_panel(panel: DataFrame) -> DataFrame:
    """Countries that report the largest number of years for at least one location; then sums by
    location and year."""
    known = panel.where("n IS NOT NULL")
    years = known.groupBy("country", "location").agg(F.count("year").alias("years"))
    full = years.where(F.col("years") >= years.agg(F.max("years")).scalar()).select("country").distinct()
    return known.join(full, "country", "left_semi").groupBy("location", "year").agg(F.sum("n").alias("n"))


def pivot_ratio(sums: DataFrame, locations: Sequence[str], part: str) -> DataFrame:
    """Years as rows, locations as columns, and the share of one location."""
    wide = sums.groupBy("year").pivot("location", list(locations)).sum("n")
    total = sum((F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in locations), F.lit(0.0))
    return wide.withColumn("ratio", F.col(f"`{part}`") / total)


def deaths_with_bounds(deaths: DataFrame, first: int = 2001, last: int = 2021) -> DataFrame:
    """Yearly deaths with the distances to the lower and upper estimate."""
    return deaths.where((F.col("measure") == "Deaths") & F.col("year").between(first, last)).select(
        "year", "val", (F.col("val") - F.col("lower")).alias("below"), (F.col("upper") - F.col("val")).alias("above"))


# --- model and filter tables ---------------------------------------------------------------------

def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles, one row per column."""
    from nearmiss.operators.tracks import exact_quantiles
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")).select("s.*").where(
        "v IS NOT NULL AND NOT isnan(v)")
    basic = long.groupBy("column").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    return basic.join(exact_quantiles(long, ["column"], "v", {"q25": .25, "q50": .5, "q75": .75}).drop("n"), "column", "inner")


def rmse_by_event(frames: DataFrame, pairs: Mapping[str, tuple[str, str]], by: Sequence[str] = ("event_id",)) -> DataFrame:
    """Root mean square difference of each estimated and measured column, per event."""
    return frames.groupBy(*by).agg(*[
        F.sqrt(F.avg(F.pow(F.col(a) - F.col(b), 2))).alias(name) for name, (a, b) in pairs.items()])


def mean_displacement(frames: DataFrame, by: Sequence[str] = ("event_id",)) -> DataFrame:
    return frames.groupBy(*by).agg(
        F.avg(F.sqrt(F.pow(F.col("x_ekf") - F.col("x"), 2) + F.pow(F.col("y_ekf") - F.col("y"), 2))).alias("displacement"))


def mean_std(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def histogram_density(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Density over equal bins of [lo, hi], the last bin closed; values outside are not counted."""
    width = (hi - lo) / bins
    slot = F.when(F.col(value) == hi, F.lit(bins - 1)).otherwise(F.floor((F.col(value) - lo) / width).cast("int"))
    counts = df.where(F.col(value).between(lo, hi)).groupBy(F.least(slot, F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))  # at most one row per bin
    return counts.withColumn("density", F.col("n") / (F.sum("n").over(whole) * F.lit(width)))


def trimmed_mean_last(log: DataFrame, by: Sequence[str], order: str = "epoch", value: str = "val_loss", last: int = 5) -> DataFrame:
    """Mean of the last five values without the smallest and the largest."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    tail = log.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= last)
    return tail.groupBy(*by).agg(
        ((F.sum(value) - F.min(value) - F.max(value)) / (F.count(value) - 2)).alias(value))


def lead_time_before_impact(frames: DataFrame, meta: DataFrame) -> DataFrame:
    """Seconds between the first frame of each event and its impact."""
    start = frames.groupBy("event_id").agg(F.min("time").alias("_t0"))
    return meta.join(start, "event_id", "inner").where("impact_timestamp IS NOT NULL").select(
        "event_id", (F.col("impact_timestamp") / 1000 - F.col("_t0")).alias("lead_time"))


def efficiency_mean(log: DataFrame) -> DataFrame:
    return log.groupBy("model_name").agg(*[F.avg(c).alias(c) for c in ("time", "num_targets", "num_moments")])


def consistency_report(current: DataFrame, profiles: DataFrame) -> DataFrame:
    """Smallest spacing, and whether both tables hold the same number of scenes."""
    a = current.groupBy("scene_id").agg(F.min("s").alias("s")).agg(
        F.count(F.lit(1)).alias("scenes"), F.min("s").alias("min_spacing"))
    n = profiles.select("scene_id").distinct().agg(F.count(F.lit(1))).scalar()
    return a.withColumn("profile_scenes", n).withColumn("agree", F.col("scenes") == F.col("profile_scenes"))


def best_second_flag(table: DataFrame, columns: Sequence[str], largest: bool = True) -> DataFrame:
    """Rounds each metric to 3 digits (if its mean exceeds 0.01) and marks the best and second value;
    equal best values are all best, and then none is second."""
    whole = Window.partitionBy(F.lit(0))  # one row per model: a report table
    out = table
    for c in columns:
        known = F.when(~F.isnan(c), F.col(c))  # NaN is no value: it is neither averaged nor ranked
        v = F.when(F.avg(known).over(whole) > 0.01, F.round(c, 3)).otherwise(F.col(c))
        out = out.withColumn(c, v)
    for c in columns:
        ordered = F.sort_array(F.collect_list(F.when(~F.isnan(c), F.col(c))).over(whole), asc=not largest)
        out = out.withColumn(f"{c}_mark", F.when(F.col(c) == F.get(ordered, 0), 1).when(F.col(c) == F.get(ordered, 1), 2).otherwise(0))
    return out


def mix_rate_table(records: DataFrame, meta: DataFrame, dataset: str, conflicts: Sequence[str], baseline: str) -> DataFrame:
    """Metrics of a dataset's mixtures and of the unmixed baseline on some kinds of conflict, by mix rate."""
    models = records.where((F.col("model").contains("mixed") & F.col("model").contains(dataset)) | (F.col("model") == baseline))
    kept = models.join(meta.where(F.col("conflict").isin(*conflicts)).select("event_id"), "event_id", "left_semi")
    return parse_model_name(mt.eval_metrics(kept)).drop("dataset", "encoder")


def model_table(records: DataFrame, models: Mapping[str, str], with_time: bool = False) -> DataFrame:
    """Metrics of chosen models in the given order, under their report labels."""
    named = mapping(F.col("model"), models)
    place = mapping(F.col("model"), {m: str(i) for i, m in enumerate(models)}).cast("int")
    out = mt.eval_metrics(records.where(F.col("model").isin(*models)), with_time=with_time)
    return out.withColumns({"label": named, "place": place})


# --- attribution ---------------------------------------------------------------------------------

def top_factor_frequency(frames: DataFrame, factors: Sequence[str], threshold: Column | float, by: Sequence[str] = ()) -> DataFrame:
    """How often each factor is among the three strongest of a frame: largest positive ones in warning
    frames above the threshold, smallest negative ones in safe frames at or below it. Needs `side`."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    warn = F.col("side") == "warning"
    used = frames.where((warn & (F.col("intensity") > limit)) | (~warn & (F.col("intensity") <= limit)))
    strength = [F.struct((F.when(warn, -F.col(f"eg_{c}")).otherwise(F.col(f"eg_{c}"))).alias("v"), F.lit(i).alias("i"), F.lit(c).alias("factor"))
                for i, c in enumerate(factors)]
    # strongest first inside each frame's own short array: no shuffle before counting
    top = F.slice(F.array_sort(F.filter(F.array(*strength), lambda s: s["v"] < 0)), 1, 3)
    return (used.select(*by, "side", F.explode(top).alias("s")).groupBy(*by, "side", F.col("s.factor").alias("factor"))
            .agg(F.count(F.lit(1)).alias("n")))


def cum_share_cut(counts: DataFrame, by: Sequence[str] = (), proportion: float = 0.9, number: int | None = None) -> DataFrame:
    """Shares in falling order, cut where their running sum reaches the proportion, or after `number`."""
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # one row per factor
    order = whole.orderBy(F.desc("share"), "factor")
    df = counts.withColumn("share", F.col("n") / F.sum("n").over(whole)).withColumns({
        "_sum": F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0)), "place": F.row_number().over(order)})
    return df.where(F.col("place") <= number if number else F.round("_sum", 12) < proportion).drop("_sum")


def attribution_sums(attribution: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Sum of all factors of a frame, and of the positive and the negative ones."""
    cols = [F.coalesce(F.col(f"eg_{c}"), F.lit(0.0)) for c in factors]
    total = lambda xs: sum(xs[1:], xs[0])
    return attribution.withColumns({
        "eg_sum": total(cols), "positive_sum": total([F.greatest(c, F.lit(0.0)) for c in cols]),
        "negative_sum": total([F.least(c, F.lit(0.0)) for c in cols])})


def attribution_by_condition(
    attribution: DataFrame, records: DataFrame, conditions: DataFrame, factors: Sequence[str], threshold: float, number: int = 6
) -> DataFrame:
    """Strongest factors per condition: `conditions` lists (event_id, condition), an event may meet several."""
    from nearmiss.operators.clean import attribution_window
    frames = attribution_window(attribution, records).join(conditions, "event_id", "inner")
    counts = top_factor_frequency(frames, factors, threshold, by=["condition"])
    return cum_share_cut(counts, ["condition", "side"], number=number)


def event_conditions(meta: DataFrame, environment: DataFrame) -> DataFrame:
    """The report's event subsets, one row per event and condition met."""
    tests = [
        ("Adjacent lane", F.col("conflict") == "adjacent_lane"),
        ("Crossing/turning", mapping(F.col("conflict"), fv.CONFLICT_GROUPS) == "Crossing/turning"),
        ("Raining weather", F.col("weather").isin("Raining", "Mist/Light Rain")),
        ("Not dry road", F.col("surfaceCondition") != "Dry"),
        ("Not in daylight", F.col("lighting") != "Daylight"),
        ("Unstable traffic flow", F.col("trafficDensity") == fv.TRAFFIC_ORDER[4]),
    ]
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests]))
    return meta.select("event_id", "conflict").join(environment, "event_id", "inner").select(
        "event_id", F.explode(names).alias("condition"))
