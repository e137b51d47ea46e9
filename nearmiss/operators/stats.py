"""Splits, samples, encodings and the context-conditioned log-normal spacing model."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearmiss.functions import fixed_values as fv
from nearmiss.functions import numeric as nm
from nearmiss.functions.numeric import with_exprs
from nearmiss.operators.tracks import number_ranges

SEED = 131
ENVIRONMENT = ("lighting", "weather", "surfaceCondition", "trafficDensity")
BETA = 5.0


def hash_text(column: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(column).cast("string"), F.lit(f"-{seed}")))


def _hash_rank(ids: DataFrame, column: str, seed: int) -> DataFrame:
    """Rank of each id in hash order and their number."""
    hashed = ids.withColumn("_h", hash_text(column, seed))
    return number_ranges(hashed, ["_h", column], idx="_rank", total="_total").drop("_h")


def split_by_event(df: DataFrame, column: str = "event_id", share: float = 0.8, seed: int = SEED) -> DataFrame:
    """Distinct events with their part: exactly floor(share * n) of them train, the others val."""
    ranked = _hash_rank(df.select(column).distinct(), column, seed)
    return ranked.select(column, F.when(F.col("_rank") < F.floor(F.lit(share) * F.col("_total")), "train").otherwise("val").alias("part"))


def random_dims(events: DataFrame, donors: DataFrame, seed: int = SEED) -> DataFrame:
    """Sizes drawn for each event, with replacement, from the donor rows that have a target length."""
    rows = number_ranges(donors.where("target_length IS NOT NULL"), ["event_id"], idx="_i", total="_m")
    count = rows.agg(F.max("_m")).scalar()
    pick = F.pmod(F.conv(F.substring(hash_text("event_id", seed), 1, 15), 16, 10).cast("long"), count)
    return events.select("event_id").distinct().withColumn("_i", pick).join(
        rows.select("_i", F.col("target_length").alias("random_length"), F.col("target_width").alias("random_width")), "_i", "inner").drop("_i")


def mix_datasets(base: DataFrame, other: DataFrame, rate: float, seed: int = SEED) -> DataFrame:
    """All scenes of the first set and a share of the second's, scene ids running on."""
    offset = base.agg(F.max("scene_id") + 1).scalar()
    if rate < 1:
        ranked = _hash_rank(other.select("scene_id").distinct(), "scene_id", seed)
        kept = ranked.where(F.col("_rank") < F.floor(F.col("_total") * F.lit(rate))).select("scene_id")
        other = other.join(kept, "scene_id", "left_semi")
    return base.unionByName(other.withColumn("scene_id", F.col("scene_id") + offset))


def mix_sets(sets: Sequence[tuple[DataFrame, float]], seed: int = SEED) -> DataFrame:
    """Scenes of several sets under running ids. Of a set with a rate below 1, floor(rate * n) scenes are taken by hash
    rank; the ids run on after the whole set, taken or not."""
    out = offset = None
    for scenes, rate in sets:
        own = scenes
        if offset is not None:
            own = scenes.withColumn("scene_id", F.col("scene_id") + offset)
        offset = own.agg(F.max("scene_id") + 1).scalar()
        if rate < 1:
            ranked = _hash_rank(own.select("scene_id").distinct(), "scene_id", seed)
            own = own.join(ranked.where(F.col("_rank") < F.floor(F.col("_total") * F.lit(rate))).select("scene_id"), "scene_id", "left_semi")
        out = own if out is None else out.unionByName(own)
    return out


def mixing_rates(names: Sequence[str], rate: float = 2.0) -> list[float]:
    """Share taken of each set: the given rate counts for the second of two sets, three sets have fixed rates."""
    if len(names) == 3:
        return [fv.THREE_SET_RATES.get(n, 2.0) for n in names]
    return [rate if len(names) == 2 and i == 1 and rate <= 1 else 2.0 for i in range(len(names))]


def learn_categories(events: DataFrame, columns: Sequence[str] = ENVIRONMENT) -> DataFrame:
    """One row: the sorted labels of each column, from rows without any 'Unknown'. The labels are a
    short closed list, whatever the number of events."""
    known = events
    for c in columns:
        known = known.where(F.coalesce(F.col(c), F.lit("Unknown")) != "Unknown")
    return known.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in columns])


def one_hot_environment(events: DataFrame, learned_from: DataFrame, columns: Sequence[str] = ENVIRONMENT) -> DataFrame:
    """Adds `environment`: indicators over the learned labels of all columns; unseen labels give zeros."""
    cats = learn_categories(learned_from, columns)
    parts = []
    for c in columns:
        events = events.withColumn(f"_{c}", cats.select(c).scalar())
        parts.append(F.expr(f"transform(_{c}, l -> CASE WHEN l = {c} THEN 1D ELSE 0D END)"))
    return events.withColumn("environment", F.concat(*parts)).drop(*[f"_{c}" for c in columns])


def feature_std(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    return features.agg(*[F.stddev_samp(c).alias(c) for c in columns])


def perturb(features: DataFrame, columns: Sequence[str], noise: float = 0.01, seed: int = SEED,
            angles: Sequence[str] = ("psi_sur", "rho")) -> DataFrame:
    """Adds noise of the given share of each column's deviation; angles stay in [-pi, pi)."""
    spread = features.agg(F.struct(*(F.stddev_samp(c).alias(c) for c in columns))).scalar()  # one pass for all columns
    out = features.withColumn("_std", spread)
    out = out.withColumns({f"_{c}": F.col(c) + F.lit(noise) * F.col(f"_std.{c}") * F.randn(seed + i) for i, c in enumerate(columns)})
    return with_exprs(out, {c: nm.wrap(f"_{c}") if c in angles else f"_{c}" for c in columns}).drop("_std", *[f"_{c}" for c in columns])


# --- spacing model -------------------------------------------------------------------------------

def fit_binned_lognormal(features: DataFrame, bins: Mapping[str, float]) -> DataFrame:
    """Mean and deviation of the log spacing per cell of the context, cells of the given widths."""
    cells = {f"{c}_bin": F.floor(F.col(c) / F.lit(float(w))).cast("long") for c, w in bins.items()}
    return features.withColumns(cells).withColumn("_ls", F.ln(F.greatest("s", F.lit(nm.SMALL)))).groupBy(*cells).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_ls").alias("mu"), F.sqrt(F.var_pop("_ls")).alias("sigma"))


def apply_binned(features: DataFrame, model: DataFrame, bins: Mapping[str, float], narrow: float = 0.0) -> DataFrame:
    """Every frame with mu and sigma of its cell. Where the cell is unknown or its sigma not above `narrow`, the
    cells pooled without the last column stand for it, and so on up to all cells together."""
    cells = {f"{c}_bin": F.floor(F.col(c) / F.lit(float(w))).cast("long") for c, w in bins.items()}
    names, out = list(cells), features.withColumns(cells)
    for d in range(len(names), -1, -1):
        pooled = model.select(*names, "mu", "sigma") if d == len(names) else model.groupBy(*names[:d]).agg(
            (F.sum(F.col("n") * F.col("mu")) / F.sum("n")).alias("mu"),
            (F.sum(F.col("n") * (F.col("sigma") ** 2 + F.col("mu") ** 2)) / F.sum("n")).alias("sigma")).withColumn(
            "sigma", F.sqrt(F.greatest(F.col("sigma") - F.col("mu") ** 2, F.lit(0.0))))
        wide = pooled.where(F.col("sigma") > narrow)
        if d:
            out = out.join(wide.withColumnsRenamed({"mu": f"_mu{d}", "sigma": f"_sigma{d}"}), names[:d], "left")
        else:  # one row at most: both of its numbers come as one constant
            out = out.withColumn("_all", wide.select(F.struct("mu", "sigma")).scalar()).withColumns(
                {"_mu0": F.col("_all.mu"), "_sigma0": F.col("_all.sigma")}).drop("_all")
    own = range(len(names), -1, -1)
    return out.withColumns({"mu": F.coalesce(*[f"_mu{d}" for d in own]), "sigma": F.coalesce(*[f"_sigma{d}" for d in own])}).drop(
        *names, *[f"_{c}{d}" for d in own for c in ("mu", "sigma")])


def fit_linear_lognormal(features: DataFrame, columns: Sequence[str]) -> tuple[dict[str, float], dict[str, float]]:
    """Two regressions: the log spacing on the features, then the log squared residual on them.
    Returns the weights of the mean and of the log variance; key '' holds the intercept."""
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=list(columns), outputCol="f").transform(features.select("s", *columns))
    mean, log_var = _two_regressions(data)
    return {"": mean[0], **dict(zip(columns, mean[1:]))}, {"": log_var[0], **dict(zip(columns, log_var[1:]))}


def matrix_of(lists: pa.ListArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix; missing elements are NaN."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes != sizes[:1]).any():
        raise ValueError("vectors differ in length")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(len(lists), len(flat) // max(len(lists), 1))


def add_up(rows: DataFrame, sums: Callable[[Iterable[pa.RecordBatch]], Iterable[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """Arrays that tasks make of their rows, each for a slot, added up slot by slot before they reach the driver."""
    def task(parts):
        for slot, total in sums(parts):
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "total"])

    def merge(pdf):
        return pd.DataFrame({"slot": pdf["slot"][:1], "total": [sum(map(np.frombuffer, pdf["total"])).tobytes()]})

    schema = "slot int, total binary"
    found = rows.mapInArrow(task, schema).groupBy("slot").applyInPandas(merge, schema).toPandas()
    return {int(slot): np.frombuffer(total).copy() for slot, total in zip(found["slot"], found["total"])}


def fit_vector_lognormal(features: DataFrame, column: str) -> tuple[list[float], list[float]]:
    """The same two regressions on an array column; intercepts first, then the weight of every element.

    Tasks add up products of whole batches; the small systems are those of Spark's solver. Where it has ways of its own
    (labels that do not vary, values that are missing or not finite, systems that cannot be solved) it is called."""
    from pyspark.ml.functions import array_to_vector

    rows = features.select("s", F.col(column).cast("array<double>").alias("f"))
    products = _products(rows)
    mean = None if products is None else _solved(products)
    log_var = None
    if mean is not None:
        size = len(mean)
        products[:, size] = products[size] = _products(rows, mean)[size]
        log_var = _solved(products)
    if log_var is None:
        return _two_regressions(features.select("s", array_to_vector(F.col(column)).alias("f")))
    return [*map(float, mean)], [float(log_var[0]) + 1.2703628454614782, *map(float, log_var[1:])]


#: Sums of so many tasks' sums reach the driver.
SLOTS = 16


def _products(rows: DataFrame, mean: np.ndarray | None = None) -> np.ndarray | None:
    """Sums of the products of 1, the features and the label with each other: the label is the log spacing, or the log of
    its squared distance from the mean with the given weights; then only those with the label are worked out."""
    def sums(parts):
        total = None
        for part in parts:
            if not part.num_rows:
                continue
            x, s = matrix_of(part.column("f")), part.column("s").to_numpy(zero_copy_only=False).astype(float)
            with np.errstate(all="ignore"):
                y = np.log(np.maximum(s, nm.SMALL))
                if mean is not None:
                    y = np.log(np.maximum((y - x @ mean[1:] - mean[0]) ** 2, nm.SMALL))
                z = np.column_stack([np.ones(len(x)), x, y])
                own = z.T @ z if mean is None else y @ z
            total = own if total is None else total + own
        if total is not None:
            yield TaskContext.get().partitionId() % SLOTS, total

    found = list(add_up(rows, sums).values())
    if not found:
        return None
    total = sum(found)
    size = round(len(total) ** 0.5) if mean is None else len(total)
    if mean is None:
        return total.reshape(size, size)
    out = np.zeros((size, size))
    out[-1] = total
    return out


def _solved(products: np.ndarray, reg: float = 1e-6) -> np.ndarray | None:
    """Intercept and weights of the regression with features and label scaled to a deviation of 1 and a squared penalty
    on the scaled weights, as LinearRegression has them; None where the scaled system cannot be solved like that."""
    if not np.isfinite(products).all():
        return None
    products = products / products[0, 0]
    bar = products[0, 1:]
    spread = np.maximum(np.diag(products)[1:] - bar ** 2, 0.0)
    if spread[-1] <= 0 or ((spread > 0) & (spread < 1e-12 * bar ** 2)).any():
        return None
    std = np.sqrt(spread)
    scale = np.concatenate([[1.0], np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)])
    scaled = products * np.outer(scale, scale)
    system = scaled[:-1, :-1] + np.diag([0.0, *[reg / std[-1]] * (len(std) - 1)])
    try:
        np.linalg.cholesky(system)
    except np.linalg.LinAlgError:
        return None
    return np.linalg.solve(system, scaled[:-1, -1]) * scale[:-1] * std[-1]


def _two_regressions(rows: DataFrame) -> tuple[list[float], list[float]]:
    from pyspark.ml.regression import LinearRegression

    def fit(data: DataFrame, label: str, out: str):
        return LinearRegression(featuresCol="f", labelCol=label, predictionCol=out, regParam=1e-6, solver="normal").fit(data)

    data = rows.select("f", F.ln(F.greatest("s", F.lit(nm.SMALL))).alias("ls"))
    mean = fit(data, "ls", "m")
    squared = mean.transform(data).withColumn("lv", F.ln(F.greatest(F.pow(F.col("ls") - F.col("m"), 2), F.lit(nm.SMALL))))
    var = fit(squared, "lv", "p")
    # the mean of ln of a squared standard normal is -1.2704
    return ([mean.intercept, *map(float, mean.coefficients)],
            [var.intercept + 1.2703628454614782, *map(float, var.coefficients)])


def linear_text(weights: Mapping[str, float]) -> str:
    return " + ".join([f"({weights['']!r}D)"] + [f"({w!r}D) * {c}" for c, w in weights.items() if c])


def apply_linear(features: DataFrame, mean: Mapping[str, float], log_var: Mapping[str, float]) -> DataFrame:
    return with_exprs(features, {"mu": linear_text(mean), "sigma": f"exp(0.5D * ({linear_text(log_var)}))"})


def score_intensity(scored: DataFrame, raw: bool = False) -> DataFrame:
    """Conflict intensity from spacing s, mu and sigma: log10 of the count, at least 0, or the raw count."""
    text = nm.intensity_count("s", "mu", "sigma") if raw else nm.intensity("s", "mu", "sigma")
    return with_exprs(scored, {"intensity": text})


def lognormal_curves(scored: DataFrame) -> DataFrame:
    """Scaled density, distribution, mode and the chance that the largest of n = 10 stays above s."""
    return with_exprs(scored, {
        "pdf": nm.lognormal_pdf("s", "mu", "sigma"), "cdf": nm.lognormal_cdf("s", "mu", "sigma"),
        "mode": nm.lognormal_mode("mu", "sigma"), "extreme": nm.extreme_cdf("s", "mu", "sigma")})


def mean_nll(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg(F.expr(nm.lognormal_nll("s", "mu", "2D * ln(sigma)"))).alias("nll"))


def smoothed_nll(scored: DataFrame, beta: float = BETA) -> DataFrame:
    """Mean negative log-likelihood plus beta times the mean divergence to the outputs (mu2, sigma2)
    for slightly changed inputs."""
    nll = F.avg(F.expr(nm.lognormal_nll("s", "mu", "2D * ln(sigma)")))
    js = F.avg(F.expr(nm.js_divergence("mu", "2D * ln(sigma)", "mu2", "2D * ln(sigma2)")))
    return scored.agg(nll.alias("nll"), js.alias("divergence"), (nll + F.lit(beta) * js).alias("smooth_nll"))


def model_inspection(scored: DataFrame) -> DataFrame:
    from nearmiss.operators.reports import describe
    return describe(with_exprs(scored, {"mode": nm.lognormal_mode("mu", "sigma")}), ["mu", "sigma", "mode"])


# --- registry ------------------------------------------------------------------------------------

def dataset_summary(log: DataFrame, samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Registry rows: samples, trimmed validation loss and number of epochs per training run."""
    from nearmiss.operators.reports import trimmed_mean_last
    epochs = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_epochs_trained"))
    return trimmed_mean_last(log, keys).join(epochs, list(keys), "inner").join(samples, list(keys), "left")
