"""Ordered-series building blocks that stay parallel when one track holds a large share of the rows.

A plain window over a track puts the whole track into one task. Here a track is first numbered by
counting rows per coarse chunk (partial counts, then a running sum over the few chunks), and every
bounded window then runs over fixed-size blocks of that number. Each block also receives the few
neighbouring rows its frame reaches into, so results equal those of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearmiss.session import cut_lineage

BLOCK = 8192


def time_chunk(k: str = "k", size: int = BLOCK) -> Column:
    return F.floor(F.col(k) / F.lit(size)).cast("long")


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    chunk: Column | Sequence[Column],
    idx: str = "idx",
    total: str | None = None,
    sums: dict[str, Column] | None = None,
) -> DataFrame:
    """0-based position of each row within its key, in the given order, and running sums if asked.

    `chunk` must never decrease along the order; it sets the unit of parallel work. Counts and sums
    per chunk are aggregated before the shuffle, and only those few rows are ordered per key. Give
    several chunk columns, coarse first, where one key has too many chunks for a single task.
    """
    keys, sums = list(keys), sums or {}
    levels = list(chunk) if isinstance(chunk, (list, tuple)) else [chunk]
    level_names = [f"_level{i}" for i in range(len(levels) - 1)] + ["_chunk"]
    base = df.withColumns(
        dict(zip(level_names, levels)) | {f"_v_{n}": c for n, c in sums.items()})
    per_chunk = base.groupBy(*keys, *level_names).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    offsets = _chunk_offsets(per_chunk, keys, level_names, list(sums))
    if total:
        offsets = offsets.withColumn(total, F.sum("_rows").over(_within(keys)))
    offsets = offsets.drop("_rows", *level_names[:-1])
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = base.withColumns(
        {"_rn": F.row_number().over(inside)} | {f"_s_{n}": F.sum(f"_v_{n}").over(upto) for n in sums})
    # null-safe match, so rows with a missing key or chunk keep their place
    on = [out[c].eqNullSafe(offsets[c]) for c in [*keys, "_chunk"]]
    joined = out.join(offsets, on, "inner")
    return joined.select(
        *[out[c] for c in df.columns if c not in sums],
        (F.col("_offset") + F.col("_rn") - 1).cast("long").alias(idx),
        *([offsets[total]] if total else []),
        *[(F.col(f"_p_{n}") + F.col(f"_s_{n}")).alias(n) for n in sums],
    )


def _within(keys: Sequence[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def _chunk_offsets(per_chunk: DataFrame, keys: list[str], levels: list[str], sums: list[str]) -> DataFrame:
    """Rows and sums before each chunk, summed level by level so no task orders all chunks at once."""
    *coarse, last = levels
    before = _within([*keys, *coarse]).orderBy(last).rowsBetween(Window.unboundedPreceding, -1)
    out = per_chunk.select(
        *keys, *levels, "_rows",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0.0)).alias(f"_p_{n}") for n in sums],
    )
    if not coarse:
        return out
    upper = per_chunk.groupBy(*keys, *coarse).agg(
        F.sum("_rows").alias("_rows"), *[F.sum(f"_t_{n}").alias(f"_t_{n}") for n in sums])
    upper = _chunk_offsets(upper, keys, coarse, sums).drop("_rows")
    added = ["_offset", *[f"_p_{n}" for n in sums]]
    upper = upper.withColumnsRenamed({c: f"{c}_up" for c in added})
    out = out.join(upper, [*keys, *coarse], "inner")
    return out.withColumns({c: F.col(c) + F.col(f"{c}_up") for c in added}).drop(
        *[f"{c}_up" for c in added])


def range_rows(df: DataFrame, order: Sequence[str | Column], partitions: int | None = None) -> DataFrame:
    """The rows in sampled ranges of the order, stored with their range (`_part`) and their place in it (`_at`), so the
    numbers stay whatever the files are split into later. Only rows equal in the whole order share a range by force."""
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    places = {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}
    return cut_lineage(ranged.sortWithinPartitions(*order).withColumns(places), "ranges")


def number_ranges(
    df: DataFrame, order: Sequence[str | Column], idx: str = "idx", total: str | None = None, partitions: int | None = None
) -> DataFrame:
    """0-based position of each row over the whole table in the given order, and the number of rows if asked.

    Unlike `number_rows` it needs no chunks, so sparse ids and one id with most of the rows are spread alike: each task
    sorts one sampled range, and only one count per range is summed up.
    """
    stored = range_rows(df, order, partitions)
    before = _within([]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        *([F.sum("_rows").over(_within([])).alias(total)] if total else []))
    # one row per range, so never more than the shuffle partitions
    return stored.join(F.broadcast(offsets), "_part", "inner").select(
        *df.columns, (F.col("_offset") + F.col("_at")).cast("long").alias(idx), *([total] if total else []))


def number_groups(df: DataFrame, key: str, order: Sequence[str], idx: str = "idx") -> DataFrame:
    """0-based position of each row within its key, also where one key holds most of the rows."""
    rows = cut_lineage(number_ranges(df, [key, *order], "_place"), "places")
    first = rows.groupBy(F.col(key).alias("_key")).agg(F.min("_place").alias("_first"))
    return rows.join(first, rows[key].eqNullSafe(first["_key"]), "inner").select(
        *df.columns, (F.col("_place") - F.col("_first")).alias(idx))


def spread_blocks(
    df: DataFrame, idx: str = "idx", before: int = 0, after: int = 0, block: int = BLOCK
) -> DataFrame:
    """Give each row to its block and, when it lies within reach, to the neighbouring block.

    Adds `_block` and `_own`; run the window over (keys, _block) and keep the `_own` rows.
    """
    if before > block or after > block:
        raise ValueError("reach of the frame exceeds the block size")
    i = F.col(idx)
    home = F.floor(i / F.lit(block)).cast("long")
    pos = F.pmod(i, F.lit(block))
    targets = F.filter(
        F.array(
            home,
            F.when(pos >= block - before, home + 1) if before else F.lit(None).cast("long"),
            F.when((pos < after) & (home > 0), home - 1) if after else F.lit(None).cast("long"),
        ),
        lambda b: b.isNotNull(),
    )
    return df.withColumn("_block", F.explode(targets)).withColumn("_own", F.col("_block") == home)


def block_window(keys: Sequence[str], idx: str = "idx"):
    return Window.partitionBy(*keys, "_block").orderBy(idx)


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_block", "_own")


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    values: dict[str, Column],
    idx: str = "idx",
    block: int = BLOCK,
) -> DataFrame:
    """Cumulative sums along a numbered track."""
    out = number_rows(df, keys, [idx], time_chunk(idx, block), idx="_again", sums=values)
    return out.drop("_again")


#: Bits of a double's code that each round of a selection looks at, the highest first.
DIGITS = (22, 21, 21)


def with_code(df: DataFrame, value: str, name: str = "_code") -> DataFrame:
    """Adds the 64 bits of a double as a long of the same order: sign, exponent, fraction, so values near 0 have codes
    of their own and infinities lie outside all others. NULL and NaN give NULL; -0.0 and 0.0 are equal."""
    v = F.col(value).cast("double")
    # step by step: each column is used several times by the next one
    df = df.withColumn("_size", F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None)).otherwise(F.abs(v)))
    df = df.withColumn("_guess", F.floor(F.log2("_size")))
    df = df.withColumn("_power", F.pow(F.lit(2.0), F.col("_guess")))
    # the logarithm rounds, so it may be one off beside a power of two; below 2^-1022 the exponent stands still
    df = df.withColumn("_e", F.greatest(F.lit(-1022), F.when(F.col("_size") < F.col("_power"), F.col("_guess") - 1)
                                        .when(F.col("_size") >= F.col("_power") * 2, F.col("_guess") + 1).otherwise(F.col("_guess"))))
    df = df.withColumn("_part", F.col("_size") / F.pow(F.lit(2.0), F.col("_e")))
    whole, fraction = F.lit(1 << 52), F.lit(float(1 << 52))
    bits = (F.when(F.col("_size") == 0, F.lit(0).cast("long"))
            .when(F.col("_part") >= 1, (F.col("_e") + 1023) * whole + ((F.col("_part") - 1) * fraction).cast("long"))
            .when(F.col("_part") < 1, (F.col("_part") * fraction).cast("long"))
            .when(F.abs(v) == float("inf"), F.lit(0x7FF << 52)))
    df = df.withColumn("_bits", bits)
    return df.withColumn(name, F.when(v < 0, -F.col("_bits")).otherwise(F.col("_bits"))).drop(
        "_size", "_guess", "_power", "_e", "_part", "_bits")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Linear-interpolated quantiles per key without bringing a key's values together."""
    ranks, out = {}, []
    for name, p in probs.items():
        place = (F.col("n") - 1) * F.lit(p)
        lo, hi = F.floor(place).cast("long"), F.ceil(place).cast("long")
        ranks |= {f"_lo_{name}": lo, f"_hi_{name}": hi}
        out.append((F.col(f"_lo_{name}") + (place - lo) * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name))
    return order_statistics(df, keys, value, ranks).select(*keys, "n", *out)


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column]
) -> DataFrame:
    """Values at the given 0-based ranks per key; a rank may depend on the group size n.

    Radix selection: equal values are counted first; then rows are counted by the leading bits of their code, and only
    those that share the bits of a wanted rank are counted by the next ones, until all 64 are known. No values are
    sorted, and no window holds more than 2^22 counts, wherever the values lie. Infinities count as values; NULL and
    NaN are ignored; a rank outside the group gives NULL.
    """
    keys = list(keys)
    values = (df.where(F.col(value).isNotNull() & ~F.isnan(value))
              .groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    values = with_code(values, "_v")
    known, left = None, 64
    names = [f"_r_{name}" for name in ranks]
    for bits in DIGITS:
        left -= bits
        prefix = F.shiftright("_code", left) if left else F.col("_code")
        if known is None:
            counts = values.withColumn("_prefix", prefix).groupBy(*keys, "_prefix").agg(F.sum("_c").alias("_n"), F.min("_v").alias("_v"))
            inside = _within(keys)
            counts = counts.withColumns({"_before": F.lit(0).cast("long"), "n": F.sum("_n").over(inside)})
        else:
            rows = values.withColumns({"_prefix": prefix, "_up": F.shiftright("_code", left + bits)})
            up = known.select(*(F.col(c).alias(f"_k_{c}") for c in keys), F.col("_prefix").alias("_at"), "_before", "n", *names)
            # null-safe also for the bits: a plain match would push a filter with the whole code below its steps
            same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys] + [F.col("_up").eqNullSafe(F.col("_at"))]
            counts = (rows.join(up, same, "inner").groupBy(*keys, "_up", "_prefix")
                      .agg(F.sum("_c").alias("_n"), F.min("_v").alias("_v"), *(F.first(c).alias(c) for c in ("_before", "n", *names))))
            inside = Window.partitionBy(*keys, "_up")
        before = inside.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_n").over(before), F.lit(0)))
        if known is None:
            # ranks may be costly to work out: once per key, on its first count, then handed to the others
            counts = counts.withColumns({f"_f{c}": F.when(F.col("_before") == 0, rank) for c, rank in zip(names, ranks.values())})
            counts = counts.withColumns({c: F.max(f"_f{c}").over(inside) for c in names}).drop(*(f"_f{c}" for c in names))
        held = {c: (F.col(c) >= F.col("_before")) & (F.col(c) < F.col("_before") + F.col("_n")) for c in names}
        wanted = F.lit(False)
        for test in held.values():
            wanted = wanted | test
        known = counts.where(F.coalesce(wanted, F.lit(False)))
    found = [F.max(F.when(held[c], F.col("_v"))).alias(name) for c, name in zip(names, ranks)]
    return known.groupBy(*keys).agg(F.max("n").alias("n"), *found)
