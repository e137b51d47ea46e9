"""Reference points by mini-batch k-means, and attribution of conflict intensity to groups of features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearmiss.functions import numeric as nm
from nearmiss.operators.stats import SEED, add_up, matrix_of
from nearmiss.session import scratch_path

#: Rows the first centres are chosen from, times k.
SAMPLE_PER_CENTRE = 16
#: Rows and centres compared at a time: an array of ROWS x CENTRES doubles is 128 KB, and a handful of them live.
ROWS, CENTRES = 64, 256


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows x centres, without the rows' own squares (the same for every centre)."""
    return (centres ** 2).sum(axis=1)[None, :] - 2 * x @ centres.T


def nearest_places(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of every row, the first one on a tie."""
    return np.concatenate([distances(x[i:i + ROWS], centres).argmin(axis=1) for i in range(0, len(x), ROWS)] or [np.zeros(0, int)])


def spread_centres(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++: each centre drawn with a chance in proportion to its squared distance from those before. Fewer than k
    different rows give that many centres."""
    draw = np.random.default_rng(seed)
    squares = (sample ** 2).sum(axis=1)
    chosen = [int(draw.integers(len(sample)))]
    away = np.full(len(sample), np.inf)
    while len(chosen) < k:
        last = sample[chosen[-1]]
        away = np.minimum(away, np.maximum(squares - 2 * (sample @ last) + last @ last, 0.0))
        near = np.flatnonzero(~(away > 1e-9 * (squares + last @ last)))  # equal rows are among them, whatever the rounding
        away[near[(sample[near] == last).all(axis=1)]] = 0.0
        total = away.sum()
        if total <= 0:
            break
        chosen.append(min(int(np.searchsorted(np.cumsum(away), draw.random() * total, side="right")), len(sample) - 1))
    return sample[chosen].copy()


def deal_batches(vectors: DataFrame, column: str, batches: int, seed: int) -> DataFrame:
    """The vectors that are not null, dealt to mini-batches by hash and written once, a folder per batch, each as the
    bytes of its doubles, which take less work to write and read again than a list."""
    spark = vectors.sparkSession
    path = scratch_path(spark, "vectors")
    rows = vectors.select(F.col(column).cast("array<double>").alias("v")).where("v IS NOT NULL")
    rows = rows.withColumn("hash", F.xxhash64(F.lit(seed), "v")).withColumn("batch", F.pmod("hash", F.lit(batches)).cast("int"))

    def pack(parts):
        for part in parts:
            if part.num_rows:
                x = matrix_of(part.column("v"))
                ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(8 * x.shape[1])
                v = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])
                yield pa.RecordBatch.from_arrays([v, part.column("hash"), part.column("batch")], names=["v", "hash", "batch"])

    dealt = rows.mapInArrow(pack, "v binary, hash long, batch int")
    dealt.write.partitionBy("batch").option("parquet.enable.dictionary", "false").parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def dealt_matrix(packed: pa.BinaryArray) -> np.ndarray:
    """Dealt vectors, all of one length, as the rows of a matrix."""
    ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset:packed.offset + len(packed) + 1]
    return np.frombuffer(packed.buffers()[2])[ends[0] // 8:ends[-1] // 8].reshape(len(packed), -1)


def first_rows(dealt: DataFrame, rows: int) -> np.ndarray:
    """The vectors of the smallest hashes, in their order. The hashes are read first, so that few vectors are sorted."""
    last = dealt.select("hash").orderBy("hash").limit(rows).agg(F.max("hash")).first()[0]
    if last is None:
        return np.zeros((0, 0))
    found = dealt.where(F.col("hash") <= last).orderBy("hash").limit(rows).select("v").toPandas()["v"]
    return np.stack([np.frombuffer(v) for v in found])


#: Centres whose sums of a batch are added up by one task.
SLICE = 64


def mini_batch_centres(vectors: DataFrame, column: str, k: int = 1024, batches: int = 16, seed: int = SEED) -> np.ndarray:
    """Cluster centres that stand for the data; k of them, however large the data.

    Rows are dealt to mini-batches by hash and written once, a folder per batch, so every row is read twice in all. A
    batch moves each centre to the mean of all rows it has won so far, so later batches weigh less. Tasks add up the
    rows of each centre, and at most k sums of a batch reach the driver. The first centres come from the
    SAMPLE_PER_CENTRE * k rows of the smallest hashes. Null vectors are left out; no rows give no centres."""
    dealt = deal_batches(vectors, column, batches, seed)
    sample = first_rows(dealt, SAMPLE_PER_CENTRE * k)
    if not len(sample):
        return np.zeros((0, 0))
    centres = spread_centres(sample, k, seed)
    won = np.zeros(len(centres))
    for batch in range(batches):
        def sums(parts, centres=centres):
            total = np.zeros((len(centres), centres.shape[1] + 1))
            for part in parts:
                if not part.num_rows:
                    continue
                x = dealt_matrix(part.column("v"))
                at = nearest_places(x, centres)
                order = np.argsort(at, kind="stable")
                own, first = np.unique(at[order], return_index=True)
                total[own, 1:] += np.add.reduceat(x[order], first, axis=0)
                total[:, 0] += np.bincount(at, minlength=len(centres))
            if total[:, 0].any():
                yield from ((i // SLICE, total[i:i + SLICE]) for i in range(0, len(total), SLICE))

        found = add_up(dealt.where(F.col("batch") == batch).select("v"), sums)
        for i, part in found.items():
            own = slice(i * SLICE, i * SLICE + SLICE)
            part = part.reshape(-1, centres.shape[1] + 1)
            n = part[:, :1]
            won[own] += n[:, 0]
            centres[own] += np.where(n > 0, (part[:, 1:] - n * centres[own]) / np.maximum(won[own], 1)[:, None], 0.0)
    return centres


def nearest_centre(vectors: DataFrame, column: str, centres: np.ndarray, keys: Sequence[str]) -> DataFrame:
    """The keys and `centre`, the place of the nearest one."""
    types = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}

    def task(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[column].to_list()).astype(float)
                yield pdf[list(keys)].assign(centre=nearest_places(x, centres).astype(np.int32))

    return vectors.where(F.col(column).isNotNull()).select(*dict.fromkeys([*keys, column])).mapInPandas(
        task, ", ".join(f"{k} {types[k]}" for k in keys) + ", centre int")


def _np_intensity(s, mu, log_var):
    z = (np.log(np.maximum(s, nm.SMALL)) - mu) * np.exp(-0.5 * log_var) * np.sqrt(0.5)
    t = 1 / (1 + 0.5 * np.abs(z))
    poly = np.full_like(t, nm.ERFC_COEFFICIENTS[-1])
    for c in nm.ERFC_COEFFICIENTS[-2::-1]:
        poly *= t
        poly += c
    tail = t * np.exp(poly - z * z)
    sf = np.clip(0.5 * np.where(z >= 0, tail, 2 - tail), nm.SMALL, 1 - nm.SMALL)
    return np.log10(np.maximum(np.log(0.5) / np.log(sf), 1.0))


def enough_tasks(frames: DataFrame) -> DataFrame:
    """Stored frames in four parts for each task that runs at once where they are stored in less than two, so that no
    core waits long for the last parts."""
    tasks = frames.sparkSession.sparkContext.defaultParallelism
    return frames if frames.rdd.getNumPartitions() >= 2 * tasks else frames.repartition(4 * tasks)


#: Cells of the intensity's table between its two flat ends.
CELLS = 2048


@lru_cache(maxsize=1)
def intensity_table() -> tuple[float, float, np.ndarray]:
    """The intensity depends on z, the standardised log spacing over sqrt(2), alone: one value up to the first returned
    z, smooth from there to the second one, next to 0, and 0 beyond. Per cell, the weights of the cubic function through
    its ends and thirds, which is within 1e-12 of the value, but for the formula's own rounding next to the flat end
    (5e-11); the last column is what comes after."""
    def of(z):
        return _np_intensity(np.exp(np.asarray(z)), 0.0, -np.log(2.0))

    def last(holds, z, beyond):
        while z < (middle := (z + beyond) / 2) < beyond:
            z, beyond = (middle, beyond) if holds(of([middle])[0]) else (z, middle)
        return z

    full = of([-10.0])[0]
    flat, end = last(lambda h: h >= full, -10.0, -1.0), last(lambda h: h > 0, -1.0, 0.0)
    h = of(np.linspace(flat, end, 3 * CELLS + 1))
    d1, d2, d3 = (np.diff(h, n)[::3][:CELLS] for n in (1, 2, 3))
    parts = np.zeros((4, CELLS + 1))
    parts[:, :-1] = h[:-1:3], 3 * (d1 - d2 / 2 + d3 / 3), 9 * (d2 - d3) / 2, 27 * d3 / 6
    return flat, end, parts


def _spread(mean: np.ndarray, square: np.ndarray, n: int, part: np.ndarray) -> int:
    """Merges rows x points into the rows' means and squared deviations over n points; `part` is used up."""
    m, own = part.shape[1], part.mean(axis=1)
    away = own - mean
    part -= own[:, None]
    square += np.einsum("ij,ij->i", part, part) + away ** 2 * n * m / (n + m)
    mean += away * m / (n + m)
    return n + m


def _row_terms(s, mu, lv, own):
    """What is left of the log spacing and of the log variance when a factor's share is taken out."""
    return np.log(np.maximum(s, nm.SMALL)) - (mu - own[:, 0]), lv - own[:, 1]


def _moments(a: np.ndarray, left: np.ndarray, other: np.ndarray, odd) -> tuple:
    """Mean and variance of the intensity over the points, each of which is compared with each row. a, left: the terms of
    a row; odd(rows, points): the intensity of rows or points that are not finite.

    z is a product of row and point terms, so a block is one matrix product and one look into the table; rows whose
    spacing lies above the median at every point have intensity 0 there and need neither. Blocks of points are merged by
    their counts, means and squared deviations."""
    mean, square = np.zeros(len(a)), np.zeros(len(a))
    flat, end, table = intensity_table()
    with np.errstate(all="ignore"):
        e = np.exp(-0.5 * left) * np.sqrt(0.5)
        rows = np.stack([e * a, -e, np.ones(len(a))], axis=1)
        shrink = np.exp(-0.5 * other[:, 1])
        # cells from the flat end, in place of z
        points = np.stack([shrink, other[:, 0] * shrink, np.full(len(other), -flat)]) * (CELLS / (end - flat))
        usual = np.isfinite(rows).all(axis=1) & np.isfinite(points).all()
    never = usual & (a >= other[:, 0].max(initial=-np.inf)) & bool(len(other))
    usual &= ~never
    for some, work in ((usual, rows[usual]), (~(usual | never), None)):
        if not some.any():
            continue
        own_mean, own_square, n = np.zeros(some.sum()), np.zeros(some.sum()), 0
        for i in range(0, len(other), CENTRES):
            if work is not None:
                t = work @ points[:, i:i + CENTRES]
                np.clip(t, 0.0, CELLS, out=t)
                cell = t.astype(np.intp)
                t -= cell
                part, weight = table[3].take(cell, mode="clip"), np.empty_like(t)
                for power in (2, 1, 0):
                    part *= t
                    part += table[power].take(cell, out=weight, mode="clip")
            else:
                part = odd(some, other[i:i + CENTRES])
            n = _spread(own_mean, own_square, n, part)
        mean[some], square[some] = own_mean, own_square
    return mean, square / len(other) if len(other) else np.full(len(a), np.nan)


def falls(s: np.ndarray, mu: np.ndarray, lv: np.ndarray, base: np.ndarray, own: np.ndarray, other: np.ndarray, grid: Grid | None = None) -> tuple:
    """Mean and deviation, over the reference points, of how much the intensity falls when a factor takes its value
    there. own: rows x 2, other: points x 2, the factor's shares of mu and of the log variance. Rows within the grid are
    taken from there, all others are compared with every point."""
    with np.errstate(all="ignore"):
        a, left = _row_terms(s, mu, lv, own)
    mean, square = np.zeros(len(s)), np.zeros(len(s))
    rest = np.ones(len(s), bool)
    if grid is not None:
        mean, square, known = grid.moments(a, left)
        rest = ~known
    if rest.any():
        def odd(some, there):
            with np.errstate(all="ignore"):
                at = np.flatnonzero(rest)[some]
                return _np_intensity(s[at, None], there[:, 0] + (mu - own[:, 0])[at, None], there[:, 1] + (lv - own[:, 1])[at, None])

        step = len(s) if grid is None else max(ROWS, ROWS * CENTRES // max(len(other), 1))
        at = np.flatnonzero(rest)
        for i in range(0, len(at), max(step, 1)):
            some = at[i:i + step]
            mean[some], square[some] = _moments(a[some], left[some], other, lambda m, there, i=i: odd(i + np.flatnonzero(m), there))
    return (base - mean if len(other) else mean), np.sqrt(square)


#: Cells of a grid along the first term besides those between points, the widest cell along the second, their greatest
#: number, and the nodes of a cell.
ACROSS, WIDE, ALONG = 128, 0.6, 12
NODES = (4, 10)
#: How far a mean or a deviation of a grid may be off at the places where a cell is tested.
CLOSE = 1e-9
#: Values worked out for a cell: at its nodes and where it is tested.
PER_CELL = NODES[0] * NODES[1] + (NODES[0] + 1) * 4


def _nodes(n: int) -> np.ndarray:
    return np.cos((np.arange(n) + 0.5) * np.pi / n)


def _tests(n: int, some: Sequence[int]) -> np.ndarray:
    """Where the error of a function through the nodes is largest, just inside the cell."""
    return 0.9999 * np.cos(np.asarray(some) * np.pi / n)


class Grid:
    """Mean and variance of the intensity over the points, as a function of a row's two terms.

    The intensity has a corner where z is 0, that is at the first share of each point, and is smooth elsewhere; cells lie
    between these corners and evenly spaced edges, and hold the polynomials through the values at their nodes. Each cell
    is tested against values worked out point by point; rows in cells that are off by more than CLOSE or were not filled,
    and rows outside, are not known to the grid. Above the last corner everything is 0."""

    def __init__(self, a: np.ndarray, left: np.ndarray, other: np.ndarray):
        """Empty, with the cells for rows like those given; at least one of them lies below the last corner."""
        self.last = other[:, 0].max()
        self.low, high = np.quantile(left, [0.0005, 0.9995])
        reach = 1.1 * (high - self.low) + 1e-6
        self.low -= 0.05 * (high - self.low) + 5e-7
        self.along = int(np.clip(np.ceil(reach / WIDE), 1, ALONG))
        self.width = reach / self.along
        first = a.min() - 0.05 * (self.last - a.min())
        self.edges = np.unique(np.concatenate([np.linspace(first, self.last, ACROSS + 1), other[:, 0][other[:, 0] > first]]))
        # where a cell's polynomials stand in the table; -1: it has none
        self.places = np.full((len(self.edges) - 1) * self.along, -1, np.int32)
        self.table, self.least = np.zeros((0, 2 * NODES[0] * NODES[1])), np.zeros(0)

    @staticmethod
    def over(a: np.ndarray, left: np.ndarray, other: np.ndarray) -> Grid | None:
        fine = np.isfinite(a) & (np.abs(left) < 500)
        if not np.isfinite(other).all() or not len(other) or not (fine & (a < other[:, 0].max())).any():
            return None
        return Grid(a[fine], left[fine], other)

    def cells(self, a: np.ndarray, left: np.ndarray) -> tuple:
        """Which rows lie in a cell; of these, their cells and the places within these."""
        at = np.searchsorted(self.edges, a, side="right") - 1
        place = (left - self.low) / self.width
        some = np.flatnonzero((at >= 0) & (a < self.last) & (place >= 0) & (place < self.along))
        at, along = at[some], place[some].astype(np.intp)
        return some, at * self.along + along, 2 * (a[some] - self.edges[at]) / (self.edges[at + 1] - self.edges[at]) - 1, 2 * (place[some] - along) - 1

    def worth(self, a: np.ndarray, left: np.ndarray, rows: float) -> np.ndarray:
        """Cells that spare more comparisons than filling them takes, where each row given stands for so many rows."""
        held = np.bincount(self.cells(a, left)[1], minlength=len(self.places))
        return np.flatnonzero((held + 0.5) * rows >= PER_CELL)

    def fill(self, cells: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Polynomials of the cells, and the least variance at which they are close."""
        at, along = np.divmod(cells, self.along)
        start, size = self.edges[at][:, None, None], np.diff(self.edges)[at][:, None, None]
        low = self.low + along[:, None, None] * self.width

        def values(u, w):
            a, left = np.broadcast_arrays(start + (u[:, None] + 1) / 2 * size, low + (w + 1) / 2 * self.width)
            found, flat_a, flat_left = np.empty((2, a.size)), a.ravel(), left.ravel()
            step = max(ROWS, ROWS * CENTRES // len(other))
            for i in range(0, a.size, step):
                found[:, i:i + step] = _moments(flat_a[i:i + step], flat_left[i:i + step], other, None)
            return found.reshape(2, *a.shape)

        u, w = map(_nodes, NODES)
        # powers of the place within a cell, x of u and y of w, from the values at the nodes
        to_u, to_w = (np.linalg.inv(np.vander(x, increasing=True)) for x in (u, w))
        table = np.einsum("xu,yw,mcuw->cmxy", to_u, to_w, values(u, w), optimize=True)
        u, w = _tests(NODES[0], range(NODES[0] + 1)), _tests(NODES[1], (0, 3, 5, 10))
        powers = np.vander(u, NODES[0], increasing=True), np.vander(w, NODES[1], increasing=True)
        off = np.abs(np.einsum("ux,wy,cmxy->mcuw", *powers, table, optimize=True) - values(u, w)).max(axis=(2, 3))
        return table.reshape(len(cells), -1), np.where(off[0] <= CLOSE, (off[1] / (2 * CLOSE)) ** 2, np.inf)

    def moments(self, a: np.ndarray, left: np.ndarray) -> tuple:
        """Mean, variance, and which rows the grid knows."""
        with np.errstate(all="ignore"):
            known = (a >= self.last) & np.isfinite(a) & np.isfinite(np.exp(-0.5 * left))
            some, cell, u, w = self.cells(a, left)
        mean, square = np.zeros(len(a)), np.zeros(len(a))
        place = self.places[cell]
        own = place >= 0
        some, place, u, w = some[own], place[own], u[own], w[own]
        if len(some):
            parts = self.table.take(place, axis=0).reshape(len(some), 2 * NODES[0], NODES[1])
            powers = np.empty((len(some), NODES[1]))
            powers[:, 0] = 1.0
            for i in range(1, NODES[1]):
                np.multiply(powers[:, i - 1], w, out=powers[:, i])
            parts = np.einsum("rxy,ry->rx", parts, powers).reshape(len(some), 2, NODES[0])
            found = parts[:, :, -1]
            for i in range(NODES[0] - 2, -1, -1):
                found = found * u[:, None] + parts[:, :, i]
            mean[some], square[some] = found[:, 0], np.maximum(found[:, 1], 0.0)
            known[some] = found[:, 1] >= self.least[place]
        return mean, square, known


def _shares(mean: Sequence[float], log_var: Sequence[float], centres: np.ndarray, factors: Mapping[str, Sequence[int]]) -> tuple:
    b, g, ref = np.asarray(mean[1:], float), np.asarray(log_var[1:], float), np.asarray(centres, float)
    places = {name: list(at) for name, at in factors.items()}
    return b, g, places, {name: np.stack([ref[:, at] @ b[at], ref[:, at] @ g[at]], axis=1) for name, at in places.items()}


#: Rows whose terms set the reach of the grids, and cells filled by a task at a time.
REACH, FILLED = 16_384, 64


def factor_grids(
    frames: DataFrame, column: str, mean: Sequence[float], log_var: Sequence[float], centres: np.ndarray, factors: Mapping[str, Sequence[int]],
) -> dict[str, Grid]:
    """A grid for each factor, worked out by tasks, of stored frames. Some rows tell how far it reaches and which of its
    cells are worth it; rows elsewhere are compared with every point, so results do not depend on that choice."""
    spark, n = frames.sparkSession, frames.count()
    b, g, places, there = _shares(mean, log_var, centres, factors)
    if n < ACROSS * PER_CELL:
        return {}
    some = frames.select("s", column).sample(min(1.0, REACH / n), SEED).toPandas()
    if not len(some):
        return {}
    x, s = np.stack(some[column].to_list()), some["s"].to_numpy(float)
    mu, lv = mean[0] + x @ b, log_var[0] + x @ g
    grids, work = {}, []
    with np.errstate(all="ignore"):
        for name, at in places.items():
            a, left = _row_terms(s, mu, lv, np.stack([x[:, at] @ b[at], x[:, at] @ g[at]], axis=1))
            if (grid := Grid.over(a, left, there[name])) is not None and len(cells := grid.worth(a, left, n / len(s))):
                grids[name] = grid
                grid.places[cells] = np.arange(len(cells))
                work += [(name, i, cells[i:i + FILLED].tolist()) for i in range(0, len(cells), FILLED)]
    if not work:
        return {}

    def task(parts):
        for pdf in parts:
            for name, first, cells in pdf.itertuples(index=False):
                table, least = grids[name].fill(np.asarray(cells), there[name])
                yield pd.DataFrame({"name": [name], "first": [first], "table": [table.tobytes()], "least": [least.tobytes()]})

    tasks = min(len(work), 8 * spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame(work, "name string, first long, cells array<long>").repartition(tasks)
    done = rows.mapInPandas(task, "name string, first long, table binary, least binary").toPandas().sort_values(["name", "first"])
    for name, own in done.groupby("name"):
        grids[name].table = np.frombuffer(b"".join(own["table"])).reshape(-1, 2 * NODES[0] * NODES[1])
        grids[name].least = np.frombuffer(b"".join(own["least"]))
    return grids


def attribute_intensity(
    frames: DataFrame, column: str, mean: Sequence[float], log_var: Sequence[float], centres: np.ndarray,
    factors: Mapping[str, Sequence[int]], keys: Sequence[str] = ("event_id", "target_id", "k"), grids: Mapping[str, Grid] | None = None,
) -> DataFrame:
    """Per frame and factor: how much the intensity falls, on average over the reference points, when the factor's
    features take their reference values (eg_), and the deviation of that change (std_).

    column: an array of features; mean, log_var: intercept, then a weight per element; factors: the elements of each;
    grids: those of `factor_grids`, for many frames. A frame's memory does not depend on the number of points: a task
    holds an Arrow batch and arrays of ROWS x CENTRES."""
    b, g, places, there = _shares(mean, log_var, centres, factors)
    grids = grids or {}
    rows = max(ROWS, ROWS * CENTRES // max(len(centres), 1))  # few points are compared with more rows at a time
    if grids:
        rows = max(rows, 2048)
    types = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["intensity double"]
                       + [f"eg_{c} double, std_{c} double" for c in places])

    def task(batches):
        for pdf in batches:
            for i in range(0, len(pdf), rows):
                part = pdf.iloc[i:i + rows]
                x, s = np.stack(part[column].to_list()), part["s"].to_numpy(float)
                mu, lv = mean[0] + x @ b, log_var[0] + x @ g
                base = _np_intensity(s, mu, lv)
                out = {**{k: part[k] for k in keys}, "intensity": base}
                for name, at in places.items():
                    own = np.stack([x[:, at] @ b[at], x[:, at] @ g[at]], axis=1)
                    out[f"eg_{name}"], out[f"std_{name}"] = falls(s, mu, lv, base, own, there[name], *([grids[name]] if name in grids else []))
                yield pd.DataFrame(out)

    return frames.select(*keys, "s", column).mapInPandas(task, schema)
