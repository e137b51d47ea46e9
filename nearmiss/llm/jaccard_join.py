"""N-gram Jaccard join with Bayesian candidate pruning.

A text is its set of five-word shingles (all its words where it has one to four; none where it has none). Rows
with equal sets are one class. MinHash bands retrieve candidate classes; within a block of candidates the MinHash
values are compared 16 at a time, and a pair is dropped once the posterior probability that its Jaccard similarity
reaches the threshold falls below the tolerance. The pairs that are left are verified exactly on their shingles.

Candidates are grouped by the components of their shared bands; a large group is split into blocks, and every
pair of blocks is a task of its own. A task returns counts of links and a spanning forest, never all pairs.
The result has one row per document: its class (smallest doc_id of equal sets), the links of that class to other
classes, and the component (smallest doc_id) that the links join. Null, empty and blank texts share no class and
have no links. Repeated rows share a class. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmiss.llm.common import CACHE_ENTRIES, cut_lineage, documents
from nearmiss.session import drop_tables, tables_written

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
#: 32 bands of 4 values: a pair at 0.8 shares a band with a probability of 1 - 5e-8.
BANDS, PER_BAND, STEP = 32, 4, 16
VALUES = BANDS * PER_BAND
BLOCK = 256

_rng = np.random.default_rng(20240229)
_MULTIPLY = (_rng.integers(0, 1 << 32, VALUES, dtype=np.uint64) | 1).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32)
_words: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: a bijection whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_codes(words: list[bytes]) -> np.ndarray:
    import xxhash

    if len(_words) > CACHE_ENTRIES:
        _words.clear()
    fresh = [w for w in dict.fromkeys(words) if w not in _words]
    _words.update((w, xxhash.xxh64_intdigest(w)) for w in fresh)
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit codes of the text's distinct shingles."""
    words = (text or "").encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    c = word_codes(words)
    n = max(1, len(c) - WORDS + 1)
    code = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(c))):
        code = mix(code + c[k:k + n] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(code)


def signature(codes: np.ndarray) -> np.ndarray:
    x = (codes >> np.uint64(32)).astype(np.uint32) ^ codes.astype(np.uint32)
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        part = x[i:i + 4096]
        for a in range(0, VALUES, 32):
            values = part[None, :] * _MULTIPLY[a:a + 32, None] + _ADD[a:a + 32, None]
            values ^= values >> np.uint32(15)
            values *= np.uint32(0x2C1B3C6D)
            values ^= values >> np.uint32(12)
            np.minimum(out[a:a + 32], values.min(axis=1), out=out[a:a + 32])
    return out


def least_matches(tolerance: float = TOLERANCE, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """(n, m): after n compared values, a pair with fewer than m equal ones is dropped. Under a uniform prior the
    similarity's posterior is Beta(m + 1, n - m + 1); its upper tail at the threshold is a binomial sum."""
    def tail(m: int, n: int) -> float:
        return sum(math.comb(n + 1, j) * threshold ** j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))

    return [(n, next(m for m in range(n + 1) if tail(m, n) >= tolerance)) for n in range(STEP, VALUES + 1, STEP)]


LEAST = least_matches()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, set_hash (null without words) and values, the MinHash values."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            sets = [shingles(t) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                "set_hash": [xxhash.xxh128_hexdigest(s.tobytes()) if len(s) else None for s in sets],
                "values": [signature(s).astype("<u4").tobytes() if len(s) else None for s in sets]})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(
        work, "doc_id long, set_hash string, values binary")


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, component (smallest node reached) of an undirected graph of edges (a, b). Every round links each
    node's neighbours to the smallest of them, first towards larger and then towards smaller nodes, until nothing
    changes; neighbours are never gathered, and each round is a stored table."""
    def star(e: DataFrame, larger: bool) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else e
        # of the neighbours and the node itself, the smallest; counted before the shuffle
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        joined = both.join(low, "a")
        if larger:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        moved = joined.where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        return moved.union(low.where("a != low").select("a", F.col("low").alias("b"))).distinct()

    # an edge points from the larger node to the smaller one
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    now = cut_lineage(now, name)
    mark = None
    while True:
        last, now = now, cut_lineage(star(star(now, True), False), name)
        drop_tables(edges.sparkSession, last)
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(seen) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = tuple(seen)


def intersections(sets_a: list[np.ndarray], sets_b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the common parts of every set of a with every set of b, over columns of shared shingles."""
    flat_a, flat_b = np.concatenate(sets_a), np.concatenate(sets_b)
    shared = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(sets_a), len(sets_b)), np.float32)

    def cells(sets, flat):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(shared, flat)
        good = at < len(shared)
        good[good] = shared[at[good]] == flat[good]
        order = np.argsort(at[good], kind="stable")
        return row[good][order], at[good][order]

    (ra, ca), (rb, cb) = cells(sets_a, flat_a), cells(sets_b, flat_b)
    for low in range(0, len(shared), 8192):
        high = min(low + 8192, len(shared))
        a, b = (np.zeros((len(s), high - low), np.float32) for s in (sets_a, sets_b))
        for m, r, c in ((a, ra, ca), (b, rb, cb)):
            i, j = np.searchsorted(c, [low, high])
            m[r[i:j], c[i:j] - low] = 1
        out += a @ b.T
    return out


def candidates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs that the comparison of MinHash values leaves, as a matrix of booleans."""
    alive = np.ones((len(a), len(b)), bool)
    same = np.zeros((len(a), len(b)), np.int16)
    for (n, least), first in zip(LEAST, range(0, VALUES, STEP), strict=True):
        if alive.mean() > 0.05:
            for k in range(first, n):
                same += a[:, k, None] == b[None, :, k]
        else:
            i, j = np.nonzero(alive)
            same[i, j] += (a[i, first:n] == b[j, first:n]).sum(axis=1, dtype=np.int16)
        alive &= same >= least
    return alive


def link_block(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the linked pairs of two blocks."""
    va, vb = (np.stack([np.frombuffer(v, "<u4") for v in x["values"]]) for x in (a, b))
    alive = candidates(va, vb)
    if same:
        alive = np.triu(alive, 1)
    i, j = np.nonzero(alive)
    if not len(i):
        return i, j
    used_a, used_b = np.unique(i), np.unique(j)
    sa = [np.frombuffer(x, "<u8") for x in a["codes"].iloc[used_a]]
    sb = [np.frombuffer(x, "<u8") for x in b["codes"].iloc[used_b]]
    common = intersections(sa, sb)[np.searchsorted(used_a, i), np.searchsorted(used_b, j)].astype(np.int64)
    na, nb = (np.array([len(x) // 8 for x in y["codes"]]) for y in (a, b))
    union = na[i] + nb[j] - common
    good = 5 * common >= 4 * union  # 0.8 in whole numbers
    return i[good], j[good]


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest, without cycles."""
    root: dict[int, int] = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (rx := find(x)) != (ry := find(y)):
            root[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def links(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """members (doc_id, set_hash, class_id), counts (class_id, n_links) and joins (a, b: class ids that a
    spanning forest of the links joins)."""
    sketch = cut_lineage(sketches(docs), "sketches")
    # one row of each set goes on: its smallest id; a null id only where there is no other
    low = sketch.where("set_hash is not null").groupBy("set_hash").agg(F.min("doc_id").alias("class_id"))
    low = cut_lineage(low, "classes")
    # the values of equal sets are equal: any row's do
    unique = sketch.where("set_hash is not null").groupBy("set_hash").agg(F.first("values").alias("values"))
    unique = cut_lineage(unique.withColumn("node", F.xxhash64("set_hash")), "unique")
    members = cut_lineage(sketch.select("doc_id", "set_hash"), "members")
    name = cut_lineage(unique.select("node", "set_hash").join(low, "set_hash").select("node", "class_id", "set_hash"), "names")
    # a table goes once all that is made from it stands
    drop_tables(docs.sparkSession, sketch)
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(
        k, F.substring(F.col("values"), k * F.lit(4 * PER_BAND) + 1, F.lit(4 * PER_BAND))))
    keys = unique.select("node", F.explode(bands).alias("band"))
    first = keys.groupBy("band").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    grouped = components(keys.join(first, "band").select(F.col("node").alias("a"), "b").where("a != b"), "groups")
    size = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    placed = grouped.join(size, "component").withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).withColumn(
        "block", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("blocks")).cast("int"))
    # shingles are computed for the members of groups only, from one row of each class
    member = unique.join(placed, "node").select("set_hash", "values", "node", "component", "blocks", "block")
    chosen = low.join(member, "set_hash")

    def add_codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                some = batch.iloc[i:i + 500]
                yield some.drop(columns="text").assign(codes=[shingles(t).astype("<u8").tobytes() for t in some["text"]])

    texts = docs.select(F.col("doc_id").cast("long").alias("class_id"), F.col("text").cast("string"))
    # rows that share an id may differ in text, so the set itself is checked again
    names = ["class_id", "set_hash", "values", "node", "component", "blocks", "block"]
    schema = ("class_id long, set_hash string, values binary, node long, component long, blocks int, block int, "
              "codes binary")
    holder = texts.join(chosen, texts["class_id"].eqNullSafe(chosen["class_id"])).drop(texts["class_id"])
    coded = holder.select(*names, "text").mapInPandas(add_codes, schema)
    hashed = coded.where(F.length("codes") > 0).withColumn("own", F.xxhash64("codes"))
    coded = cut_lineage(hashed.dropDuplicates(["node", "own"]), "codes")
    drop_tables(docs.sparkSession, unique, low)
    single = coded.where("blocks = 1").withColumn("part", F.lit("0")).withColumn("side", F.lit(0))
    # block i meets every block j >= i; a row goes to as many tasks as its group has blocks
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        F.concat_ws("-", F.least(k, F.col("block")), F.greatest(k, F.col("block"))).alias("part"),
        F.when(k < F.col("block"), 1).otherwise(0).alias("side")))
    split = (coded.where("blocks > 1").withColumn("pair", F.explode(pairs))
             .select(*coded.columns, F.col("pair.part").alias("part"), F.col("pair.side").alias("side")))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        sides = rows["part"].iloc[0].split("-")
        same = sides[0] == sides[-1]
        a, b = (rows, rows) if same else (rows[rows["side"] == 0], rows[rows["side"] == 1])
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        i, j = link_block(a, b, same)
        na, nb = a["node"].to_numpy()[i], b["node"].to_numpy()[j]
        node, n = np.unique(np.concatenate([na, nb]), return_counts=True)
        tree = forest(na, nb)
        return pd.concat([pd.DataFrame({"a": node, "b": node, "n": n}),
                          pd.DataFrame(tree, columns=["a", "b"], dtype="int64").assign(n=0)]).astype("int64")

    # small groups share tasks by Spark's hashing of the group's key
    found = single.unionByName(split).groupBy("component", "part").applyInPandas(compare, "a long, b long, n long")
    found = cut_lineage(found, "links")
    drop_tables(docs.sparkSession, coded)
    counts = (found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links")))
    classes = name.join(counts, "node", "left").select("node", "set_hash", "class_id",
                                                       F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return members, classes, found.where("a != b").select("a", "b")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links (to other classes), component_id (smallest doc_id that links reach)."""
    members, classes, joins = links(docs)
    part = components(joins, "linked")
    named = part.join(classes.select("node", "class_id"), "node")
    first = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    known = classes.join(part.join(first, "component").select("node", "component_id"), "node", "left").select(
        "set_hash", "class_id", "n_links", F.coalesce("component_id", "class_id").alias("component_id"))
    return members.join(known, "set_hash", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each linked component: the row with its smallest id, and of rows that share that id the
    first by text. Documents without words stay. A row's own number stands for its id, so ids may repeat or be
    null."""
    own = {c: f"row_{i}" for i, c in enumerate(docs.columns)}
    # the number is stored: a later read of the rows may split them anew. Each column is stored once
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items()))
    rows = cut_lineage(rows.withColumn("doc_id", F.monotonically_increasing_id()), "rows")
    text = F.col(own["text"]).cast("string").alias("text")
    before = len(tables_written())
    joined = cut_lineage(jaccard_join(rows.select("doc_id", text)), "joined")
    drop_tables(docs.sparkSession, *tables_written(before)[:-1])
    ids = rows.select("doc_id", F.col(own["doc_id"]).cast("long").alias("own_id")).join(joined, "doc_id")
    order = F.struct(F.col("own_id").isNull(), F.col("own_id"), F.col("doc_id"))
    best = ids.groupBy("component_id").agg(F.min(order).alias("best")).select(F.col("best.doc_id").alias("doc_id"))
    return rows.join(best, "doc_id", "left_semi").select(*(F.col(n).alias(c) for c, n in own.items()))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, r, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS sh
  FROM w),
k AS (SELECT doc_id, r, CASE WHEN len(sh) = 0 THEN 'none' || r ELSE sha256(array_to_string(list_sort(sh), '|')) END AS h,
             sh FROM s),
c AS MATERIALIZED (SELECT h, min(doc_id) AS class_id, any_value(sh) AS sh FROM k GROUP BY h),
e AS (SELECT h, len(sh) AS n, unnest(sh) AS g FROM c),
l AS MATERIALIZED (
  SELECT x.h AS a, y.h AS b FROM e x JOIN e y ON x.g = y.g AND x.h <> y.h
  GROUP BY x.h, y.h, x.n, y.n HAVING 5 * count(*) >= 4 * (x.n + y.n - count(*))),
reach AS (
  WITH RECURSIVE go(h, t) AS (SELECT h, h FROM c UNION SELECT go.h, l.b FROM go JOIN l ON go.t = l.a) SELECT * FROM go),
m AS (SELECT reach.h, min(c.class_id) AS component_id FROM reach JOIN c ON c.h = reach.t GROUP BY reach.h),
n AS (SELECT a AS h, count(*) AS n_links FROM l GROUP BY a)
SELECT k.doc_id, c.class_id, coalesce(n.n_links, 0) AS n_links, m.component_id
FROM k JOIN c USING (h) JOIN m USING (h) LEFT JOIN n USING (h)
"""
