"""Quality rules: an isolation forest on rule statistics.

Word, line and symbol statistics of the whole text feed the hard rules (the base) and, as distances from the
range usual among good rows, the forest. Each tree splits a random subsample at random values; the mean path
length tells how isolated a document is. Ranges and trees are fitted on at most `fit_rows` labelled rows taken by hash order, and its threshold on the scores of all
labelled rows: the score that gains most rejected bad rows against `price` times the rejected good rows. Null
texts have no words and fail the base. Without labels only the base rejects. Repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmiss.llm.common import cut_lineage, documents, keep_rows, labels, small_batches

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS, SPACE = b"#*$%&|<>", b" \t\n\v\f\r"
FEATURES = ("word_length", "symbol_share", "upper_share", "mark_share", "digit_share", "dup_share", "repeat_share")
STATS = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
         + ", ".join(f"{f} double" for f in FEATURES))


def repeated_words(words: list) -> int:
    """Words inside a three-word window that is found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    windows = pairs[:-1] * np.int64(len(number)) + ids[2:]
    _, back, count = np.unique(windows, return_inverse=True, return_counts=True)
    twice = count[back] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= twice
    return int(covered.sum())


def statistics(doc_id: int, text: str) -> tuple:
    raw = text.encode()
    words = raw.split()  # bytes split at ASCII white space alone
    n, dense = len(words), raw.translate(None, SPACE)
    chars = len(text) - (len(raw) - len(dense))
    symbols = len(dense) - len(dense.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    upper = sum(map(text.count, UPPER)) if text.isascii() else sum(map(str.isupper, text))
    marks = len(dense) - len(dense.translate(None, b"!?.,;:"))
    digits = len(dense) - len(dense.translate(None, b"0123456789"))
    each = max(chars, 1)
    return (doc_id, n, chars, symbols, dup, repeat, chars / max(n, 1), symbols / each, upper / each, marks / each,
            digits / each, dup / max(len(lines), 1), repeat / max(n, 1))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def rule_statistics(docs: DataFrame) -> DataFrame:
    names = [f.split()[0] for f in STATS.split(", ")]
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [statistics(i, t or "") for i, t in zip(batch["doc_id"], batch["text"], strict=True)]
            yield pd.DataFrame(rows, columns=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(work, STATS)


def base_failed() -> F.Column:
    return ((F.col("n_words") < MIN_WORDS)
            | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words")))


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1),
                    np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays: feature (-1 for a leaf), value, left child (right is the next), path at a leaf."""
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    sample: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """0.5 is usual; near 1 is isolated."""
        total = np.zeros(len(x))
        for feature, value, left, path in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = np.flatnonzero(feature[at] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                at[inner] = left[node] + (x[inner, feature[node]] >= value[node])
            total += path[at]
        return 2.0 ** (-total / max(len(self.trees), 1) / max(float(mean_path(self.sample)), 1e-9))


def grow(x: np.ndarray, trees: int, sample: int, seed: int) -> Forest:
    rng, out = np.random.default_rng(seed), []
    sample = min(sample, len(x))
    deepest = int(np.ceil(np.log2(max(sample, 2))))
    for _ in range(trees if sample else 0):
        nodes: list[list] = [[-1, 0.0, 0, 0.0]]
        todo = [(0, x[rng.choice(len(x), sample, replace=False)], 0)]
        while todo:
            at, rows, depth = todo.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            able = np.flatnonzero(high > low)
            if depth >= deepest or len(rows) < 2 or not len(able):
                nodes[at][3] = depth + float(mean_path(len(rows)))
                continue
            f = int(rng.choice(able))
            v = rng.uniform(low[f], high[f])
            right = rows[:, f] >= v
            nodes[at][:3] = [f, v, len(nodes)]
            todo += [(len(nodes), rows[~right], depth + 1), (len(nodes) + 1, rows[right], depth + 1)]
            nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
        cols = list(zip(*nodes, strict=True))
        out.append((np.array(cols[0]), np.array(cols[1]), np.array(cols[2]), np.array(cols[3])))
    return Forest(out, sample)


@dataclass
class Rules:
    """The usual range of each statistic among good rows. What counts is how far a row lies outside."""
    low: np.ndarray
    high: np.ndarray

    def violations(self, x: np.ndarray) -> np.ndarray:
        outside = np.maximum(np.maximum(self.low - x, x - self.high), 0)
        return np.log1p(outside / np.maximum(self.high - self.low, 0.01))


def usual(good: np.ndarray, tail: float = 0.0) -> Rules:
    if not len(good):
        return Rules(np.full(len(FEATURES), -np.inf), np.full(len(FEATURES), np.inf))
    return Rules(np.quantile(good, tail, axis=0), np.quantile(good, 1 - tail, axis=0))


def score(stats: DataFrame, made: Verdict) -> DataFrame:
    sent = stats.sparkSession.sparkContext.broadcast(made)  # trees x 2 x sample nodes at most

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(score=sent.value.scores(batch[list(FEATURES)].to_numpy(float)))

    return stats.mapInPandas(work, STATS + ", score double")


@dataclass
class Verdict:
    rules: Rules
    forest: Forest
    threshold: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.forest.score(self.rules.violations(features))


def learn(stats: DataFrame, marks: DataFrame, fit_rows: int = 8192, trees: int = 100, sample: int = 256,
          price: float = 20.0, seed: int = 7) -> Verdict:
    """Fits ranges, forest and threshold on the labelled rows among stored statistics."""
    marks = (marks.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("good"))
             .where(F.col("good").isNotNull()).groupBy("doc_id").agg(F.max("good").alias("good")))
    known = stats.where(~base_failed()).join(marks, "doc_id")
    # the bounded, labelled sample that ranges and trees are fitted on
    rows = (known.select(*FEATURES, "good", F.xxhash64(F.lit(seed), "doc_id").alias("h"))
            .orderBy("h", *FEATURES).limit(fit_rows).drop("h").toPandas())
    values, good = rows[list(FEATURES)].to_numpy(float), rows["good"].to_numpy() == 1
    rules = usual(values[good])
    made = Verdict(rules, grow(rules.violations(values), trees, sample, seed), 2.0)
    # all labelled rows, counted in a thousand score steps
    steps = (score(known.drop("good"), made).join(marks, "doc_id").groupBy(F.floor(F.col("score") * 1000).alias("step"))
             .agg(F.sum(F.col("good")).alias("good"), F.sum(1 - F.col("good")).alias("bad")).orderBy(F.desc("step")).collect())
    best, gain = 0.0, 0.0
    for r in steps:
        gain += r["bad"] - price * r["good"]
        if gain > best:
            made.threshold, best = r["step"] / 1000, gain
    return made


def quality(docs: DataFrame, marks: DataFrame, **options) -> DataFrame:
    """doc_id, the base statistics, base_failed, score, threshold and kept, one row per document."""
    stats = cut_lineage(rule_statistics(docs), "rules")
    made = learn(stats, marks, **options)
    failed = base_failed()
    return score(stats, made).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("score") < made.threshold)).alias("kept"), "score", F.lit(made.threshold).alias("threshold"))


def keep_good(docs: DataFrame, marks: DataFrame, **options) -> DataFrame:
    """The documents whose text passes. The verdict depends on the text alone, so it is taken where the text is
    read, and texts do not move."""
    made = learn(cut_lineage(rule_statistics(docs), "rules"), marks, **options)

    def decide(texts: list) -> np.ndarray:
        rows = [statistics(0, t or "") for t in texts]
        if not rows:
            return np.zeros(0, bool)
        failed = np.array([r[1] < MIN_WORDS or 100 * r[5] > MAX_REPEAT_PERCENT * r[1] for r in rows])
        return ~failed & (made.scores(np.array([r[6:] for r in rows], float)) < made.threshold)

    return keep_rows(docs, decide)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), labels(spark, sf_dir))
