"""Language ID by rank-order profiles of character n-grams (one to three letters, word edges marked).

A profile ranks a language's most frequent n-grams over all its training rows; a document's ranking is compared
with each by the out-of-place distance, and the nearest language wins, ties by name. Null texts and texts without
a letter are `und` with score 0. Texts are read whole, long ones in slices of words. With nothing to learn from, every
text is `und`. Repeated rows each give their own row; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from nearmiss.llm.common import cut_lineage, documents, fold, keep_rows, small_batches

PROFILE = 300
#: Of the misfit limit; fewer known texts than FEW give none.
MARGIN, SPREADS, FEW = 0.05, 6, 20
#: Words whose n-grams are sorted at a time: a long text takes no more memory than this many words do.
SLICE = 20_000
_WORD = re.compile(r"[^\W\d_]+")
_EDGE = ord("_")


def gram_counts(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of counted words, sorted by code: 21 bits a letter from the left, so that codes
    sort as the n-grams do. Words stand in one row with an edge between them; an n-gram with an edge inside is none."""
    every, parts = words.elements(), []
    while some := list(islice(every, SLICE)):
        c = np.frombuffer(("_" + "_".join(some) + "_").encode("utf-32-le"), "<u4").astype(np.int64)
        inner = c != _EDGE
        double = (c[:-1] << 42) | (c[1:] << 21)
        triple = (double[:-1] | c[2:])[inner[1:-1]]
        parts.append(np.unique(np.concatenate([c[inner] << 42, double, triple]), return_counts=True))
    return added(parts)


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the same codes added up."""
    if len(parts) == 1:
        return parts[0]
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    total = np.zeros(len(codes), np.int64)
    np.add.at(total, at, np.concatenate([n for _, n in parts]))
    return codes, total


def ranked(words: Counter, size: int) -> np.ndarray:
    """Codes of the most frequent n-grams, the most frequent first, ties by the n-gram."""
    codes, counts = gram_counts(words)
    if len(codes) > size:  # only what can be among the first is put in order
        some = counts >= np.partition(counts, -size)[-size]
        codes, counts = codes[some], counts[some]
    return codes[np.argsort(-counts, kind="stable")[:size]]


def words_of(text: str | None) -> Counter:
    found = Counter(_WORD.findall((text or "").lower()))
    for w in [w for w in found if not (w.isalpha() or any(map(str.isalpha, w)))]:
        del found[w]
    return found


def profiles(train: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's ranked n-grams from all rows of `train` (text, lang). At most `size` rows a language
    reach the driver."""
    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            by = defaultdict(list)
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                if words := words_of(text):
                    by[lang].append(gram_counts(words))
            for lang, parts in by.items():
                codes, n = added(parts)
                yield pd.DataFrame({"lang": lang, "gram": codes, "n": n})

    small_batches(train.sparkSession)
    counted = (train.select("text", "lang").mapInPandas(tally, "lang string, gram long, n long")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = (counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
            .select("lang", "rank", "gram").collect())
    out = defaultdict(list)
    for lang, _, gram in sorted(rows):
        out[lang].append(gram)
    return {lang: np.array(g, np.int64) for lang, g in sorted(out.items())}


def judged(learned: dict[str, np.ndarray], size: int = PROFILE):
    """A function of texts that gives language, score and misfit of each."""
    names = list(learned)
    every = np.unique(np.concatenate([*learned.values(), np.zeros(0, np.int64)]))
    ranks = np.full((len(names), len(every) + 1), -1, np.int64)  # the last column: n-grams of no profile
    for k, g in enumerate(learned.values()):
        ranks[k, np.searchsorted(every, g)] = np.arange(len(g))

    def judge(texts) -> list[tuple[str, float, float]]:
        out = []
        for text in texts:
            words = words_of(text)
            if not words or not names:
                out.append(("und", 0.0, 1.0))
                continue
            mine = ranked(words, size)
            at = np.searchsorted(every, mine)
            at[(at == len(every)) | (every[np.minimum(at, len(every) - 1)] != mine)] = len(every)
            theirs = ranks[:, at]
            far = np.where(theirs < 0, size, np.minimum(np.abs(theirs - np.arange(len(mine))), size)).sum(axis=1)
            best = int(far.argmin())
            rest = np.delete(far, best)
            second = int(rest.min()) if len(rest) else len(mine) * size
            out.append((names[best], second / max(second + int(far[best]), 1), far[best] / (len(mine) * size)))
        return out

    return judge


def identify(docs: DataFrame, learned: dict[str, np.ndarray], size: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred, score (second nearest distance over the sum of the two nearest) and misfit (mean
    out-of-place distance to the nearest profile over the largest one) of rows with doc_id, held_out and text."""
    judge = judged(learned, size)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = pd.DataFrame(judge(batch["text"]), columns=["lang_pred", "score", "misfit"])
            yield pd.concat([batch.drop(columns="text").reset_index(drop=True), said], axis=1)

    return docs.mapInPandas(work, "doc_id long, held_out boolean, lang_pred string, score double, misfit double")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 3) != 1))


def language_id(docs: DataFrame) -> DataFrame:
    learned = profiles(training_rows(docs))
    slim = docs.select(F.col("doc_id").cast("long"), (fold("doc_id", 3) == 1).alias("held_out"),
                       F.col("text").cast("string"))
    return identify(slim, learned)


def with_verdict(docs: DataFrame, learned: dict[str, np.ndarray], names: tuple[str, str]) -> DataFrame:
    """The documents with the language and the misfit of each text under the given names."""
    judge = judged(learned)
    schema = StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    at = docs.columns.index("text")

    def work(batches):
        for batch in batches:
            said = judge(batch.column(at).to_pylist())
            columns = [*batch.columns, pa.array([x[0] for x in said], pa.string()), pa.array([x[2] for x in said], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(work, schema)


def misfit_limit(judged_docs: DataFrame, names: tuple[str, str]) -> float:
    """The largest misfit of all rows with a known language plus MARGIN, so that none of them goes; at most SPREADS
    deviations above their mean, so that a few rows with a wrong language do not lift it to where anything passes.
    1, which lets every text with a letter pass, when too few rows are known to tell."""
    pred, misfit = names
    known = judged_docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col(pred) != "und"))
    n, largest, mean, spread = known.agg(F.count(F.lit(1)), F.max(misfit), F.avg(misfit), F.stddev_samp(misfit)).first()
    return min(largest + MARGIN, mean + SPREADS * spread) if n >= FEW else 1.0


def keep_known(docs: DataFrame) -> DataFrame:
    """Documents in a learned language: texts without a letter go, and texts that fit no profile as well as texts of
    known language do. When no language could be learned, all texts with a letter stay. Texts are judged once and
    stored with what was found; extra columns are kept, whatever their names."""
    learned = profiles(training_rows(docs))
    if not learned:
        return keep_rows(docs, lambda texts: [bool(words_of(t)) for t in texts])
    names = tuple(next(n for i in count() if (n := f"{name}_{i}") not in docs.columns) for name in ("pred", "misfit"))
    stored = cut_lineage(with_verdict(docs, learned, names), "judged")
    limit = misfit_limit(stored, names)
    return stored.where((F.col(names[0]) != "und") & (F.col(names[1]) <= limit)).drop(*names)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))
