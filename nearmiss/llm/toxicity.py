"""Toxicity through a noisy channel: obfuscated words are restored before they are scored.

A character trigram model counts the letters of all documents. A suspicious word (digits or signs among letters,
a letter twice or more in a row, single letters with gaps) becomes a lattice: a sign may stand for letters, a run for
one or two letters, a gap of one sign or more for nothing or a blank, signs at the end for nothing. Viterbi decoding
takes the path with the best product of model and channel; what it gives is split into words.
The restored words, and the beginnings of long ones, of at most `fit_rows` labelled training rows, taken by hash order,
each weigh their smoothed log-odds times how much their counts raise the chance that the word differs between the labels,
so rare words shrink and no number of documents is a threshold; a document's evidence is the sum over its distinct words.
A logistic curve turns it into the score; it is fitted on the same rows, each without its own share of the counts.

Null, empty and wordless texts have evidence 0 and the score of that. With no labels every score is 0. Whole
texts are read; repeated rows each give a row.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmiss.llm.common import CACHE_ENTRIES, cut_lineage, documents, fold, labels

#: What a sign may stand for.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a",
         "$": "s", "!": "i", "+": "t", "|": "il", "€": "e", "*": "aeiou"}
GAPS = " .-_*"
#: Signs at a word's end that may also stand for nothing.
CLOSING = "$@+€"
SIGN_COST, RUN_COST, DOUBLE_COST, GAP_COST = math.log(0.4), math.log(0.9), math.log(0.1), math.log(0.5)
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))
SIZE = 64  # 0: a word's edge; 1 to 58: the letters; 63: any other letter
NUMBER = {c: i + 1 for i, c in enumerate(LETTERS)} | {" ": 0}
_TABLE = np.zeros(0x300, np.int64)
for _c, _i in NUMBER.items():
    _TABLE[ord(_c)] = _i
SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_]|[0-9@$!])(?:[ .*_-]+[^\W_]|[ .*_-]+[@$!]){2,}(?![^\W_])")
TOKEN = re.compile(r"[^\s]+")
EDGE = "\"'(),.:;?!*&%#|[]{}<>-_=/\\~`"
#: Signs that start no word; others may stand for its first letter.
OPENING = "".join(c for c in EDGE if c not in SIGNS)
#: Parts of texts whose features a worker keeps; a full table takes no more, results never depend on it.
TOKEN_ENTRIES = 200_000
STEM = 5  # letters of a word's beginning
_SUSPECT = re.compile(r"(?=.*[^\W\d_])(?:.*[^\W\d_][.*_-]+[^\W_].*|.*[0-9@$!+|€*].*|.*([^\W\d_])\1.*)")


def letter_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts of all documents; a task sends the trigrams it has seen."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SIZE ** 3, np.int64)
        for batch in batches:
            for text in batch["text"]:
                c = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
                n = np.zeros(len(c) + 4, np.int64)
                low = c < len(_TABLE)
                n[2:-2][low] = _TABLE[c[low]]
                total += np.bincount((n[:-2] << 12) | (n[1:-1] << 6) | n[2:], minlength=SIZE ** 3)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at, "n": total[at]})

    rows = (docs.select(F.col("text").cast("string")).mapInPandas(work, "gram long, n long")
            .groupBy("gram").agg(F.sum("n").alias("n")).collect())  # 64^3 rows at most
    out = np.zeros(SIZE ** 3)
    for gram, n in rows:
        out[gram] = n
    return out


def trigram_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b): trigrams backed by bigrams and single letters."""
    tri = counts.reshape(SIZE, SIZE, SIZE)
    two, one = tri.sum(axis=0), tri.sum(axis=(0, 1))
    base = (one + 1) / (one.sum() + SIZE)
    bigram = (two + 4 * base) / (two.sum(axis=1, keepdims=True) + 4)
    return np.log((tri + 4 * bigram) / (tri.sum(axis=2, keepdims=True) + 4))


_DECODED: dict[int, tuple[dict[str, str], dict[str, tuple[str, ...]], list[float]]] = {}


@dataclass
class Decoder:
    model: np.ndarray

    def __post_init__(self):
        # what a worker has decoded serves every pass under the same model
        mark = zlib.crc32(self.model.tobytes())
        if mark not in _DECODED:
            _DECODED.clear()
            _DECODED[mark] = {}, {}, self.model.ravel().tolist()
        self.known, self.tokens, self.flat = _DECODED[mark]

    def __reduce__(self):
        return Decoder, (self.model,)

    def lattice(self, word: str) -> list[list[tuple[str, float]]]:
        """For each step the strings it may stand for, with the channel's log probability."""
        steps, i = [], 0
        while i < len(word):
            c, j = word[i], i + 1
            if c in GAPS:
                while j < len(word) and word[j] in GAPS:
                    j += 1
                options = [("", GAP_COST), (" ", GAP_COST)]
                if word[i:j].strip(" ") == "*" * (j - i):
                    options += [(v * k, SIGN_COST) for v in SIGNS["*"] for k in {1, min(j - i, 2)}]
                steps.append(options)
                i = j
                continue
            while j < len(word) and word[j] == c:
                j += 1
            if c in NUMBER or c.isalpha():
                if j - i >= 3:
                    steps.append([(c, RUN_COST), (c + c, DOUBLE_COST)])
                elif j - i == 2:
                    steps.append([(c + c, RUN_COST), (c, DOUBLE_COST)])
                elif steps and len(steps[-1]) == 1:  # letters that stand for themselves make one step
                    steps[-1] = [(steps[-1][0][0] + c, steps[-1][0][1])]
                else:
                    steps.append([(c, 0.0)])
            else:
                options = [(s * k, SIGN_COST) for s in SIGNS.get(c, "") for k in sorted({1, min(j - i, 2)})]
                if c in CLOSING and j == len(word):
                    options.append(("", GAP_COST))
                steps.append(options or [("", math.log(0.01))])
            i = j
        return steps

    def decode(self, word: str) -> str:
        known = self.known.get(word)
        if known is not None:
            return known
        flat, number = self.flat, NUMBER.get
        states = {(0, 0): (0.0, None)}  # the last two letters to score and path
        for step in self.lattice(word):
            after: dict = {}
            for (a, b), (score, path) in states.items():
                for said, cost in step:
                    x, y, total = a, b, score + cost
                    for c in said:
                        n = number(c, SIZE - 1)
                        total += flat[x << 12 | y << 6 | n]
                        x, y = y, n
                    old = after.get((x, y))
                    if old is None or total > old[0]:
                        after[(x, y)] = total, (path, said)
            states = after
        (_, _), (_, path) = max(states.items(), key=lambda s: s[1][0] + flat[s[0][0] << 12 | s[0][1] << 6])
        said = []
        while path is not None:
            path, part = path
            said.append(part)
        out = "".join(reversed(said))
        if len(word) < 100:
            if len(self.known) > CACHE_ENTRIES:
                self.known.clear()
            self.known[word] = out
        return out

    def token(self, word: str) -> list[str]:
        """The restored words of a text's part without blanks."""
        core = word.rstrip(EDGE).lstrip(OPENING)
        if core.isalpha() and core.isascii() and not _RUN.search(core):
            return [core]
        if core in self.known or (_SUSPECT.fullmatch(core) and not core.isdigit()):
            return self.decode(core).split()
        return [core] if core else []

    def parts(self, text: str | None) -> tuple[set[str], set[str]]:
        """Words restored from single letters with gaps, and the distinct other parts of the text."""
        spaced: set[str] = set()

        def gone(found: re.Match) -> str:
            spaced.update(self.decode(found[0]).split())
            return " "

        rest = SPACED.sub(gone, (text or "").lower())
        return spaced, set(rest.split())

    def words(self, text: str | None) -> set[str]:
        """Distinct words of the restored text."""
        out, tokens = self.parts(text)
        for word in tokens:
            out.update(self.token(word))
        return out

    def features(self, text: str | None) -> set[str]:
        """The distinct words and the beginnings of longer ones, which stand for a word with any ending."""
        spaced, tokens = self.parts(text)
        out = set(with_beginnings(spaced))
        for word in tokens:
            own = self.tokens.get(word)
            if own is None:
                own = with_beginnings(self.token(word))
                if len(word) < 100 and len(self.tokens) < TOKEN_ENTRIES:
                    self.tokens[word] = own
            out.update(own)
        return out


def with_beginnings(words: Iterable[str]) -> tuple[str, ...]:
    return (*words, *("^" + w[:STEM] for w in words if len(w) > STEM))


_RUN = re.compile(r"(.)\1")
#: Chance, before any count, that a word differs between the labels.
DIFFER = 0.01


def weight(clean: int, toxic: int, share: float) -> float:
    """Log-odds of a word in `clean` and `toxic` documents against the toxic `share` of all, times the rise of the
    chance that it differs between the labels over DIFFER. The counts are beta-binomial if it does, binomial if not;
    a single document tells nothing, so its words weigh 0."""
    if min(clean, toxic) < 0 or clean + toxic < 2:
        return 0.0
    factor = (math.lgamma(toxic + share) - math.lgamma(share) + math.lgamma(clean + 1 - share) - math.lgamma(1 - share)
              - math.lgamma(clean + toxic + 1) - toxic * math.log(share) - clean * math.log(1 - share))
    chance = 1 / (1 + math.exp(-max(-60.0, min(60.0, factor + math.log(DIFFER / (1 - DIFFER))))))
    odds = math.log((toxic + share) / (clean + 1 - share)) - math.log(share / (1 - share))
    return max(0.0, (chance - DIFFER) / (1 - DIFFER)) * odds


@dataclass
class Model:
    decoder: Decoder
    words: dict[str, int]  # the place of a word's counts in the weights
    weights: list[tuple[float, float, float]]  # by all rows, by all but a clean one with the word, but a toxic one
    slope: float = 1.0
    shift: float = -60.0

    def evidence(self, text: str | None, left_out: int | None = None) -> float:
        """left_out: the label of a fitted row, whose own count then does not weigh."""
        k = 0 if left_out is None else 1 + left_out
        found = map(self.words.get, self.decoder.features(text))
        return math.fsum(self.weights[at][k] for at in found if at is not None)

    def score(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.slope * evidence + self.shift))))


def curve(evidence: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton's method with a small ridge."""
    if not len(label) or label.min() == label.max():
        return 0.0, (60.0 if len(label) and label[0] else -60.0)
    beta, x = np.zeros(2), np.stack([evidence, np.ones(len(evidence))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (label - p) - 1e-2 * beta)
        beta += step
        if abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def learn(docs: DataFrame, marks: DataFrame, fit_rows: int = 20_000, seed: int = 11) -> Model:
    """Fits on labelled rows outside the held-out fold alone. The words with a weight reach the driver, and one
    evidence and label a fitted row."""
    spark = docs.sparkSession
    decoder = Decoder(trigram_model(letter_counts(docs)))
    chosen = (marks.where((fold("doc_id", 5) != 0) & F.col("toxic").isNotNull())
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
              .orderBy(F.xxhash64(F.lit(seed), "doc_id")).limit(fit_rows))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    sent = spark.sparkContext.broadcast(decoder)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by, seen = defaultdict(lambda: [0, 0]), [0, 0]
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                seen[int(toxic)] += 1
                for w in sent.value.features(text):
                    by[w][int(toxic)] += 1
        # the empty word carries the number of documents
        yield pd.DataFrame([("", *seen), *((w, *n) for w, n in by.items())], columns=["word", "clean", "toxic"])

    counted = cut_lineage(rows.mapInPandas(count, "word string, clean long, toxic long")
                          .groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "words")
    both = counted.where("word = ''").first()
    if both is None or not both["toxic"] or not both["clean"]:
        label = 1.0 if both is not None and both["toxic"] else 0.0
        return Model(decoder, {}, [], 0.0, 60.0 if label else -60.0)
    share = both["toxic"] / (both["toxic"] + both["clean"])

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = lru_cache(maxsize=CACHE_ENTRIES)(lambda c, t: (weight(c, t, share), weight(c - 1, t, share),
                                                              weight(c, t - 1, share)))
        for batch in batches:
            three = [known(c, t) for c, t in zip(batch["clean"], batch["toxic"], strict=True)]
            yield batch.assign(some=[any(w) for w in three])

    kept = (counted.where("word != '' and clean + toxic > 1")
            .mapInPandas(weigh, "word string, clean long, toxic long, some boolean").where("some").collect())
    place: dict[tuple[int, int], int] = {}
    words = {r["word"]: place.setdefault((r["clean"], r["toxic"]), len(place)) for r in kept}
    model = Model(decoder, words, [(weight(c, t, share), weight(c - 1, t, share), weight(c, t - 1, share)) for c, t in place])
    tried = with_evidence(rows, model, left_out="toxic").select("evidence", "toxic").toPandas()  # fit_rows rows at most by id
    model.slope, model.shift = curve(tried["evidence"].to_numpy(float), tried["toxic"].to_numpy(float))
    return model


def with_evidence(rows: DataFrame, model: Model, left_out: str | None = None) -> DataFrame:
    """The rows without their text, with evidence and score. left_out: the column with a fitted row's own label."""
    sent = rows.sparkSession.sparkContext.broadcast(model)  # the words with a weight and 64^3 numbers
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for batch in batches:
            own = batch[left_out] if left_out else [None] * len(batch)
            evidence = [model.evidence(t, k) for t, k in zip(batch["text"], own, strict=True)]
            yield batch.drop(columns="text").assign(evidence=np.array(evidence, float),
                                                    score=np.array([model.score(e) for e in evidence], float))

    return rows.mapInPandas(work, schema + ", evidence double, score double")


def toxicity(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence."""
    rows = docs.select(F.col("doc_id").cast("long"), (fold("doc_id", 5) == 0).alias("held_out"),
                       F.col("text").cast("string"))
    return with_evidence(rows, learn(docs, marks)).select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), labels(spark, sf_dir))
