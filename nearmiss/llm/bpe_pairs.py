"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a batch form one list of symbols. An index maps every adjacent pair to all its positions;
a heap gives the active ranks in ascending order; applying a rank merges its positions from left to right and
moves only the neighbouring pairs to their new lists. The normaliser is the library's own, words are cut by the
file's pattern, and special strings in a text become their ids before anything else, as the library does.
Decoding joins the tokens by blanks, which is what a file without a decoder asks for.

Null and empty texts have no ids and decode to an empty text. Repeated rows each give a row.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmiss.llm.common import CACHE_ENTRIES, byte_letters, documents, slices, tokenizer_path


def merge_words(words: list[list[int]], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[list[int]]:
    """Applies the merges (pair to rank and product) to all words at once."""
    symbol, right, left, ends = [], [], [], []
    for w in words:
        first = len(symbol)
        symbol += w
        left += [-1, *range(first, first + len(w) - 1)] if w else []
        right += [*range(first + 1, first + len(w)), -1] if w else []
        ends.append(len(symbol))
    places: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, j in enumerate(right):
        if j >= 0 and (pair := (symbol[i], symbol[j])) in ranks:
            places[pair].append(i)
    active = [(ranks[p][0], p) for p in places]
    heapq.heapify(active)
    while active:
        rank, pair = heapq.heappop(active)
        at = places.pop(pair, None)
        if at is None:
            continue
        a, b = pair
        made = ranks[pair][1]
        at.sort()
        waiting = []  # positions of a word in which an earlier rank became active meanwhile
        held = -1  # such a word ends before this position
        for i in at:
            j = right[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue
            if i < held:
                waiting.append(i)
                continue
            symbol[i], symbol[j] = made, -1
            after, before = right[j], left[i]
            right[i] = after
            if after >= 0:
                left[after] = i
            for x, y in ((before, i), (i, after)):
                if x < 0 or y < 0:
                    continue
                new = symbol[x], symbol[y]
                known = ranks.get(new)
                if known is None:
                    continue
                if new == pair:
                    waiting.append(x)
                    continue
                if new not in places:
                    heapq.heappush(active, (known[0], new))
                places[new].append(x)
                if known[0] < rank:
                    held = ends[_word_of(ends, i)]
        if waiting:
            places[pair] += waiting
            heapq.heappush(active, (rank, pair))
    out, first = [], 0
    for end in ends:
        out.append([s for s in symbol[first:end] if s >= 0])
        first = end
    return out


def _word_of(ends: list[int], i: int) -> int:
    from bisect import bisect_right

    return bisect_right(ends, i)


class PairEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.ranks = {}
        for k, (a, b) in enumerate(model["merges"]):
            self.ranks[(self.vocab[a], self.vocab[b])] = (k, self.vocab[a + b])
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(split)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.letters = byte_letters()
        self.words: dict[str, tuple[bytes, str]] = {}
        self.chunks: dict[str, tuple[bytes, str]] = {}

    def symbols(self, word: str) -> list[int]:
        spelled = [self.letters[b] for b in word.encode()]
        # the mark of a word's end belongs to the last letter as the library sees it, a byte's letter
        return [self.vocab[c] for c in spelled[:-1]] + [self.vocab[spelled[-1] + self.suffix]]

    def add(self, words: list[str]) -> None:
        for i in range(0, len(words), 20_000):
            some = words[i:i + 20_000]
            for w, ids in zip(some, merge_words([self.symbols(w) for w in some], self.ranks), strict=True):
                self.words[w] = np.array(ids, "<u4").tobytes(), " ".join(self.tokens[t] for t in ids)

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids and decoded text of every text."""
        if len(self.words) + len(self.chunks) > 2 * CACHE_ENTRIES:
            self.words.clear()
            self.chunks.clear()
        cut, fresh = [], {}
        for t in texts:
            parts = []
            for k, part in enumerate(self.cut.split(t) if "<|" in t else [t]):
                if k % 2:
                    parts.append(part)
                elif part:
                    chunks = [c for c in self.normalizer.normalize_str(part).split(" ") if c]
                    parts.append(chunks)
                    fresh.update(dict.fromkeys(c for c in chunks if c not in self.chunks))
            cut.append(parts)
        pieces = {c: self.pattern.findall(c) for c in fresh}
        self.add(list({p: None for found in pieces.values() for p in found if p not in self.words}))
        for c, found in pieces.items():
            known = [self.words[p] for p in found]
            self.chunks[c] = b"".join(k[0] for k in known), " ".join(k[1] for k in known)
        out = []
        for parts in cut:
            ids, said = [], []
            for part in parts:
                if isinstance(part, str):
                    ids.append(np.array([self.special[part]], "<u4").tobytes())
                    said.append(part)
                else:
                    known = [self.chunks[c] for c in part]
                    ids += [k[0] for k in known]
                    said += [k[1] for k in known if k[0]]
            out.append((b"".join(ids), " ".join(said)))
        return out


@lru_cache(maxsize=2)
def pair_encoder(path: str) -> PairEncoder:
    return PairEncoder(path)


def encode(docs: DataFrame, path: str | None = None, full: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, on request, ids (little-endian) and decoded."""
    path = path or tokenizer_path("word_bpe_49k.json")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = pair_encoder(path)
        for batch in batches:
            keys = batch["doc_id"]
            for i, part in slices(batch["text"].tolist(), 1000):
                done = encoder.encode(part)
                out = {"doc_id": keys.iloc[i:i + len(part)].to_numpy(), "n_tokens": [len(x) // 4 for x, _ in done],
                       "ids_sha256": [hashlib.sha256(x).hexdigest() for x, _ in done],
                       "decoded_sha256": [hashlib.sha256(y.encode()).hexdigest() for _, y in done]}
                if full:
                    out |= {"ids": [x for x, _ in done], "decoded": [y for _, y in done]}
                yield pd.DataFrame(out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(
        work, schema + ", ids binary, decoded string" * full)


def op10_bpe_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir))
