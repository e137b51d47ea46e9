"""Token counts: the exact count at every prefix by dynamic programming.

The last token of each prefix of a word piece is the only vocabulary token that ends there and is a valid
neighbour of the last token before it; counts[i] = counts[i - len(last)] + 1. A text's table joins the tables
of its pieces, so truncation and budget questions read the table and never encode again.

Null and empty texts have 0 tokens and an empty table; repeated rows each give a row; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import PATTERN

from nearmiss.llm.common import CACHE_ENTRIES, ChunkCache, byte_letters, documents, slices, tokenizer_path

SPECIAL = "<|endoftext|>"
LIMIT = 1024
_LEADING = regex.compile(r"\p{White_Space}*")
_WORD = re.compile(" ?[A-Za-z]+")
_CONTRACTIONS = ("'re", "'ve", "'ll")


class PrefixCounter:
    """Exact token counts of all prefixes of a chunk under a byte-level vocabulary whose ids follow merge order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = {c: b for b, c in byte_letters().items()}
        spell = lambda s: bytes(back[c] for c in s)
        # a special token is no part of the merge vocabulary
        self.ids = {spell(t): i for t, i in model["vocab"].items() if t != SPECIAL}
        self.split = {i: (i, i) for i in self.ids.values()}
        self.joined = {}
        for a, b in model["merges"]:
            a, b = spell(a), spell(b)
            pair, made = (self.ids[a], self.ids[b]), self.ids[a + b]
            self.joined[pair], self.split[made] = made, pair
        if list(self.joined.values()) != sorted(set(self.joined.values())):
            raise ValueError("ids must follow merge order, one merge for each")
        # states stand for beginnings of tokens: the longest one that the bytes so far end with
        self.states = {b"": 0}
        for token in self.ids:
            for n in range(1, len(token) + 1):
                self.states.setdefault(token[:n], len(self.states))
        self.begun = list(self.states)
        self.ending: list[tuple] = [self.endings(b) for b in self.begun]
        self.moves: dict[int, int] = {}
        self.pieces: dict[str, list[int]] = {}
        self.fits: dict[int, bool] = {}
        self.pattern = regex.compile(PATTERN)

    def endings(self, begun: bytes) -> tuple[tuple[int, int], ...]:
        """Size and id of all tokens that the bytes end with, the longest first."""
        tails = (begun[i:] for i in range(len(begun)))
        return tuple((len(t), self.ids[t]) for t in tails if t in self.ids)

    def move(self, state: int, byte: int) -> int:
        """The state after one more byte; kept, as far as the table goes."""
        after = self.begun[state] + bytes((byte,))
        while after not in self.states:
            after = after[1:]
        if len(self.moves) > 2_000_000:
            self.moves.clear()
        to = self.moves[state << 8 | byte] = self.states[after]
        return to

    def neighbours(self, a: int, b: int) -> bool:
        """Whether encoding the two tokens' bytes together gives just these two tokens: no merge across the
        border, at any step of building them, comes before the merges that built both sides."""
        key, limit = a << 32 | b, 1 << 40
        known = self.fits.get(key)
        if known is not None:
            return known
        while True:
            made = self.joined.get((a, b))
            if made is not None and made < limit:
                good = False
                break
            left = a > b
            for _ in range(2):
                if left:
                    if self.split[a][0] != a:
                        limit, a = a, self.split[a][1]
                        break
                elif self.split[b][0] != b:
                    limit, b = b + 1, self.split[b][0]
                    break
                left = not left
            else:
                good = True
                break
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[key] = good
        return good

    def piece(self, piece: str) -> list[int]:
        """Counts after 1, 2, ... code points of one pattern match."""
        known = self.pieces.get(piece)
        if known is not None:
            return known
        raw = piece.encode()
        counts, last, fits, moves, ending = [0], [-1], self.fits.get, self.moves, self.ending
        end = state = 0
        for byte in raw:
            end += 1
            move = moves.get(state << 8 | byte)
            state = self.move(state, byte) if move is None else move
            for size, token in ending[state]:
                start = end - size
                if start:
                    good = fits(last[start] << 32 | token)
                    if not (self.neighbours(last[start], token) if good is None else good):
                        continue
                counts.append(counts[start] + 1)
                last.append(token)
                break
            else:
                raise AssertionError("a prefix without a last token")
        if len(raw) == len(piece):
            ends = counts[1:]
        else:
            ends, at = [], 0
            for c in piece:
                at += len(c.encode())
                ends.append(counts[at])
        if len(self.pieces) < CACHE_ENTRIES and len(piece) < 100:
            self.pieces[piece] = ends
        return ends

    def plain(self, chunk: str) -> list[int]:
        """Counts of a chunk's prefixes without special strings; a run of blanks at the end of a prefix is one
        piece, and an apostrophe with one letter of a longer ending is two."""
        if _WORD.fullmatch(chunk):  # one piece, and so is a blank before it
            return self.piece(chunk)
        run = _LEADING.match(chunk).end()
        out = list(self.piece(chunk[:run])) if run else []
        if run == len(chunk):
            return out
        base, at = 0, 0
        for m in self.pattern.finditer(chunk):
            p = m.group()
            counts = self.piece(p)
            if p in _CONTRACTIONS:
                counts = [counts[0], 2, counts[2]]
            own = counts[run - at:] if at < run else counts
            out += [base + c for c in own] if base else own
            base, at = base + counts[-1], m.end()
        return out

    def chunk(self, chunk: str) -> np.ndarray:
        out, base, rest = [], 0, chunk
        while (cut := rest.find(SPECIAL)) >= 0:
            counts = self.plain(rest[:cut + len(SPECIAL)])
            before = self.plain(rest[:cut])[-1] if cut else 0
            out += [base + c for c in counts[:-1]] + [base + before + 1]
            base, rest = out[-1], rest[cut + len(SPECIAL):]
        if rest:
            out += [base + c for c in self.plain(rest)]
        return np.array(out, np.int32)


@lru_cache(maxsize=2)
def counter(path: str) -> ChunkCache:
    return ChunkCache(PrefixCounter(path).chunk)


def prefix_table(chunks: list[np.ndarray]) -> np.ndarray:
    """counts[i]: exact tokens of the first i + 1 code points."""
    if not chunks:
        return np.zeros(0, np.int32)
    ends = np.fromiter((c[-1] for c in chunks), np.int32, len(chunks))
    sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
    table = np.concatenate(chunks)
    table += np.repeat(np.cumsum(ends, dtype=np.int32) - ends, sizes)
    return table


def tokens_of_prefix(table: np.ndarray, chars: int) -> int:
    return int(table[min(chars, len(table)) - 1]) if chars > 0 and len(table) else 0


def longest_prefix(table: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix whose own encoding has at most the given tokens."""
    fits = np.flatnonzero(table <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def token_counts(docs: DataFrame, limit: int = LIMIT, path: str | None = None, store: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars (the longest prefix within the limit) and, on request,
    prefix_counts: the table as little-endian 32-bit integers, one per code point."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = counter(path)
        for batch in batches:
            ids, texts = batch["doc_id"], batch["text"].tolist()
            for i, part in slices(texts):
                tables = [prefix_table(cache.of(t)) for t in part]
                n = [int(t[-1]) if len(t) else 0 for t in tables]
                out = {"doc_id": ids.iloc[i:i + len(part)].to_numpy(), "n_bytes": [len(t.encode()) for t in part],
                       "n_tokens": n, "over_limit": [x > limit for x in n],
                       "fit_chars": [longest_prefix(t, limit) for t in tables]}
                if store:
                    out["prefix_counts"] = [t.astype("<i4").tobytes() for t in tables]
                yield pd.DataFrame(out)

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(
        work, schema + ", prefix_counts binary" * store)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
