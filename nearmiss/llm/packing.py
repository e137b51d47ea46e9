"""Best-fit packing under token, document-count and attention-cost capacities.

Documents become ids plus a closing id 0; only longer ones are cut into full sequences, the first piece taking
the remainder. The lengths alone are then dealt into cells of like size, and each cell is packed by vector
best fit, longest first: of the open sequences that satisfy every capacity, the one with the largest weighted
dot product of demand and used capacity takes the piece, ties by the smaller residual norm and then by age.

Null texts count as empty and hold id 0 alone. Repeated rows are packed each on its own. No rows: no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmiss.llm.common import byte_encoder, cut_lineage, documents, slices, tokenizer_path

CLOSING = b"\0\0\0\0"


@dataclass(frozen=True)
class Capacity:
    """tokens: of a sequence; documents: pieces of a sequence; attention: sum of squared piece lengths. The
    defaults leave the last two to what full sequences may need, so they cost no sequence."""
    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)


def pieces(docs: DataFrame, capacity: Capacity = Capacity(), path: str | None = None, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, on request, ids (little-endian unsigned 32-bit)."""
    path, most = path or tokenizer_path("byte_bpe_50k.json"), capacity.tokens

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = byte_encoder(path)
        for batch in batches:
            keys, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            for i, part in slices(texts):
                rows = []
                for key, text in zip(keys[i:i + len(part)], part, strict=True):
                    raw = b"".join(cache.of(text)) + CLOSING
                    n = len(raw) // 4
                    cuts = [0, *range(n % most or most, n + 1, most)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        own = raw[4 * a:4 * b]
                        rows.append((key, k, a, b - a, zlib.crc32(own), *([own] if ids else [])))
                names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
                yield pd.DataFrame(rows, columns=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(work, schema)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every piece, in the given order of the pieces."""
    caps = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    weights = np.array(capacity.weights) / caps
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    smallest = lengths[order[-1]] if len(order) else 0
    left = np.empty((3, 1024))  # residual capacities of the open sequences
    name = np.empty(1024, np.int64)
    opened = n = 0
    for at in order:
        size = float(lengths[at])
        need = np.array([size, 1.0, size * size])
        if (need > caps).any():
            raise ValueError("a piece alone exceeds a capacity")
        fits = np.flatnonzero((left[0, :n] >= need[0]) & (left[1, :n] >= need[1]) & (left[2, :n] >= need[2]))
        if len(fits):
            rest = left[:, fits] / caps[:, None]
            gain = (weights * need) @ (1.0 - rest)
            top = fits[gain == gain.max()]
            norm = ((left[:, top] / caps[:, None]) ** 2).sum(axis=0)
            pick = top[norm.argmin()]
        else:
            if n == len(name):
                left, name = np.concatenate([left, np.empty_like(left)], 1), np.concatenate([name, np.empty_like(name)])
            pick, n = n, n + 1
            left[:, pick], name[pick] = caps, opened
            opened += 1
        sequence[at], offset[at] = name[pick], capacity.tokens - left[0, pick]
        left[:, pick] -= need
        if left[0, pick] < smallest or left[1, pick] < 1 or left[2, pick] < smallest * smallest:  # closed for good
            n -= 1
            left[:, pick], name[pick] = left[:, n], name[n]
    return sequence, offset


def pack(docs: DataFrame, capacity: Capacity = Capacity(), cell: int = 8192) -> DataFrame:
    """Places of all pieces; `cell` is the mean number of pieces packed together, whatever the input's size."""
    table = cut_lineage(pieces(docs, capacity), "pieces")
    cells = max(1, -(-table.count() // cell))
    # a row's own number salts equal ids; it is fixed by the stored files
    salt = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(cells))

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True])
        sequence, offset = best_fit(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=sequence + (int(key[0]) << 32), offset=offset).drop(columns="cell")

    return table.withColumn("cell", salt).groupBy("cell").applyInPandas(
        work, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
