"""Training-order materialisation of token ids.

Each task joins the ids of its documents, every document followed by the closing id, and cuts them into sequences
of a fixed number of tokens; only a task's last one may be shorter. Sequences get dense numbers. A keyed Feistel
network with cycle-walking permutes the numbers, so each sequence has one global slot and each slot one sequence.
Slots are dealt to shards by range; a shard is a file of records of one fixed stride: the used tokens as 2 bytes,
then the ids as unsigned 16-bit integers, filled with zeros, and a line feed. Slot s is record s % shard_rows of
shard s // shard_rows, so a reader seeks to any slot and resumes there.

Spark's own writer and committer make the shards: a lost executor's tasks are written again whole. Null texts
count as empty and hold the closing id alone. Repeated rows are tokenised each. An empty table gives no sequence.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmiss.llm.common import byte_encoder, cut_lineage, documents, slices, tokenizer_path
from nearmiss.session import scratch_path

TOKENS, SHARD_ROWS, KEY, ROUNDS = 2048, 8192, 0x5DEECE66D, 6
#: Texts, and code points of each, whose ids are counted to choose the short codes. They change the size of what is stored and nothing else.
SAMPLE_ROWS, SAMPLE_CHARS = 500, 4000
#: First bytes: a common id by itself, a page of 256 less common ones, or an id that is written out.
SINGLE, WRITTEN_OUT = 192, 255
CLOSING = 50256  # the vocabulary's end-of-text id


def feistel(numbers: np.ndarray, total: int, key: int = KEY) -> np.ndarray:
    """A permutation of 0 .. total - 1: a balanced network over the next even number of bits; values beyond the
    range walk on along their cycle until they are inside."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def step(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in range(ROUNDS):
            f = right * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * (2 * r + 1) + r) & 0xFFFFFFFFFFFFFFFF)
            f = (f ^ (f >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(31))) & mask)
        return (left << np.uint64(half)) | right

    out = step(numbers.astype(np.uint64))
    while len(outside := np.flatnonzero(out >= np.uint64(total))):
        out[outside] = step(out[outside])
    return out.astype(np.int64)


def common_ids(docs: DataFrame, path: str | None = None) -> np.ndarray:
    """Ids by how often they stand in the beginnings of the first SAMPLE_ROWS texts, then by number. The beginnings are
    bounded and read from as few files as hold them; nothing is shuffled."""
    cache, n = byte_encoder(path or tokenizer_path("byte_bpe_50k.json")), np.zeros(1 << 16, np.int64)
    for r in docs.select(F.substring(F.col("text").cast("string"), 1, SAMPLE_CHARS).alias("text")).limit(SAMPLE_ROWS).collect():
        n += np.bincount(np.frombuffer(b"".join(cache.of(r["text"] or "")), "<u4"), minlength=len(n))
    return np.argsort(-n, kind="stable").astype("<u2")


class Packing:
    """Ids in one byte, two or three, the common ones the shortest; the first bytes are compressed, the others are not
    since they are nearly random. Any id can be packed whatever the order of the ids is."""

    def __init__(self, order: np.ndarray):
        paged = order[SINGLE:SINGLE + (WRITTEN_OUT - SINGLE) * 256]
        self.head, self.low = np.full(1 << 16, WRITTEN_OUT, np.uint8), np.zeros(1 << 16, np.uint8)
        self.head[order[:SINGLE]] = np.arange(SINGLE)
        self.head[paged], self.low[paged] = SINGLE + np.arange(len(paged)) // 256, np.arange(len(paged)) % 256
        self.single, self.paged = np.r_[order[:SINGLE], np.zeros(256 - SINGLE, order.dtype)], paged
        self.press, self.open_up = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()

    def pack(self, raw: bytes) -> bytes:
        ids = np.frombuffer(raw, "<u2")
        head = self.head[ids]
        rest = ids[head >= SINGLE]
        out = head[head >= SINGLE] == WRITTEN_OUT
        first = self.press.compress(head.tobytes())
        return struct.pack("<I", len(first)) + first + self.low[rest[~out]].tobytes() + rest[out].tobytes()

    def unpack(self, packed: bytes) -> bytes:
        at = 4 + struct.unpack_from("<I", packed)[0]
        head = np.frombuffer(self.open_up.decompress(packed[4:at]), np.uint8)
        ids = self.single[head]
        page = np.flatnonzero((head >= SINGLE) & (head < WRITTEN_OUT))
        low = np.frombuffer(packed, np.uint8, len(page), at)
        ids[page] = self.paged[(head[page].astype(np.int64) - SINGLE) * 256 + low]
        ids[head == WRITTEN_OUT] = np.frombuffer(packed, "<u2", offset=at + len(page))
        return ids.astype("<u2").tobytes()


def sequences(docs: DataFrame, tokens: int = TOKENS, path: str | None = None, order: np.ndarray | None = None) -> DataFrame:
    """doc_ids (those with a token in it, in order), first_token (of the first document's own), length, ids_crc32
    and packed, the ids as `Packing` stores them, the common ones by `order`."""
    path = path or tokenizer_path("byte_bpe_50k.json")
    order = np.arange(1 << 16).astype("<u2") if order is None else order
    size, closing = 2 * tokens, struct.pack("<H", CLOSING)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, packing = byte_encoder(path), Packing(order)
        held, owners, first = bytearray(), [], 0  # the open sequence

        def row():
            raw = bytes(held)
            return list(owners), first, len(raw) // 2, zlib.crc32(raw), packing.pack(raw)

        names = ["doc_ids", "first_token", "length", "ids_crc32", "packed"]
        for batch in batches:
            keys = [None if pd.isna(k) else int(k) for k in batch["doc_id"]]
            for i, part in slices(batch["text"].tolist()):
                rows = []
                for key, text in zip(keys[i:i + len(part)], part, strict=True):
                    raw = np.frombuffer(b"".join(cache.of(text)), "<u4").astype("<u2").tobytes() + closing
                    at = 0
                    while at < len(raw):
                        if not owners:
                            first = at // 2
                        owners.append(key)
                        step = min(size - len(held), len(raw) - at)
                        held += raw[at:at + step]
                        at += step
                        if len(held) == size:
                            rows.append(row())
                            held.clear()
                            owners.clear()
                yield pd.DataFrame(rows, columns=names)
        if held:
            yield pd.DataFrame([row()], columns=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(
        work, "doc_ids array<bigint>, first_token long, length long, ids_crc32 long, packed binary")


def numbered(rows: DataFrame) -> DataFrame:
    """Dense numbers over the rows, whose stored `own` holds each row's part and place in it: the place plus the rows
    of earlier parts. They do not depend on how the files are split when they are read. One count a part reaches the
    driver."""
    own = rows
    part, place = F.shiftright("own", 33), F.col("own").bitwiseAND((1 << 33) - 1)
    counts = own.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    start, total = {}, 0
    for r in sorted(counts):
        start[r["part"]], total = total, total + r["n"]
    offsets = rows.sparkSession.createDataFrame(list(start.items()) or [(0, 0)], "part long, start long")
    return own.withColumn("part", part).join(F.broadcast(offsets), "part").select(
        *(c for c in rows.columns if c != "own"), (F.col("start") + place).alias("number"), F.lit(total).cast("long").alias("total"))


def in_order(rows: DataFrame, key: int = KEY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The stored sequences (with `own`) with slot and shard."""
    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total = int(batch["total"].iloc[0]) if len(batch) else 1
            slot = feistel(batch["number"].to_numpy(), total, key)
            yield batch.drop(columns=["number", "total"]).assign(slot=slot, shard=slot // shard_rows)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "own")
    return numbered(rows).mapInPandas(slots, schema + ", slot long, shard long")


def stride(tokens: int = TOKENS) -> int:
    return 2 * (tokens + 1) + 1


def write_shards(ordered: DataFrame, shards: int, path: str, tokens: int, order: np.ndarray) -> None:
    """One file a shard under shard=<number>/, in the order of the slots; the text writer adds the line feed."""
    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packing = Packing(order)
        for batch in batches:
            for i in range(0, len(batch), 500):
                some = batch.iloc[i:i + 500]
                raw = [packing.unpack(p) for p in some["packed"]]
                yield pd.DataFrame({"shard": some["shard"].to_numpy(), "value": [
                    struct.pack("<H", len(r) // 2) + r + bytes(2 * tokens - len(r)) for r in raw]})

    (ordered.select("shard", "slot", "packed").repartitionByRange(max(1, shards), "shard")
     .sortWithinPartitions("shard", "slot").mapInPandas(records, "shard long, value binary")
     .select("shard", F.col("value").cast("string").alias("value"))
     .write.partitionBy("shard").option("lineSep", "\n").text(path))


def read_record(raw: bytes, record: int, tokens: int = TOKENS) -> np.ndarray:
    """Ids of one record of a shard's bytes (or, as record 0, of the bytes that a seek to it has read)."""
    at = record * stride(tokens)
    return np.frombuffer(raw, "<u2", struct.unpack_from("<H", raw, at)[0], at + 2)


def materialise(docs: DataFrame, path: str, key: int = KEY, tokens: int = TOKENS,
                shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Writes the shards and returns the index: doc_ids, first_token, length, ids_crc32, slot, shard, byte_offset."""
    order = common_ids(docs)
    rows = cut_lineage(sequences(docs, tokens, order=order).withColumn("own", F.monotonically_increasing_id()), "sequences")
    write_shards(in_order(rows, key, shard_rows), -(-rows.count() // shard_rows), path, tokens, order)
    return in_order(rows.drop("packed"), key, shard_rows).select(
        "doc_ids", "first_token", "length", "ids_crc32", "slot", "shard",
        ((F.col("slot") % shard_rows) * stride(tokens)).alias("byte_offset"))


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(documents(spark, sf_dir), scratch_path(spark, "shards"))
