"""Helpers of the training-data operators: reading, fixed splits and a chunk-cached encoder."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmiss.session import cut_lineage  # noqa: F401  (re-exported for the operators)

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: ASCII white space of the contracts, [\x20\x09-\x0D].
BLANKS = " \t\n\v\f\r"
#: Entries of a per-worker cache; a full one takes no more, results never depend on it.
CACHE_ENTRIES = 500_000

_TWO_BLANKS = re.compile(r"\s\s")
_CHUNK = regex.compile(r"\p{White_Space}*\P{White_Space}+|\p{White_Space}+")


#: Rows handed to a Python worker at a time; texts are long, and a worker holds a batch in several forms.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def keep_rows(docs: DataFrame, decide) -> DataFrame:
    """The rows whose text passes, with all their columns, without a shuffle. decide: a list of texts to booleans."""
    def work(batches):
        for batch in batches:
            yield batch.filter(pa.array(decide(batch.column("text").to_pylist()), pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(work, docs.schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fold(doc_id: Column | str, of: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % of


def cut_chunks(text: str) -> tuple[list[str], bool]:
    """Parts of a text that the byte-level pattern never matches across, and whether every part but the
    first stands for a blank followed by the part."""
    if _TWO_BLANKS.search(text) is None:
        return text.split(" "), True
    return _CHUNK.findall(text), False


class Known(dict):
    """Values by chunk, computed where they are missing. A full table takes no more; results never depend on it."""

    def __init__(self, compute, before: str = ""):
        super().__init__()
        self.compute, self.before = compute, before

    def __missing__(self, chunk: str):
        value = self.compute(self.before + chunk)
        if len(self) < CACHE_ENTRIES and len(chunk) < 100:
            self[chunk] = value
        return value


class ChunkCache:
    """Values of text chunks, computed once per worker."""

    def __init__(self, compute):
        self.whole, self.after_blank = Known(compute), Known(compute, " ")

    def of(self, text: str) -> list:
        """The values of a text's chunks, in order. An empty text has none."""
        if not text:
            return []
        parts, spaced = cut_chunks(text)
        if not spaced:
            return list(map(self.whole.__getitem__, parts))
        first = [self.whole[parts[0]]] if parts[0] else []
        return first + list(map(self.after_blank.__getitem__, parts[1:]))


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


@lru_cache(maxsize=4)
def byte_encoder(path: str) -> ChunkCache:
    """Chunks to the ids of a byte-level vocabulary as little-endian unsigned 32-bit integers. The vocabulary's
    ids follow merge order, so they serve as ranks; the special string becomes its id wherever it stands."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    back = {c: b for b, c in byte_letters().items()}
    ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    plain = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                              special_tokens={}).encode_ordinary
    cut = re.compile("(" + "|".join(map(re.escape, special)) + ")")

    def compute(chunk: str) -> bytes:
        if "<|" not in chunk:
            return array("I", plain(chunk)).tobytes()
        return b"".join(array("I", [special[p]] if p in special else plain(p)).tobytes() for p in cut.split(chunk))

    return ChunkCache(compute)


def tokenizer_path(name: str) -> str:
    return public_tokenizers.path(name)


def slices(column, rows: int = 256):
    """Lists of texts, a bounded number at a time, null read as empty."""
    for i in range(0, len(column), rows):
        yield i, [t or "" for t in column[i:i + rows]]
