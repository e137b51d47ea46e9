"""Source divergence audit by iceberg prefix refinement.

A term of at most `length` bytes is complete at that length; a longer one stands there as its prefix. Level by level
(4, 8, 16, ... bytes) each task counts, per language, the documents that hold a prefix and, per language and source,
the documents and occurrences of the terms complete at that level. Prefixes in fewer documents than the threshold
cannot lead to a kept term and are discarded; only what begins with a kept one is counted at the next level, until no
prefix is left. Rare terms with rare beginnings so never shuffle. A document lies in one task, so counts of documents
add up.

Kept prefixes reach the tasks as a table of FILTER_BITS bits, 2 MB at any size of input. Where two prefixes share a
bit, one may be followed without need; the exact counts of complete terms decide, so results do not depend on it.

Term rows are then joined with the sizes of their (language, source) group. Groups are broadcast: the result holds
all pairs of a language's sources, so its size bounds theirs by its square root. Tasks add up f for all pairs of
sources over blocks of terms; only those sums shuffle. The ten first terms of a group are cut before the shuffle by
Spark's limit of window groups.

Null text, lang and source count as ''; repeated rows count each; very long texts and terms are read whole; ties are
in order of the UTF-8 item; a language without kept terms has pairs of value 0. An empty table gives no rows; columns
beyond text, lang and source are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearmiss.llm.common import cut_lineage, documents, small_batches

LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
FIRST_PREFIX, FILTER_BITS = 4, 1 << 24
#: Entries a task holds before it hands them on, and prefixes of a language that a worker remembers.
HELD = 300_000
KEYS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("key", pa.binary()), ("complete", pa.bool_()),
                  ("docs", pa.int64()), ("n", pa.int64())])
SCHEMA = "lang string, source string, key binary, complete boolean, docs long, n long"
#: Letters to lower case, other ASCII to blanks; every byte from 128 on belongs to a term.
_TERMS = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


class Kept(dict):
    """Whether a prefix of a language may be kept, by the bits of the level before."""

    def __init__(self, lang: str, bits: bytes):
        super().__init__()
        self.lang, self.bits = zlib.crc32(lang.encode() + b"\0"), bits

    def __missing__(self, prefix: bytes) -> bool:
        bit = zlib.crc32(prefix, self.lang) % (8 * len(self.bits))
        value = self.bits[bit >> 3] >> (bit & 7) & 1 == 1
        if len(self) < HELD:
            self[prefix] = value
        return value


def count_level(done: int, length: int, kept: bytes | None):
    """Counts of one level, terms of at most `done` bytes being complete before. An Arrow function over (lang, source, text)."""
    longer = re.compile(b"[^ ]{%d,}" % (done + 1))

    def work(batches):
        known: dict[str, Kept] = {}
        prefixes, docs, more = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                if kept is None:
                    found = Counter(terms(text))
                    begun = found
                else:
                    found = Counter(longer.findall(text.translate(_TERMS)))
                    if lang not in known:
                        known[lang] = Kept(lang, kept)
                    may = known[lang]
                    begun = [t for t in found if may[t[:done]]]
                prefixes[lang].update({t[:length] for t in begun if len(t) > length})
                whole = [t for t in begun if len(t) <= length]
                docs[lang, source].update(whole)
                again = more[lang, source]
                for term in whole:  # most terms occur once in a text
                    if found[term] > 1:
                        again[term] += found[term] - 1
            if sum(map(len, prefixes.values())) + sum(map(len, docs.values())) > HELD:
                yield from counted(prefixes, docs, more)
                prefixes, docs, more = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
        yield from counted(prefixes, docs, more)

    return work


def counted(prefixes, docs, more):
    for lang, counts in prefixes.items():
        yield from key_batches(lang, None, counts, {})
    for (lang, source), counts in docs.items():
        yield from key_batches(lang, source, counts, more[lang, source])


def key_batches(lang: str, source: str | None, docs: Counter, more: dict, size: int = 10_000):
    """Rows of SCHEMA: occurrences are documents and what they hold beyond the first. Prefixes have no source."""
    keys = list(docs)
    for i in range(0, len(keys), size):
        part = keys[i:i + size]
        columns = [[lang] * len(part), [source] * len(part), part, [source is not None] * len(part),
                   [docs[k] for k in part], [docs[k] + more.get(k, 0) for k in part]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, KEYS)], schema=KEYS)


def filter_table(kept: DataFrame, bits: int = FILTER_BITS) -> bytes:
    """A bit per kept (lang, key); what reaches the driver is at most bits / 64 words."""
    bit = F.crc32(F.concat(F.col("lang").cast("binary"), F.lit(bytearray(b"\0")), F.col("key"))) % bits
    words = (kept.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toPandas())
    table = np.zeros(bits // 64, "<i8")
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table.tobytes()


def kept_terms(rows: DataFrame, least_docs: int = LEAST_DOCS, bits: int = FILTER_BITS) -> DataFrame:
    """lang, key, counts (by source) and total, one row per kept term."""
    small_batches(rows.sparkSession)
    done, length, kept, complete = 0, FIRST_PREFIX, None, None
    while True:
        level = rows.mapInArrow(count_level(done, length, kept), SCHEMA)
        level = cut_lineage(level.groupBy("lang", "source", "key", "complete")
                            .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")), "term_level")
        found = level.where("complete").drop("complete")
        complete = found if complete is None else complete.unionByName(found)
        prefixes = level.where(~F.col("complete") & (F.col("docs") >= least_docs)).select("lang", "key")
        if prefixes.isEmpty():
            break
        done, length, kept = length, 2 * length, filter_table(prefixes, bits)
    every = complete.groupBy("lang", "key").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.map_from_entries(
        F.collect_list(F.struct("source", "n"))).alias("counts"))
    return cut_lineage(every.where(F.col("docs") >= least_docs).drop("docs"), "kept_terms")


def share(count: str, group: str, kept: str) -> str:
    """1 + floor(SCALE * (count + 2) / (group + 2 * kept)) without rounding, as SQL. Rows of terms have kept > 0."""
    def wide(c: str) -> str:
        return f"CAST({c} AS DECIMAL(19, 0))"

    return f"1 + (({wide(count)} + 2) * CAST({SCALE} AS DECIMAL(10, 0))) div ({wide(group)} + 2 * {wide(kept)})"


def pair_sums(batches):
    """f summed over the terms of a task, for every ordered pair of places in a language's list of sources."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, shares = np.array(batch.column("lang").to_pylist(), object), batch.column("shares")
        values, begins = shares.values.to_numpy(), shares.offsets.to_numpy()
        for lang in set(langs):
            rows = np.flatnonzero(langs == lang)
            size = begins[rows[0] + 1] - begins[rows[0]]
            p = values[begins[rows][:, None] + np.arange(size)]
            total = sums.setdefault(lang, np.zeros((size, size), np.int64))
            for i in range(size):
                own = p[:, i:i + 1]
                total[i] += ((own - p) ** 2 // (own + p)).sum(axis=0)
    for lang, total in sums.items():
        for i, row in enumerate(total):
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(row), "i": np.full(len(row), i, np.int32),
                                              "j": np.arange(len(row), dtype=np.int32), "value": row})


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: other sources by divergence, and the terms a group has more often."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    by_term = kept_terms(rows, least_docs)
    cells = by_term.select("lang", "key", "total", F.explode("counts").alias("source", "n"))
    langs = by_term.groupBy("lang").agg(F.sum("total").alias("n_lang"), F.count(F.lit(1)).alias("v"))
    groups = (rows.select("lang", "source").distinct()
              .join(cells.groupBy("lang", "source").agg(F.sum("n").alias("n_group")), ["lang", "source"], "left")
              .join(langs, "lang", "left").na.fill(0, ["n_group", "n_lang", "v"])
              .withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))
    groups = cut_lineage(groups, "groups")

    known = (cells.join(F.broadcast(groups), ["lang", "source"])
             .withColumns({"p": F.expr(share("n", "n_group", "v")), "q": F.expr(share("total", "n_lang", "v"))})
             .where("p > q").withColumn("value", F.expr("(p - q) * (p - q) div (p + q)")))
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("key"))
    term = (known.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
            .select("lang", "source", F.lit("term").alias("part"), F.col("key").cast("string").alias("item"), "value", "rank"))

    members = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "source", "n_group"))).alias("members"),
                                         F.max("v").alias("v"))
    count = "coalesce(try_element_at(counts, m.source), 0L)"
    shares = by_term.join(F.broadcast(members), "lang").select(
        "lang", F.expr(f"transform(members, m -> {share(count, 'm.n_group', 'v')})").alias("shares"))
    sums = (shares.mapInArrow(pair_sums, "lang string, i int, j int, value long")
            .groupBy("lang", "i", "j").agg(F.sum("value").alias("value")))
    other = groups.select("lang", F.col("source").alias("item"), F.col("i").alias("j"))
    nearest = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pair = (groups.select("lang", "source", "i").join(other, "lang").where("i <> j").join(sums, ["lang", "i", "j"], "left")
            .withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
            .select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(nearest).alias("rank")))
    return pair.unionByName(term)


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))


OP13_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS number, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT number, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT number) AS docs FROM w GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(docs) >= 10),
l AS (SELECT lang, sum(total) AS n_lang, count(*) AS v FROM k GROUP BY ALL),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, sum(n) AS n_group FROM c SEMI JOIN k USING (lang, term) GROUP BY ALL),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT) // (coalesce(n_group, 0) + 2 * v)::HUGEINT AS p,
         1 + (1000000000 * (total + 2)::HUGEINT) // (n_lang + 2 * v)::HUGEINT AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN s USING (lang, source)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
