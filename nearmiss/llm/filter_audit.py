"""Filter interaction audit with radix text tries.

Every row gets a mask with a bit per filter it fails. The filters on the text alone are read off its bytes. The last
filter, a copy of a text with a smaller doc_id anywhere in the table, needs the smallest id of every text:

1. Each task inserts the texts it reads into compressed tries that hold the smallest id at their terminals. A row
   that meets a smaller id is decided; only the smallest of each text goes on, so a hot text leaves a row or a few
   per task. A trie is emptied when it holds TRIE_BYTES.
2. Prefixes are refined where they weigh too much: the bytes of texts are summed by their first 4 bytes, heavy prefixes
   by their first 8, and so on until none is heavy or a heavy one is a whole text. The heavy prefixes are at most
   HEAVY_ROWS per level (as hashes; a collision refines a prefix without need and changes no result).
3. Texts are range-partitioned by those adaptive prefixes (behind 64 bytes their hash), so that equal texts meet, and
   inserted into one trie per partition, which is traversed for the rows that stay.
4. Masks are counted per part, and the counts of at most 32 masks give every order and step.

Null text and null source count as empty. A null doc_id is neither smaller nor larger than another. Rows with the
same id and text are no copies of each other. Labels of an id given twice count if any of them says so. Very long
texts are inserted whole. An empty table gives no rows; columns beyond doc_id, text and source are not read.
"""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmiss.llm.common import cut_lineage, documents, labels, small_batches

LETTERS = "ABCDE"
COPY = 1 << 4
#: Bytes of text in a trie of a reading task, and about as many in a range partition.
TRIE_BYTES = 32 << 20
#: A prefix is heavy that holds more than a quarter of a range, or one part in HEAVY_SHARE of all texts.
HEAVY_SHARE = 256
#: Heavy prefixes of a level, 16 bytes each.
HEAVY_ROWS = 1 << 20
FIRST_PREFIX, HEAD = 4, 64
SCHEMA = "text binary, doc_id long, part string, mask int, n long"
ARROW = pa.schema([("text", pa.binary()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())])

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_SIGNS = b"#$%&*|"
_INNER = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D. bytes.split() cuts at the six ASCII blanks of the contract."""
    words = text.split()
    chars = len(text.translate(None, _INNER))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return ((len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * capitals > 5 * chars) << 2
            | (len(text.translate(None, _SIGNS)) < len(text)) << 3)


class Node:
    """An edge label, children by first byte, and at a terminal the smallest id: (id, mask, rows by part)."""

    __slots__ = ("label", "children", "least")

    def __init__(self, label: bytes):
        self.label, self.children, self.least = label, {}, None


class TextTrie:
    """A compressed trie over whole texts. add() returns the rows that are decided by then."""

    def __init__(self):
        self.root, self.bytes = Node(b""), 0

    def terminal(self, text: bytes) -> Node:
        node, at, end = self.root, 0, len(text)
        while at < end:
            child = node.children.get(text[at])
            if child is None:
                node.children[text[at]] = child = Node(text[at:])
                self.bytes += end - at + 200
                return child
            if not text.startswith(child.label, at):
                child = self.split(node, child, text, at)
            node, at = child, at + len(child.label)
        return node

    def split(self, node: Node, child: Node, text: bytes, at: int) -> Node:
        """A new node for what the child's label and the text have in common, a byte at least."""
        low, high = 1, min(len(child.label) - 1, len(text) - at)
        while low < high:
            middle = (low + high + 1) // 2
            if text.startswith(child.label[:middle], at):
                low = middle
            else:
                high = middle - 1
        upper = Node(child.label[:low])
        child.label = child.label[low:]
        upper.children[child.label[0]] = child
        node.children[text[at]] = upper
        return upper

    def add(self, text: bytes, doc_id: int, part: str, mask: int, n: int) -> list[tuple]:
        node = self.terminal(text)
        if node.least is None:
            node.least = doc_id, mask, {part: n}
            return []
        least, mask, parts = node.least
        if doc_id > least:
            return [(None, doc_id, part, mask | COPY, n)]
        if doc_id == least:
            parts[part] = parts.get(part, 0) + n
            return []
        node.least = doc_id, mask, {part: n}
        return [(None, least, p, mask | COPY, k) for p, k in parts.items()]

    def rows(self, with_text: bool):
        """Traversal: the rows of the smallest id of every text."""
        open_nodes = [(self.root, b"")]
        while open_nodes:
            node, before = open_nodes.pop()
            text = before + node.label if with_text else None
            if node.least is not None:
                least, mask, parts = node.least
                for part, n in parts.items():
                    yield text, least, part, mask, n
            open_nodes += [(child, text or b"") for child in node.children.values()]


def in_batches(rows, size: int = 1000):
    """Arrow batches of at most `size` rows and about 8 MB of text."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += len(row[0] or b"")
        if len(held) == size or weight > 8 << 20:
            yield batch_of(held)
            held, weight = [], 0
    if held:
        yield batch_of(held)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


def local_tries(batches):
    """Reading tasks: decided rows without their text, and the smallest row of every text with it."""
    def rows():
        trie = TextTrie()
        for batch in batches:
            for doc_id, part, text in zip(*(c.to_pylist() for c in batch.columns)):
                if doc_id is None:
                    yield None, None, part, text_mask(text), 1
                else:
                    yield from trie.add(text, doc_id, part, text_mask(text), 1)
            if trie.bytes > TRIE_BYTES:
                yield from trie.rows(True)
                trie = TextTrie()
        yield from trie.rows(True)

    return in_batches(rows())


def range_tries(batches):
    """A range of texts: every row decided."""
    def rows():
        trie = TextTrie()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                yield from trie.add(*row)
        yield from trie.rows(False)

    return in_batches(rows())


def prefix(length: int) -> Column:
    return F.expr(f"substring(text, 1, {length})")


def prefix_hash(length: int) -> Column:
    return F.xxhash64(F.lit(length), prefix(length))


def by_prefix(rows: DataFrame, range_bytes: int) -> DataFrame:
    """Rows range-partitioned by the shortest prefix that is not heavy."""
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    heavy = max(min(range_bytes // 4, total // HEAVY_SHARE), total // HEAVY_ROWS)
    length, level, dealt = FIRST_PREFIX, rows.select("text"), rows.withColumn("depth", F.lit(FIRST_PREFIX))
    while True:
        found = cut_lineage(
            level.groupBy(prefix_hash(length).alias("hash"))
            .agg(F.sum(F.length("text")).alias("weight"), F.max(F.length("text")).alias("longest"))
            .where((F.col("weight") > heavy) & (F.col("longest") > length)).select("hash"), "heavy_prefixes")
        if found.isEmpty():
            break
        found = F.broadcast(found)
        level = level.join(found, prefix_hash(length) == F.col("hash"), "left_semi")
        dealt = (dealt.join(found, (F.col("depth") == length) & (prefix_hash(length) == F.col("hash")), "left")
                 .withColumn("depth", F.when(F.col("hash").isNotNull(), 2 * length).otherwise(F.col("depth"))).drop("hash"))
        length *= 2
    keyed = dealt.withColumns({
        "head": F.expr(f"substring(text, 1, least(depth, {HEAD}))"),
        "tail": F.when(F.col("depth") > HEAD, F.xxhash64(F.expr("substring(text, 1, depth)"))).otherwise(0)})
    return keyed.repartitionByRange(max(1, -(-total // range_bytes)), "head", "tail").drop("depth", "head", "tail")


def failed_filters(docs: DataFrame, range_bytes: int = TRIE_BYTES) -> DataFrame:
    """doc_id, part, mask (bit i is filter i of LETTERS) and n, the number of such rows."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                      F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    local = cut_lineage(own.mapInArrow(local_tries, SCHEMA), "local_tries")
    ranges = by_prefix(local.where(F.col("text").isNotNull()), range_bytes).mapInArrow(range_tries, SCHEMA)
    return (local.where(F.col("text").isNull()).unionByName(ranges)
            .groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")))


def audit(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Per part, filter order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = failed_filters(docs).join(marks, "doc_id", "left")
    masks = rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    orders = ["".join(p) for p in permutations(LETTERS)]
    steps = (masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
             .select("part", "masks", F.explode(F.array(*map(F.lit, orders))).alias("filter_order"))
             .select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step")))
    own = F.expr("substring(filter_order, step, 1)")
    before = F.expr("substring(filter_order, 1, step - 1)")
    steps = steps.withColumns({
        "own": sum((F.when(own == c, 1 << i).otherwise(0) for i, c in enumerate(LETTERS)), F.lit(0)),
        "past": sum((F.when(F.instr(before, c) > 0, 1 << i).otherwise(0) for i, c in enumerate(LETTERS)), F.lit(0))})

    def total(value, test) -> Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda a, m: a + F.when(test(m["mask"]), value(m)).otherwise(0))

    def fails(mask: Column) -> Column:
        return mask.bitwiseAND(F.col("own")) != 0

    def first(mask: Column) -> Column:
        return fails(mask) & (mask.bitwiseAND(F.col("past")) == 0)

    def n(m: Column) -> Column:
        return m["n"]

    return steps.select(
        "part", "filter_order", "step",
        total(n, lambda k: k.bitwiseAND(F.col("own").bitwiseOR(F.col("past"))) == 0).alias("kept"),
        total(n, first).alias("removed"),
        total(n, lambda k: fails(k) & ~first(k)).alias("redundant"),
        total(n, lambda k: k == F.col("own")).alias("unique_fails"),
        total(lambda m: m["good"], first).alias("good_lost"),
        total(lambda m: m["toxic"], first).alias("toxic_lost"),
        # of the filters a row fails, each comes first in an equal share of the orders
        total(lambda m: m["n"] * F.floor(F.lit(len(orders)) / F.bit_count(m["mask"])), fails).alias("shapley"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), labels(spark, sf_dir))


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
m AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {
    'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words),
    'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
    'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)} AS s
  FROM t LEFT JOIN m USING (doc_id)),
g AS (
  SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda c: CASE c WHEN 'A' THEN s.A WHEN 'B' THEN s.B
           WHEN 'C' THEN s.C WHEN 'D' THEN s.D ELSE s.E END) AS fails,
         count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
l(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT a.c || b.c || d.c || e.c || h.c AS filter_order FROM l a, l b, l d, l e, l h
  WHERE len(list_distinct([a.c, b.c, d.c, e.c, h.c])) = 5),
r AS (
  SELECT g.*, filter_order, step::INT AS step, filter_order[step] AS own, substr(filter_order, 1, step::INT - 1) AS past,
         list_contains(fails, filter_order[step]) AS hit,
         len(list_filter(fails, lambda c: contains(substr(filter_order, 1, step::INT - 1), c))) > 0 AS gone
  FROM g, o, range(1, 6) s(step)),
x AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails = [own]), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM x
"""
