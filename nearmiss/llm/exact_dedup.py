"""Exact dedup in two Bloom passes, with DataFrame functions alone.

Texts are equal when equal without ASCII white space; their SHA-256 stands for them. Pass one counts, in two
tables of cells addressed by independent hashes, which cells more than one row hits, and packs those cells into
64-bit words. Pass two tests every row against both tables: a row with a cell of its own has no copy and passes
straight through; only the others shuffle to be grouped. False positives cost a shuffled row, never a result.

Null counts as empty. Of equal texts the longest original stays, then the smallest doc_id (a null id last); of
rows that are equal in both, one stays. An empty table gives no rows. Columns beyond doc_id and text are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmiss.llm.common import cut_lineage, documents

#: Cells per row in each table: a lone row meets another in both with a probability of about 1 / 16^2.
CELLS_PER_ROW = 16
#: Words a table may hold when it is broadcast (8 MB of keys and values); a larger one is joined by a shuffle
#: of ids and hashes.
BROADCAST_WORDS = 1 << 19
PASSES = ("a", "b")


def normal_text(text: F.Column) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, chars (code points of the original) and text_sha256."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.length(F.coalesce(text, F.lit(""))).alias("chars"),
                       F.sha2(normal_text(text).cast("binary"), 256).alias("text_sha256"))


def with_cells(rows: DataFrame, cells: int) -> DataFrame:
    for k, name in enumerate(PASSES):
        cell = F.pmod(F.xxhash64(F.lit(k), "text_sha256"), F.lit(cells))
        rows = rows.withColumn(f"word_{name}", F.shiftright(cell, 6)).withColumn(
            f"bit_{name}", F.expr(f"shiftleft(1L, int(pmod(xxhash64({k}, text_sha256), {cells}L) & 63))"))
    return rows


def repeated_cells(rows: DataFrame, name: str) -> DataFrame:
    """Pass one: the words of one table with a bit for every cell that two rows or more hit."""
    return (rows.groupBy(f"word_{name}", f"bit_{name}").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            .groupBy(f"word_{name}").agg(F.bit_or(f"bit_{name}").alias(f"seen_{name}")))


def suspects(rows: DataFrame, total: int) -> DataFrame:
    """Pass two: rows (with text_sha256) and `suspect`, true where both of the row's cells were hit twice."""
    words = max(1, -(-total * CELLS_PER_ROW // 64))
    rows = with_cells(rows, words * 64)
    slim = rows.select(*(f"{c}_{n}" for n in PASSES for c in ("word", "bit")))
    hit = F.lit(True)
    for name in PASSES:
        table = repeated_cells(slim, name)
        table = F.broadcast(table) if words <= BROADCAST_WORDS else table
        rows = rows.join(table, f"word_{name}", "left")
        hit = hit & ((F.coalesce(F.col(f"seen_{name}"), F.lit(0)).bitwiseAND(F.col(f"bit_{name}"))) != 0)
    return rows.withColumn("suspect", hit).drop(*(f"{c}_{n}" for n in PASSES for c in ("word", "bit", "seen")))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, one row per document."""
    # rows with equal id, length and text differ in their number alone, which is stored: a later read may split anew
    rows = cut_lineage(fingerprints(docs).withColumn("number", F.monotonically_increasing_id()), "fingerprints")
    tested = suspects(rows, rows.count())
    alone = tested.where(~F.col("suspect")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    again = tested.where("suspect")
    order = F.struct("chars", F.coalesce(-F.col("doc_id"), F.lit(-(1 << 63))).alias("first"),
                     (-F.col("number")).alias("row"), "doc_id")
    best = (again.groupBy("text_sha256").agg(F.max(order).alias("best"), F.count(F.lit(1)).alias("group_size")))
    grouped = again.join(best, "text_sha256").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("number") == -F.col("best.row")).alias("kept"), "text_sha256")
    return alone.unionByName(grouped)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns. Only suspects' keys shuffle; texts stay where they are
    read unless the row is a suspect."""
    text = F.col("text").cast("string")
    own = {c: f"row_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items()),
                       F.col("doc_id").cast("long").alias("doc_id"),
                       F.length(F.coalesce(text, F.lit(""))).alias("chars"),
                       F.sha2(normal_text(text).cast("binary"), 256).alias("text_sha256"))
    rows = cut_lineage(rows.withColumn("number", F.monotonically_increasing_id()), "texts")
    back = [F.col(n).alias(c) for c, n in own.items()]
    tested = suspects(rows, rows.count())
    order = F.struct("chars", F.coalesce(-F.col("doc_id"), F.lit(-(1 << 63))).alias("first"),
                     (-F.col("number")).alias("row"))
    best = (tested.where("suspect").groupBy("text_sha256").agg(F.max(order).alias("best"))
            .select((-F.col("best.row")).alias("number")))
    return (tested.where(~F.col("suspect")).select(*back)
            .unionByName(tested.where("suspect").join(best, "number", "left_semi").select(*back)))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256,
         row_number() OVER () AS number
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST, number)
"""
