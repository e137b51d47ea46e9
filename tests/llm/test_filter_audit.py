"""Filter audit against plain Python over all orders and DuckDB; tries and adaptive prefixes on their own."""

import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest

from nearmiss.llm import filter_audit
from nearmiss.llm.filter_audit import TextTrie, by_prefix, failed_filters, local_tries

GOOD = " ".join(f"word{i}" for i in range(60))
HOT = "the same " * 40
ROWS = [
    (1, None, "a"), (2, "", "a"), (3, None, None), (4, GOOD, "a"), (5, GOOD, "b"), (5, GOOD, "b"), (6, GOOD + "!", "b"),
    (7, GOOD.upper(), ""), (8, GOOD + " #", "a"), (9, "a b " * 40, "a"), (10, "é" * 30 + " ÀÉ" * 60, "c"), (None, GOOD, "a"),
    (None, "", "a"), (4, GOOD, "b"), (3, GOOD, "c"), (11, GOOD[:-1], "a"), (12, GOOD + "\x00", "a"), (13, "w " * 30_000, "a"),
    (14, "w " * 30_000 + "x", "a"), (15, "x y" * 20_000, "c"), (-5, GOOD + "!", "c"), (16, " " * 60 + "A", "a"),
] + [(100 + i, HOT, "hot") for i in range(60, 0, -1)]
MARKS = [(4, 1, 0), (4, 0, 1), (5, 1, 1), (6, None, 1), (8, 1, 0), (101, 1, 0), (102, 1, 1), (None, 1, 1), (999, 1, 1)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("audit"))
    rows = [(*r, 1, "x") for r in ROWS]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n int, part string").repartition(3).write.parquet(
        f"{path}/documents.parquet")
    spark.createDataFrame([(*m, 1) for m in MARKS], "doc_id long, quality int, toxic int, n int").write.parquet(f"{path}/labels.parquet")
    return path


def brute_masks():
    least = {}
    for i, t, _ in ROWS:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, s in ROWS:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": i is not None and i > least[t]}
        out.append((i, s or "", {c for c, f in fails.items() if f}))
    return out


def brute_audit():
    good = {i for i, q, _ in MARKS if q == 1 and i is not None}
    toxic = {i for i, _, t in MARKS if t == 1 and i is not None}
    rows, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for step, own in enumerate(order, 1):
            past = set(order[:step - 1])
            for i, part, fails in brute_masks():
                r = rows.setdefault((part, order, step), Counter())
                first = own in fails and not fails & past
                r["kept"] += not fails & (past | {own})
                r["removed"] += first
                r["redundant"] += own in fails and bool(fails & past)
                r["unique_fails"] += fails == {own}
                r["good_lost"] += first and i in good
                r["toxic_lost"] += first and i in toxic
                shapley[part, own] += first
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return Counter((p, o, s, *(int(r[n]) for n in names), shapley[p, o[s - 1]]) for (p, o, s), r in rows.items())


def test_audit_is_that_of_plain_python_and_sql(spark, folder):
    got = Counter(tuple(r) for r in filter_audit.op12_filter_audit(spark, folder).collect())
    assert got == brute_audit()
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    assert got == Counter(con.execute(filter_audit.OP12_SQL).fetchall())


def test_adaptive_ranges_change_nothing(spark, folder):
    want = Counter((i, p, sum(1 << "ABCDE".index(c) for c in f)) for i, p, f in brute_masks())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for size in (300, 1 << 20):
        got = Counter()
        for r in failed_filters(docs, size).collect():
            got[r.doc_id, r.part, r.mask] += r.n
        assert got == want


def test_equal_texts_meet_in_one_range_and_ranges_are_even(spark):
    texts = [f"{'common beginning ' * 20}{i * 7919 % 1000:04}" for i in range(1000)] + [f"{i} tail" for i in range(200)]
    rows = spark.createDataFrame([(t.encode(), 1) for t in texts * 3], "text binary, n int")
    from pyspark.sql import functions as F
    dealt = by_prefix(rows, 100_000).select("text", F.spark_partition_id().alias("p")).collect()
    places = {}
    for text, p in dealt:
        places.setdefault(text, set()).add(p)
    assert all(len(p) == 1 for p in places.values())
    sizes = Counter(p for _, p in dealt)
    assert len(sizes) >= 8 and max(sizes.values()) < 3 * len(dealt) / len(sizes)


def test_trie_finds_every_text():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(12))).encode() for _ in range(3000)] + [b"", b"\xff" * 5000, b"\xff" * 4999]
    trie, least, decided = TextTrie(), {}, Counter()
    for n, text in enumerate(texts):
        doc_id = rng.randrange(500)
        least.setdefault(text, []).append(doc_id)
        for row in trie.add(text, doc_id, "p", 0, 1):
            decided[row[1]] += row[4]
    rows = list(trie.rows(True))
    assert {r[0]: r[1] for r in rows} == {t: min(ids) for t, ids in least.items()} and len(rows) == len(least)
    assert sum(decided.values()) + sum(r[4] for r in rows) == len(texts)
    assert decided == Counter(i for ids in least.values() for i in ids if i > min(ids))


def test_hot_text_leaves_one_row_a_task():
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000, 0, -1)), "part": ["s"] * 1000, "text": [b"hot"] * 1000})
    out = pa.Table.from_batches(local_tries(iter([batch, batch]))).to_pylist()
    assert [(r["doc_id"], r["n"]) for r in out if r["text"] is not None] == [(1, 2)]
    assert sum(r["n"] for r in out) == 2000


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filter_audit.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
