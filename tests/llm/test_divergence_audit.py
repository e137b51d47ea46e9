"""Divergence audit against plain Python and DuckDB; refinement against counting every term."""

import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from nearmiss.llm import divergence_audit
from nearmiss.llm.divergence_audit import count_level, filter_table, kept_terms, terms

LONG = "x" * 70
ROWS = (
    [(i, f"Alpha beta{i % 3} ÄÖ gamma{i} the-The THE {LONG if i % 2 else ''} 9a9", "en", f"s{i % 3}") for i in range(30)]
    + [(i, "alpha alpha ab abc abcd abcde é\x7fè", "en", None) for i in range(12)]
    + [(i, "ab" * (i % 4) + " rare" + "é" * i, "fr", f"t{i % 2}") for i in range(9)]
    + [(i, "lone zwei zwei", "de", "only") for i in range(11)] + [(1, None, None, None), (1, "", None, ""), (2, "", None, "u"), (None, None, "xx", "a")]
    + [(7, "copy of a row", None, "u")] * 12 + [(8, "tie one two tie", "it", s) for s in "abc" for _ in range(10)]
)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("divergence"))
    spark.createDataFrame([(*r, 5, "k") for r in ROWS], "doc_id long, text string, lang string, source string, n int, key string") \
        .repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def brute(rows=ROWS, least=10):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups[lang].add(source)
        count[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        whole = shares(sum((count[lang, s] for s in sources), Counter()))
        own = {s: shares(count[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum((own[s][t] - own[o][t]) ** 2 // (own[s][t] + own[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            words = [(-((own[s][t] - whole[t]) ** 2 // (own[s][t] + whole[t])), t.encode()) for t in kept
                     if count[lang, s][t] and own[s][t] > whole[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(words)[:10])):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(items, 1)]
    return Counter(out)


def test_audit_is_that_of_plain_python_and_sql(spark, folder):
    got = Counter(tuple(r) for r in divergence_audit.op13_divergence_audit(spark, folder).collect())
    assert got == brute()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert got == Counter(con.execute(divergence_audit.OP13_SQL).fetchall())


def test_refinement_keeps_what_counting_every_term_keeps(spark, folder):
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")),
                       F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    want = Counter((r.lang, t) for r in rows.collect() for t in set(terms(bytes(r.text))))
    for bits in (1 << 24, 64):  # a full table follows every prefix and keeps the same terms
        got = {(r.lang, bytes(r.key)) for r in kept_terms(rows, 10, bits).select("lang", "key").collect()}
        assert got == {k for k, n in want.items() if n >= 10}
        assert ("en", LONG.encode()) in got


def test_rare_beginnings_are_discarded(spark):
    kept = spark.createDataFrame([("en", b"al"), ("en", b"be")], "lang string, key binary")
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "fr"], "source": ["s", "s"], "text": [b"alpha alpha bet al rare", b"alpha"]})
    rows = pa.Table.from_batches(count_level(2, 4, filter_table(kept))(iter([batch]))).to_pylist()
    assert {(r["lang"], r["key"], r["complete"], r["docs"], r["n"]) for r in rows} == {
        ("en", b"alph", False, 1, 1), ("en", b"bet", True, 1, 1)}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence_audit.divergence(none).count() == 0
