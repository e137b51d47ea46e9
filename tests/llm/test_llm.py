"""The training-data operators against the libraries, brute force and round trips, on odd rows."""

import glob
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from nearmiss.llm import (bpe_pairs, exact_dedup, jaccard_join, language_id, license_scan, packing, quality_rules,
                          token_counts, toxicity, training_order)
from nearmiss.llm.common import tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
NEAR = [f"word{i}" for i in range(200)]
ODD = [
    (1, None, "en", None, None, None, None), (2, "", None, "s", 0, 1.0, "k"), (3, "  \n\t ", "en", "s", 5, None, None),
    (4, "I'll  say <|endoftext|> 'tis　日本語 😀 x́\n\nStraße ΣΑΣ 1234²", "de", "s", 1, None, None),
    (5, LONG, "en", "s", len(LONG), None, None), (5, LONG, "en", "s", len(LONG), None, None),
    (6, "a b", "fr", "s", 3, None, None), (7, "a  b", "fr", "s", 4, None, None), (8, "ab", "fr", "s", 2, None, None),
    (9, " ".join(NEAR), "en", "s", 9, None, None), (10, " ".join([*NEAR, "more"]), "en", "s", 9, None, None),
    (11, " ".join([*NEAR, "other", "words"]), "en", "s", 9, None, None), (None, "Released under the MIT License!", "en", "s", 9, None, None),
    (12, "x. " * 60 + "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0. " + "y " * 40, "es", "s", 9, None, None),
    (13, "x" * 30_000, "en", "s", 30_000, None, None), (14, "<|startoftext|>Hello<|endoftext|>'s<|endof", "en", "s", 1, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def marks(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def bytes_tok():
    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def test_prefix_counts_are_exact(odd, docs, none, bytes_tok):
    rows = token_counts.token_counts(odd.where("doc_id != 13 and doc_id != 5"), store=True).collect()
    texts = {r[0]: r[1] or "" for r in ODD}
    for r in rows:
        text, table = texts[r["doc_id"]], np.frombuffer(r["prefix_counts"], "<i4")
        assert table.tolist() == [len(ids_of(bytes_tok, text[:i + 1])) for i in range(len(text))]
        assert r["n_bytes"] == len(text.encode())
    got = Counter(tuple(r)[:4] for r in token_counts.token_counts(odd.unionByName(docs, allowMissingColumns=True)).collect())
    every = [(r[0], r[1] or "") for r in ODD] + [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = Counter()
    for k, t in every:
        n = len(ids_of(bytes_tok, t))
        want[(k, len(t.encode()), n, n > 1024)] += 1
    assert got == want
    assert token_counts.token_counts(none).count() == 0


def test_budget_questions_need_no_encoding(bytes_tok):
    text = LONG[:3000]
    table = token_counts.prefix_table(token_counts.counter(tokenizer_path("byte_bpe_50k.json")).of(text))
    cut = token_counts.longest_prefix(table, 100)
    assert len(ids_of(bytes_tok, text[:cut])) <= 100 < min(len(ids_of(bytes_tok, text[:i])) for i in range(cut + 1, cut + 9))
    assert token_counts.tokens_of_prefix(table, 50) == len(ids_of(bytes_tok, text[:50]))


def brute_statistics(text):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))


def test_quality_statistics_and_verdict(odd, docs, none, marks):
    both = docs.unionByName(odd.select(*docs.columns))
    got = Counter((r["doc_id"], *tuple(r)[1:7]) for r in quality_rules.quality(both, marks).collect())
    want = Counter()
    for r in both.collect():
        s = brute_statistics(r["text"])
        want[(r["doc_id"], *s, s[0] < 50 or 100 * s[4] > 50 * s[0])] += 1
    assert got == want
    assert quality_rules.quality(none, marks).count() == 0
    kept = quality_rules.keep_good(odd, marks)
    assert kept.columns == odd.columns and {1, 2, 3} & {r["doc_id"] for r in kept.collect()} == set()


def test_quality_finds_bad_rows_and_keeps_good_ones(spark):
    sf = "/root/testdata/sf0.1"
    marks = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_rules.op3_quality_rules(spark, sf).where("not base_failed").join(marks, "doc_id")
    rate = {r["quality"]: r["kept"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rate[1] > 0.99 and rate[0] < 0.2


def test_forest_scores_the_isolated_row_highest():
    x = np.random.default_rng(0).normal(size=(500, 7))
    x[7] = 9.0
    assert quality_rules.grow(x, 50, 128, 1).score(x).argmax() == 7


def test_toxicity_held_out(spark, odd, none):
    from ranks import auc
    sf = "/root/testdata/sf0.1"
    marks = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.op4_toxicity(spark, sf).where("held_out").join(marks, "doc_id").select("score", "toxic").toPandas()
    assert auc(got["score"].to_numpy(), got["toxic"].to_numpy()) > 0.95
    rows = toxicity.toxicity(odd, marks).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxicity(none, marks).count() == 0


def test_toxicity_held_out_with_few_labels(spark):
    from ranks import auc
    sf = "/root/testdata/sf0.01"
    marks = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.op4_toxicity(spark, sf).where("held_out").join(marks, "doc_id").toPandas()
    assert auc(got["score"].to_numpy(), got["toxic"].to_numpy()) > 0.9
    assert got["predicted"].sum() > 0 and got[got["predicted"] == 1]["toxic"].mean() > 0.8


def test_word_weights_need_no_number_of_documents():
    assert toxicity.weight(0, 17, 0.13) > 3 and toxicity.weight(0, 17, 0.001) > 3 and toxicity.weight(0, 17, 0.5) > 3
    assert 0 < toxicity.weight(0, 3, 0.13) < toxicity.weight(0, 5, 0.13) < toxicity.weight(0, 9, 0.13)
    assert toxicity.weight(0, 1, 0.13) == toxicity.weight(1, 0, 0.13) == toxicity.weight(87, 13, 0.13) == 0
    assert toxicity.weight(17, 0, 0.5) == pytest.approx(-toxicity.weight(0, 17, 0.5))


def test_lattice_restores_words(spark, docs):
    texts = spark.createDataFrame([(i, "you idiot and stupid people " * 30) for i in range(20)], "doc_id long, text string")
    decoder = toxicity.Decoder(toxicity.trigram_model(toxicity.letter_counts(texts)))
    for said in ("1d10t", "idi0t", "idiooooot", "i-d-i-o-t", "i d i o t", "!diot"):
        assert "idiot" in decoder.words(f"what {said} here"), said
    assert decoder.words("Plain words 42") == {"plain", "words", "42"}


def test_lattice_restores_gaps_doubles_and_closing_signs(spark):
    text = "such a stupid person is an idiot and i said hello to the dumbass who is well known "
    texts = spark.createDataFrame([(i, text * 30) for i in range(20)], "doc_id long, text string")
    decoder = toxicity.Decoder(toxicity.trigram_model(toxicity.letter_counts(texts)))
    for said in ("i  d  i  o  t", "i - d - i - o - t", "i--d--i--o--t", "i . d . i . o . t", "idiiot", "iidiot", "id--iot", "1diiot"):
        assert "idiot" in decoder.words(f"the {said}"), said
    assert {"a", "stupid", "person"} <= decoder.words("such a s t u p i d person")
    assert {"i", "stupid"} <= decoder.words("and i s t u p i d")
    assert {"stupid", "idiot"} <= decoder.words("you s t u p i d i d i o t")
    assert "stupid" in decoder.words("so stuupid") and "stupid" in decoder.words("so stupid$$$")
    assert "dumbass" in decoder.words("the dumba$$") and "dumbass" in decoder.words("the dumba$$$")
    assert decoder.words("said hello, well-known") == {"said", "hello", "well", "known"}


def test_language_held_out_and_odd_rows(docs, odd, none):
    got = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    said = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.language_id(odd).collect()}
    assert said[1] == said[2] == said[3] == ("und", 0.0) and len(said) == len({r[0] for r in ODD})
    assert language_id.language_id(none).count() == 0
    kept = language_id.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_language_stage_rejects_what_fits_no_profile(spark, docs):
    rng = np.random.default_rng(5)
    junk = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(n)) for n in (60, 300)]
    finnish = ("Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja "
               "omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.")
    texts = [*junk, finnish, "Все люди рождаются свободными и равными в своём достоинстве"]
    columns = docs.columns
    more = spark.createDataFrame([(10 ** 6 + i, t, None, "s", len(t)) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long").select(columns)
    both = docs.unionByName(more)
    assert {r["doc_id"] for r in language_id.keep_known(both).collect()} == {r["doc_id"] for r in docs.collect()}
    # nothing to learn from: all texts with a letter are passed on
    unknown = both.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.keep_known(unknown).count() == both.count()


def test_profile_ranks_match_brute_force():
    words = language_id.words_of("the cat and the other cat ate the rat")
    count = Counter()
    for w, n in words.items():
        p = f"_{w}_"
        for k in (1, 2, 3):
            for i in range(len(p) - k + 1):
                if p[i:i + k] != "_":
                    count[p[i:i + k]] += n
    want = [g for g, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))]
    code = lambda g: sum(ord(c) << s for c, s in zip(g, (42, 21, 0), strict=False))
    assert language_id.ranked(words, 300).tolist() == [code(g) for g in want]


def test_exact_dedup_odd_rows(odd, none):
    rows = exact_dedup.exact_dedup(odd).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert by[8]["keep_id"] == by[6]["keep_id"] == 7 and by[6]["group_size"] == 3 and by[1]["keep_id"] == 3
    assert sum(r["kept"] for r in rows if r["doc_id"] == 5) == 1
    assert by[6]["text_sha256"] == hashlib.sha256(b"ab").hexdigest()
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in rows if r["kept"])
    assert exact_dedup.drop_copies(none).count() == 0


def test_bloom_passes_lose_no_copy(spark):
    rows = spark.range(5000).select(F.sha2(F.format_string("%d", F.col("id") % 4900), 256).alias("text_sha256"))
    tested = exact_dedup.suspects(rows, 5000).groupBy("text_sha256").agg(F.count("*").alias("n"), F.min("suspect").alias("s"))
    assert tested.where("n > 1 and not s").count() == 0 and tested.where("n = 1 and s").count() < 250


def test_jaccard_join_blocks_and_odd_rows(spark, odd, none):
    rows = {r["doc_id"]: r for r in jaccard_join.jaccard_join(odd).collect()}
    assert rows[9]["n_links"] == rows[10]["n_links"] == rows[11]["n_links"] == 2
    assert {rows[k]["component_id"] for k in (9, 10, 11)} == {9} and rows[1]["n_links"] == 0
    assert rows[6]["class_id"] == rows[7]["class_id"] == 6
    assert jaccard_join.jaccard_join(none).count() == 0
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, 4, 5, 6, 8, 9, None, 12, 13, 14])


def test_large_group_over_blocks_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(120)]
    texts = []
    for i in range(90):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 4), replace=False):
            words[at] = f"n{rng.integers(5)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    distinct = set(sets)
    monkeypatch.setattr(jaccard_join.links, "__defaults__", (16,))
    for r in jaccard_join.jaccard_join(docs).collect():
        s = sets[r["doc_id"]]
        near = [o for o in distinct if o != s and 5 * len(o & s) >= 4 * len(o | s)]
        assert r["n_links"] == len(near) and r["class_id"] == sets.index(s)


def test_pruning_bounds():
    assert jaccard_join.LEAST[0][0] == 16 and all(m <= n * 0.8 for n, m in jaccard_join.LEAST)


def test_shards_round_trip(spark, docs, odd, none, bytes_tok, tmp_path):
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    path = str(tmp_path / "shards")
    index = training_order.materialise(both, path, tokens=64, shard_rows=500).collect()
    n = len(index)
    assert sorted(r["slot"] for r in index) == list(range(n))
    files = {int(f.split("shard=")[1].split("/")[0]): f for f in glob.glob(f"{path}/shard=*/*.txt")}
    assert len(files) == -(-n // 500) == len(glob.glob(f"{path}/shard=*/*.txt"))
    raw = {k: open(f, "rb").read() for k, f in files.items()}
    assert all(len(v) % training_order.stride(64) == 0 for v in raw.values())
    for r in index:
        ids = training_order.read_record(raw[r["shard"]][r["byte_offset"]:], 0, 64)
        assert len(ids) == r["length"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
    total = sum(len(ids_of(bytes_tok, r["text"])) + 1 for r in both.collect())
    assert sum(r["length"] for r in index) == total
    assert training_order.materialise(none, str(tmp_path / "none"), tokens=64).count() == 0


def test_packed_ids_are_small_and_come_back_whole():
    rnd = np.random.default_rng(4)
    order = rnd.permutation(1 << 16).astype("<u2")
    packing = training_order.Packing(order)
    for ids in (np.arange(1 << 16), np.zeros(0, int), order[:300], order[-3:], rnd.integers(0, 1 << 16, 5000)):
        raw = np.asarray(ids).astype("<u2").tobytes()
        assert packing.unpack(packing.pack(raw)) == raw
    often = order[np.minimum(rnd.geometric(0.004, 2048), 1 << 15)].astype("<u2").tobytes()
    assert len(packing.pack(often)) < 0.85 * len(training_order.zstandard.ZstdCompressor(level=3).compress(often))


def test_common_ids_come_first(spark, docs, none):
    order = training_order.common_ids(docs)
    assert sorted(order.tolist()) == list(range(1 << 16)) == training_order.common_ids(none).tolist()


def test_row_numbers_are_stored(spark, docs, tmp_path, monkeypatch):
    """Each stored intermediate is read with a number that does not depend on how its files are split."""
    from nearmiss.llm import common
    many = docs.repartition(7)

    def numbers_in_plan(df):
        return "monotonically_increasing_id" in df._jdf.queryExecution().optimizedPlan().toString()

    for module in (training_order, exact_dedup, jaccard_join, license_scan):
        stored = {}

        def keep(df, name, stored=stored):
            stored[name] = df.columns
            return common.cut_lineage(df, name)

        monkeypatch.setattr(module, "cut_lineage", keep)
        if module is training_order:
            out = training_order.materialise(many, str(tmp_path / "shards"), tokens=64, shard_rows=500)
            assert "own" in stored["sequences"] and not numbers_in_plan(out)
        elif module is exact_dedup:
            assert not numbers_in_plan(exact_dedup.exact_dedup(many)) and not numbers_in_plan(exact_dedup.drop_copies(many))
            assert "number" in stored["fingerprints"] and "number" in stored["texts"]
        elif module is jaccard_join:
            assert not numbers_in_plan(jaccard_join.keep_one(many)) and "doc_id" in stored["rows"]
        else:
            license_scan.scan(many)
            assert "row" in stored["hits"]


def test_slots_do_not_depend_on_file_splits(spark, docs):
    rows = training_order.sequences(docs.repartition(3), tokens=64).withColumn("own", F.monotonically_increasing_id())
    stored = training_order.cut_lineage(rows, "sequences")
    said = []
    for size in ("128m", "20k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            said.append(sorted((r["ids_crc32"], r["slot"]) for r in training_order.in_order(stored).select("ids_crc32", "slot").collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert said[0] == said[1] and sorted(s for _, s in said[0]) == list(range(len(said[0])))


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(training_order.feistel(np.arange(n), n).tolist()) == list(range(n))
    assert training_order.feistel(np.arange(1000), 1000, 1).tolist() != training_order.feistel(np.arange(1000), 1000, 2).tolist()


def test_packing_is_whole_and_tight(docs, odd, none, bytes_tok):
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = packing.pack(both).collect()
    want = Counter()
    for r in both.collect():
        ids = [*ids_of(bytes_tok, r["text"]), 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert [p[0] for p in places] == [sum(x[1] for x in places[:i]) for i in range(len(places))]
        assert sum(p[1] for p in places) <= 2048
    assert len(by) <= 1.02 * sum(r["length"] for r in rows) / 2048 + 2
    assert packing.pack(none).count() == 0


def test_packing_keeps_every_capacity():
    lengths = np.random.default_rng(1).integers(1, 400, 500)
    cap = packing.Capacity(1000, 4, 200_000)
    seq, _ = packing.best_fit(lengths, cap)
    for s in np.unique(seq):
        own = lengths[seq == s]
        assert own.sum() <= 1000 and len(own) <= 4 and (own ** 2).sum() <= 200_000


def test_pair_index_equals_the_library(docs, odd, none):
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = Counter()
    for r in both.collect():
        ids = ids_of(tok, r["text"])
        said = tok.decode(ids, skip_special_tokens=False)
        want[(r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
              hashlib.sha256(said.encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe_pairs.encode(both).collect())) == want
    assert bpe_pairs.encode(none).count() == 0


def test_merges_in_rank_order_within_each_word():
    # (a b) makes 5 late, although (5 c) ranks first of all: it must wait for no other place of (a b)
    ranks = {(1, 2): (5, 5), (5, 3): (0, 6), (2, 1): (1, 7)}
    assert bpe_pairs.merge_words([[1, 2, 3], [1, 2, 1, 2, 3], [], [4]], ranks)[0] == [6]


def test_license_scan_odd_rows(odd, none):
    got = sorted((r["doc_id"] or 0, r["template"], r["containment"]) for r in license_scan.scan(odd).collect())
    assert got == [(0, "MIT", 1.0), (12, "CC-BY-NC-4.0", 1.0)]
    assert license_scan.scan(none).count() == 0


def test_pipeline_stages_keep_columns_and_clean_rows(spark, docs):
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
    from compare import duck
    rows = duck(SF).execute(exact_dedup.OP6_SQL).fetchall()
    texts = {r[0] for r in rows if r[3]}
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} <= texts
