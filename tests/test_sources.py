"""Unreadable files are set aside whole, and no event lies in two chunks."""

import gzip

from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameReader

from nearmiss.sources import telemetry as tl

SCHEMA = "timestamp LONG, speed DOUBLE"


def test_files_not_read_to_their_end_are_set_aside_whole(spark, tmp_path):
    body = "".join(f"{i * 100},{i % 37 * 1.5}\n" for i in range(4000))
    whole = ("vtti.timestamp,vtti.speed\n" + body).encode()
    packed = gzip.compress(whole)
    (tmp_path / "trip_1.csv").write_bytes(whole)
    (tmp_path / "trip_2.csv").write_bytes(whole.replace(b"\n", b"\r\n")[:-2])       # other line ends, none at the end
    (tmp_path / "trip_3.csv.gz").write_bytes(packed)
    (tmp_path / "trip_4.csv.gz").write_bytes(packed[:len(packed) // 2])             # cut off
    (tmp_path / "trip_6.csv").write_bytes(b"t,s\n1,2.0\n\n3,x\n4,5.0\xff\n")
    (tmp_path / "trip_7.csv.gz").write_bytes(packed[:200] + b"\0" * 50 + packed[250:])  # damaged inside
    good, bad, unread = tl.read_telemetry(spark, str(tmp_path), SCHEMA)
    assert {r["event_id"]: r["n"] for r in good.groupBy("event_id").agg(F.count("*").alias("n")).collect()} == {
        1: 4000, 2: 4000, 3: 4000, 6: 1}
    assert {r["event_id"] for r in bad.select("event_id").distinct().collect()} == {6}
    assert {(r["event_id"], r["note"]) for r in unread.collect()} == {(e, "file reading error") for e in (4, 7)}
    assert good.agg(F.max("timestamp")).head()[0] == 399900


def test_chunks_hold_whole_events_also_with_a_hot_one(spark, tmp_path):
    rows = [("a", e, k) for e in range(0, 70, 2) for k in range(3)] + [("b", 5, k) for k in range(3000)]
    rows += [("b", 10**15 * e, 0) for e in range(1, 12)] + [(None, 1, 0), ("a", None, 0)]
    df = spark.createDataFrame(rows, "event_category string, event_id long, k long")
    got = {(r["event_category"], r["event_id"], r["k"]): r["chunk"] for r in tl.event_chunks(df, size=10).collect()}
    assert len(got) == len(rows)
    for cat in ("a", "b", None):
        ids = sorted({e for c, e, _ in rows if c == cat}, key=lambda e: (e is not None, e))
        for c, e, k in rows:
            if c == cat:
                assert got[c, e, k] == ids.index(e) // 10
    tl.write_chunks(df, str(tmp_path / "out"), size=10)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows)
    assert back.groupBy("event_category", "event_id").agg(F.count_distinct("chunk").alias("n")).where("n > 1").isEmpty()
    assert tl.event_chunks(df.limit(0)).isEmpty()


def test_target_ids_are_numbered_from_stored_keys(spark, monkeypatch):
    from nearmiss.operators import tracks
    rows = [(sc, o, t / 10) for sc in (7, 3, None) for o in range(3) for t in range(o, 4)] + [(3, 9, 5.0)]
    objects = spark.createDataFrame(rows, "scenario long, object_id int, time double").withColumn("x", F.col("time") + F.col("object_id"))
    seen, number = [], tracks.number_ranges
    monkeypatch.setattr(tracks, "number_ranges", lambda df, *a, **k: seen.append(df) or number(df, *a, **k))
    got = {(r["scenario"], r["target_id"], r["time"], r["x_ego"], r["x_sur"]) for r in tl.scenario_pairs(objects).collect()}
    assert got == {(sc, 2 * i + o - 1, t / 10, t / 10, t / 10 + o) for i, sc in enumerate((3, 7)) for o in (1, 2) for t in range(o, 4)}
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_parsed_once_and_folders_listed_once_a_reader(spark, tmp_path, monkeypatch):
    (tmp_path / "trip_1.csv").write_text("t,s\n1,2.0\n2,x\n3,4.5\n")
    (tmp_path / "trip_2.csv").write_text("5,6.0\n")
    listed = []
    for name in ("load", "text"):
        monkeypatch.setattr(DataFrameReader, name, lambda self, *a, _f=getattr(DataFrameReader, name), **k: listed.append(a) or _f(self, *a, **k))
    good, bad, unread = tl.read_telemetry(spark, str(tmp_path), "timestamp LONG, speed DOUBLE")
    assert len([a for a in listed if a == (str(tmp_path),)]) == 2
    for rows in (good, bad):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_csv") == 1
    assert {tuple(r) for r in good.collect()} == {(1, 1, 2.0), (1, 3, 4.5), (2, 5, 6.0)} and good.columns == ["event_id", "timestamp", "speed"]
    assert [tuple(r) for r in bad.collect()] == [(1, "2,x")] and unread.isEmpty()
    assert good.groupBy().agg(F.sum("speed")).head()[0] == 12.5
