"""Keyed tables that rewrite touched folders only, and the first arrivals of a stream."""

import os

import pytest
from pyspark.sql import functions as F

from labelmill.streaming import dedupe, expiry, ingest, keyed
from tests.conftest import values

SCHEMA = "k string, v long, at long"


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def table(spark, path, buckets=8):
    return keyed.KeyedTable(spark, str(path), rows(spark).schema, ["k"], ["at"], buckets)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_batches_rewrite_the_folders_they_touch(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().count() == 0
    t.upsert(rows(spark, *((f"k{i}", i, 1) for i in range(100))), 0)
    before = files(tmp_path / "data")
    touched = t.upsert(rows(spark, ("k3", 33, 2), ("new", 1, 1)), 1)
    assert 1 <= len(touched) <= 2
    after = files(tmp_path / "data")
    assert before.items() <= after.items()  # nothing is changed in place
    assert {f for f in after if f not in before} == {f for f in after if "batch_id=1" in f}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in after if f not in before} == set(touched)
    found = {r[0]: r[1] for r in values(t.read())}
    assert found == {**{f"k{i}": i for i in range(100)}, "k3": 33, "new": 1}
    # the folders that batch 1 replaced go with the next batch, all others stay
    t.upsert(rows(spark, ("k3", 34, 3)), 2)
    gone = set(after) - set(files(tmp_path / "data"))
    assert gone and all("batch_id=0" in f and int(f.split("bucket=")[1].split("/")[0]) in touched for f in gone)
    assert {r[0]: r[1] for r in values(t.read())} == {**found, "k3": 34}


def test_order_and_ties(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(rows(spark, ("a", 1, 5), ("a", 2, 4), ("b", 1, 1), (None, 1, 1), ("c", 1, None)), 0)
    t.upsert(rows(spark, ("a", 3, 4), ("b", 2, 1), (None, 2, 2), ("c", 2, 0)), 1)
    assert sorted(values(t.read()), key=str) == sorted([("a", 1, 5), ("b", 2, 1), (None, 2, 2), ("c", 2, 0)], key=str)
    assert values(t.lookup("a")) == [("a", 1, 5)] and values(t.lookup(None)) == [(None, 2, 2)] and values(t.lookup("zz")) == []
    assert len(t.lookup("a").inputFiles()) < len(t.read().inputFiles())
    assert t.upsert(rows(spark), 2) == [] and t.read().count() == 4
    with pytest.raises(ValueError):
        keyed.KeyedTable(spark, "x", spark.createDataFrame([], "bucket int").schema, ["bucket"], [])


def test_a_repeated_batch_changes_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.upsert(rows(spark, ("a", 1, 1), ("b", 1, 1)), 0)
    second = rows(spark, ("a", 2, 2), ("c", 1, 1))
    # it fails after its data, before its manifest: readers do not see it
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        t.upsert(second, 1)
    monkeypatch.undo()
    assert sorted(values(t.read())) == [("a", 1, 1), ("b", 1, 1)]
    for _ in range(2):
        t.upsert(second, 1)
        assert sorted(values(t.read())) == [("a", 2, 2), ("b", 1, 1), ("c", 1, 1)]


def test_upsert_stream_resumes(spark, tmp_path):
    t, source = table(spark, tmp_path / "t"), str(tmp_path / "in")
    for n in range(3):
        rows(spark, ("a", n, n), (f"k{n}", n, n)).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        ingest.upsert_stream(stream, t, str(tmp_path / "check")).awaitTermination()
        assert sorted(values(t.read())) == sorted([("a", n, n), *((f"k{i}", i, i) for i in range(n + 1))])


def test_first_arrivals(spark, tmp_path):
    source, target, check = (str(tmp_path / c) for c in ("in", "out", "check"))
    batches = [
        [("a", 1, "2024-01-01"), ("b", 1, "2024-01-10")],
        [("a", 2, "2024-01-02"), ("b", 2, "2024-01-10"), ("c", 1, "2024-01-08")],  # a: forgotten and too late, b: repeated
        [("c", 2, "2024-01-12"), ("d", 1, "2024-01-20")],
        [("b", 3, "2024-01-19"), ("late", 1, "2024-01-02")],  # b: remembered no longer
    ]
    for batch in batches:
        df = spark.createDataFrame(batch, "k string, v long, day string").withColumn("ts", F.to_timestamp("day"))
        df.select("k", "v", "ts").write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, v long, ts timestamp").parquet(source)
        dedupe.run_once(dedupe.first_arrivals(stream, ["k"], "ts", "5 days"), target, check).awaitTermination()
    found = sorted(values(spark.read.parquet(target), "k", "v"))
    assert found == [("a", 1), ("b", 1), ("b", 3), ("c", 1), ("d", 1)]


def test_state_forgets_what_has_expired(spark, tmp_path):
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    hour = lambda n: f"2024-01-{1 + n // 24:02} {n % 24:02}:00:00"
    batches = [
        [(f"k{i}", i, hour(0), i) for i in range(50)] + [("late", 1, hour(9), 1), (None, 3, hour(9), None)],
        [("k1", 60, hour(9), 61), ("k2", 0, hour(0), 99), ("late", 0, hour(8), 0)],  # k2: a smaller tie
        [("k3", 70, hour(11), 71), ("new", 71, hour(30), 72)],
        [("k4", 72, hour(31), 73), ("late", 2, hour(23), 2), ("gone", 1, hour(20), 1)],
    ]
    sizes, changes, table = [], None, None
    for batch in batches:
        df = spark.createDataFrame(batch, "k string, n long, hour string, v long").withColumn("ts", F.to_timestamp("hour")).drop("hour")
        df.select("k", "n", "ts", "v").write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, n long, ts timestamp, v long").parquet(source)
        changes = expiry.live_changes(stream, ["k"], "ts", "n", 8, lag_hours=1)
        table = keyed.KeyedTable(spark, str(tmp_path / "t"), changes.schema, ["k"], ["ts", "n"], 4)
        run = ingest.upsert_stream(changes, table, check, "update")
        run.awaitTermination()
        sizes.append(run.lastProgress["stateOperators"][0]["numRowsTotal"])
    # the clock is 30 at last: rows from 22 on live
    assert sorted(values(table.read().filter("live"), "k", "n", "v"), key=str) == [("k4", 72, 73), ("late", 2, 2), ("new", 71, 72)]
    assert table.read().filter("NOT live").count() == 50
    assert sizes[0] == 52 and sizes[-1] == 3
