"""Ordered and join operators against brute force, with one hot key."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmill.operators import joins, ordered
from labelmill.operators.grams import GramIndex
from labelmill.sources import derived
from tests.conftest import values


def _rows(n=600):
    rng = random.Random(7)
    return [(("hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}"), i * 3, rng.randrange(4)) for i in rng.sample(range(5000), n)]


def test_number_rows_matches_global_sort(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, seq bigint, score int")
    got = ordered.number_rows(df, ["k"], [-F.col("score")], "seq", "rn", span=128).collect()
    expected = {}
    for k in {r[0] for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1])), 1):
            expected[(k, r[1])] = i
    assert {(r.k, r.seq): r.rn for r in got} == expected


def test_previous_value_crosses_spans(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, seq bigint, score int")
    got = {(r.k, r.seq): r.prev for r in ordered.previous_value(df, "k", "seq", "prev", span=64).collect()}
    for k in {r[0] for r in rows}:
        seqs = sorted(r[1] for r in rows if r[0] == k)
        for before, now in zip([None, *seqs], seqs):
            assert got[(k, now)] == before


def test_first_and_last_per_key(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, seq bigint, score int")
    first = {r.k: r.seq for r in ordered.first_per_key(df, ["k"], [F.col("seq")]).collect()}
    last = {r.k: r.seq for r in ordered.last_per_key(df, ["k"], ["seq"]).collect()}
    for k in {r[0] for r in rows}:
        seqs = [r[1] for r in rows if r[0] == k]
        assert (first[k], last[k]) == (min(seqs), max(seqs))


def test_first_per_key_limits_before_the_shuffle(spark):
    df = spark.createDataFrame(_rows(50), "k string, seq bigint, score int")
    plan = ordered.first_per_key(df, ["k"], [F.col("seq")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_substring_pairs_is_exact(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc d") for _ in range(rng.randrange(0, 9))) for _ in range(150)] + ["aaaa", ""]
    needles = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 5))) for _ in range(60)] + ["aa", "zzz"]
    got = joins.substring_pairs(
        spark.createDataFrame([(n,) for n in needles], "n string"), "n", spark.createDataFrame([(t,) for t in texts], "t string"), "t"
    ).collect()
    assert sorted(map(tuple, got)) == sorted({(n, t) for n in needles for t in texts if n and n in t})


def test_salted_join_equals_join(spark):
    left = spark.createDataFrame(_rows(), "k string, seq bigint, score int")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    a = joins.salted_join(left, right, "k", ["seq"]).select("k", "seq", "n")
    b = left.join(right, "k").select("k", "seq", "n")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("span", [3, 50_000])
def test_gram_index_is_exact(spark, tmp_path, span):
    """However a common gram is dealt out, and over several batches of needles."""
    rng = np.random.default_rng(span)
    word = lambda n: "".join(rng.choice(list("ab é😀"), n))
    names = [word(rng.integers(0, 12)) for _ in range(120)] + ["aaaa", "aaaa", None, "", "x", "%_\\"]
    asked = [word(rng.integers(1, 5)) for _ in range(60)] + ["", None, "x", "aaa", "zz", "_", "\\", "aaaa"]
    index = GramIndex.build(spark.createDataFrame([(n,) for n in names], "name string").repartition(3), "name", str(tmp_path / "index"), span)
    for some in (asked[::2], asked[1::2], asked[:1], []):
        found = values(index.find(spark.createDataFrame([(a,) for a in some], "asked string"), "asked"))
        assert sorted(found) == sorted({(a, n) for a in some if a for n in names if n is not None and a in n})
    again = GramIndex(spark, str(tmp_path / "index"))
    assert again.counts.filter("parts > 1").count() > 0 or span > 3
    assert values(again.find(spark.createDataFrame([("x",)], "asked string"), "asked")) == [("x", "x")]
    folders = {f.split("shelf=")[1].split("/")[0] for f in again.postings.inputFiles()}
    assert len(folders) > 10


def test_line_items_share_no_more_tasks_than_the_session_has(spark, monkeypatch, tmp_path):
    """Tasks that gather the line items of labels grow in number with the table; labels stay the same."""
    spark.range(2000).selectExpr(
        "id % 30 AS l_partkey", "id * 700 AS l_orderkey", "int(id % 3) AS l_linenumber", "id % 7 AS l_suppkey",
        "double(id) AS l_extendedprice", "date '2024-01-01' AS l_shipdate",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    few = derived.label_lines(spark, str(tmp_path))
    monkeypatch.setattr(derived, "TASK_LINES", 100, raising=False)
    many = derived.label_lines(spark, str(tmp_path))
    assert many.rdd.getNumPartitions() == 20 > few.rdd.getNumPartitions()
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))
