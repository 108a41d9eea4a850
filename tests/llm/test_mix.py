import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from compare import compare, connect
from labelmill.llm import poisson_mix as pm
from tests.conftest import SF_DIR


def plain_count(seed, key, rate):
    pieces = max(1, math.ceil(rate / pm.PIECE))
    total = 0
    for j in range(1, pieces + 1):
        u = int(hashlib.md5(f"{seed}|{key}|{j}".encode()).hexdigest()[:13], 16) / 2**52
        mean, k = rate / pieces, 0
        p = c = math.exp(-mean)
        while c <= u:
            k += 1
            p *= mean / k
            c += p
        total += k
    return total


def test_copies_equal_plain_draws(spark, odd_docs):
    weights = {"a": 3.0, "b": 0.5, "": 1.0}
    rate = {r["source"]: r["rate"] for r in pm.rates(odd_docs, weights, epochs=2.0).collect()}
    expected = Counter()
    for r in odd_docs.collect():
        key = r["doc_id"] if r["doc_id"] is not None else hashlib.md5(r["text"].encode()).hexdigest()
        for n in range(plain_count(9, key, rate[r["source"] or ""])):
            expected[r["doc_id"], r["text"], n + 1] += 1
    mixed = pm.mix(odd_docs, 9, weights, epochs=2.0)
    assert Counter((r["doc_id"], r["text"], r["copy_no"]) for r in mixed.collect()) == expected
    assert set(odd_docs.columns) <= set(mixed.columns)


def test_large_rates_are_drawn_in_pieces(spark):
    docs = spark.createDataFrame([(i, "s", "x" * 10) for i in range(40)], "doc_id long, source string, text string")
    counts = Counter(r["doc_id"] for r in pm.mix(docs, 1, {"s": 1.0}, epochs=1200.0).select("doc_id").collect())
    assert counts == {i: plain_count(1, i, 1200.0) for i in range(40)}
    assert abs(sum(counts.values()) / 40 - 1200) < 25


def test_the_mix_has_the_target_weights(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    weights = {"src0": 0.5, "src1": 0.3, "src2": 0.2}
    mixed = pm.mix(docs, 3, weights)
    chars = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(F.char_length("text")).alias("n")).collect()}
    assert set(chars) == set(weights)
    for s, w in weights.items():
        assert abs(chars[s] / sum(chars.values()) - w) < 0.12
    keys = [r[0] for r in mixed.select("shuffle_key").collect()]
    assert keys == sorted(keys)


def test_nothing_to_mix(spark, no_docs, odd_docs):
    assert pm.mix(no_docs).count() == 0
    assert pm.mix(odd_docs, weights={"none of them": 1.0}).count() == 0
    assert pm.mix(odd_docs.filter("doc_id in (2, 3)")).count() == 0  # sources without characters


def test_no_python_in_the_plan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = pm.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


@pytest.mark.parametrize("name", ["op9_poisson_mix"])
def test_query_equals_its_sql(spark, name):
    ok, note = compare(spark, connect(SF_DIR), name, SF_DIR)
    assert ok, note
